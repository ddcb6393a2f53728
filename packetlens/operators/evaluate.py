"""Predictions against truth: counters, sweeps, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import running


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def counters(predicted: Column, truth: Column) -> list[Column]:
    return [F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & ~truth).alias("tn"), F.count_if(~predicted & truth).alias("fn")]


def with_scores(rows: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rows = rows.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn)})
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def metrics(rows: DataFrame, predicted: Column, truth: Column, *groups: str) -> DataFrame:
    return with_scores(rows.groupBy(*groups).agg(*counters(predicted, truth)))


def sweep(rows: DataFrame, similarity: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Metrics of `similarity < t` for each t. Each row goes to a bin of the thresholds first, so the counts that meet the
    thresholds are few, whatever the number of rows."""
    limits = sorted(thresholds)
    place = F.aggregate(F.array(*(F.lit(float(t)) for t in limits)), F.lit(0), lambda s, t: s + (t <= F.col(similarity)).cast("int"))
    bins = rows.where(F.col(similarity).isNotNull()).groupBy(place.alias("bin")).agg(F.count_if(truth).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    # similarity < limits[i] where the bin is at most i
    grid = bins.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(limits) - 1))))
    hit = F.col("bin") <= F.col("i")
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    out = grid.groupBy("i").agg(total("pos", hit).alias("tp"), total("neg", hit).alias("fp"), total("neg", ~hit).alias("tn"), total("pos", ~hit).alias("fn"))
    return with_scores(out.withColumn("threshold", F.array(*(F.lit(float(t)) for t in limits))[F.col("i")]).drop("i"))


def best(swept: DataFrame, metric: str = "f1") -> DataFrame:
    """The threshold of the largest metric, the smallest of equals."""
    return swept.agg(F.max_by("threshold", F.struct(F.round(metric, 9), -F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def roc(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """(score, p, n, tpr, fpr) for each distinct score, highest first. Scores are counted before the running sums."""
    counts = rows.groupBy(score).agg(F.count_if(truth).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    sums = running(counts, None, [F.col(score).desc()], "__rank", {"__p": "p", "__n": "n"})
    every = dict(zip("pn", sums.agg(F.sum("p"), F.sum("n")).first(), strict=True))
    share = lambda c, of: ratio(F.col(of), F.lit(every[c]).cast("long"))
    return sums.select(score, "p", "n", share("p", "__p").alias("tpr"), share("n", "__n").alias("fpr"), share("p", "p").alias("__up"), share("n", "n").alias("__right"))


def auc(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """The area under the curve, by trapezoids: each score's step to the right times the mean of the heights before and after it."""
    curve = roc(rows, score, truth)
    return curve.agg(F.coalesce(F.sum(F.col("__right") * (F.col("tpr") - F.col("__up") / 2)), F.lit(0.0)).alias("auc"))


def failures(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, failure): predictions without truth and truth without prediction."""
    p, t = predicted.select(*keys).distinct(), truth.select(*keys).distinct()
    return p.join(t, keys, "left_anti").withColumn("failure", F.lit("false_positive")).union(t.join(p, keys, "left_anti").withColumn("failure", F.lit("false_negative")))


def stats(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


def word_accuracy(expected: Column, actual: Column) -> dict[str, Column]:
    """Shares of expected words that were read and of read words that were expected (of distinct words over all words)."""
    hits = F.size(F.array_intersect(F.array_distinct(expected), F.array_distinct(actual)))
    p, r = ratio(hits, F.size(actual)), ratio(hits, F.size(expected))
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}
