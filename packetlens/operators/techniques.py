"""Techniques that compare neighbouring pages, by name, and a grid of runs over them.

A technique gives each pair of pages one number, and a pair is a boundary if that is below its threshold, or above it for distances. A
grid scores all techniques in one scan, counts the pairs by technique and step of its thresholds, and has every run's metrics from
the cumulative counts: a run more costs no pass more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.functions import vector as V

from .evaluate import with_scores


@dataclass(frozen=True)
class Technique:
    """score: of two columns of equally long arrays of numbers. above: a boundary is what is over the threshold, not under it. threshold: of a
    run that names none."""

    score: Callable[[Column, Column], Column]
    threshold: float
    above: bool = False

    def boundary(self, score: Column, threshold: float | None = None) -> Column:
        limit = F.lit(float(self.threshold if threshold is None else threshold))
        return (score > limit) if self.above else (score < limit)


REGISTRY: dict[str, Technique] = {}


def technique(name: str, threshold: float, above: bool = False, *aliases: str) -> Callable:
    """Registers a score under a name, and others."""

    def add(score: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        for n in (name, *aliases):
            REGISTRY[n] = Technique(score, threshold, above)
        return score

    return add


def of(name: str) -> Technique:
    if name.lower() not in REGISTRY:
        raise ValueError(f"unknown technique: {name}")
    return REGISTRY[name.lower()]


BINS, SPAN = 16, (-1.0, 1.0)


def histogram(values: Column) -> Column:
    """How many values fall in each of BINS steps of SPAN; what is beyond counts at the ends."""
    width = (SPAN[1] - SPAN[0]) / BINS
    bins = F.transform(values, lambda x: F.least(F.greatest(F.floor((x.cast("double") - SPAN[0]) / width), F.lit(0)), F.lit(BINS - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.size(F.filter(bins, lambda x: x == b)))


@technique("histogram", 0.8)
def histogram_overlap(a: Column, b: Column) -> Column:
    """The share of values that both histograms have."""
    both = F.aggregate(F.zip_with(histogram(a), histogram(b), lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return both / F.greatest(F.size(a), F.lit(1))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(x)


@technique("ssim", 0.7)
def structure(a: Column, b: Column) -> Column:
    """Structural similarity of the whole, with the usual constants for a range of two."""
    c1, c2 = (0.01 * 2) ** 2, (0.03 * 2) ** 2
    ma, mb = _mean(a), _mean(b)
    va, vb, vab = V.dot(a, a) / F.size(a) - ma * ma, V.dot(b, b) / F.size(b) - mb * mb, V.dot(a, b) / F.size(a) - ma * mb
    return (2 * ma * mb + c1) * (2 * vab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


@technique("phash", 10, True, "perceptual_hash")
def sign_distance(a: Column, b: Column) -> Column:
    """In how many places one is over zero and the other is not."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) != (y > 0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


@technique("embeddings", 0.5)
def cosine(a: Column, b: Column) -> Column:
    return V.cosine(a, b)


@technique("combined", 0.6, False, "combined_hash")
def combined(a: Column, b: Column) -> Column:
    """Half the sign hash's likeness, a quarter the histogram's and a quarter the cosine; equal weights of a pair without direction."""
    sign, rest = 1 - sign_distance(a, b) / F.greatest(F.size(a), F.lit(1)), histogram_overlap(a, b)
    return 0.5 * sign + 0.25 * rest + 0.25 * F.nanvl(cosine(a, b), rest)


def scored(pairs: DataFrame, a: str, b: str, names: Sequence[str]) -> DataFrame:
    """The pairs with a column of scores for each technique."""
    return pairs.withColumns({n: of(n).score(F.col(a), F.col(b)) for n in names})


def grid(rows: DataFrame, truth: str, runs: dict[str, Sequence[float] | None]) -> DataFrame:
    """(technique, threshold, tp, fp, tn, fn, precision, recall, accuracy, f1) for each technique, a column of scores, and each of its
    thresholds; None is its own. Pairs without a score, not even NaN, and without truth are left out; NaN is no boundary."""
    limits = {n: sorted(set(map(float, t if t is not None else [of(n).threshold]))) for n, t in runs.items()}
    rows = rows.where(F.col(truth).isNotNull())
    cells = []
    for i, (n, own) in enumerate(limits.items()):
        score, t = F.col(n), of(n)
        # The step is the number of thresholds at which the pair is no boundary, in the order in which it becomes one.
        order = own[::-1] if t.above else own
        step = sum(((~F.coalesce(t.boundary(score, x), F.lit(False)) | F.isnan(score)).cast("int") for x in order), F.lit(0))
        cells.append(F.when(score.isNotNull(), F.struct(F.lit(i).alias("i"), step.alias("step"))))
    counted = rows.select(truth, F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.i", "c.step").agg(F.count_if(truth).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    every = rows.sparkSession.createDataFrame([(i, k, n, (own[::-1] if of(n).above else own)[k] if k < len(own) else None) for i, (n, own) in enumerate(limits.items()) for k in range(len(own) + 1)], "i int, step int, technique string, threshold double")
    found = every.join(counted, ["i", "step"], "left").na.fill(0, ["p", "n"])
    # One row for each run and one more for each technique, so windows are small.
    upto, whole = Window.partitionBy("i").orderBy("step"), Window.partitionBy("i")
    sums = {f"{k}_{c}": F.sum(c).over(w) for k, w in (("hit", upto), ("all", whole)) for c in "pn"}
    found = found.withColumns(sums).where("threshold is not null")
    return with_scores(found.select("technique", "threshold", F.col("hit_p").alias("tp"), F.col("hit_n").alias("fp"), (F.col("all_n") - F.col("hit_n")).alias("tn"), (F.col("all_p") - F.col("hit_p")).alias("fn")))


def ranking(runs: DataFrame) -> DataFrame:
    """The best run of each technique, by F1, the smallest threshold of equals, with its place among them, and the number of its runs."""
    best = runs.groupBy("technique").agg(F.max_by(F.struct("threshold", "precision", "recall", "accuracy", "f1"), F.struct(F.round("f1", 9), -F.col("threshold"))).alias("b"), F.count("*").alias("runs"))
    return best.select("technique", "runs", "b.*").withColumn("place", F.row_number().over(Window.orderBy(F.round("f1", 9).desc(), "technique")))
