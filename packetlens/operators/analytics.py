"""Usage, latency and progress over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import ratio
from .ranking import in_chunks, with_rank


def latest(rows: DataFrame, n: int, order: list[Column], *keys: str) -> DataFrame:
    """The n rows of each key that come first in the order (planned as a group limit, which cuts in each task before the
    shuffle); without keys the n first of all."""
    if not keys:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def downloads(rows: DataFrame, done: Column, failed: Column, size: Column) -> DataFrame:
    n = F.count_if(done | failed)
    return rows.agg(n.alias("total"), F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"), (ratio(F.count_if(done), n) * 100).alias("success_rate"), F.coalesce(F.sum(F.when(done, size)), F.lit(0.0)).alias("total_size"), F.avg(F.when(done, size)).alias("average_size"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def popular(rows: DataFrame, name: str, n: int = 10) -> DataFrame:
    """The names with most rows; of equals, the one seen first."""
    return rows.groupBy(name).agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("seen")).orderBy(F.desc("n"), "seen").limit(n).select(name, "n")


def by_hour(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def endpoint_performance(rows: DataFrame, endpoint: str, seconds: str, failed: Column, last: int = 1000) -> DataFrame:
    """Over the last calls of each endpoint: p50 and p95 are the sorted values at n // 2 and int(.95 n), counted from zero."""
    recent = latest(rows, last, [F.desc("ts"), F.desc("event_id")], endpoint)
    values = F.array_sort(F.collect_list(seconds))
    out = recent.groupBy(endpoint).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), values.alias("v"), F.count_if(failed).alias("errors"))
    at = lambda i: F.element_at("v", (F.least(i, F.col("n") - 1) + 1).cast("int"))
    return out.select(endpoint, "n", "mean", "least", "most", at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 95 / 100)).alias("p95"), "errors", ratio(F.col("errors"), F.col("n")).alias("error_rate"))


def alerts(performance: DataFrame, least: int = 100, slow: float = 2.0, errors: float = 0.05) -> DataFrame:
    return performance.where((F.col("n") >= least) & ((F.col("p95") > slow) | (F.col("error_rate") > errors)))


def progress(rows: DataFrame, key: str, stage: str, value: str) -> DataFrame:
    """The latest value of each stage and their mean for each key."""
    last = rows.groupBy(key, stage).agg(F.max_by(value, F.struct("ts", "event_id")).alias("latest"))
    return last.groupBy(key).agg(F.count("*").alias("stages"), F.avg("latest").alias("overall"))


def remaining(started: Column, now: Column, share: Column) -> Column:
    """Seconds left at the speed so far; never below zero."""
    gone = F.unix_timestamp(now) - F.unix_timestamp(started)
    return F.when(share > 0, F.greatest(gone / F.when(share > 0, share).otherwise(1) - gone, F.lit(0.0)))


def search(rows: DataFrame, statuses: list[str] | None = None, since: str | None = None, until: str | None = None, least: int | None = None, most: int | None = None, page: int = 1, size: int = 20, count: str = "n_files", key: str = "id", at: str = "created_at") -> DataFrame:
    """A page of results, newest first, with the total of the matches. None, zero and empty filters filter nothing."""
    conditions = [
        F.col("status").isin(*statuses) if statuses else None, F.col(at) >= F.lit(since).cast("timestamp_ntz") if since else None, F.col(at) <= F.lit(until).cast("timestamp_ntz") if until else None,
        F.col(count) >= least if least else None, F.col(count) <= most if most else None,
    ]
    for c in conditions:
        rows = rows if c is None else rows.where(c)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc(at), key).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def rates(rows: DataFrame, width: str = "5 minutes", step: str = "5 minutes") -> DataFrame:
    """Events a second in windows."""
    seconds = F.unix_timestamp(F.col("w.end").cast("timestamp")) - F.unix_timestamp(F.col("w.start").cast("timestamp"))
    return rows.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n", (F.col("n") / seconds).alias("rate"))


def histogram_quantile(rows: DataFrame, value: str, bounds: list[float], q: float, *keys: str) -> DataFrame:
    """The quantile by linear interpolation within a histogram's bucket; beyond the last bound, that bound."""
    edges = [0.0, *bounds]
    n_at = [F.count_if(F.col(value) <= b).alias(f"le{i}") for i, b in enumerate(bounds)]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *n_at)
    rank, found = F.col("n") * q, F.lit(bounds[-1])
    for i in reversed(range(len(bounds))):
        below = F.col(f"le{i - 1}") if i else F.lit(0)
        inside = F.when(F.col(f"le{i}") > below, F.col(f"le{i}") - below).otherwise(1)
        found = F.when(F.col(f"le{i}") >= rank, edges[i] + (edges[i + 1] - edges[i]) * (rank - below) / inside).otherwise(found)
    return out.select(*keys, "n", found.alias("quantile"))


def connections(rows: DataFrame, key: str = "session_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("connections"), F.min("ts").alias("oldest"))


def admitted(rows: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Whether a connection comes within a session's limit, in order of arrival."""
    return rows.withColumn("admitted", F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id")) <= most)


def health(rows: DataFrame) -> DataFrame:
    share = lambda s: F.round(ratio(F.count_if(F.col("status") == s), F.count("*")) * 100, 2)
    rank = F.create_map(*(x for i, s in enumerate(("healthy", "warning", "failed")) for x in (F.lit(s), F.lit(i))))
    return rows.agg(*(share(s).alias(f"{s}_percent") for s in ("healthy", "warning", "failed")), F.max_by("status", rank[F.col("status")]).alias("worst"))


def route_group(path: Column) -> Column:
    has = lambda x: F.contains(path, F.lit(x))
    return F.when(has("/auth") | has("/login"), "auth").when(has("/upload"), "upload").when(has("/download"), "download").otherwise("default")


def speed(seconds: Column) -> Column:
    return F.when(seconds > 5, "very_slow").when(seconds > 1, "slow").otherwise("normal")


def load_factor(rows: DataFrame, seconds: str, key: str = "event_type", last: int = 1000, least: int = 100, chunk: int = 100_000) -> DataFrame:
    """Mean of the key's last 1000 durations at each event, from 100 on. A key's events are cut into chunks by rank, each with the
    999 before it, so that no key is one task."""
    ranked = with_rank(rows, ["ts", "event_id"], key, name="__rank")
    w = Window.partitionBy(key, "chunk").orderBy("__rank").rowsBetween(1 - last, 0)
    out = in_chunks(ranked, chunk, last - 1, "__rank").withColumn("recent_mean", F.when(F.count("*").over(w) >= least, F.avg(seconds).over(w)))
    return out.where("not context").drop("chunk", "context", "__rank")
