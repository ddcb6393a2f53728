"""Rate limits over an event table: sliding log, fixed window, token bucket, slots, and how long requests wait for them.

What depends on earlier decisions is a fold in order of time. Keys are folded apart; the log of one key must fit a task,
as each decision needs the one before. Where all requests count, the sliding count is a range window instead; where all are
granted in the end, by a bucket, waits come from a running maximum, and concurrency is a running sum: both are cut by ranges of time.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import running

SECOND = 1_000_000


def sliding_count(rows: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """Requests of the key in the seconds up to each one, itself included."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("n_recent", F.count("*").over(w))


class SlidingLog:
    """Allowed while fewer than `limit` allowed requests lie within the seconds before; inclusive: one that is exactly as old
    has left."""

    def __init__(self, limit: int, seconds: float, inclusive: bool = False):
        self.limit, self.seconds, self.inclusive, self.log = limit, seconds, inclusive, deque()

    def allow(self, t: float) -> bool:
        cut = t - self.seconds
        while self.log and (self.log[0] <= cut if self.inclusive else self.log[0] < cut):
            self.log.popleft()
        if len(self.log) >= self.limit:
            return False
        self.log.append(t)
        return True

    def wait(self, t: float) -> float:
        """After a refusal at t: the seconds until the oldest request leaves."""
        return max(0.0, self.log[0] + self.seconds - t) if len(self.log) >= self.limit else 0.0


class FixedWindow:
    """A window opens with the first request and closes after the seconds."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds, self.start, self.n = limit, seconds, None, 0

    def allow(self, t: float) -> bool:
        if self.start is None or t - self.start >= self.seconds:
            self.start, self.n = t, 0
        if self.n >= self.limit:
            return False
        self.n += 1
        return True


class TokenBucket:
    def __init__(self, capacity: float, rate: float):
        self.capacity, self.rate, self.tokens, self.last = capacity, rate, capacity, None

    def allow(self, t: float) -> bool:
        if self.last is not None:
            self.tokens = min(self.capacity, self.tokens + (t - self.last) * self.rate)
        self.last = t
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


def _by_key(rows: DataFrame, key: str, *more: str) -> DataFrame:
    ordered = rows.select(F.col(key).cast("string").alias("k"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), *more)
    return ordered.repartition("k").sortWithinPartitions("k", "micros", "event_id")


def decided(rows: DataFrame, key: str, make: Callable[[], SlidingLog | FixedWindow | TokenBucket]) -> DataFrame:
    """(key, event_id, ts, allowed). Rows stream through in order of key and time; only a limiter's own state is held."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, limiter = None, make()
        for pdf in parts:
            out = []
            for k, t in zip(pdf["k"], pdf["micros"], strict=True):
                if k != last:
                    last, limiter = k, make()
                out.append(limiter.allow(t / 1e6))
            pdf["allowed"] = out
            yield pdf

    out = _by_key(rows, key).mapInPandas(run, "k string, event_id long, micros long, allowed boolean")
    return out.select(F.col("k").alias(key), "event_id", "allowed")


def refused_waits(rows: DataFrame, key: str, limit: int, seconds: float) -> DataFrame:
    """(key, event_id, allowed, wait): a sliding log whose requests leave once they are `seconds` old, and the seconds until a refused
    request could be made."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, limiter = None, SlidingLog(limit, seconds, inclusive=True)
        for pdf in parts:
            out = []
            for k, t in zip(pdf["k"], pdf["micros"] / 1e6, strict=True):
                if k != last:
                    last, limiter = k, SlidingLog(limit, seconds, inclusive=True)
                out.append((True, 0.0) if limiter.allow(t) else (False, limiter.wait(t)))
            pdf[["allowed", "wait"]] = out
            yield pdf

    out = _by_key(rows, key).mapInPandas(run, "k string, event_id long, micros long, allowed boolean, wait double")
    return out.select(F.col("k").alias(key), "event_id", "allowed", "wait")


def bucket_waits(rows: DataFrame, key: str, capacity: float, rate: float, tokens: Column | None = None, event: str = "event_id") -> DataFrame:
    """The rows with the seconds that each request waits for its tokens (one, or `tokens`) at a bucket of its key that starts full: requests
    are served in order of ts and event, and all that come wait. A request of more than the capacity would wait for ever; it has no
    wait and takes nothing.

    The tokens of all earlier requests are earned back at the latest of all earlier times plus what was taken since; less what was
    taken since the key's start that is a running maximum."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    need = F.lit(1.0) if tokens is None else tokens.cast("double")
    rows = rows.withColumns({"__t": t, "__need": need}).withColumn("__taken", F.when(F.col("__need") <= capacity, F.round(F.col("__need") * SECOND)).otherwise(0).cast("long"))
    rows = running(rows, key, ["__t", event], "__n", {"__sum": "__taken"}).drop("__n")
    before = (F.col("__sum") - F.col("__taken")) / rate
    rows = running(rows.withColumn("__free", F.col("__t") - before), key, ["__t", event], "__n", maxima={"__most": "__free"})
    earned = F.col("__most") + (F.col("__sum") - F.col("__taken")) / rate
    wait = F.greatest(F.lit(0.0), earned - (capacity - F.col("__need")) * SECOND / rate - F.col("__t")) / SECOND
    return rows.withColumn("wait", F.when(F.col("__need") <= capacity, wait)).drop("__t", "__need", "__taken", "__sum", "__n", "__free", "__most")


def concurrency(rows: DataFrame, key: str, seconds: Column, event: str = "event_id") -> DataFrame:
    """The rows with n_active: how many requests of the key run when it starts, itself included. A request runs from ts for `seconds`; one that
    ends when another starts has left, and one that takes no time, or null, counts for itself alone. Starts and ends are sorted together, and
    each adds or takes one."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.withColumns({"__start": t, "__end": t + F.round(seconds * SECOND).cast("long")})
    moment = lambda at, n, ends: F.struct(F.col(at).alias("at"), F.lit(n).cast("long").alias("change"), F.lit(ends).alias("ends"))
    moments = F.when(F.col("__end") > F.col("__start"), F.array(moment("__start", 1, False), moment("__end", -1, True))).otherwise(F.array(moment("__start", 0, False)))
    both = rows.withColumn("__m", F.explode(moments)).select(*rows.columns, "__m.*")
    both = running(both, key, ["at", F.col("ends").desc(), event], "__n", {"n_active": "change"})
    return both.where("not ends").withColumn("n_active", F.col("n_active") + 1 - F.col("change")).drop("at", "change", "ends", "__n", "__start", "__end")


def slot_waits(rows: DataFrame, key: str, slots: int, seconds: Column) -> DataFrame:
    """(key, event_id, wait): the seconds until one of the key's slots is free, taken in order of ts and event_id. What is held is the time at
    which each slot is free."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, free = None, []
        for pdf in parts:
            out = []
            for k, t, took in zip(pdf["k"], pdf["micros"], pdf["took"], strict=True):
                if k != last:
                    last, free = k, []
                start = t if len(free) < slots else max(t, heapq.heappop(free))
                heapq.heappush(free, start + took)
                out.append((start - t) / SECOND)
            pdf["wait"] = out
            yield pdf

    out = _by_key(rows.withColumn("took", F.round(seconds * SECOND).cast("long")), key, "took").mapInPandas(run, "k string, event_id long, micros long, took long, wait double")
    return out.select(F.col("k").alias(key), "event_id", "wait")
