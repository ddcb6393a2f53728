"""Streaming twins of the event operators: windows with watermarks, and keyed state that timers clear.

All results are final rows: a window, a decision or a lost connection is emitted once, when the watermark has passed it, and its state
goes with it. What is open when the input ends is closed by marker rows far ahead of all times (`drained`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetlens.runtime import shared_dir

#: Where timers and their state are kept.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times after all others: the first closes what is open, the second ends what waits for a timer that the first has set.
ENDS = ("2999-01-01 00:00:00", "2999-12-31 00:00:00")
SPAN = 3_600_000
#: Groups of keys whose state is kept together; spans of time whose rows wait together; rows of a group that a task holds at a time, beside
#: those of one cell.
GROUPS, CELL, MOST_ROWS = 512, 24, 1 << 18


def stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events below a folder, or in the parts of one table, as a file stream; ts is a timestamp."""
    found = f"{path}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(found).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{found}*").withColumn("ts", F.col("ts").cast("timestamp"))


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Rows with a watermark, without the marker at the end, which moves it as well: a condition on another column would be tested before."""
    return rows.withWatermark("ts", late).where(F.col("ts") < F.lit(ENDS[0]).cast("timestamp"))


def rates(rows: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, once the watermark has passed the window."""
    return _timed(rows, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(rows: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of a key that end after the gap: counters whose expiry every hit renews."""
    return _timed(rows, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "total")


class InOrder(StatefulProcessor):
    """Rows (key, micros, event_id) of a group of keys in order of time, whatever the order in which they come: they are handed to `take` once the
    watermark has passed their span of time, in milliseconds, and wait in cells of CELL spans. State is read and written once for a cell of a
    group, not for each key or row, and a group has one timer; null keys are a group of their own."""

    def __init__(self, span: int = SPAN, most: int = MOST_ROWS):
        self.span, self.most = span, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long", "rows binary")
        self.own = handle.getValueState("own", "state binary")

    def _wait(self, found: list[np.ndarray]) -> None:
        rows = np.concatenate(found)
        at = rows[:, 1] // (self.span * 1000 * CELL)
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        cuts = [*np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist(), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            cell = int(at[a])
            before = self.waiting.getValue((cell,))
            self.waiting.updateValue((cell,), ((bytes(before[0]) if before is not None else b"") + rows[a:b].tobytes(),))
        self.handle.registerTimer((int(rows[:, 1].min()) // (self.span * 1000) + 1) * self.span)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found: list[np.ndarray] = []
        for pdf in rows:
            found.append(pdf[["key", "micros", "event_id"]].to_numpy(np.int64))
            if sum(map(len, found)) >= self.most:
                self._wait(found)
                found = []
        if any(map(len, found)):
            self._wait(found)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        over = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // self.span
        cells = sorted(k[0] for k in self.waiting.keys())  # noqa: SIM118 not a dict
        ready = [c for c in cells if c * CELL < over]
        self.load(bytes(self.own.get()[0]) if self.own.exists() else b"")
        held: list[np.ndarray] = []
        for cell in ready:
            rows = np.frombuffer(bytes(self.waiting.getValue((cell,))[0]), np.int64).reshape(-1, 3)
            passed = rows[:, 1] < over * self.span * 1000
            held.append(rows[passed])
            if passed.all():
                self.waiting.removeKey((cell,))
                cells.remove(cell)
            elif passed.any():
                self.waiting.updateValue((cell,), (rows[~passed].tobytes(),))
            if (cell == ready[-1] or sum(map(len, held)) >= self.most) and any(map(len, held)):
                rows = np.concatenate(held)
                held = []
                yield self.take(key[0] < 0, rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))])
        left, after = self.left(over * self.span / 1000)
        if left:
            self.own.update((left,))
            self.handle.registerTimer(max(over + 1, int(after * 1000) // self.span + 1) * self.span)
        else:
            self.own.clear()
        if cells:
            self.handle.registerTimer((max(over, cells[0] * CELL) + 1) * self.span)

    def load(self, state: bytes) -> None:
        raise NotImplementedError

    def take(self, null: bool, rows: np.ndarray) -> pd.DataFrame:
        """The answers to rows sorted by key, micros and event_id, none of them before those of an earlier call; null: their key is null."""
        raise NotImplementedError

    def left(self, now: float) -> tuple[bytes, float]:
        """The state that rows from `now` on, in seconds, need, and when the first part of it goes."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Bucket(InOrder):
    """A token bucket for each key; one that is full again is as good as new, so its state goes after that time."""

    def __init__(self, key: str, capacity: float, rate: float, span: int = SPAN, most: int = MOST_ROWS):
        super().__init__(span, most)
        self.key, self.capacity, self.rate = key, capacity, rate

    def load(self, state: bytes) -> None:
        known = np.frombuffer(state, [("key", np.int64), ("tokens", np.float64), ("last", np.float64)])
        self.buckets = dict(zip(known["key"].tolist(), zip(known["tokens"].tolist(), known["last"].tolist(), strict=True), strict=True))

    def take(self, null: bool, rows: np.ndarray) -> pd.DataFrame:
        capacity, rate, out = self.capacity, self.rate, np.empty(len(rows), bool)
        begins = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])).tolist()
        times = rows[:, 1] / 1e6
        for a, b in zip(begins, [*begins[1:], len(rows)], strict=True):
            k = int(rows[a, 0])
            tokens, last = self.buckets.get(k, (capacity, None))
            for i, t in enumerate(times[a:b].tolist(), a):
                if last is not None:
                    tokens = min(capacity, tokens + (t - last) * rate)
                last = t
                out[i] = tokens >= 1
                tokens -= tokens >= 1
            self.buckets[k] = tokens, last
        keys = pd.array(rows[:, 0], "Int64")
        if null:
            keys[:] = pd.NA
        return pd.DataFrame({self.key: keys, "event_id": rows[:, 2], "allowed": out})

    def left(self, now: float) -> tuple[bytes, float]:
        # A second more than it takes to be full, so that rounding leaves it full.
        full = {k: last + (self.capacity - tokens) / self.rate + 1 for k, (tokens, last) in self.buckets.items()}
        kept = [(k, *self.buckets[k]) for k, at in full.items() if at > now]
        return np.array(kept, [("key", np.int64), ("tokens", np.float64), ("last", np.float64)]).tobytes(), min((at for at in full.values() if at > now), default=0.0)


def bucket_decisions(rows: DataFrame, key: str = "user_id", capacity: float = 3.0, rate: float = 1 / 86400, late: str = "10 minutes", span: int = SPAN, groups: int = GROUPS) -> DataFrame:
    """(key, event_id, allowed) by a token bucket for each key, in order of time and event_id. Rows later than the watermark are dropped. Keys are
    dealt to `groups`, which have their state together."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    group = F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    timed = _timed(rows, late).select(group.alias("group"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), "event_id", "ts", F.unix_micros("ts").alias("micros"))
    return timed.groupBy("group").transformWithStateInPandas(Bucket(key, capacity, rate, span), f"{key} long, event_id long, allowed boolean", "Append", "EventTime")


def lost_connections(rows: DataFrame, key: str = "user_id", seconds: float = 90.0, late: str = "10 minutes") -> DataFrame:
    """(key, last_micros, beats) for each time that a key was silent for more than `seconds` after a heartbeat: the last heartbeat and how many there
    were since the time before. A silence is the end of a session, so Spark's session windows keep the state, a row for each open one."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    session = F.session_window("ts", f"{round(seconds * 1_000_000)} microseconds").alias("w")
    found = _timed(rows, late).groupBy(session, key).agg(F.max("ts").alias("last"), F.count("*").alias("beats"))
    return found.select(F.col(key).cast("long").alias(key), F.unix_micros("last").alias("last_micros"), "beats")


def upsert_into(path: str, key: str, at: str):
    """A foreachBatch function that keeps the latest row of each key under a folder; a batch that repeats changes nothing."""
    from packetlens.operators.sessions import upserted

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = f"{path}/{number}"
        try:
            old = spark.read.parquet(f"{path}/{number - 1}") if number else batch.limit(0)
        except Exception as error:  # noqa: BLE001 an earlier state that is gone can't be made up for
            raise RuntimeError(f"the state before batch {number} is missing") from error
        upserted(old, batch, key, at).write.mode("overwrite").parquet(now)

    return write


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(make: Callable[[DataFrame], DataFrame], rows: DataFrame, progress: list | None = None) -> DataFrame:
    """Run `make` over the stream `rows` as far as it goes, then over marker rows that close what is open, and read the rows it gave. Each batch
    writes a folder of its own, so one that is repeated changes nothing. progress: gets what the batches tell."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    marker = spark.range(1).select(*(F.lit(ENDS[0] if c == "ts" else None).cast(kind).alias(c) for c, kind in rows.dtypes))
    marker.limit(0).write.parquet(f"{folder}-end")
    ends = spark.readStream.schema(marker.schema).parquet(f"{folder}-end")
    out = make(rows.unionByName(ends))
    done: set[int] = set()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        done.add(number)

    for end in (None, *ENDS):
        if end:
            marker.withColumn("ts", F.lit(end).cast("timestamp")).write.mode("append").parquet(f"{folder}-end")
        query = out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            if progress is not None:
                progress += query.recentProgress
        finally:
            query.stop()
    if not done:
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(*(f"{folder}/batch={n}" for n in sorted(done)))
