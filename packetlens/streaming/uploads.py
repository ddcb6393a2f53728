"""Uploads that come in chunks, in any order and more than once: a file is handed on once all its chunks are there."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import STORE, _timed

CHUNK = "file_id long, chunk_number int, total_chunks int, data binary, ts timestamp"
FILE = "file_id long, status string, n_chunks int, n_bytes long, content binary"


def chunks(files: DataFrame, file_id: str, content: Column, at: Column, size: int = 1 << 20) -> DataFrame:
    """CHUNK rows of (file_id, content) rows, `size` bytes each, numbered from zero; an empty file is one empty chunk."""
    rows = files.select(F.col(file_id).cast("long").alias("file_id"), content.cast("binary").alias("content"), at.cast("timestamp").alias("ts"))
    total = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    rows = rows.withColumn("total_chunks", total).withColumn("chunk_number", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    data = F.substring("content", F.col("chunk_number") * size + 1, F.lit(size))
    return rows.select("file_id", "chunk_number", "total_chunks", data.alias("data"), "ts")


class Assembling(StatefulProcessor):
    """The chunks of one file until it is complete. A complete file is remembered, without its chunks, until an upload of its age would be given
    up, so that a chunk that is sent again does nothing; then all state goes."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "chunk int", "data binary")
        self.head = handle.getValueState("head", "total int, received int, n_bytes long, done boolean")

    def _row(self, key: tuple, status: str, n: int, size: int, content: bytes | None) -> pd.DataFrame:
        out = pd.DataFrame({"file_id": [key[0]], "status": [status], "n_chunks": [n], "n_bytes": [size], "content": [content]})
        return out.astype({"n_chunks": "int32"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.head.exists()
        total, received, size, done = self.head.get() if known else (0, 0, 0, False)
        latest = 0
        for pdf in rows:
            latest = max(latest, int(pdf["ms"].max()))
            for number, of, data in zip(pdf["chunk_number"].tolist(), pdf["total_chunks"].tolist(), pdf["data"], strict=True):
                total = max(total, of)
                if done or not 0 <= number < of or self.parts.containsKey((number,)):
                    continue
                self.parts.updateValue((number,), (bytes(data),))
                received, size = received + 1, size + len(data)
        if not known:
            self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.wait)
        if not done and received == total:
            content = b"".join(bytes(self.parts.getValue((i,))[0]) for i in range(total))
            self.parts.clear()
            done = True
            yield self._row(key, "complete", total, size, content)
        self.head.update((total, received, size, done))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.head.exists():
            _, received, size, done = self.head.get()
            self.parts.clear()
            self.head.clear()
            if not done:
                yield self._row(key, "expired", received, size, None)

    def close(self) -> None:
        pass


def assembled(rows: DataFrame, seconds: float = 86400.0, late: str = "10 minutes") -> DataFrame:
    """FILE rows of CHUNK rows, a stream: `complete` with the content, or `expired`, without it and with what had come, if the file is not
    complete `seconds` after the first time that chunks of it came. Chunks may come in any order; a repeated one counts once, and numbers outside the file
    are left out. A task holds one file when it puts it together."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = _timed(rows, late).select("file_id", "chunk_number", "total_chunks", "data", "ts", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("file_id").transformWithStateInPandas(Assembling(seconds), FILE, "Append", "EventTime")
