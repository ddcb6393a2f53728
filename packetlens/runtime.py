"""What operators with several steps share: durable intermediate results, and workers that give memory back."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a new local one if all runs in one process; else that
    is an error."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="packetlens-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, so that a lost executor costs no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Shuffle files of a write go when it ends; else they stay until the driver happens to collect garbage, which in a driver with little to do may be never.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind. The session's setting is as before afterwards."""
    before = spark.conf.get(CLEANUP_SETTING, "false")
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_SETTING, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, as `durable` has them, but in compressed columns and without the shuffle files of the steps before. They come
    back in any order and number of partitions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    with shuffles_cleared(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task of a large shuffle sorts. Adaptive execution joins small partitions by their compressed bytes, so tasks would grow with the input first.
TASK_ROWS = 250_000


def parts_of(spark: SparkSession, rows: int) -> int:
    """Partitions for that many rows, at least one for each core: what a task sorts does not grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


#: Bytes of rows that a Python worker gets at a time. By Spark's default of 64 MB a core holds over 100 MB outside the heap, as columns of texts double while they are filled.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """The rows as they are. Sets the session's limit of an Arrow batch to BATCH_BYTES where the session has none of its own, for this and later
    queries; results do not depend on it, and a longer row is alone."""
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, which then gives freed memory back to the system: a worker lives on after its task, beside others."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return outer
