"""What the operators of this subpackage share: durable intermediate results, and Arrow batches cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.runtime import BATCH_BYTES, durable, releasing, shared_dir, small_batches

__all__ = ["BATCH_BYTES", "as_bytes", "durable", "free_name", "held_out", "map_batches", "pieces", "record_batch", "releasing", "shared_dir", "small_batches"]

#: Text that is held as Python words at a time, in bytes.
PIECE_BYTES = 1 << 20


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, whatever the case of its letters."""
    used = {c.lower() for c in df.columns}
    while stem.lower() in used:
        stem += "_"
    return stem


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow; `make` runs once a task and returns what turns a batch into batches."""

    def run(batches):
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return small_batches(df).mapInArrow(releasing(run), schema)


def as_bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()) if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)) else column


def pieces(batch: pa.RecordBatch, name: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row ranges of the batch with about `limit` bytes of text (a longer text is alone), and the texts; null is empty."""
    column = as_bytes(batch.column(batch.schema.get_field_index(name)))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at), [x or b"" for x in column.slice(at, stop - at).to_pylist()]
        at = stop


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
