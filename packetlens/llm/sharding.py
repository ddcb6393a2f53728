"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, with u a hash of the row's key
and the child's name, and the smallest draw wins, so a child gets rows in proportion to its weight. A child's draw does
not depend on its siblings: changing a weight moves rows only into or out of the subtree whose weight changed, at the
level where it changed. `grow` opens a region of its own for a new shard, so that growth takes rows only into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

HASH_DIGITS = 13  # 52 bits: exact in a double


@dataclass(frozen=True)
class HashTree:
    """regions: of each, its racks; of each rack, (shard, weight). Weights are positive."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def even(cls, shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> HashTree:
        """Weight one for each of the shards 0.. in full racks and regions, but for the last."""
        racks = [tuple((s, 1.0) for s in range(a, min(a + shards_per_rack, shards))) for a in range(0, shards, shards_per_rack)]
        return cls(tuple(tuple(racks[a : a + racks_per_region]) for a in range(0, len(racks), racks_per_region)))

    def grow(self, shard: int, weight: float = 1.0) -> HashTree:
        return HashTree((*self.regions, (((shard, weight),),)))

    def _nested(self) -> list:
        """(name, weight, children or shard) of each region."""
        out = []
        for r, racks in enumerate(self.regions):
            inner = [(f"r{r}k{k}", sum(w for _, w in rack), [(f"s{s}", w, s) for s, w in rack]) for k, rack in enumerate(racks)]
            out.append((f"r{r}", sum(x[1] for x in inner), inner))
        return out

    def shard(self, key: Column) -> Column:
        """The shard of a row, as an int column; key is a string."""
        return _descend(key, self._nested())


def draw(key: Column, name: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{name}")).cast("binary")), 1, HASH_DIGITS)
    return -F.log((F.conv(digits, 16, 10).cast("long") + 1) / float(16**HASH_DIGITS)) / weight


def _descend(key: Column, children: list) -> Column:
    below = [_descend(key, x[2]) if isinstance(x[2], list) else F.lit(x[2]) for x in children]
    if len(children) == 1:
        return below[0]
    won = F.array_min(F.array(*(F.struct(draw(key, x[0], x[1]).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(children))))["i"]
    out = below[-1]
    for i in reversed(range(len(children) - 1)):
        out = F.when(won == i, below[i]).otherwise(out)
    return out


def place(docs: DataFrame, tree: HashTree, grown: HashTree | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    Law `key`: the id and the tree decide alone, so repeated ids go to one shard and a null id has a place like any
    other. size is UTF-8 bytes plus one (null text: one), text_crc32 that of the whole text (null: of an empty one).
    slot numbers a shard's rows from 0 by doc_id, nulls first; rows of one id stand in any order. One range shuffle
    deals the rows, by shard, id and a row number, so that one id with very many rows is cut too; slots come from the
    number of rows in each range. An empty table gives no rows; other columns are not read.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.select("*", tree.shard(key).alias("shard"), (grown.shard(key) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("shard", "doc_id", "tie").sortWithinPartitions("shard", "doc_id", "tie").drop("tie")
    rows = durable(rows.withColumn("at", F.monotonically_increasing_id()))
    # One row for each range and shard that meet: at most the number of partitions and of shards together.
    range_no = F.shiftright("at", 33).alias("range_no")
    runs = rows.groupBy("shard", range_no).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("shard", "range_no", (before - F.col("first")).alias("shift"))
    out = rows.withColumn("range_no", range_no).join(F.broadcast(runs), ["shard", "range_no"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")
