"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64 bits from the 3-word shingles of the whole text. Distinct fingerprints that differ in at most three
bits agree on one of four 16-bit blocks, so each distinct fingerprint goes to four buckets (block, value). A task
rotates the shared block to the front, sorts by Gray rank and folds neighbours, eight at a time, into nodes that hold
the bits all their members share. Node pairs are walked from the top: a child pair adds the differences on the bits
that its nodes share beyond their parents', and the whole pair of groups is dropped beyond three, or on any difference
in the front block. Each task hands on only a spanning forest of the links it found, which keeps every component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, pieces, record_batch, releasing
from .components import connected_components

SEED = 42
BLOCKS, BLOCK_BITS, MAX_DIFF = 4, 16, 3
FAN = 8
#: Distinct fingerprints of a bucket that one task indexes; a larger bucket is dealt out in pairs of parts of this size.
BUCKET_ROWS = 1 << 17
#: Fingerprints in memory at a time (but a bucket is never cut here).
RUN_ROWS = 1 << 18
#: Node pairs that are expanded at a time.
FRONT = 1 << 14
LANES = np.uint64(0x0101010101010101)
FRONT_MASK = np.uint64(0xFFFF << 48)


def shingles(text: bytes, width: int = 3) -> list[bytes]:
    """Space-joined runs of `width` words, repeats included; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """A uint64 for each text: a bit is 1 if it is set in over half of the shingles' XXH64; zero without words."""
    out = np.zeros(len(texts), np.uint64)
    found = [shingles(t, width) for t in texts]
    rows = [i for i, s in enumerate(found) if s]
    if not rows:
        return out
    counts = np.array([len(found[i]) for i in rows])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, (s for i in rows for s in found[i]), repeat(SEED)), np.uint64, counts.sum())
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for j in range(8):
        lanes = (hashes >> np.uint64(j) & LANES).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes, starts, axis=0, dtype=np.int64)
        for byte in range(8):
            out[rows] |= (2 * ones[:, byte] > counts).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, texts in pieces(batch, "text"):
                yield record_batch(doc_id=part.column(0), fp=fingerprints(texts, width).view(np.int64))

        return each

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; level 0 are the fingerprints. Each node has `shared`, the bits on
    which all members agree, and `bits`, their values there."""

    def __init__(self, values: np.ndarray, fan: int = FAN):
        self.order = np.argsort(gray_rank(values), kind="stable")
        ones = anded = values[self.order]
        self.fan, self.levels = fan, [(ones, np.full(len(ones), ~np.uint64(0)))]
        while len(ones) > 1:
            at = np.arange(0, len(ones), fan)
            ones, anded = np.bitwise_or.reduceat(ones, at), np.bitwise_and.reduceat(anded, at)
            self.levels.append((anded, ~(ones ^ anded)))

    def links(self, max_diff: int = MAX_DIFF, front: np.uint64 = FRONT_MASK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j) in the input, i before j in Gray order, of all pairs that agree on `front` and differ in at
        most max_diff bits; in bounded portions."""
        top = len(self.levels) - 1
        zero = np.zeros(1, np.int64)
        todo = [(top, zero, zero, np.zeros(1, np.uint64), zero)]
        while todo:
            level, a, b, known, diff = todo.pop()
            if len(a) > FRONT:
                for s in range(0, len(a), FRONT):
                    todo.append((level, a[s : s + FRONT], b[s : s + FRONT], known[s : s + FRONT], diff[s : s + FRONT]))
                continue
            if level == 0:
                if len(a):
                    yield self.order[a], self.order[b]
                continue
            bits, shared = self.levels[level - 1]
            step = np.arange(self.fan)
            x = np.repeat(a[:, None] * self.fan + step, self.fan, axis=1).ravel()
            y = np.tile(b[:, None] * self.fan + step, (1, self.fan)).ravel()
            parent = np.repeat(np.arange(len(a)), self.fan * self.fan)
            ok = (x < len(bits)) & (y < len(bits)) & ((x < y) if level == 1 else (x <= y))
            x, y, parent = x[ok], y[ok], parent[ok]
            common = shared[x] & shared[y]
            new = (bits[x] ^ bits[y]) & common & ~known[parent]
            more = diff[parent] + np.bitwise_count(new)
            ok = (more <= max_diff) & (new & front == 0)
            todo.append((level - 1, x[ok], y[ok], common[ok], more[ok]))


def forest(values: np.ndarray, nodes: np.ndarray, max_diff: int = MAX_DIFF, front: np.uint64 = FRONT_MASK) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its group) of the components of the links among the values."""
    root = np.arange(len(values))
    if len(values) > 1:
        for i, j in GrayIndex(values).links(max_diff, front):
            while len(i):
                i, j = root[i], root[j]
                apart = i != j
                i, j = np.minimum(i, j)[apart], np.maximum(i, j)[apart]
                if not len(i):
                    break
                root[j] = i
                while (root[root] != root).any():
                    root = root[root]
    least = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(least, root, nodes)
    to = least[root]
    moved = to != nodes
    return nodes[moved], to[moved]


def _bucket_forests(probes: DataFrame) -> DataFrame:
    """(u, v) edges from rows (block, bucket, part, other, fp, node) that are sorted by these columns in each partition."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, last = 0, None

        def flush():
            table = pa.Table.from_batches(held)
            block = table.column("block")[0].as_py()
            value = table.column("fp").to_numpy().view(np.uint64)
            turn = 64 - BLOCK_BITS * (block + 1)
            if turn:
                value = value << np.uint64(turn) | value >> np.uint64(64 - turn)
            u, v = forest(value, table.column("node").to_numpy())
            return record_batch(u=u, v=v)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key = tuple(keys[:, s])
                if held and key != last and (key[0] != last[0] or rows >= RUN_ROWS):
                    yield flush()
                    held, rows = [], 0
                held.append(batch.slice(s, e - s))
                rows, last = rows + e - s, key
            held = pa.Table.from_batches(held).combine_chunks().to_batches()
        if held:
            yield flush()

    return probes.mapInArrow(releasing(run), "u long, v long")


def links_forest(nodes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) between nodes (fp long, node long; both unique) that keep the components of all links of at most
    three bits. A bucket beyond bucket_rows is cut into parts by hash; a task gets each pair of parts."""
    block = F.explode(F.array(*(F.lit(b) for b in range(BLOCKS)))).alias("block")
    probes = nodes.select("fp", "node", block)
    value = F.lit(None)
    for b in reversed(range(BLOCKS)):
        value = F.when(F.col("block") == b, F.shiftrightunsigned("fp", b * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1)).otherwise(value)
    probes = probes.select("block", value.cast("int").alias("bucket"), "fp", "node")
    hot = probes.groupBy("block", "bucket").count().where(F.col("count") > bucket_rows)
    if hot.limit(1).count():
        probes = probes.join(hot, ["block", "bucket"], "left").withColumn("parts", F.ceil(F.coalesce("count", F.lit(1)) / bucket_rows).cast("int"))
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        probes = probes.withColumn("mine", mine).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        probes = probes.select("block", "bucket", F.least("mine", "to").alias("part"), F.greatest("mine", "to").alias("other"), "fp", "node")
    else:
        probes = probes.select("block", "bucket", F.lit(0).alias("part"), F.lit(0).alias("other"), "fp", "node")
    keys = ["block", "bucket", "part", "other"]
    return _bucket_forests(probes.repartition(*keys).sortWithinPartitions(*keys))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most three bits. Null and empty
    texts have fingerprint zero and link like any other; repeated rows are all returned; a row without doc_id gets its
    fingerprint but takes no part in linking, and its component_id is that of its fingerprint, else null. An empty
    table gives no rows; columns but doc_id and text are not read. A very long text is hashed as a whole, alone in its task:
    about 30 bytes of memory for each of its own.
    """
    marked = durable(with_fingerprints(docs, doc_id, text))
    nodes = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    groups = connected_components(links_forest(nodes, bucket_rows))
    groups = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(groups, "fp", "left").select("doc_id", digits, "component_id")
