"""Substring dedup with a count-min prefilter.

A window is a run of consecutive words. It is counted under its anchor, the first smallest of its 8-word shingle hashes:
equal windows have equal anchors at equal offsets, so the anchor's count, taken once per place, is never below the window's;
the sketch holds a seventh of the items and loses nothing.

Documents are dealt out by their key once, and all three passes read that one exchange. Pass one: each group of documents
counts its anchors in a sketch of as many cells as the size of the input asks for, and sends the cells that it touched to
the cells' blocks; a block adds up all groups' counts and tells each group which of its cells were met twice or more. The
merged sketch is never in one place. The answers come back with the group's first document (documents of a group follow
each other), so pass two tests each window by the smallest count of its cells and hands on only windows estimated repeated,
the earliest of each piece of the input. Windows meet under their anchor, or, where the sketch counts the anchor too often for
one task, under their own hash. They are equal if two 64-bit hashes of their words are (anchor and window). Pass three
removes the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pieces, record_batch, releasing

WINDOW = 20
SHINGLE = 8
#: Rows of cells; bytes of text for each cell of a row (anchors are a seventh of the words, so a cell is met by 0.2 anchors or so);
#: cells of a block, which is what a merging task holds, and blocks of a row at least, as powers of two.
ROWS, CELL_BYTES, BLOCK_BITS, LEAST_BLOCKS = 2, 8, 24, 6
#: Text of a group, whose anchors and answers a task holds, in bytes.
GROUP_BYTES = 64 << 20
#: An anchor that the sketch counts so often is no key by itself.
HOT_ANCHOR = 256
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
NO_ID = -(1 << 63)
#: Text whose windows are in memory at a time, and text over which a task reduces windows before it sends them on, in bytes;
#: rows that are settled at a time.
PART_BYTES, PIECE_BYTES, SETTLE_ROWS = 1 << 20, 4 << 20, 20_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * MIX[0]
    x = (x ^ x >> np.uint64(27)) * MIX[1]
    return x ^ x >> np.uint64(31)


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive word hashes, by doubling."""
    out, done, power, length = None, 0, 1, words
    factor, left = int(MULTIPLIER), size
    while True:
        if left & 1:
            part = length
            if out is None:
                out, done = part, power
            else:  # out covers `done` words, part the `power` words before them
                n = len(words) - done - power + 1
                scale = np.uint64(pow(int(MULTIPLIER), done, 1 << 64))
                out = part[:n] * scale + out[power : power + n]
                done += power
        left >>= 1
        if not left:
            return mixed(out)
        length = length[: len(length) - power] * np.uint64(factor) + length[power:]
        factor = factor * factor % (1 << 64)
        power *= 2


def first_minimum(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the first smallest value in each run of `span` values."""
    place, power = np.arange(len(values)), 1
    while power * 2 <= span:
        a, b = place[: len(place) - power], place[power:]
        place = np.where(values[b] < values[a], b, a)
        power *= 2
    rest = span - power
    if rest:
        a, b = place[: len(place) - rest], place[rest:]
        place = np.where(values[b] < values[a], b, a)
    return place


class Windows:
    """The windows of a few texts. doc, start: text number and first word; anchor_place: the anchor's place among all
    words of the texts; anchor, hash: uint64."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.words = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(texts))
        total = int(self.counts.sum())
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(self.words)), np.uint64, total)
        first = np.cumsum(self.counts) - self.counts
        doc = np.repeat(np.arange(len(texts)), self.counts)
        shingle = min(SHINGLE, window)
        n = total - window + 1
        if n <= 0:
            self.doc = self.start = self.anchor_place = np.zeros(0, np.int64)
            self.anchor = self.hash = np.zeros(0, np.uint64)
            return
        inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
        short = runs_of(hashes, shingle)
        self.anchor_place = first_minimum(short, window - shingle + 1)[inside]
        self.anchor = short[self.anchor_place]
        self.hash = runs_of(hashes, window)[inside]
        self.doc = doc[inside]
        self.start = inside - first[self.doc]


def cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(anchors ^ np.uint64((row + 1) * int(MULTIPLIER) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def cell_bits(text_bytes: int) -> int:
    """Cells of a row of the sketch for an input of so much text, as a power of two."""
    return max(LEAST_BLOCKS + 4, (max(text_bytes, 1) // CELL_BYTES).bit_length())


def block_bits(bits: int) -> int:
    """Cells of a block: a row has LEAST_BLOCKS blocks, or more if they would be larger than BLOCK_BITS."""
    return min(BLOCK_BITS, bits - LEAST_BLOCKS)


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


#: The part of a row that says only that there is a group.
MARKER = -1
SKETCH = "part int, id long, copy long, cells binary, counts binary"
ANSWER = "id long, copy long, part int, cells binary, counts binary"


def _sketched(docs: DataFrame, bits: int, window: int) -> DataFrame:
    """SKETCH rows of (id, copy, text, grp) rows that are sorted by grp, id and copy: for each group and block, the distinct
    cells (uint32, within the block) and how often a place of an anchor fell there (uint16, cut at its greatest value). Each group also
    has a row without cells, of part MARKER, whether it has anchors or not."""
    own_bits = block_bits(bits)

    def run(batches):
        key: tuple[int, int, int] | None = None
        held: list[np.ndarray] = []

        def flush():
            anchors = np.concatenate(held)
            for row in range(ROWS):
                cell, n = np.unique(cells(anchors, row, bits), return_counts=True)
                block = cell >> own_bits
                at, n = (cell & (1 << own_bits) - 1).astype("<u4"), np.minimum(n, 65535).astype("<u2")
                cuts = _cuts(block)
                m = len(cuts) - 1
                yield record_batch(
                    part=(row << bits - own_bits | block[cuts[:-1]]).astype(np.int32), id=np.full(m, key[1]), copy=np.full(m, key[2]),
                    cells=pa.array([at[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    counts=pa.array([n[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(3).to_numpy()
            cuts = _cuts(group)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if key is None or key[0] != group[a]:
                    if held:
                        yield from flush()
                    key, held = (int(group[a]), batch.column(0)[a].as_py(), batch.column(1)[a].as_py()), []
                    yield record_batch(part=np.array([MARKER], np.int32), id=[key[1]], copy=[key[2]], cells=[b""], counts=[b""])
                for _, texts in pieces(batch.slice(a, b - a), limit=PART_BYTES):
                    w = Windows(texts, window)
                    if len(w.anchor):  # places of anchors never go back
                        held.append(w.anchor[np.append(True, w.anchor_place[1:] != w.anchor_place[:-1])])
        if held:
            yield from flush()

    return docs.select("id", "copy", "text", "grp").mapInArrow(releasing(run), SKETCH)


def _merged(sketches: DataFrame, bits: int) -> DataFrame:
    """ANSWER rows: of each group's cells those whose counts add up to two or more, with the sums (uint16, cut); and the groups' markers."""
    size = 1 << block_bits(bits)

    def run(batches):
        total, held, last = np.zeros(size, np.uint16), [], -1

        def flush():
            out = []
            for name, copy, at in held:
                at = np.frombuffer(at, "<u4")
                n = total[at]
                again = n > 1
                if again.any():
                    out.append((name, copy, at[again].tobytes(), n[again].astype("<u2").tobytes()))
            if out:
                yield record_batch(
                    id=np.array([x[0] for x in out], np.int64), copy=np.array([x[1] for x in out], np.int64), part=np.full(len(out), last, np.int32),
                    cells=pa.array([x[2] for x in out], pa.binary()), counts=pa.array([x[3] for x in out], pa.binary()),
                )

        for batch in batches:
            marks = pc.equal(batch.column(0), MARKER)
            if pc.any(marks).as_py():
                yield batch.filter(marks).select(["id", "copy", "part", "cells", "counts"])
                batch = batch.filter(pc.invert(marks))
            for part, name, copy, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last:
                    yield from flush()
                    total[:], held, last = 0, [], part
                held.append((name, copy, at))
                at, n = np.frombuffer(at, "<u4"), np.frombuffer(n, "<u2")  # distinct cells
                total[at] = np.minimum(total[at].astype(np.uint32) + n, 65535)
        yield from flush()

    return sketches.repartition("part").sortWithinPartitions("part").mapInArrow(releasing(run), ANSWER)


class Answers:
    """Counts of the anchors of a group, from its answers (part, cells, counts); an anchor that is not there was met once."""

    def __init__(self, answers: list[dict], bits: int):
        own_bits = block_bits(bits)
        self.bits, self.rows = bits, []
        blocks = 1 << bits - own_bits
        for row in range(ROWS):
            own = sorted((a["part"] % blocks, a["cells"], a["counts"]) for a in answers if a["part"] // blocks == row)
            at = [np.frombuffer(c, "<u4").astype(np.int64) | block << own_bits for block, c, _ in own]
            n = [np.frombuffer(c, "<u2") for _, _, c in own]
            self.rows.append((np.concatenate(at), np.concatenate(n)) if own else (np.zeros(0, np.int64), np.zeros(0, np.uint16)))

    def counts(self, anchors: np.ndarray) -> np.ndarray:
        out = np.full(len(anchors), 65535, np.int64)
        for row, (known, n) in enumerate(self.rows):
            if not len(known):
                return np.ones(len(anchors), np.int64)
            cell = cells(anchors, row, self.bits)
            at = np.minimum(np.searchsorted(known, cell), len(known) - 1)
            out = np.minimum(out, np.where(known[at] == cell, n[at], 1))
        return out


def _earliest(key: list[np.ndarray], doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of rows with equal key: is each at the smallest (doc_id, start)?"""
    order = np.lexsort((start, doc_id, *key))
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in key], axis=0))[: len(order)]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    first = np.empty(len(order), bool)
    first[order] = (doc_id[order] == doc_id[lead]) & (start[order] == start[lead])
    return first


CANDIDATE = "known boolean, hot boolean, id long, copy long, key long, first int, starts binary, hashes binary"


def _candidates(docs: DataFrame, bits: int, window: int, hot_anchor: int) -> DataFrame:
    """CANDIDATE rows of (id, copy, text, grp, answers) rows that are sorted by grp, id and copy; the first row of a group has
    its answers, its marker at least (a group that begins without, or has them later, was cut otherwise than in pass one, which is an
    error). known: starts of windows that the piece itself showed to be later ones. Others are the earliest of their
    piece: a row for each document and anchor, its windows' starts (int32) and hashes; or, hot, for each window, with
    the window's hash as the key and the anchor in `hashes`."""

    def run(batches):
        group, answers = None, Answers([], bits)
        ids: list[np.ndarray] = []
        copies: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, ...]] = []
        n_docs = held = 0

        def flush():
            nonlocal ids, copies, parts, n_docs, held
            if parts:
                yield from _reduced(np.concatenate(ids), np.concatenate(copies), *(np.concatenate(x) for x in zip(*parts, strict=True)))
            ids, copies, parts, n_docs, held = [], [], [], 0, 0

        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(3).to_numpy()
            cuts = _cuts(groups)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = batch.slice(a, b - a)
                begins = group != groups[a]
                if begins and not own.column(4)[0].is_valid or own.column(4).slice(int(begins)).null_count < len(own) - int(begins):
                    raise RuntimeError("a group of documents was dealt out differently in two passes")
                if begins:
                    group, answers = groups[a], Answers(own.column(4)[0].as_py(), bits)
                for part, texts in pieces(own.select([0, 1, 2]), limit=PART_BYTES):
                    w = Windows(texts, window)
                    n = answers.counts(w.anchor)
                    ok = n > 1
                    ids.append(part.column(0).to_numpy())
                    copies.append(part.column(1).to_numpy())
                    parts.append((w.doc[ok] + n_docs, w.start[ok], w.anchor[ok], w.hash[ok], n[ok] >= hot_anchor))
                    n_docs += len(texts)
                    held += sum(map(len, texts))
                    if held >= PIECE_BYTES:
                        yield from flush()
        yield from flush()

    return docs.select("id", "copy", "text", "grp", "answers").mapInArrow(releasing(run), CANDIDATE)


def _reduced(ids: np.ndarray, copies: np.ndarray, doc: np.ndarray, start: np.ndarray, anchor: np.ndarray, value: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """CANDIDATE rows of one piece's windows."""
    if not len(doc):
        return
    first = _earliest([anchor, value], _rank(ids[doc]), start)
    yield from _known(ids, copies, doc[~first], start[~first])
    doc, start, anchor, value, hot = (x[first] for x in (doc, start, anchor, value, hot))
    for which in (False, True):
        d, s, a, v = (x[hot == which] for x in (doc, start, anchor, value))
        if not len(d):
            continue
        order = np.lexsort((s, d, a))
        d, s, a, v = (x[order] for x in (d, s, a, v))
        cuts = np.arange(len(d) + 1) if which else _cuts(a, d)
        at = cuts[:-1]
        lists = [(x, y) for x, y in zip(at.tolist(), cuts[1:].tolist(), strict=True)]
        yield record_batch(
            known=np.zeros(len(at), bool), hot=np.full(len(at), which), id=ids[d[at]], copy=copies[d[at]], key=(v if which else a)[at].view(np.int64), first=s[at].astype(np.int32),
            starts=pa.array([s[x:y].astype("<i4").tobytes() for x, y in lists], pa.binary()), hashes=pa.array([(a if which else v)[x:y].tobytes() for x, y in lists], pa.binary()),
        )


def _known(ids: np.ndarray, copies: np.ndarray, row: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(row):
        return
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    cuts = _cuts(row)
    n, at = len(cuts) - 1, row[cuts[:-1]]
    yield record_batch(
        known=np.ones(n, bool), hot=np.zeros(n, bool), id=ids[at], copy=copies[at], key=copies[at], first=start[cuts[:-1]].astype(np.int32),
        starts=pa.array([start[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), hashes=pa.nulls(n, pa.binary()),
    )


LATER = "id long, copy long, starts binary"


def _settled(rows: DataFrame) -> DataFrame:
    """LATER rows: starts of the windows that are not the earliest of their words. Rows of one key follow each other; those of
    a hot key come in the order of places, so a task keeps only the first one, however many there are."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        n_held = 0
        lead: tuple[int, bytes, int, int] | None = None  # of a hot key: the key, anchor, rank and start of the earliest

        def later(ids, copies, row, start):
            for batch in _known(ids, copies, row, start):
                yield batch.select(["id", "copy", "starts"])

        def cold():
            table = pa.Table.from_batches(held).combine_chunks()
            ids, copies, keys = (table.column(c).to_numpy() for c in ("id", "copy", "key"))
            starts = [np.frombuffer(x, "<i4") for x in table.column("starts").to_pylist()]
            row = np.repeat(np.arange(len(ids)), [len(x) for x in starts])
            start = np.concatenate(starts).astype(np.int64)
            value = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
            first = _earliest([keys[row].view(np.uint64), value], _rank(ids[row]), start)
            yield from later(ids, copies, row[~first], start[~first])

        for batch in batches:
            known, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if known.any():
                yield batch.filter(pa.array(known)).select(["id", "copy", "starts"])
            if hot.any():
                few = batch.filter(pa.array(hot & ~known))
                ids, copies, keys, start = (few.column(c).to_numpy() for c in ("id", "copy", "key", "first"))
                gone = np.zeros(len(ids), bool)
                rank = _rank(ids)
                for i, (key, anchor) in enumerate(zip(keys.tolist(), few.column("hashes").to_pylist(), strict=True)):
                    if lead is None or (key, anchor) != lead[:2]:
                        lead = (key, anchor, rank[i], start[i])
                    gone[i] = (rank[i], start[i]) != lead[2:]
                yield from later(ids, copies, np.flatnonzero(gone), start[gone].astype(np.int64))
            few = batch.filter(pa.array(~hot & ~known))
            if not few.num_rows:
                continue
            keys = few.column("key").to_numpy()
            if n_held >= SETTLE_ROWS:
                last = held[-1].column("key")[-1].as_py()
                cut = next((c for c in _cuts(keys)[:-1].tolist() if keys[c] != last), None)
                if cut is not None:
                    held.append(few.slice(0, cut))
                    yield from cold()
                    held, n_held, few = [], 0, few.slice(cut)
            held.append(few)
            n_held += few.num_rows
        if held:
            yield from cold()

    rank = F.when(F.col("id") == NO_ID, F.lit((1 << 63) - 1)).otherwise(F.col("id"))
    anchor = F.when(F.col("hot"), F.col("hashes"))
    return rows.repartition("key").sortWithinPartitions("hot", "key", anchor, rank, "first").mapInArrow(releasing(run), LATER)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, id, copy, text): id and copy name a row's document; rows that repeat id and text are one document."""
    own = F.col(doc_id).cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text)).alias("copy"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _rank(ids: np.ndarray) -> np.ndarray:
    """Ids for ordering: a missing one comes last."""
    return np.where(ids == NO_ID, np.iinfo(np.int64).max, ids)


def _group(spark: SparkSession, text_bytes: int) -> Column:
    """Which group a document is of: a part of a partition of the exchange, which is by the same hash of the key."""
    set_for = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    partitions = int(set_for or spark.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.hash("id", "copy"), F.lit(partitions * max(1, text_bytes // (partitions * GROUP_BYTES)))).alias("grp")


def later_windows(own: DataFrame, text_bytes: int, window: int = WINDOW, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """LATER rows of the documents `own` (id, copy, text): windows whose words also start earlier; a document may have several
    rows."""
    bits = cell_bits(text_bytes)
    group = _group(own.sparkSession, text_bytes)
    order = ["grp", "id", "copy"]
    answers = _merged(_sketched(own.select("id", "copy", "text", group).sortWithinPartitions(*order), bits, window), bits)
    answers = answers.groupBy("id", "copy").agg(F.collect_list(F.struct("part", "cells", "counts")).alias("answers"))
    asked = own.join(answers, ["id", "copy"], "left").select("id", "copy", "text", group, "answers").sortWithinPartitions(*order)
    return _settled(_candidates(asked, bits, window, hot_anchor))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row.

    A word is removed if a window covers it whose words also start earlier: at a smaller doc_id, or earlier in the same
    document; all are judged on the input. Rows of one doc_id are one document, so at equal starts neither is earlier;
    a missing doc_id comes after all others. Null and empty texts have no words, texts shorter than a window lose none.
    Repeated rows are all returned; an empty table gives no rows; other columns are not read. A very long text is cut
    nowhere: its words and windows are in the memory of its task, about 30 bytes for each of its own.
    """
    keyed = _keyed(docs, doc_id, text)
    text_bytes = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Each document once: the one exchange of texts, which all passes read.
    own = keyed.groupBy("id", "copy").agg(F.max("text").alias("text"))
    later = later_windows(own, text_bytes, window, hot_anchor).groupBy("id", "copy").agg(F.collect_list("starts").alias("starts"))
    rows = own.join(later, ["id", "copy"], "left").select("id", "copy", "text", "starts")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, texts in pieces(batch, limit=PART_BYTES):
                words, removed, kept = [], [], []
                for t, found in zip(texts, part.column(3).to_pylist(), strict=True):
                    own = t.split()
                    n = len(own)
                    if found:
                        change = np.zeros(n + 1, np.int32)
                        at = np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in found]))
                        change[at] += 1
                        change[at + window] -= 1
                        own = [own[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
                    words.append(n)
                    removed.append(n - len(own))
                    kept.append(b" ".join(own))
                out = {"id": part.column(0), "copy": part.column(1), "n_words": np.array(words, np.int64), "n_removed": np.array(removed, np.int64), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
                yield record_batch(**out, **({"kept_text": [x.decode() for x in kept]} if with_text else {}))

        return each

    columns = ["n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    found = map_batches(rows, make, "id long, copy long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return keyed.select("doc_id", "id", "copy").join(found, ["id", "copy"]).select("doc_id", *columns)
