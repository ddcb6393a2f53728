"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by documents: a segment holds, for some of them, the postings (sorted places of words) of each term
that the test items use, and is stored. A phrase is looked up in each segment by itself: its terms' lists, shifted by the
terms' offsets, are intersected from the segment's rarest term on; with a slop, a term may stand that many words off.
Test items come to the tasks in blocks of bounded size, each a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, pieces, record_batch

WINDOW = 13
#: Words of test items that are broadcast at a time; an item longer than that is alone in its block.
BLOCK_WORDS = 1_000_000
SEGMENT_BYTES = 2 << 20
#: Words are of 0-9, a-z and all beyond ASCII; A-Z counts as a-z.
SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(SEPARATE).split()


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """(id as text, words) of the items that have words, some at a time."""
    block, n = [], 0
    for key, t in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        words = words_of((t or "").encode())
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        if words:
            block.append((key, words))
            n += len(words)
    if block:
        yield block


class Phrases:
    """The windows of a block of items: terms (ids in `vocab`) by window, -1 behind a short one; sizes; items, the
    numbers of the items that have the window; keys, the items' ids."""

    def __init__(self, block: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in block for w in words))}
        self.keys = [k for k, _ in block]
        found: dict[tuple[int, ...], list[int]] = {}
        for i, (_, words) in enumerate(block):
            ids = [self.vocab[w] for w in words]
            for s in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[s : s + window]), []).append(i)
        self.items = [sorted(set(x)) for x in found.values()]
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.terms = np.array([[*x, *[-1] * (window - len(x))] for x in found], np.int64).reshape(len(found), window)


SEGMENT = "id array<long>, copy array<long>, words array<int>, terms binary, ends binary, places binary"


def index(docs: DataFrame, vocab: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored segments: of each document its id, the XXH64 of its text and number of words; the terms found, where each
    one's list ends, and the lists. Places run on from document to document, with one left free between them."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def make():
        get = sent.value.get

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, texts in pieces(batch, limit=SEGMENT_BYTES):
                counts, ids = [], []
                for t in texts:
                    words = words_of(t)
                    counts.append(len(words))
                    ids.append(np.fromiter((get(w, -1) for w in words), np.int32, len(words)))
                    ids.append(np.full(1, -1, np.int32))
                ids = np.concatenate(ids)
                places = np.flatnonzero(ids >= 0)
                order = places[np.argsort(ids[places], kind="stable")].astype("<i4")
                terms, n = np.unique(ids[order], return_counts=True)
                columns = [pa.array([x], pa.list_(t)) for x, t in ((part.column(0).to_pylist(), pa.int64()), (part.column(1).to_pylist(), pa.int64()), (counts, pa.int32()))]
                blobs = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (terms, np.cumsum(n), order)]
                yield pa.RecordBatch.from_arrays([*columns, *blobs], names=["id", "copy", "words", "terms", "ends", "places"])

        return each

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text"))
    return durable(map_batches(rows, make, SEGMENT))


class Segment:
    def __init__(self, row: dict):
        self.words = np.array(row["words"], np.int64)
        self.first = np.cumsum(self.words + 1) - (self.words + 1)
        self.terms = np.frombuffer(row["terms"], "<i4")
        self.ends = np.frombuffer(row["ends"], "<i4")
        self.places = np.frombuffer(row["places"], "<i4")

    def postings(self, k: int) -> np.ndarray:
        return self.places[self.ends[k - 1] if k else 0 : self.ends[k]]

    def starts(self, phrases: Phrases, slop: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the phrase, places where it starts) for each phrase that occurs; with a slop, places where its
        rarest term would have it start and every other term is at most that far off."""
        if not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, phrases.terms), len(self.terms) - 1)
        here = self.terms[at] == phrases.terms
        length = np.where(here, np.diff(self.ends, prepend=0)[at], 0)
        length[phrases.terms < 0] = np.iinfo(np.int32).max
        for p in np.flatnonzero(length.min(axis=1) > 0):
            order = np.argsort(length[p], kind="stable")[: phrases.sizes[p]]
            left = self.postings(at[p, order[0]]) - order[0]
            for k in order[1:]:
                own = self.postings(at[p, k])
                i = np.searchsorted(own, left + (k - slop))
                left = left[(i < len(own)) & (own[np.minimum(i, len(own) - 1)] <= left + (k + slop))]
                if not len(left):
                    break
            if slop and len(left):
                doc = np.searchsorted(self.first, left, side="right") - 1
                left = left[(left >= 0) & (left + phrases.sizes[p] - slop <= self.first[doc] + self.words[doc])]
            if len(left):
                yield int(p), left


FOUND = "id long, copy long, n_words long, n_hit long, spans binary, items array<string>"


def search(segments: DataFrame, phrases: Phrases, every: bool = True, slop: int = 0) -> DataFrame:
    """FOUND rows of each document (or, not every, of those with a hit): words inside an occurrence, the spans (start,
    end; int32) that these make up, and the ids of the items that occur."""
    sent = segments.sparkSession.sparkContext.broadcast(phrases)

    def make():
        own = sent.value

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                segment = Segment(row)
                n = len(segment.words)
                size = int((segment.words + 1).sum()) + 1
                items: dict[int, set[int]] = {}
                begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for p, starts in segment.starts(own, slop):
                    begins.append(starts)
                    ends.append(np.minimum(starts + own.sizes[p], size - 1))
                    for doc in np.unique(np.searchsorted(segment.first, starts, side="right") - 1).tolist():
                        items.setdefault(doc, set()).update(own.items[p])
                change = np.bincount(np.concatenate(begins), minlength=size) - np.bincount(np.concatenate(ends), minlength=size)
                hit = np.append(0, np.cumsum(change)[:-1] > 0).astype(np.int8)
                total = np.append(0, np.cumsum(hit[1:]))
                n_hit = total[segment.first + segment.words] - total[segment.first]
                rows = np.arange(n) if every else np.flatnonzero(n_hit)
                spans = []
                for d in rows.tolist():
                    s, e = segment.first[d], segment.first[d] + segment.words[d]
                    edge = np.diff(hit[s + 1 : e + 1], prepend=0, append=0) if n_hit[d] else hit[:0]
                    spans.append(np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)], axis=1).astype("<i4").tobytes())
                keys = [sorted({own.keys[i] for i in items.get(d, ())} - {None}) for d in rows.tolist()]
                yield record_batch(
                    id=pa.array([row["id"][d] for d in rows.tolist()], pa.int64()), copy=pa.array([row["copy"][d] for d in rows.tolist()], pa.int64()),
                    n_words=segment.words[rows], n_hit=n_hit[rows].astype(np.int64), spans=pa.array(spans, pa.binary()), items=pa.array(keys, pa.list_(pa.string())),
                )

        return each

    return map_batches(segments, make, FOUND)


def _joined(spans: list[bytes]) -> tuple[int, bytes]:
    """The union of spans and its words."""
    at = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in spans])
    at = at[np.argsort(at[:, 0], kind="stable")]
    out: list[list[int]] = []
    for s, e in at.tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return sum(e - s for s, e in out), np.array(out, "<i4").tobytes()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """FOUND rows, one for each row of docs. slop 0: exact phrases; else matches by proximity."""
    found, more = None, []
    for block in item_blocks(benchmark, block_words=block_words):
        phrases = Phrases(block, window)
        hits = search(index(docs, phrases.vocab), phrases, found is None, slop)
        if found is None:
            found = hits
        else:
            more.append(hits)
    if found is None:  # no item has a word
        return search(index(docs, {}), Phrases([], window), True, slop)
    if not more:
        return found
    other = more[0]
    for x in more[1:]:
        other = other.unionAll(x)
    # One row for a document and block: repeated rows have equal hits.
    other = other.distinct().groupBy("id", "copy").agg(F.collect_list("spans").alias("more"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("also"))
    found = found.alias("a").join(other.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & F.col("a.copy").eqNullSafe(F.col("b.copy")), "left")
    found = found.select("a.*", "more", F.array_sort(F.array_union("items", F.coalesce("also", F.array().cast("array<string>")))).alias("all"))

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            spans, n = [], []
            for own, hit, more in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), batch.column(6).to_pylist(), strict=True):
                hit, own = _joined([own, *more]) if more else (hit, own)
                n.append(hit)
                spans.append(own)
            yield record_batch(id=batch.column(0), copy=batch.column(1), n_words=batch.column(2), n_hit=np.array(n, np.int64), spans=pa.array(spans, pa.binary()), items=batch.column(7))

        return each

    return map_batches(found, make, FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, copy) for every row of docs (doc_id, text).

    A document word inside an occurrence of a window of a benchmark item is hit; a document is contaminated if at least a
    twentieth of its words are. Null and empty texts have no words and are clean; so is all if no item has a word. Items
    without item_id hit words but are not listed; items that repeat count once. Repeated rows are all returned; an empty
    table gives no rows; other columns are not read. copy is the XXH64 of the text, which with doc_id names the row.
    """
    found = matches(docs, benchmark, window, 0, block_words)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "copy",
    )
