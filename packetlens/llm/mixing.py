"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, as often as a document may be taken. A copy's virtual finish time is the
words its source has queued up to and with it, divided by the source's target, so at time one every source has given its target.
Copies of all sources are sorted by finish time in ranges, and those that end within the total budget are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.operators.scans import looked_up, running

from .common import durable

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, REPEATS = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = REPEATS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): `share` of all sizes by weight, at most `most` times a source's size.

    Sources take the weights in turn, by code point, null last. A source that would give more than it may stops at its limit, and
    what it leaves is dealt to the others by weight: in order of limit by weight, a source stops if that is at most the level that
    it and those after it would share what is left at. The level of the first that does not stop is that of all after it.
    """
    turn = running(sizes, None, [F.col("source").isNull(), F.col("source")], "turn").withColumn("kind", ((F.col("turn") - 1) % len(weights)).cast("int"))
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.col("kind")]
    kinds = [f"kind{i}" for i in range(len(weights))]  # weights are added up by how often each occurs, which is exact
    rows = turn.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("limit"), *((F.col("kind") == i).cast("long").alias(k) for i, k in enumerate(kinds)))
    rows = rows.withColumn("level", F.col("limit") / F.col("weight"))
    rows = running(rows, None, ["level", F.col("source").isNull(), "source"], "place", {"sizes": "source_size", **{f"n_{k}": k for k in kinds}})
    whole = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds)).first()
    left = sum((float(w) * (F.lit(whole[k]) - F.col(f"n_{k}") + F.col(k)) for w, k in zip(weights, kinds, strict=True)), F.lit(0.0))
    shared = (F.lit(share * whole["size"]) - most * (F.col("sizes") - F.col("source_size"))) / left
    rows = durable(rows.select("source", "source_size", "weight", "limit", "level", "place", shared.alias("shared")))
    level = rows.where("level > shared").agg(F.min_by("shared", "place")).first()[0]
    return rows.select("source", "source_size", F.when(F.col("level") <= F.col("shared"), F.col("limit")).otherwise(F.col("weight") * F.lit(level)).cast("double").alias("target"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0, size: Column | None = None) -> DataFrame:
    """The queue: (row, doc_id, source, size, source_size, target, copy, finish, position, taken) for each of the `repeats` copies of
    every row of documents (doc_id, source, text). position is the words of the mix up to and with the copy, so the taken copies in
    order of position are the mix. `size`: another measure than words of text.

    A source's documents are shuffled by the md5 of seed and doc_id (a missing id as empty text), ties by the hash of the text;
    rows that repeat both are alike, and any of them may be the one that is taken. All copies of a source's documents come before any
    is queued again. A copy that would end beyond the budget is not taken, so the mix is less than a document short of it, and so
    is each source of its target or its target of it. Null and empty texts have no words, finish at once and take none; sources of
    no words have target zero. Null is a source. An empty table gives no rows; other columns are not read. A very long text is
    counted whole in its task and not kept.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"), draw.alias("draw"), F.xxhash64("text").alias("tie"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    sources = durable(targets(durable(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, share, repeats))
    queued = running(rows, "source", ["draw", "doc_id", "tie", "row"], "place", {"words": "size"})
    queued = looked_up(queued, sources, "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = F.when(F.col("target") > 0, (F.col("words") + F.col("copy") * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    queued = queued.withColumn("finish", finish)
    order = ["finish", F.col("source").isNull(), "source", "copy", "draw", "doc_id", "tie", "row"]
    queued = running(queued, None, order, "turn", {"position": "size"})
    budget = sources.agg(F.sum("target")).first()[0] or 0.0
    # Targets that come to whole words should not miss one by rounding.
    return queued.select("row", "doc_id", "source", "size", "source_size", "target", "copy", "finish", "position", (F.col("position") <= budget + 1e-6).alias("taken"))


def shares(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row: taken is the words that the mix takes of it, all copies."""
    own = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    found = mixed(docs, **options).groupBy("row").agg(*own, F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"))
    return found.select("doc_id", "size", "source_size", "target", "taken")
