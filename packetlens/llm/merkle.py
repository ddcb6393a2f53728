"""Merkle manifest of a dataset by lag and lead windows.

A row's leaf is the hash of its fields. Of each source the leaves, in order of doc_id, are cut into runs of 16, and a run's nodes
become their parent's hash, level by level, until one is left; the sources' roots become the dataset's root likewise. A level is
one window: lags and leads of 1 to 15 rows, masked by a node's slot and its run's length, are its siblings, and the first of a run
hashes the parent. Windows work in blocks of whole runs, so a source of any size is dealt out. On the way back down a node's path is
its siblings followed by its parent's path; rows meet only their parent's path, once for 16 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.operators.scans import looked_up, running

from .common import durable

FAN = 16
#: Nodes of a window, whole runs.
BLOCK = 16 * FAN
NO_PATH = "CAST(array() AS ARRAY<STRUCT<left: STRING, right: STRING>>)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value, so that no two rows of fields look alike."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def _run(fan: int) -> tuple[Column, Column, Column]:
    """A node's run, its slot in the run, and the run's length."""
    run = F.floor(F.col("pos") / fan).cast("long")
    return run, (F.col("pos") % fan).cast("int"), F.least(F.lit(fan).cast("long"), F.col("n") - run * fan)


def _siblings(fan: int, sides: tuple[str, ...]) -> list[Column]:
    """The digests left and right of a node in its run, each side in one string."""
    _, slot, length = _run(fan)
    w = Window.partitionBy("grp", F.floor(F.col("pos") / (fan * (BLOCK // FAN)))).orderBy("pos")
    left = [F.when(slot >= i, F.lag("digest", i).over(w)) for i in reversed(range(1, fan))]
    right = [F.when(slot + i < length, F.lead("digest", i).over(w)) for i in range(1, fan)]
    return [F.concat_ws("", *(left if s == "left" else right)).alias(s) for s in sides]


def parents(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """The next level of (grp, pos, n, digest): the first of each run hashes its own and the following digests. A group's only node
    stays as it is."""
    run, slot, _ = _run(fan)
    rows = nodes.select("*", *_siblings(fan, ("right",))).where(slot == 0)
    digest = F.when(F.col("n") == 1, F.col("digest")).otherwise(F.sha2(F.concat("digest", "right"), 256))
    return rows.select("grp", run.alias("pos"), F.ceil(F.col("n") / fan).cast("long").alias("n"), digest.alias("digest"))


def paths(nodes: DataFrame, above: DataFrame, fan: int = FAN) -> DataFrame:
    """`nodes` with the path of each: its siblings (left, right), then its parent's path of `above` (grp, pos, path and others)."""
    own = F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(F.expr(NO_PATH))
    rows = nodes.select("*", *_siblings(fan, ("left", "right")), _run(fan)[0].alias("run"))
    up = above.withColumnsRenamed({"grp": "up_grp", "pos": "run", "path": "up_path"})
    rows = rows.join(up, (rows["grp"] == up["up_grp"]) & (rows["run"] == up["run"])).drop("run", "up_grp")
    return rows.withColumn("path", F.concat(own, "up_path")).drop("left", "right", "up_path")


def _tree(leaves: DataFrame, most: int, fan: int) -> list[DataFrame]:
    """The levels over the leaves (grp, pos, n, digest) until each group has one node; most: nodes of the largest group."""
    levels = [leaves]
    while most > 1:
        levels.append(durable(parents(levels[-1], fan)))
        most = -(-most // fan)
    return levels


def manifest(docs: DataFrame, fan: int = FAN, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified) for every row of documents (doc_id, source, lang, n_chars, text).

    path: from the leaf to the root, the siblings left and right of each node, concatenated. folded_root: the root as path and leaf
    give it; tampered: a condition under which the leaf is taken of a text whose A-Z were lower-cased instead. verified: that is
    the root.
    A null field is hashed as `-`; rows without a source are a source of their own, before all others. Equal ids of a source stand
    in order of their leaves, a missing id first; rows that repeat are leaves of their own. A source's only leaf is its root, and a
    dataset of one source has that source's root. An empty table gives no rows; other columns are not read. A very long text is hashed
    whole in its task; after the leaf, no text is kept.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    start = F.when(tampered, leaf_of(*fields, F.translate(text, UPPER, LOWER))) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id"), F.col("source"), leaf_of(*fields, text).alias("digest"), start.alias("changed"))
    rows = running(rows, "source", [F.col("doc_id").asc_nulls_first(), "digest"], "place")
    sources = durable(rows.groupBy("source").agg(F.count("*").alias("n")))
    n_sources, most = sources.agg(F.count("*"), F.max("n")).first()
    if not n_sources:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, leaf string, subroot string, root string, path array<struct<left: string, right: string>>, folded_root string, verified boolean")
    sources = running(sources, None, [F.col("source").asc_nulls_first()], "rank").select("source", "n", (F.col("rank") - 1).alias("grp"))
    leaves = looked_up(rows, sources, "source").select("grp", (F.col("place") - 1).alias("pos"), "n", "digest", "doc_id", "changed")

    below = _tree(leaves, most, fan)
    subroots = below[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(n_sources).cast("long").alias("n"), "digest")
    above = _tree(subroots, n_sources, fan)
    root = above[-1].first()["digest"]

    level = above[-1].select("grp", "pos", F.expr(NO_PATH).alias("path"), "digest")
    for nodes in reversed(above[:-1]):
        level = durable(paths(nodes, level.drop("digest"), fan).select("grp", "pos", "path", "digest"))
    level = level.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
    for i in reversed(range(1, len(below) - 1)):
        level = paths(below[i], level, fan).select("grp", "pos", "path", "subroot")
        level = durable(level) if i > 1 else level  # of the lowest the join with the leaves has the one copy
    if len(below) > 1:
        level = paths(leaves, level, fan)
    else:
        level = leaves.join(level.drop("pos"), "grp")
    folded = F.aggregate("path", F.coalesce("changed", "digest"), lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))
    out = level.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof(path: str = "path") -> Column:
    """The hash of a path's digests from leaf to root."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def tampered_fifth(doc_id: str = "doc_id") -> Column:
    """Does 5 divide the unsigned CRC-32 of the id's decimal? A missing id is not tampered with."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
