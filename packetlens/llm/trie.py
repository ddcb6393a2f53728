"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation is rebuilt from the head of another one and its own later turns, but only as references to stored turns. The
fingerprint of turns is a product in a monoid (`Product`): a pair of their number and a polynomial of their contents' hashes,
modulo three primes. One scan gives the products of all stored prefixes; the rebuilt prefix is the head's product times the
own turns' product without the turns left out, which is arithmetic on numbers. Prefixes that share depth and fingerprint are a node.
That they are equal is verified: stored turns of one content hash by their whole role and text, and a node's members by the content
of the turn that each refers to and by their parents, from the root down. If two contents or prefixes meet in a hash, other ones are
taken.

A node belongs to its smallest member, whose nodes are a chain; a chain hangs on a node of another. Sums over subtrees are added
up from chain to chain in doubling steps, and within chains by a running sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.operators.scans import Product, running

from .common import durable, record_batch, releasing

#: The three largest primes below 2**31.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1_000_003, 998_244_353, 1_234_567_891)
#: A conversation takes its head from the first of its hundred, and so many turns less one at most.
GROUP, HEADS = 100, 6
#: Ids of a node that are handed on in one row, in bytes.
CHUNK_BYTES = 1 << 16
KEY = ["depth", "a", "b"]
NO_IDS = hashlib.sha256(b"").hexdigest()


class Collision(Exception):
    """Unlike contents or prefixes have one hash."""


def head_length(conv_id: Column, heads: int = HEADS) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % heads).cast("int")


def _any(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


def _stored(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, place, content, size, v0..v2, v0_before..) of every stored turn: its place in its conversation, and the products of
    the turns up to it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.xxhash64(F.lit(seed), role, text).alias("content"))
    alike = turns.groupBy("content").agg(*(f(F.struct("role", "text")).alias(n) for n, f in (("least", F.min), ("most", F.max))))
    if _any(alike.where("least <> most")):
        raise Collision
    turns = turns.select("conv_id", "turn", F.sha2(F.concat("role", F.lit("\n"), "text"), 256).alias("tie"), "content", F.char_length("text").cast("long").alias("size"), *(F.pmod("content", F.lit(p)).alias(f"e{i}") for i, p in enumerate(PRIMES)))
    products = {f"v{i}": Product(f"e{i}", b + seed, p) for i, (b, p) in enumerate(zip(BASES, PRIMES, strict=True))}
    return running(turns, "conv_id", [F.col("turn").asc_nulls_first(), "tie"], "place", products=products).drop("turn", "tie", *(f"e{i}" for i in range(len(PRIMES))))


def _packed(values: list[Column], names: tuple[str, str]) -> list[Column]:
    """Two numbers for three remainders."""
    return [(F.shiftleft(values[0], 31) + values[1]).alias(names[0]), values[2].alias(names[1])]


def _composed(i: int, seed: int) -> tuple[Column, Column]:
    """Remainder i of the head's product times the own turns' product up to a turn, and up to the one before it."""
    p, base = PRIMES[i], BASES[i] + seed
    inverse = F.array(*(F.lit(pow(base, -k, p)) for k in range(HEADS)))[F.col("h") - F.col("n_head")]
    return tuple(F.pmod(F.col(f"head{i}") + inverse * F.pmod(F.col(c) - F.col(f"skip{i}"), F.lit(p)), F.lit(p)) for c in (f"v{i}", f"v{i}_before"))


def prefixes(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: (conv_id, depth, a, b, parent_a, parent_b, content, size, turn_conv, turn_place,
    ends). a, b: the prefix's fingerprint; turn_conv, turn_place: the stored turn that is its last one; ends: the prefix is the
    whole conversation."""
    k, every = range(len(PRIMES)), [f"v{i}{x}" for i in range(len(PRIMES)) for x in ("", "_before")]
    turns = _stored(conversations, seed)
    h = head_length(F.col("conv_id")).alias("h")
    skipped = [F.coalesce(F.max(F.when(F.col("place") == F.col("h"), F.col(f"v{i}"))), F.lit(0)).alias(f"skip{i}") for i in k]
    convs = turns.withColumn("h", h).groupBy("conv_id", "h").agg(F.max("place").alias("n_own"), *skipped)
    # Of a base at most HEADS - 1 turns, joined by the conversations of its hundred.
    bases = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "content", "size", *every))).alias("turns"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(bases, "base", "left")
    convs = convs.withColumn("head", F.when(F.col("turns").isNotNull(), F.slice("turns", F.lit(1), F.col("h")))).withColumn("n_head", F.coalesce(F.size("head"), F.lit(0)))
    convs = convs.withColumn("n_head", F.greatest("n_head", F.lit(0)))
    last = F.when(F.col("n_head") > 0, F.element_at("head", -1))
    length = F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    convs = durable(convs.select("conv_id", "base", "h", "n_head", "head", length.cast("long").alias("length"), *(F.coalesce(last[f"v{i}"], F.lit(0)).alias(f"head{i}") for i in k), *(f"skip{i}" for i in k)))

    rest = ["content", "size", "turn_conv", "turn_place", (F.col("depth") == F.col("length")).alias("ends")]
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), "length", zero.alias("content"), zero.alias("size"), F.lit(None).cast("long").alias("turn_conv"), zero.alias("turn_place"))
    root = root.select("conv_id", "depth", *(zero.alias(c) for c in ("a", "b", "parent_a", "parent_b")), *rest)
    heads = convs.select("conv_id", "base", "length", F.explode("head").alias("t")).select("conv_id", F.col("base").alias("turn_conv"), "length", F.col("t.place").alias("depth"), F.col("t.place").alias("turn_place"), "t.*")
    heads = heads.select("conv_id", "depth", *_packed([F.col(f"v{i}") for i in k], ("a", "b")), *_packed([F.col(f"v{i}_before") for i in k], ("parent_a", "parent_b")), *rest)
    own = turns.join(convs.drop("head", "base"), "conv_id").where("place > h")
    both = [_composed(i, seed) for i in k]
    own = own.withColumns({"depth": (F.col("n_head") + F.col("place") - F.col("h")).cast("long"), "turn_conv": F.col("conv_id"), "turn_place": F.col("place")})
    own = own.select("conv_id", "depth", *_packed([x[0] for x in both], ("a", "b")), *_packed([x[1] for x in both], ("parent_a", "parent_b")), *rest)
    return durable(root.unionByName(heads).unionByName(own))


def _nodes(rows: DataFrame) -> DataFrame:
    """(depth, a, b, conv_id, n_convs, size, turn, parent_conv_id, n_children) of each node; its members are found equal or it is
    a Collision."""
    same = [f(c).alias(f"{n}_{c}") for c in ("content", "parent_a", "parent_b") for n, f in (("least", F.min), ("most", F.max))]
    nodes = durable(rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"), F.min(F.struct("turn_conv", "turn_place")).alias("turn"), *same))
    if _any(nodes.where("least_content <> most_content or least_parent_a <> most_parent_a or least_parent_b <> most_parent_b")):
        raise Collision
    nodes = nodes.select(*KEY, "conv_id", "n_convs", "size", "turn", F.col("least_parent_a").alias("up_a"), F.col("least_parent_b").alias("up_b"))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(up, ["depth", "up_a", "up_b"], "left").drop("up_a", "up_b")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    return durable(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def _hung(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, leaves, saved): what the chains that hang on a node sum up to, with all that hangs on them."""
    # A chain's first node alone has a parent of another chain.
    first = F.when(F.col("parent_conv_id") < F.col("conv_id"), F.col("parent_conv_id"))
    chains = nodes.groupBy("conv_id").agg(F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"), F.max(first).alias("up"), (F.min("depth") - 1).alias("at"))
    chains = durable(chains.withColumn("far", F.col("up")))
    while _any(chains.where("far is not null")):
        # far is the chain 1, 2, 4 .. steps up; leaves and saved are those of the chains less than so many steps below.
        gained = chains.where("far is not null").groupBy(F.col("far").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = chains.where("far is not null").select(F.col("conv_id").alias("far"), F.col("far").alias("further"))
        chains = chains.join(gained, "conv_id", "left").join(further, "far", "left")
        chains = durable(chains.select("conv_id", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")), "up", "at", F.col("further").alias("far")))
    return chains.where("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where conversations end. Ranges of a node's ids, in order, are written out in rows of bounded
    size; a task then reads a node's rows in order and keeps only the state of the hash."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i).to_numpy() for i in range(3)]
            ids = batch.column(3).to_numpy()
            new = np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0))
            cuts = np.append(np.flatnonzero(new), len(ids)).tolist()
            most = CHUNK_BYTES // 21
            parts = [(a, min(a + most, e)) for b, e in zip(cuts[:-1], cuts[1:], strict=True) for a in range(b, e, most)]
            at = np.array([a for a, _ in parts])
            yield record_batch(depth=key[0][at], a=key[1][at], b=key[2][at], first=ids[at], ids=[",".join(map(str, ids[a:e].tolist())) for a, e in parts])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if key == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = key, hashlib.sha256(ids.encode())
            if out:
                yield record_batch(**dict(zip(("depth", "a", "b", "ends_sha256"), map(list, zip(*out, strict=True)), strict=True)))
        if last is not None:
            yield record_batch(depth=[last[0]], a=[last[1]], b=[last[2]], ends_sha256=[state.hexdigest()])

    ends = rows.where("ends").select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    parts = ends.mapInArrow(releasing(chunks), "depth long, a long, b long, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(releasing(hashed), "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, seed: int = 0, seeds: int = 5) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn) for each distinct prefix of the rebuilt
    conversations of (conv_id, turn, role, text), the empty one included. turn: the stored turn that is the node's last one, as
    conversation and place.

    Conversation c is the first h turns of the first conversation of its hundred, h being a hash of c, and its own turns after the
    first h. Turns stand in order of their number, null first; turns of one number in order of the SHA-256 of role, line feed and text, so that rows that repeat are turns of
    their own. A null role or text is empty; rows without conv_id are of no conversation. A conversation may be rebuilt empty: it
    ends at the root. An empty table gives no rows; other columns are not read. Very long texts are read twice, to compare those of
    one hash and to hash them, and otherwise only counted; a conversation of very many turns is cut by ranges like any other rows.
    """
    for s in range(seed, seed + seeds):
        try:
            rows = prefixes(conversations, s)
            nodes = _nodes(rows)
            break
        except Collision:
            continue
    else:
        raise RuntimeError(f"contents met in a hash under {seeds} seeds")
    nodes = nodes.withColumns({"own_leaves": (F.col("n_children") == 0).cast("long"), "own_saved": (F.col("n_convs") - 1) * F.col("size")})
    nodes = nodes.join(_hung(nodes), ["conv_id", "depth"], "left")
    nodes = nodes.withColumns({c: F.col(f"own_{c}") + F.coalesce(c, F.lit(0)) for c in ("leaves", "saved")})
    nodes = running(nodes, "conv_id", [F.col("depth").desc()], "from_end", {"n_leaves": "leaves", "saved_tokens": "saved"})
    nodes = nodes.join(_ends(rows), KEY, "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"), "turn")
