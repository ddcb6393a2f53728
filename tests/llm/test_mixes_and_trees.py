"""Mixing, the prefix trie and the Merkle manifest: plain versions, SQL, and nulls, ties, repeated rows, long texts, skew, empty tables
and clashing names."""

import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from packetlens.llm import merkle, mixing, queries, trie

from . import brute

SF = "/root/testdata/sf0.001"
LONG = "Very LONG words " * 80_000  # over one piece of text
TEXTS = [(1, "a", "One two THREE"), (2, "a", None), (3, "b", ""), (3, "b", ""), (3, "b", "Other"), (None, "b", "no id"), (None, None, "neither"), (4, None, LONG), (5, "é", " \n\t "), (6, "z", "single"), *((i, "hot", f"Word {i} " * (i % 7)) for i in range(10, 400))]


def rows(df):
    return brute.order(tuple(r) for r in df.collect())


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in ("n", "row", "size", "place", "digest", "grp", "pos", "path", "depth", "a", "b", "v0", "content", "__first", "target")}).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, source string, text string").withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "n_chars": F.length("text").cast("long")})
    return clashing(df)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Mixing


def plain_targets(sizes, share=1.5, most=2):
    """Deals out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in out]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]


def plain_mix(table, seed=0):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in table]
    sizes = {s: sum(n for n, r in zip(size, table, strict=True) if r[1] == s) for s in {r[1] for r in table}}
    target = plain_targets(sizes)
    queue = []
    for s in sizes:
        own = sorted((hashlib.md5(f"{seed}|{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, j) for j, (i, x, _) in enumerate(table) if x == s)
        words = 0
        for copy in range(2):
            for draw, has, i, j in own:
                words += size[j]
                queue.append((words / target[s] if target[s] else 0.0, s is None, s or "", copy, draw, has, i, j))
    taken, at = [0] * len(table), 0
    for *_, j in sorted(queue):
        at += size[j]
        taken[j] += size[j] * (at <= sum(target.values()) + 1e-6)
    return [(i, n, sizes[s], target[s], k) for (i, s, _), n, k in zip(table, size, taken, strict=True)]


def rounded(table):
    return brute.order((*r[:3], round(r[3], 6), r[4]) for r in table)


def test_mixing(docs):
    table = [r for r in TEXTS if r[0] != 3 and r[2] != LONG and r[0] is not None]  # without ties by id
    got = mixing.shares(docs.where("doc_id is not null and doc_id <> 3 and length(text) < 1000000 or text is null"))
    assert rounded(map(tuple, got.collect())) == rounded(plain_mix(table))


def test_mixing_comes_near_its_targets(docs):
    whole = mixing.mixed(docs).cache()
    assert whole.count() == 2 * len(TEXTS)
    for r in whole.groupBy("source").agg(F.first("target").alias("t"), F.max("size").alias("most"), F.sum(F.col("taken").cast("long") * F.col("size")).alias("n"), F.first("source_size").alias("s")).collect():
        assert abs(r.n - r.t) <= max(r.most, 7) and r.t <= 2 * r.s
    again, first = (brute.order(map(tuple, mixing.shares(x).collect())) for x in (docs.repartition(2), docs))
    assert again == first and len(first) == len(TEXTS)
    other = mixing.mixed(docs, seed=1).orderBy("position").select("doc_id").collect()
    assert other != whole.orderBy("position").select("doc_id").collect()
    assert mixing.shares(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.shares(docs.where("doc_id in (2, 5)")).collect()} == {0}


# Prefix trie


def plain_trie(table):
    convs = {}
    for c, t, role, text in table:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, digest(f"{role or ''}\n{text or ''}"), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - c % 100, [])[:h] + v[h:]
    nodes, below = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for k in nodes:
        if k:
            below.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below.get(k, ())) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below.get(k, ()))
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(built[c]) == len(k))))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below.get(k, ())), leaves[k], saved[k], digest(ends)))
    return out


def conversations():
    out = [(c, t, ("user", "assistant")[t % 2], f"text {t} of {c % 3}") for c in (0, 1, 2, 5, 7, 99, 100, 103, 250, 251) for t in range(c % 9)]
    out += [(300, t, "user", f"long {t}") for t in range(400)]  # one conversation has most rows
    out += [(300 + k, t, "user", f"long {t}") for k in range(1, 40) for t in range(k)]  # each is the last one and a turn more
    out += [(1000 + k, t, None, None) for k in range(60) for t in (None, None, 3)]  # repeated rows, ties, nulls
    out += [(None, 0, "user", "of none"), (5000, 0, "user", "LONG é " * 200_000), (5001, 0, "user", "LONG é " * 200_000)]
    return out


def test_trie(spark):
    table = conversations()
    df = clashing(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"))
    assert rows(trie.trie(df).drop("turn")) == brute.order(plain_trie(table))
    assert trie.trie(df.limit(0)).count() == 0
    nowhere = df.where("conv_id is null")
    assert trie.trie(nowhere).count() == 0


def test_trie_takes_other_hashes_when_contents_meet(spark, monkeypatch):
    table = conversations()[:60]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    seen, real = [], trie._stored

    def meets(conversations, seed):
        seen.append(seed)
        if seed == 0:
            raise trie.Collision
        return real(conversations, seed)

    monkeypatch.setattr(trie, "_stored", meets)
    assert rows(trie.trie(df).drop("turn")) == brute.order(plain_trie(table)) and seen == [0, 1]
    monkeypatch.setattr(trie, "PRIMES", (7, 7, 7))  # of 50 unlike prefixes some meet under any seed
    monkeypatch.setattr(trie, "BASES", (8, 8, 8))
    unlike = spark.createDataFrame([(c, t, "user", f"{c} {t}") for c in range(50) for t in range(7)], "conv_id long, turn long, role string, text string")
    with pytest.raises(RuntimeError):
        trie.trie(unlike)


def test_trie_refers_to_stored_turns(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    for r in trie.trie(df).where("depth > 0").collect():
        assert r.turn.turn_place >= 1 and r.turn.turn_conv % 100 == 0 or r.turn.turn_conv >= r.conv_id


# Merkle manifest


def encoded(*fields):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_levels(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + fan])) for i in range(0, len(last), fan)])
    return levels


def plain_path(levels, at, fan):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // fan * fan :][:fan]
        out.append(("".join(run[: at % fan]), "".join(run[at % fan + 1 :])))
        at //= fan
    return out


def plain_manifest(table, fan=16):
    by = {}
    for row in table:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]) if row[4] is not None else None
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, encoded(*row), encoded(*row[:4], low), row[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[2] for x in sorted(by[s])], fan) for s in order}
    top = plain_levels([trees[s][-1][0] for s in order], fan)
    out = []
    for i, s in enumerate(order):
        for j, (_, _, leaf, changed, doc_id) in enumerate(sorted(by[s])):
            path = plain_path(trees[s], j, fan) + plain_path(top, i, fan)
            now = changed if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else leaf
            for left, right in path:
                now = digest(left + now + right)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return out


@pytest.mark.parametrize("fan", [16, 3])
def test_manifest(docs, fan):
    table = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle.manifest(docs, fan, merkle.tampered_fifth()).select("doc_id", "leaf", "subroot", "root", merkle.proof(), "folded_root", "verified")
    assert rows(got) == brute.order(plain_manifest(table, fan))
    assert merkle.manifest(docs.limit(0), fan).count() == 0


@pytest.mark.parametrize("where", ["source = 'z'", "source = 'hot'", "source in ('z', 'é')", "source is null"])
def test_manifest_of_few_sources(docs, where):
    few = docs.where(where)
    table = [tuple(r) for r in few.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle.manifest(few, tampered=merkle.tampered_fifth()).select("doc_id", "leaf", "subroot", "root", merkle.proof(), "folded_root", "verified")
    assert rows(got) == brute.order(plain_manifest(table))


def test_untampered_rows_verify(docs):
    assert merkle.manifest(docs).where("verified").count() == len(TEXTS)


# SQL


@pytest.mark.parametrize("name", ["op11_mixing", "op12_prefix_trie", "op13_merkle_manifest"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    same = lambda table: brute.order(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in table)
    assert same(map(tuple, got.collect())) == same(want.fetchall())
