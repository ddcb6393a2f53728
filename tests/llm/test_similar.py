"""Near copies by Jaccard similarity against all pairs of sets."""

import pytest

import corpus_pipeline as C
from packetlens.llm import similar, simhash

from . import brute


def groups(texts):
    """The smallest position of each text's group."""
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def texts_of(n, edits):
    words = [f"w{i}" for i in range(n)]
    for e in edits:
        words[e] = f"x{e}"
    return " ".join(words)


EDITED = [texts_of(120, ()), texts_of(120, (50,)), texts_of(120, (50, 90)), texts_of(120, (20, 50, 90)), texts_of(120, (10, 30, 60, 80, 100)), "a b", "A  b", "a c", ""]


@pytest.mark.parametrize("hot_key, part", [(64, 256), (1, 2), (4, 8)])
def test_near_copies_are_all_found(spark, hot_key, part):
    table = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts = EDITED + table
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component for r in similar.near_copies(docs, hot_key=hot_key, part=part).collect()}
    want = groups(texts)
    assert len(got) == len(texts) and len(set(want)) == len(set(got.values())) == len({(want[i], got[i]) for i in got})


def test_stage_drops_edited_copies(spark):
    """One edited word leaves most five-word shingles but more than three bits of the SimHash differ."""
    texts = [texts_of(120, ()), texts_of(120, (50,)), "another text of its own with more than five words"]
    a, b = (brute.fingerprint(t) for t in texts[:2])
    assert bin(a ^ b).count("1") > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in C.near_dedup(spark, docs, "").collect()) == [0, 2]
    assert C.near_dedup(spark, docs.limit(0), "").count() == 0


def family(n, base, seed):
    """Copies of one text of 220 words, each with one or two words of its own."""
    words = [f"{base}{i}" for i in range(220)]
    return [" ".join(words[: 7 + i % 31] + [f"{base}own{seed}x{i}"] + words[8 + i % 31 : 40 + i % 29] + [f"{base}too{i % 50}"] + words[41 + i % 29 :]) for i in range(n)]


def dealt_rows(spark, n, part, monkeypatch):
    """How many sets are dealt to tasks in the two rounds for a family of n copies beside a smaller one, and the groups."""
    texts = family(n, "a", 0) + family(n // 8, "b", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen, real = [], similar._links_of
    monkeypatch.setattr(similar, "_links_of", lambda rows, dealt: (seen.append(dealt.count()), real(rows, dealt))[1])
    got = {r.doc_id: r.component for r in similar.near_copies(docs, part=part).collect()}
    monkeypatch.undo()
    assert len({got[i] for i in range(n)}) == 1 and len({got[i] for i in range(n, len(texts))}) == 1 and got[0] != got[n]
    return sum(seen)


def test_a_family_of_copies_costs_in_proportion_to_its_size(spark, monkeypatch):
    few, many = (dealt_rows(spark, n, 16, monkeypatch) for n in (400, 3200))
    assert many < 12 * few, (few, many)  # by pairs of parts it would be 64 times
