"""Running sums along an order, edits that follow each other, reuse of cached pages, alerts and waits: plain versions and small cases."""

import json
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.operators import alerts as A
from packetlens.operators import caching as C
from packetlens.operators import edits as E
from packetlens.operators import limits as L
from packetlens.operators import ratios as R
from packetlens.operators import scans


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_running_sums_and_products(spark):
    data = [(k, m, i, (i * 7919 + 3) % 1009) for k, m, n in ((None, 1, 40), ("a", None, 1), ("b", 1, 900), ("b", 2, 50), ("c", 1, 3)) for i in range(n)]
    p = scans.Product("e", 1_000_003, 2147483629)
    rows = spark.createDataFrame(data, "k string, m long, i long, e long").repartition(7)
    got = scans.running(rows, ["k", "m"], ["i"], "n", {"s": "e"}, {"v": p})
    want, groups = [], {}
    for k, m, i, e in data:
        n, total, v = groups.get((k, m), (0, 0, 0))
        groups[k, m] = n + 1, total + e, (v + e * pow(p.base, n, p.prime)) % p.prime
        want.append((k, m, i, e, *groups[k, m], v))
    assert ordered(got.collect()) == ordered(want)
    whole = scans.running(rows, None, ["k", "m", "i"], "n", {"s": "e"}).collect()
    assert sorted(r.n for r in whole) == list(range(1, len(data) + 1)) and max(r.s for r in whole) == sum(x[3] for x in data)
    assert scans.running(rows.limit(0), "k", ["i"]).count() == 0


FOUND = [(p, s, 10 * i, 10 * i + 9, 0.5 + i / 10, f"type{i}", f"{s}.pdf", "{}") for p in (1, 2) for i, s in enumerate("abc")]
EDIT = "packet_id long, edit_no long, edit string, segment_ids array<string>, at long, start_page long, end_page long, changes string, status string"


def edited(spark, *edits):
    rows = [(p, no, kind, ids, more.get("at"), more.get("start"), more.get("end"), json.dumps(more["changes"]) if "changes" in more else None, more.get("status", "modified")) for p, no, kind, ids, more in edits]
    left, log = E.in_order(spark.createDataFrame(FOUND, E.SEGMENT), spark.createDataFrame(rows, EDIT))
    return {(r.packet_id, r.segment_id): (r.start_page, r.end_page, round(r.confidence, 6), r.document_type, r.filename, json.loads(r.metadata)) for r in left.collect()}, {(r.packet_id, r.edit_no): r.reason or r.made for r in log.collect()}


def test_edits_follow_each_other(spark):
    left, log = edited(
        spark,
        (1, 3, "patch", ["e2b"], {"changes": {"document_type": "memo", "confidence": 0.9, "metadata": {"x": 1}, "start_page": 0}}),
        (1, 2, "split", ["e1"], {"at": 15}), (1, 1, "merge", ["b", "a"], {}), (1, 4, "remove", ["e2a"], {}), (1, 5, "add", [], {"start": 0, "end": 3}), (1, 6, "merge", ["e5", "e2b"], {}),
    )
    assert log == {(1, 1): "e1", (1, 2): "e2a,e2b", (1, 3): "e2b", (1, 4): "", (1, 5): "e5", (1, 6): "e6"}
    assert left[1, "e6"] == (0, 19, 0.9, None, None, {"merged_from": "e5,e2b"}) and left[1, "c"][5] == {}
    assert {k for k in left if k[0] == 1} == {(1, "e6"), (1, "c")} and {k for k in left if k[0] == 2} == {(2, s) for s in "abc"}


def test_split_keeps_and_patch_merges_metadata(spark):
    left, _ = edited(spark, (2, 1, "patch", ["c"], {"changes": {"metadata": {"x": 1, "y": 2}}}), (2, 2, "patch", ["c"], {"changes": {"metadata": {"y": 3}}}), (2, 3, "split", ["c"], {"at": 29}))
    assert left[2, "e3a"] == (20, 28, 0.7, "type2", None, {"x": "1", "y": "3", "split_from": "c"}) and left[2, "e3b"][:2] == (29, 29)
    assert left[1, "c"][4] == "c.pdf"


def test_refused_edits_change_nothing(spark):
    left, log = edited(
        spark, (1, 1, "merge", ["a"], {}), (1, 2, "merge", ["a", "z"], {}), (1, 3, "split", ["a"], {"at": 0}), (1, 4, "split", ["a"], {}), (1, 5, "remove", ["z"], {}), (1, 6, "paint", ["a"], {}),
        (1, 7, "remove", ["a"], {"status": "confirmed"}), (1, 8, "add", [], {"start": 5, "end": 4}), (1, 9, "patch", ["a"], {"changes": {"confidence": 2}}), (1, 10, "merge", ["a", "a"], {}), (9, 1, "remove", ["a"], {}),
    )
    assert len(left) == len(FOUND) and left[1, "a"] == (0, 9, 0.5, "type0", "a.pdf", {})
    assert list(log.values()).count("segment not found") == 4 and log[1, 7] == "session is confirmed" and log[1, 1] == "at least 2 segments required"
    assert log[1, 3] == log[1, 4] == "page outside the segment" and log[1, 6] == "unknown edit" and log[1, 8] == "no range of pages" and log[1, 9] == "confidence outside 0 to 1"


def test_no_edits_or_no_segments(spark):
    assert edited(spark)[0].keys() == {(p, s) for p in (1, 2) for s in "abc"}
    none = spark.createDataFrame([], E.SEGMENT)
    left, log = E.in_order(none, spark.createDataFrame([(1, 1, "remove", ["a"], None, None, None, None, "pending")], EDIT))
    assert left.count() == 0 and log.first().reason == "segment not found"


class Lru:
    """A cache that keeps what was used last, as a program holds it."""

    def __init__(self, budget):
        self.b, self.held, self.evictions, self.log = budget, OrderedDict(), 0, []

    def access(self, key, size, t):
        b, out = self.b, "miss"
        if key in self.held:
            out = "expired" if b.seconds is not None and t - self.held[key][1] > b.seconds else "hit"
            if out == "hit":
                self.held.move_to_end(key)
                return self.log.append(out)
            del self.held[key]
            self.evictions += 1
        while self.held and (b.memory is not None and sum(s for s, _ in self.held.values()) + size > b.memory or b.items is not None and len(self.held) >= b.items):
            self.held.popitem(last=False)
            self.evictions += 1
        self.held[key] = size, t
        return self.log.append(out)


BUDGETS = [C.Budget("a", memory=20), C.Budget("b", items=4, seconds=40), C.Budget("c"), C.Budget("d", memory=9, items=3, seconds=15), C.Budget("e", memory=3)]


@pytest.mark.parametrize("range_rows", [1, 7, 10_000])
def test_caches_of_all_budgets_from_one_log(spark, range_rows):
    rng = np.random.default_rng(5)
    keys = [None if k == 0 else int(k) for k in rng.zipf(1.4, 400) % 15]
    log = [(i, k, 1 + (k or 0) * 5 % 7, 1000 + 3 * i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(log, "event_id long, key long, size long, second long").repartition(3).withColumn("ts", F.timestamp_seconds("second"))
    plain = [Lru(b) for b in BUDGETS]
    for _, k, size, t in log:
        for c in plain:
            c.access(k, size, t)
    got = C.outcomes(df.drop("size"), "key", 1 + F.coalesce("key", F.lit(0)) * 5 % 7, "ts", ["second"], BUDGETS, range_rows).orderBy("event_id").collect()
    for b, c in zip(BUDGETS, plain, strict=True):
        assert [r[b.name] for r in got] == c.log, b
    sums = {r.budget: r for r in C.totals(df, "key", F.col("size"), "ts", ["second"], BUDGETS, range_rows).collect()}
    for b, c in zip(BUDGETS, plain, strict=True):
        r = sums[b.name]
        assert (r.hits, r.expired, r.evictions, r.held, r.held_size) == (c.log.count("hit"), c.log.count("expired"), c.evictions, len(c.held), sum(s for s, _ in c.held.values())), b


def test_cache_of_an_empty_log(spark):
    none = spark.createDataFrame([], "event_id long, key long, ts timestamp")
    assert C.reuse_distances(none, "key", F.lit(1), ["ts"]).count() == 0
    assert {(r.hits, r.evictions, r.held) for r in C.totals(none, "key", F.lit(1), "ts", ["ts"], BUDGETS).collect()} == {(0, 0, 0)}


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = row
        row = [0]
        for j, d in enumerate(b):
            row.append(last[j] + 1 if c == d else max(last[j + 1], row[j]))
    return row[-1]


def plain_ratio(a, b):
    return 1.0 if a == b else 2 * plain_common(a, b) / (len(a) + len(b))


def plain_partial(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return max([plain_ratio(short, long[i : i + len(short)]) for i in range(len(long) + 1)])


def test_ratios_against_the_plain_table():
    rng = np.random.default_rng(2)
    word = lambda n, k: "".join(rng.choice(list("abcdeé 😀x"[:k]), n))
    for _ in range(150):
        a, b = word(rng.integers(0, 90), int(rng.integers(2, 9))), word(rng.integers(0, 90), int(rng.integers(2, 9)))
        if rng.random() < 0.5 and a:
            b = b[:5] + a[3:] + b[:9]
        assert R.common(a, b) == plain_common(a, b) and R.ratio(a, b) == plain_ratio(a, b)
        assert abs(R.partial_ratio(a, b) - plain_partial(a, b)) < 1e-12, (a, b)


def test_text_accuracy(spark):
    rows = [(1, "Hello  World", "hello world"), (2, "the quick brown fox", "fox brown quick the quick"), (3, None, ""), (4, "abc", None), (5, "abcX", "zzabc"), (6, "ÉÈ", "éÀ"), (7, "word " * 8000, "word " * 7999 + "ward ")]
    got = {r.i: r for r in R.text_accuracy(spark.createDataFrame(rows, "i long, e string, a string"), "e", "a").collect()}
    assert (got[1].char_accuracy, got[1].word_f1, got[1].char_count_expected, got[1].char_count_actual) == (1.0, 1.0, 12, 11)
    assert got[2].token_accuracy == 1.0 and got[2].char_accuracy < 0.7 and (got[2].word_count_expected, got[2].word_count_actual) == (4, 5)
    assert got[3].char_accuracy == got[3].partial_accuracy == 1.0 and (got[4].char_accuracy, got[4].partial_accuracy, got[4].token_accuracy) == (0.0, 1.0, 0.0)
    assert got[5].partial_accuracy == 0.86 and got[6].token_accuracy == 0.0 and got[6].char_accuracy == 0.5 and got[7].char_accuracy == 1.0
    assert R.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0 and R.token_set_ratio("a b", "c d") == 2 / 6


def test_counters_that_start_again(spark):
    samples = [("a", 10 * i, v) for i, v in enumerate([0, 10, 20, 5, 15, 25])] + [("b", 0, 7), (None, 3, 1), (None, 13, 2)]
    df = spark.createDataFrame(samples, "k string, s long, v long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.k, r.s): (r.n, r.rate) for r in A.counter_rates(df, "k", "ts", "v", 30, 10).withColumn("s", F.unix_timestamp("at")).collect()}
    assert got["a", 30] == (3, pytest.approx((10 + 5) * 1.5 / 30)) and got["a", 50][1] == pytest.approx((10 + 10) * 1.25 / 30)  # 5 at 30 s; no more than to zero before it
    assert not [k for k in got if k[0] == "b"] and (None, 20) in got  # one sample has no rate; null is a series
    with pytest.raises(ValueError):
        A.counter_rates(df, "k", "ts", "v", 30, 20)


def test_alerts_fire_once_they_have_held(spark):
    breaches = [("a", i) for i in (1, 2, 3, 7, 8, 20)] + [("b", i) for i in range(100)]
    df = spark.createDataFrame(breaches, "k string, i long").select("k", F.timestamp_seconds(F.col("i") * 30).alias("at"), F.col("i").cast("double").alias("rate"))
    rows = A.alert_intervals(df, "k", F.col("rate") > 0.5, 60, 30)
    sec = lambda x: None if x is None else int(x.timestamp())
    got = sorted((r.k, sec(r.started), sec(r.firing_from), sec(r.ended), r.evaluations, r.peak) for r in rows.collect())
    assert got == [("a", 30, 90, 120, 3, 3.0), ("a", 210, None, 270, 2, 8.0), ("a", 600, None, 630, 1, 20.0), ("b", 30, 90, 3000, 99, 99.0)]
    assert A.alert_intervals(df.limit(0), "k", F.col("rate") > 0, 60, 30).count() == 0


def test_waits_against_a_plain_run(spark):
    rng = np.random.default_rng(9)
    log = [(i, "ab"[int(rng.integers(0, 2))], int(t), int(rng.integers(1, 5))) for i, t in enumerate(np.cumsum(rng.integers(0, 4, 300)))]
    df = spark.createDataFrame(log, "event_id long, k string, s long, need long").withColumn("ts", F.timestamp_seconds("s")).repartition(3)
    got = {r.event_id: r.wait for r in L.bucket_waits(df, "k", 3.0, 0.5, F.col("need")).collect()}
    active = {r.event_id: r.n_active for r in L.concurrency(df, "k", F.col("need") * 2).collect()}
    slots = {r.event_id: r.wait for r in L.slot_waits(df, "k", 2, F.col("need")).collect()}
    refused = {r.event_id: (r.allowed, r.wait) for r in L.refused_waits(df, "k", 3, 5.0).collect()}
    state = {k: [3.0, 0.0] for k in "ab"}
    free, kept = {k: [0.0, 0.0] for k in "ab"}, {k: [] for k in "ab"}
    for i, k, t, need in log:
        assert active[i] == sum(1 for j, q, s, n in log if q == k and j <= i and (j == i or s + 2 * n > t))
        first = min(free[k])
        assert slots[i] == pytest.approx(max(0.0, first - t))
        free[k][free[k].index(first)] = max(t, first) + need
        kept[k] = [x for x in kept[k] if x > t - 5]
        assert refused[i] == ((True, 0.0) if len(kept[k]) < 3 else (False, pytest.approx(kept[k][0] + 5 - t)))
        kept[k] += [t] * (len(kept[k]) < 3)
        if need > 3:
            assert got[i] is None
            continue
        tokens, at = state[k]
        start = max(at, t)
        tokens = min(3.0, tokens + (start - at) * 0.5)
        wait = max(0.0, (need - tokens) / 0.5)
        assert got[i] == pytest.approx(start + wait - t, abs=1e-6)
        state[k] = [tokens + wait * 0.5 - need, start + wait]
