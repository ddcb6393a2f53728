"""Plugged-in engines, images, the paged source, JSON records and streams."""

import numpy as np
from pyspark.sql import functions as F

from packetlens.functions import image as I
from packetlens.operators import contracts as K
from packetlens.operators import records as R
from packetlens.sources.paged import Paged
from packetlens.streaming import events as S


def test_images():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (64, 48)).astype(float)
    for h in (I.perceptual_hash, I.average_hash, I.difference_hash):
        assert h(a) == h(a.copy()) and h(a) != h(255 - a)
    assert I.structural_likeness(a, a)[0] > 0.999 > I.structural_likeness(a, 255 - a)[0]
    same = I.histogram_likeness(a, a)
    assert abs(same["correlation"] - 1) < 1e-9 and same["chi_square"] == 0
    assert 0 <= I.scan_quality(a) <= 1 and I.grey(np.ones((2, 2, 3))).shape == (2, 2)


def test_engines_fall_back(spark):
    df = spark.createDataFrame([(1, b"good"), (2, b"poor"), (3, b"none")], "id long, image binary")

    def first():
        def engine(data):
            if data == b"none":
                raise ValueError("unreadable")
            return [("text", 0.9 if data == b"good" else 0.1)]

        return engine

    def second():
        def engine(data):
            if data == b"none":
                raise ValueError("unreadable")
            return [("better", 0.6)]

        return engine

    got = {r.id: (list(r.lines), r.error) for r in K.recognised(df, [first, second]).collect()}
    assert got == {1: (["text"], None), 2: (["better"], None), 3: ([], "unreadable")}
    pages = spark.createDataFrame([("a", 0, "x")], "packet_id string, page_no long, text string")
    assert bytes(K.rendered(pages, lambda: lambda p, n, dpi: f"{p}{n}{dpi}".encode()).first().image) == b"a0150"
    assert K.embedded(pages, lambda: lambda texts: [[float(len(t))] for t in texts]).first().embedding == [1.0]


def test_hash_column(spark):
    df = spark.createDataFrame([(bytes(range(256)),), (None,), (b"x",)], "image binary")
    decode = lambda data: np.frombuffer(data, np.uint8).reshape(16, 16).astype(float)
    got = [r.h for r in df.select(I.hashes(decode)("image").alias("h")).collect()]
    assert got[0].phash is not None and got[1].phash is None and got[2].phash is None


def test_paged_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.txt").write_text("three")
    spark.dataSource.register(Paged)
    assert sorted(r.text for r in spark.read.format("paged").load(str(tmp_path)).collect()) == ["one", "three", "two"]


def test_records(spark):
    rows = spark.createDataFrame([(1, "s", 0, 3, "Invoice"), (1, "t", 4, 5, "Letter")], "packet_id long, segment_id string, start_page long, end_page long, document_type string")
    back = R.proposal_rows(R.proposals(rows)).select(*rows.columns).orderBy("start_page").collect()
    assert back == rows.orderBy("start_page").collect()
    log = spark.createDataFrame([(1, 1, "s", "a", "subscribe"), (2, 2, "s", "a", "unsubscribe"), (3, 3, "s", "b", "subscribe"), (4, 4, "s", "c", "subscribe")], "event_id long, ts long, session_id string, client_id string, action string")
    out = R.fanned_out(spark.createDataFrame([("s", "hi")], "session_id string, message string"), R.subscriptions(log), spark.createDataFrame([("s", "c")], "session_id string, client_id string"))
    assert [r.client_id for r in out.collect()] == ["b"]
    m = spark.range(1).select(R.with_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first().m
    assert m == {"a": "1", "b": "3"}


def test_upsert_stream_is_repeatable(spark, tmp_path):
    write = S.upsert_into(str(tmp_path / "state"), "k", "at")
    rows = lambda *r: spark.createDataFrame(r, "k long, at long, v string")
    write(rows((1, 1, "a"), (2, 1, "b")), 0)
    for _ in range(2):
        write(rows((1, 2, "c")), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "state/1")).collect()) == [(1, "c"), (2, "b")]
