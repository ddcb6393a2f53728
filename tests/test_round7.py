"""Cases of larger tables: what stays on the disk, and how often a text moves."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from packetlens import config as C
from packetlens import plans
from packetlens import runtime as R
from packetlens.operators import boundaries as B
from packetlens.operators import segments as G
from packetlens.operators.scans import with_neighbour
from packetlens.sources import archives as Z


def _shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    return {f for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_what_is_stored_leaves_no_shuffle_files(spark):
    """Shuffles stayed until the driver collected garbage."""
    rows = spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("some"))
    before, setting = _shuffle_files(spark), spark.conf.get(R.CLEANUP_SETTING)
    found = R.stored(rows.repartition(3, "text").groupBy(F.col("id") % 100 == 0).agg(F.count("*").alias("n"), F.count("some").alias("some")).repartition(2, "n"))
    for _ in range(50):
        if left := _shuffle_files(spark) - before:
            time.sleep(0.2)
    assert not left and spark.conf.get(R.CLEANUP_SETTING) == setting
    assert sorted((r.n, r.some) for r in found.collect()) == [(50, 33), (4950, 3300)] and found.schema["n"].dataType.simpleString() == "bigint"
    assert not R.stored(rows.where("id < 0")).count()


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_small_archives_share_files(spark, tmp_path, kind):
    """Each archive was a file of its own, which takes whole blocks of the disk."""
    rows = [(i % 3, i, f"m{i}.txt", bytes([i % 256]) * (Z.VOLUME_BYTES if i == 70 else i * 7 % 500), None) for i in range(200)]
    members = spark.createDataFrame(rows, "packet_id long, position long, name string, content binary, metadata string")
    path = str(tmp_path / "out")
    Z.write_archives(members, path, 1000, compress="false", volumes="true", format=kind)
    listed = Z.manifest(spark, path).collect()
    files = [f for f in os.listdir(path) if not f.startswith((".", "manifest"))]
    assert len({r.archive for r in listed}) > 20 >= len(files) and [f for f in files if f.startswith("packet")] == [r.archive for r in listed if r.position == 70]
    got = {(r.packet_id, r.position): bytes(r.content) for r in Z.read_members(Z.manifest(spark, path), path).collect()}
    assert got == {(p, i): c for p, i, _, c, _ in rows}


@pytest.mark.parametrize("small", [True, False])
def test_archives_of_ranges_are_those_of_their_texts(spark, tmp_path, monkeypatch, small):
    """Texts went through a join, an aggregate, a scan and a shuffle by archive; now through one exchange. Ranges begin and end anywhere in blocks and over several."""
    monkeypatch.setattr(Z, "BLOCK", 7)
    if not small:
        monkeypatch.setattr(Z, "SMALL_ROWS", 0)
    draw, ranges, pages = random.Random(11), [], []
    for packet, n in ((1, 400), (2, 60), (3, 7), (4, 1), (5, 30)):
        pages += [(packet, i, None if draw.random() < 0.1 else "é" * draw.randrange(4) + "x" * draw.randrange(9)) for i in range(n)]
        at, position = draw.randrange(3) if n > 7 else 0, 0
        while at < n and packet != 5:
            last = min(n - 1, at + draw.choice([0, 0, 1, 3, 6, 20]))
            position += 1
            ranges.append((packet, position, at, last))
            at = last + 1
    text = {(p, i): t for p, i, t in pages}
    want, upto = {}, {}
    for p, k, a, b in ranges:
        content = "\f".join(t for i in range(a, b + 1) if (t := text[p, i]) is not None).encode()
        want[p, k] = (upto.get(p, 0) // 40, f"s{k}", content)
        upto[p] = upto.get(p, 0) + len(content)
    path = str(tmp_path / "out")
    ranges, pages = spark.createDataFrame(ranges, "packet_id long, position int, start_page long, end_page long"), spark.createDataFrame(pages, "packet_id long, page_no long, text string").repartition(5)
    Z.write_ranges(ranges, pages, F.format_string("s%d", "position"), path, 40, compress="false", volumes="true")
    got = {(r.packet_id, r.position): (r.archive_no, r.name, bytes(r.content)) for r in Z.read_members(Z.manifest(spark, path), path).collect()}
    assert got == want and len({(p, no) for (p, _), (no, _, _) in want.items()}) > 20


@pytest.mark.parametrize("step", [-1, 1])
def test_rows_that_follow_are_met_over_blocks(spark, step):
    sizes = {1: 100, 2: 8, 3: 1, 4: 9}
    rows = spark.createDataFrame([(k, i, None if i % 5 == 3 else f"{k}-{i}") for k, n in sizes.items() for i in range(n)], "k long, p long, v string").repartition(4)
    value = {(r.k, r.p): r.v for r in rows.collect()}
    got = with_neighbour(rows, "k", "p", {"near": "v"}, step, 8, following=("run", "v", 3)).collect()
    assert len(got) == len(value)
    for r in got:
        assert r.run == [value.get((r.k, r.p + i)) for i in range(3)] and r.near == value.get((r.k, r.p + step)) and r.has_neighbour == ((r.k, r.p + step) in value)


def test_names_come_from_what_is_kept_with_starts(spark):
    """All texts met the segments in a join and an aggregate of their own."""
    draw = random.Random(2)
    texts = ["From: a\nTo: b\nSubject: Invoice\nInvoice #12 total", "Agreement between\nPage 1 of 3", "Date: 1/2/2024\nPage 9 of 9", "report 3/4/2023", "", "Dear x\nSincerely,", "contract\nFrom: a\nTo: c", "x" * 6000 + "\ninvoice 2024-01-02", None]
    rows = [(p, i, draw.choice(texts)) for p, n in ((1, 300), (2, 40), (3, 2)) for i in range(n)]
    pages = spark.createDataFrame(rows, "packet_id long, page_no long, text string").repartition(3)
    first = B.document_starts(pages, parts=3, opening=G.NAMED_BY)
    found = G.segments(first, pages)
    assert {r.n for r in found.select((F.col("end_page") - F.col("start_page") + 1).alias("n")).distinct().collect()} >= {1, 2, 3, 4}
    want, got = (sorted(map(str, df.select(*found.columns, "document_type", "date", "identifier", "suggested_filename", "summary").collect())) for df in (G.named(found, pages), G.named(found, None, first)))
    assert want == got and len(got) > 50
    plain = B.document_starts(pages, C.HeuristicConfig())
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, first.drop("opening").collect()))


@pytest.mark.parametrize("name", ["segment_names", "unique_filenames"])
def test_no_page_is_shuffled_for_names(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "l_orderkey" not in plan and " text#" not in plan
