"""Cases of larger tables: what is searched, how rows are dealt out, how starts are numbered."""

import random
import re

from pyspark.sql import functions as F

from packetlens import config as C
from packetlens.functions import text as T
from packetlens.operators import boundaries as B
from packetlens.operators import segments as G
from packetlens.operators.scans import BLOCK
from packetlens.sources import packets as P


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_starts_are_those_of_all_pages(spark):
    """All signals of all pages were computed before pages that can't start were left out."""
    texts = [None, "", "a", "x: y", "Page 1 of 3", "page 01", "From: a\nTo: b\nSubject: c", "1", "001", "201", "21", "12\n7", "Page 9 of 9", "Page 7 of 7\nSincerely,", "INVOICE #7\nPage 1 of 1", "cc: a\nTo: b\nPage 2 of 3", "x" + "\n" * 20 + "1",
             "x" * 4994 + "\nPage 12", "x" * 4990 + "\nPage 12", "\n1/9", "3/01", "Dear x\n\nYours truly\nPage 1 of 2", "on 1/2/2024\nPage 1 of 2"]
    draw = random.Random(5)
    rows = [(p, i, draw.choice(texts)) for p in (1, 2) for i in range(400)]
    pages = spark.createDataFrame(rows, "packet_id long, page_no long, text string")
    for s in [make() for make in C.PRESETS.values()] + [C.HeuristicConfig(page_numbers=(r"\d$",))]:
        want = B.heuristic(pages, s, dense=True).where("boundary_type = 'document_start'").select("packet_id", "page_no", "confidence")
        want, got = (sorted(map(tuple, df.collect())) for df in (want, B.document_starts(pages, s)))
        assert got == want and got
    left = {r.text for r in pages.where(T.may_start(F.col("text"), C.HeuristicConfig())).collect()}
    assert not left & {None, "", "a", "21", "12\n7", "Page 9 of 9"} and {"x: y", "001", "page 01"} <= left


def test_lines_are_dealt_out_by_their_number(spark, monkeypatch):
    """Partitions were joined up to a size in bytes, so that tasks grew with the input."""
    sf = "/root/testdata/sf0.001"
    want = sorted(map(str, P.packets(spark, sf).pages.collect()))
    monkeypatch.setattr("packetlens.runtime.TASK_ROWS", 500)
    own = P.packets(spark, sf)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    assert own.parts == n > 4
    assert len(re.findall(rf"hashpartitioning\((?:l|o)_orderkey#\d+L, {n}\), REPARTITION_BY_NUM", _plan(own.pages))) == 2 == len(re.findall(r"Exchange hashpartitioning\(\w_orderkey", _plan(own.pages)))
    assert f", {n}), REPARTITION_BY_NUM" in _plan(B.signals(own.pages, dense=True, parts=own.parts)).split("_orderkey")[0]
    assert sorted(map(str, own.pages.collect())) == want


def test_starts_are_numbered_over_blocks(spark):
    draw = random.Random(3)
    found = [(p, draw.randrange(n), round(draw.random(), 2)) for p, n in ((1, 9 * BLOCK), (2, BLOCK), (3, 40 * BLOCK)) for _ in range(60)] + [(1, 5, 0.5), (1, 5, 0.25), (3, BLOCK, 0.5), (3, 0, 0.75)]
    ends = {1: 8 * BLOCK, 2: BLOCK, 3: 41 * BLOCK, 4: 7}
    starts = spark.createDataFrame(found, "packet_id long, page_no long, confidence double")
    ends_df = spark.createDataFrame(list(ends.items()), "packet_id long, n long")
    for corrected in (False, True):
        want = []
        for p, n in ends.items():
            own = sorted((a, c) for q, a, c in found if q == p)
            own = [(0, 1.0), *own] if corrected and not any(a == 0 for a, _ in own) else own
            nexts = [a for a, _ in own[1:]] + [n]
            want += [(p, i, a, b - 1, c) for i, ((a, c), b) in enumerate(zip(own, nexts, strict=False), 1) if a <= b - 1]
        assert sorted(map(tuple, G.segments(starts, None, corrected, ends_df).collect())) == sorted(want)


def test_texts_are_measured_before_they_meet_segments(spark):
    from packetlens import plans

    plan = _plan(plans.QUERIES["segment_text"](spark, "/root/testdata/sf0.001"))
    assert "sum(length(" not in plan and "sum(n#" in plan
