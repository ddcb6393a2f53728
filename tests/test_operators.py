"""Golden cases and traps of the page operators."""

import pytest
from pyspark.sql import functions as F

from packetlens import config as C
from packetlens.functions import text as T
from packetlens.functions import vector as V
from packetlens.operators import analytics as A
from packetlens.operators import boundaries as B
from packetlens.operators import evaluate as E
from packetlens.operators import layout as L
from packetlens.operators import limits
from packetlens.operators import model as M
from packetlens.operators import segments as G
from packetlens.operators import sessions as S


def pages(spark, *texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "packet_id long, page_no long, text string")


def only(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pair(spark, before, after, settings=None):
    return B.heuristic(pages(spark, before, after), settings, every=True).first()


def test_keyword_email_numbering_and_terminal(spark):
    r = pair(spark, "Some page\nof text", "MEMORANDUM\nTo all staff")
    assert r.document_keywords == 0.9 and r.confidence > 0.6
    r = pair(spark, "x", "From: a@b.c\nTo: d@e.f\nSubject: hi")
    assert r.email_header == 0.95 and r.confidence > 0.8 and r.boundary_type == "document_start"
    r = pair(spark, "text\nPage 10 of 10", "text\nPage 1 of 5")
    assert r.page_numbering == 0.95 and r.confidence > 0.8
    assert pair(spark, "a\nb\nc\npage 12", "d\ne\nf\npage 1").page_numbering == 0.9  # `Page 1 ` counts by case
    r = pair(spark, "Sincerely\nA. Person", "INVOICE 7")
    assert r.terminal_phrases == 0.7 and r.confidence > 0.4 and r.boundary_type == "document_end"


def test_blank_lines_of_the_page_before(spark):
    r = pair(spark, "one line" + "\n" * 20, "next")
    assert r.whitespace_end == 0.8 and r.whitespace_start == 0.0
    r = pair(spark, "\n" * 9 + "low", "next")
    assert r.whitespace_start == 0.6 and r.whitespace_end == 0.0
    assert pair(spark, "next", "\n" * 9 + "low").whitespace_start == 0.0


def test_many_signals_boost_and_no_pattern_is_no_error(spark):
    r = pair(spark, "Best regards", "MEMORANDUM\n01/02/2024\nPage 1 of 3")
    assert sum(r[k] > 0 for k in C.SIGNALS) >= 3 and r.confidence > 0.8
    assert pair(spark, "a", "INVOICE", C.HeuristicConfig({})).confidence == 0.0
    assert pair(spark, "a page", "another page", C.HeuristicConfig(minimum=0.8)).boundary_type == "page_continuation"


def test_pairs(spark):
    assert B.heuristic(pages(spark, *"abcd"), every=True).count() == 3
    assert B.heuristic(pages(spark, "a"), every=True).count() == 0


def test_zero_confidence_threshold_means_the_default(spark):
    rows = spark.createDataFrame([(0.6,), (0.9,)], "confidence double")
    assert B.confident(rows, "heuristic", 0.0).count() == 1 and B.confident(rows, "llm", 0.5).count() == 2


def starts(spark, *found):
    return spark.createDataFrame([(0, p, 0.9) for p in found], "packet_id long, page_no long, confidence double")


@pytest.mark.parametrize(("n", "found", "want"), [(10, range(10), [(i, i) for i in range(10)]), (10, [], []), (10, [0, 5, 5], [(0, 4), (5, 9)]), (4, [0], [(0, 3)]), (5, [10], []), (100, range(100), [(i, i) for i in range(100)])])
def test_segments(spark, n, found, want):
    schema_rows = starts(spark, *found) if found else starts(spark, 0).limit(0)
    got = G.segments(schema_rows, pages(spark, *["t"] * n)).orderBy("start_page").collect()
    assert [(r.start_page, r.end_page) for r in got] == want


def test_a_dropped_segment_keeps_its_number(spark):
    got = G.segments(starts(spark, 0, 5, 5), pages(spark, *["t"] * 10)).orderBy("start_page").collect()
    assert [r.segment_no for r in got] == [1, 3]
    assert [(r.start_page, r.end_page) for r in G.segments(starts(spark, 4), pages(spark, *["t"] * 6), corrected=True).orderBy("start_page").collect()] == [(0, 3), (4, 5)]


def test_names_and_dates(spark):
    lit = F.lit
    assert not set('<>:"/\\|?*') & set(only(spark, T.safe_name(lit('Invoice #12345\n<>:"/\\|?*.pdf'))))
    assert only(spark, T.date_of(lit("March 15, 2024"))) == "2024-March-15" and only(spark, T.date_of(lit("15 March 2024"))) == "2024-15-March"
    assert only(spark, T.date_of(lit("due 3/7/2024"))) == "2024-03-07" and only(spark, T.date_of(lit("none"))) is None
    assert only(spark, T.document_type(lit("agreement and conclusion"))) == "Contract"  # a tie: the earlier type
    assert only(spark, T.document_type(lit("nothing"))) == "Document"
    assert only(spark, T.suggested_name(lit("Invoice"), lit(None).cast("string"), lit(None).cast("string"), lit(7))) == "invoice_007.pdf"
    assert len(only(spark, T.safe_name(lit("a" * 300 + ".pdf")))) == 254
    assert only(spark, T.strict_name(lit(".."))) == "document" and only(spark, T.strict_name(lit("a b__c?"))) == "a_b_c_"
    assert only(spark, T.duration(lit(90061))) == "1d 1h 1m" and only(spark, T.duration(lit(5))) == "< 1m" and only(spark, T.duration(lit(65), True)) == "1m 5s"


def test_text_of_other_scripts(spark):
    assert only(spark, T.special_share(F.lit("über!"))) == pytest.approx(0.2)
    assert only(spark, T.semantic(F.lit("  a \n\n b "))) == "a b"
    assert only(spark, T.jaccard(F.lit("A b"), F.lit("b C"))) == pytest.approx(1 / 3) and only(spark, T.jaccard(F.lit(""), F.lit("b"))) == 0.0
    assert only(spark, T.confidence(F.lit("  "), F.lit(9))) == 0.0


def test_similarity_of_zero_vectors(spark):
    rows = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0])], "packet_id long, page_no long, embedding array<float>")
    a, b = B.by_similarity(rows).orderBy("page_no").collect()
    assert a.similarity != a.similarity and a.boundary_type == "page_continuation" and a.confidence == 1.0
    assert b.similarity == 0.0 and b.boundary_type == "document_start"
    assert only(spark, V.image_likeness(F.array(F.lit(0), F.lit(255)), F.array(F.lit(0), F.lit(0)))) == 0.5


def test_even_window_is_refused(spark):
    with pytest.raises(ValueError):
        B.context(pages(spark, "a"), 4)


def test_violations_and_edits(spark):
    seg = spark.createDataFrame([(0, 1, 0, 4, 0.9), (0, 2, 4, 9, 0.5), (0, 3, 10, 12, 1.5)], "packet_id long, segment_no int, start_page long, end_page long, confidence double")
    got = {r.segment_no: r.violations for r in G.violations(seg, pages(spark, *["t"] * 11)).collect()}
    assert got == {2: ["overlap"], 3: ["beyond", "confidence"]}
    one = G.merge(seg, F.when(F.col("segment_no") < 3, F.lit(1))).orderBy("start_page").collect()
    assert (one[0].start_page, one[0].end_page, one[0].confidence) == (0, 9, 0.5) and len(one) == 2
    two = G.split(seg, F.when(F.col("segment_no") == 1, F.lit(2))).orderBy("start_page", "part").collect()
    assert [(r.start_page, r.end_page) for r in two] == [(0, 1), (2, 4), (4, 9), (10, 12)]
    added = G.with_segment(seg.withColumn("suggested_filename", F.lit("x.pdf")), spark.createDataFrame([(0, 4, 13, 14)], "packet_id long, segment_no int, start_page long, end_page long")).where("is_user_defined").first()
    assert added.suggested_filename == "segment_14_15.pdf" and added.confidence == 1.0


def test_sessions(spark):
    log = spark.createDataFrame([(1, 1, 10, "modified"), (2, 1, 20, "completed"), (3, 1, 30, "confirmed"), (4, 1, 40, "completed"), (5, 2, 10, "completed")], "event_id long, s long, at long, status string")
    got = {r.s: (r.status, r.refused) for r in S.replayed(log, "s", "at", F.col("status")).collect()}
    assert got == {1: ("completed", 1), 2: ("pending", 1)}
    assert {r.event_id for r in S.illegal(log, "s", "at", F.col("status")).collect()} == {2, 3}


def test_limits():
    log, core = limits.SlidingLog(1, 10), limits.SlidingLog(1, 10, inclusive=True)
    assert [log.allow(t) for t in (0, 5, 10, 10.5)] == [True, False, False, True]
    assert [core.allow(t) for t in (0, 5, 10, 10.5)] == [True, False, True, False]
    assert [limits.FixedWindow(2, 10).allow(0)] == [True]
    fixed, bucket = limits.FixedWindow(1, 10), limits.TokenBucket(1, 0.5)
    assert [fixed.allow(t) for t in (3, 12, 13)] == [True, False, True]
    assert [bucket.allow(t) for t in (0, 1, 2.5, 3)] == [True, False, True, False]


def test_percentiles_are_picked_by_place(spark):
    rows = spark.range(10).select(F.lit("e").alias("e"), F.col("id").cast("double").alias("v"), F.col("id").alias("event_id"), F.col("id").alias("ts"))
    r = A.endpoint_performance(rows, "e", "v", F.col("v") > 8).first()
    assert (r.p50, r.p95, r.errors) == (5.0, 9.0, 1)


def test_metrics_without_positives(spark):
    r = E.metrics(spark.createDataFrame([(False, False)], "p boolean, t boolean"), F.col("p"), F.col("t")).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_tables_fold(spark):
    rows = spark.createDataFrame([(1, float(y), "a") for y in (0, 0, 3, 10, 12, 14.5, 30, 33)], "page long, y0 double, text string")
    r = L.tables(rows).first()
    assert (r.n_rows, r.most_columns, r.is_table) == (4, 3, True)  # 0 0 | 3 | 10 12 14.5 | 30 33


def test_answers(spark):
    said = lambda t: tuple(only(spark, c) for c in M.parsed(F.lit(t)).values())
    assert said("<thinking>" + "long " * 9 + "</thinking><answer>different</answer>")[:2] == (True, 0.95)
    assert said("<answer>SAME</answer>") == (False, 0.65, "No reasoning provided") and said("they are DIFFERENT") == (True, 0.7, "Inferred from response")
    assert said("<answer>perhaps</answer>") == (False, 0.5, "Uncertain response") and said("")[1] == 0.0 and said("no idea") == (False, 0.0, "Invalid response format")


def test_model_errors_become_rows(spark):
    pairs = spark.createDataFrame([("k", "p")], "key string, prompt string")

    def broken(prompt):
        raise RuntimeError("offline")

    r = M.answered(pairs, broken).first()
    assert r.response is None and r.error == "offline"


def test_settings_in_layers(monkeypatch):
    monkeypatch.setenv("PACKETLENS_TOP_LINES", "9")
    s = C.ModelConfig.layered({"top_lines": 3, "bottom_lines": 4}, bottom_lines=None, cache_days=2)
    assert (s.top_lines, s.bottom_lines, s.cache_days) == (9, 4, 2)
    with pytest.raises(ValueError):
        C.ModelConfig.layered(boundary_high=2.0)


def test_ground_truth(spark, tmp_path):
    from packetlens.sources import packets as P

    (tmp_path / "t.json").write_text('{"documents": [{"pages": "1-4"}, {"pages": "5"}, {"pages": "6-9"}, {"pages": "10-12"}]}')
    assert sorted(r.page for r in P.ground_truth(spark, str(tmp_path / "t.json")).collect()) == [4, 9]
    chunks = spark.createDataFrame([("a", 1, 2, b"cd"), ("a", 0, 2, b"ab"), ("b", 0, 2, b"x")], "file_id string, chunk_number int, total_chunks int, data binary")
    assert [(r.file_id, bytes(r.content)) for r in P.joined_chunks(chunks).collect()] == [("a", b"abcd")]
    (tmp_path / "x.pdf").write_bytes(b"1234")
    assert P.binary_files(spark, str(tmp_path)).first().is_valid
