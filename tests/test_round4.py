"""Cases of larger tables: what a query reads, sorts and shuffles no more than once."""

import re

import duckdb
from pyspark.sql import functions as F

from packetlens.functions import text as T
from packetlens.operators import segments as G
from packetlens.sources import packets as P


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_sorted_once(spark):
    """They were sorted three times, and shuffled again for customers that are not broadcast."""
    pages = P.packets(spark, "/root/testdata/sf0.001").pages
    assert len(re.findall(r"Sort \[l_orderkey", _plan(pages))) == 1 and len(re.findall(r"\bWindow \[", _plan(pages))) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", _plan(pages))) == 1


def test_repeated_orders_and_customers_have_their_pages(spark, tmp_path):
    con = duckdb.connect()
    rows = {
        "orders": "SELECT CAST(k AS BIGINT) AS o_orderkey, CAST(c AS BIGINT) AS o_custkey, TIMESTAMP '2024-01-01' AS o_orderdate FROM (VALUES (1, 3), (1, 23), (1, 4), (1, 3), (2, 3), (3, 4), (9, 3), (5, 77), (NULL, 3), (6, NULL)) v(k, c)",
        "customer": "SELECT CAST(c AS BIGINT) AS c_custkey, 'n' || c AS c_name FROM (VALUES (3), (4), (4), (23)) v(c)",
        "lineitem": "SELECT CAST(k AS BIGINT) AS l_orderkey, CAST(n AS INTEGER) AS l_linenumber, CAST(k * 7 + n AS BIGINT) AS l_partkey, 5::BIGINT AS l_suppkey, 2.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'R' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '2024-01-02' AS l_shipdate FROM (VALUES (1, 1), (1, 2), (1, 3), (2, 1), (2, 1), (3, 1), (3, 2), (4, 1), (5, 1), (6, 1), (NULL, 1)) v(k, n)",
    }
    for t, sql in rows.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    fixed = "packet_id, doc_key, page_no, npages"
    want = con.execute(f"SELECT {fixed} FROM ({P.packet_oracle()})").fetchall()
    own = P.packets(spark, str(tmp_path))
    got = own.pages.select(*fixed.split(", "), "rn", "is_start")
    assert sorted(want) == sorted(tuple(r)[:4] for r in got.collect()) and len(want) > 15
    numbers = [(r.doc_key, r.rn) for r in got.collect()]
    assert len(set(numbers)) == len(numbers)
    assert sorted(map(tuple, own.first_pages.collect())) == sorted((r.packet_id, r.page_no) for r in got.collect() if r.is_start)
    assert dict(map(tuple, own.ends.collect())) == {k: max(w[2] for w in want if w[0] == k) + 1 for k in {w[0] for w in want}}


def test_segments_read_no_pages_where_ends_are_known(spark):
    starts = spark.createDataFrame([(1, 0, 0.9), (1, 5, 0.8), (2, 3, 0.7)], "packet_id long, page_no long, confidence double")
    ends = spark.createDataFrame([(1, 9), (2, 4), (3, 7)], "packet_id long, n long")
    got = sorted((r.packet_id, r.start_page, r.end_page) for r in G.segments(starts, None, ends=ends).collect())
    assert got == [(1, 0, 4), (1, 5, 8), (2, 3, 3)]


def test_signals_of_a_page_are_the_same_by_the_short_ways(spark):
    """Texts without what a pattern needs are not searched, and most blank lines not looked at."""
    texts = ["", "\n\n", " 　\n\t\nx", "x" + "\n" * 20, "\n" * 9 + "x\n ", "on 1/2/2024", "May 5, 2024", "5-6-24", "2024-01-02", "FROM: a\nTO: b\nSUBJECT: c", "cc: a\n To: b", "Page 1 of 9\n7", "page 1 of 99999999999999999999\n\n3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("l", T.lines(F.col("t")))
    end, start = T.blank_signals(F.col("l"))
    patterns = (*T.C.DATES, T.C.ISO_DATE, *T.C.EMAIL_HEADERS)
    n, plain = F.size("l"), F.transform("l", lambda x: T.strip(x) != "")
    first, last = F.array_position(plain, True), F.array_position(F.reverse(plain), True)
    whole = F.flatten(F.transform(F.flatten(T.number_matches(F.col("t"))), lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda d: d.try_cast("bigint"))))
    r = df.select("t", T.any_match(F.col("t"), patterns).alias("a"), sum((F.col("t").rlike("(?im)" + p).cast("int") for p in patterns), F.lit(0)).alias("b"), end.alias("e"), start.alias("s"),
                  F.when((last > 0) & ((last - 1) / n > 0.6), 0.8).otherwise(0.0).alias("e2"), F.when((first > 0) & ((first - 1) / n > 0.3), 0.6).otherwise(0.0).alias("s2"), T.numbers(F.col("t")).alias("n"), whole.alias("n2")).collect()
    assert all(x.a == (x.b > 0) and (x.e, x.s, x.n) == (x.e2, x.s2, x.n2) for x in r) and {x.e for x in r} == {0.0, 0.8} and {x.s for x in r} == {0.0, 0.6}


def test_edits_and_segments_meet_in_one_shuffle(spark):
    """Names of edited segments were joined with all segments twice, and the result was written before it was read."""
    from packetlens.operators import edits as E

    rows = [(p, s, i * 3, i * 3 + 2, 0.5, "t", f"{s}.pdf", '{"b":1, "a":2}') for p in (1, 2, None) for i, s in enumerate(("x", "y", "z", None))]
    found = spark.createDataFrame([*rows, (2, "w", None, None, None, None, None, None)], E.SEGMENT)
    edits = spark.createDataFrame(
        [(1, 1, "merge", ["x", "y"], None, None, None, None, "pending"), (1, 2, "remove", ["e1"], None, None, None, None, "pending"), (1, 3, "patch", ["z"], None, None, None, '{"confidence":0.25}', "pending"), (3, 1, "remove", ["x"], None, None, None, None, "pending")],
        "packet_id long, edit_no long, edit string, segment_ids array<string>, at double, start_page long, end_page long, changes string, status string",
    )
    left, log = E.in_order(found, edits)
    assert _plan(log).count("Exchange ") == 1 and "ExistingRDD[packet_id" not in _plan(log).split("MapInPandas")[0]
    assert sorted((r.packet_id, r.edit_no, r.applied, r.reason) for r in log.collect()) == [(1, 1, True, None), (1, 2, True, None), (1, 3, True, None), (3, 1, False, "segment not found")]
    got = {tuple(r) for r in left.collect()}
    untouched = {r for r in rows if r[0] != 1 or r[1] is None} | {(2, "w", None, None, None, None, None, None)}
    assert got == untouched | {(1, "z", 6, 8, 0.25, "t", "z.pdf", '{"a": 2, "b": 1}')}
