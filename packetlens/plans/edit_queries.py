"""Queries over edits that follow each other: proposals by customer, edited by what its lineitems hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.operators import edits as E
from packetlens.sources.packets import table

from .registry import query

#: Segments are a customer's orders; edits its lineitems, which name an order or what the edit before has made.
TABLES = """
WITH seg AS (
  SELECT o_custkey AS packet_id, CAST(row_number() OVER w AS STRING) AS segment_id, sum(o_orderkey % 9 + 1) OVER w - (o_orderkey % 9 + 1) AS start_page,
    sum(o_orderkey % 9 + 1) OVER w - 1 AS end_page, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, o_orderpriority AS document_type,
    concat('order_', o_orderkey, '.pdf') AS filename, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), line AS (
  SELECT o_custkey AS packet_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS edit_no, l_partkey % 10 AS k,
    l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_returnflag, l_linestatus, l_orderkey
  FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
), sized AS (
  SELECT line.*, n, pages, CAST(q % n + 1 AS STRING) AS own, CAST(l_suppkey % n + 1 AS STRING) AS second,
    CASE WHEN l_suppkey % 3 = 0 THEN concat('e', edit_no - 1) WHEN l_suppkey % 3 = 1 AND q % 2 = 0 THEN concat('e', edit_no - 1, 'a') END AS made
  FROM line JOIN (SELECT packet_id, max(n) AS n, max(end_page) + 1 AS pages FROM seg GROUP BY packet_id) x USING (packet_id)
), edit AS (
  SELECT z.packet_id, edit_no, CASE WHEN k < 4 THEN 'merge' WHEN k < 7 THEN 'split' WHEN k = 7 THEN 'patch' WHEN k = 8 THEN 'remove' ELSE 'add' END AS edit,
    coalesce(made, own) AS first_id, CASE WHEN k < 4 THEN second END AS second_id,
    CASE WHEN k BETWEEN 4 AND 6 THEN CASE WHEN made IS NULL THEN s.start_page + 1 + l_linenumber % 2 ELSE l_orderkey % pages END END AS cut,
    CASE WHEN k = 9 THEN l_orderkey % pages END AS start_page, CASE WHEN k = 9 THEN l_orderkey % pages + q % 5 - 1 END AS end_page,
    CASE WHEN k = 7 THEN concat('{{"document_type":"type ', l_linenumber, '","confidence":0.25}}') END AS changes,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND q % 3 = 0 THEN 'confirmed' ELSE 'modified' END AS status
  FROM sized z LEFT JOIN seg s ON s.packet_id = z.packet_id AND s.segment_id = z.own
)"""


#: In Spark a packet's starts stand in one row, so that lines meet them by packet alone, in the tasks that have numbered them.
SEG, LINE = (TABLES[TABLES.index(f"{x} AS (") : TABLES.index(f"), {y} AS (") + 1] for x, y in (("seg", "line"), ("line", "sized")))
FOUND = f"WITH {SEG} SELECT packet_id, segment_id, start_page, end_page, confidence, document_type, filename, '{{{{}}}}' AS metadata FROM seg"
STARTS = f"""
WITH {SEG} SELECT packet_id, count(*) AS n, max(end_page) + 1 AS pages, transform(array_sort(collect_list(struct(CAST(segment_id AS INT) AS i, start_page))), x -> x.start_page) AS starts
FROM seg GROUP BY packet_id"""
OWN_START = "LEFT JOIN seg s ON s.packet_id = z.packet_id AND s.segment_id = z.own"
EDITS = (
    f"WITH {LINE}, sized AS (SELECT line.*, n, pages, get(starts, CAST(q % n AS INT)) AS own_start, " + TABLES[TABLES.index("CAST(q % n + 1") : TABLES.index("  FROM line JOIN")]
    + "  FROM line JOIN {starts} x USING (packet_id)\n), " + TABLES[TABLES.index("edit AS (") :].replace(OWN_START, "").replace("s.start_page", "own_start") + " SELECT * FROM edit"
)


def proposals(spark, sf_dir):
    orders, lineitem = (table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    found = spark.sql(FOUND, orders=orders)
    edits = spark.sql(EDITS, orders=orders, lineitem=lineitem, starts=spark.sql(STARTS, orders=orders))
    ids = F.when(F.col("edit") == "add", F.array().cast("array<string>")).otherwise(F.array_compact(F.array("first_id", "second_id")))
    return E.in_order(found, edits.withColumns({"segment_ids": ids, "at": F.col("cut")}))


def _fold_sql() -> str:
    tables = TABLES.format(orders="orders", lineitem="lineitem").replace("WITH seg", "WITH RECURSIVE seg").replace(" STRING", " VARCHAR")
    pick = lambda n: f"list_filter(state, lambda x: x.id = {n})[1]"
    drop = lambda *n: f"list_filter(state, lambda x: x.id NOT IN ({', '.join(n)}))"
    part = lambda i, s, e: f"{{'id': {i}, 's': {s}, 'e': {e}, 'c': a.c, 't': a.t, 'f': CAST(NULL AS VARCHAR)}}"
    first, last = "CASE WHEN (a.s, first_id) <= (b.s, second_id) THEN a ELSE b END", "CASE WHEN (a.s, first_id) <= (b.s, second_id) THEN b ELSE a END"
    return f"""{tables},
f AS (
  SELECT packet_id, 0::BIGINT AS edit_no, list({{'id': segment_id, 's': CAST(start_page AS BIGINT), 'e': CAST(end_page AS BIGINT), 'c': confidence, 't': document_type, 'f': filename}}) AS state, CAST(NULL AS VARCHAR) AS edit, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS made FROM seg GROUP BY packet_id
  UNION ALL
  SELECT packet_id, edit_no,
    CASE WHEN reason IS NOT NULL THEN state
      WHEN edit = 'merge' THEN list_append({drop('first_id', 'second_id')}, {{'id': 'e' || edit_no, 's': ({first}).s, 'e': ({last}).e, 'c': least(a.c, b.c), 't': ({first}).t, 'f': CAST(NULL AS VARCHAR)}})
      WHEN edit = 'split' THEN list_concat({drop('first_id')}, [{part("'e' || edit_no || 'a'", 'a.s', 'cut - 1')}, {part("'e' || edit_no || 'b'", 'cut', 'a.e')}])
      WHEN edit = 'patch' THEN list_append({drop('first_id')}, {{'id': a.id, 's': a.s, 'e': a.e, 'c': 0.25::DOUBLE, 't': json_extract_string(changes, '$.document_type'), 'f': CAST(NULL AS VARCHAR)}})
      WHEN edit = 'remove' THEN {drop('first_id')}
      ELSE list_append(state, {{'id': 'e' || edit_no, 's': start_page, 'e': end_page, 'c': 1.0::DOUBLE, 't': CAST(NULL AS VARCHAR), 'f': 'segment_' || (start_page + 1) || '_' || (end_page + 1) || '.pdf'}}) END,
    edit, reason,
    CASE WHEN reason IS NULL THEN CASE edit WHEN 'split' THEN 'e' || edit_no || 'a,e' || edit_no || 'b' WHEN 'patch' THEN first_id WHEN 'remove' THEN '' ELSE 'e' || edit_no END END
  FROM (SELECT *, CASE WHEN status = 'confirmed' THEN 'session is confirmed'
      WHEN edit = 'add' THEN CASE WHEN start_page <= end_page THEN NULL ELSE 'no range of pages' END
      WHEN a IS NULL OR edit = 'merge' AND (b IS NULL OR first_id = second_id) THEN 'segment not found'
      WHEN edit = 'split' AND NOT coalesce(a.s < cut AND cut <= a.e, false) THEN 'page outside the segment' END AS reason
    FROM (SELECT e.*, f.state, {pick('e.first_id').replace('state', 'f.state')} AS a, {pick('e.second_id').replace('state', 'f.state')} AS b FROM f JOIN edit e ON e.packet_id = f.packet_id AND e.edit_no = f.edit_no + 1) x) y
)"""


@query(f"{_fold_sql()} SELECT packet_id, x.id AS segment_id, x.s AS start_page, x.e AS end_page, round(x.c, 6) AS confidence, x.t AS document_type, x.f AS filename FROM (SELECT packet_id, unnest(arg_max(state, edit_no)) AS x FROM f GROUP BY packet_id)")
def edited_in_order(spark, sf_dir):
    """Proposals after all their edits, several of a segment and of what they made."""
    return proposals(spark, sf_dir)[0].select("packet_id", "segment_id", "start_page", "end_page", F.round("confidence", 6).alias("confidence"), "document_type", "filename")


@query(f"{_fold_sql()} SELECT packet_id, edit_no, edit, reason IS NULL AS applied, reason, made FROM f WHERE edit_no > 0")
def edit_log(spark, sf_dir):
    """Which edits were applied, why others were not, and what they made."""
    return proposals(spark, sf_dir)[1]
