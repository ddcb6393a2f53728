"""Queries that compare read texts with expected ones: benchmark items, read with changed letters, in another order, and in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.operators import ratios as R
from packetlens.sources.packets import table

from .registry import query

PAIRS = """WITH i AS (SELECT item_id, text FROM {benchmark}),
p AS (
  SELECT item_id, 'letters' AS how, text AS expected, translate(text, 'eilo', 'c1|0') AS actual FROM i
  UNION ALL SELECT item_id, 'order', text, concat(substr(text, 41), '  ', substr(text, 1, 40), '.') FROM i
  UNION ALL SELECT item_id, 'part', text, replace(substr(text, 21, 60), 'th', 'tb') FROM i)"""


def pairs(spark, sf_dir):
    return spark.sql(PAIRS + " SELECT * FROM p", benchmark=table(spark, sf_dir, "benchmark"))


def _ratios_sql() -> str:
    """Rows of the table of common subsequences, one character of the first text a step, for all pairs of texts together."""
    normal = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"
    words = lambda c: f"list_sort(list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_]', ' ', 'g')), ' '), lambda x: x <> '')))"
    own = lambda a, b: f"list_filter({a}, lambda q: NOT list_contains({b}, q))"
    return f"""{PAIRS.format(benchmark="benchmark").replace("WITH i", "WITH RECURSIVE i")},
n AS (SELECT item_id, how, {normal('expected')} AS a, {normal('actual')} AS b FROM p),
w AS (SELECT *, {words('a')} AS x, {words('b')} AS y FROM n),
s AS (SELECT *, array_to_string(list_filter(x, lambda t: list_contains(y, t)), ' ') AS sect, array_to_string({own('x', 'y')}, ' ') AS dx, array_to_string({own('y', 'x')}, ' ') AS dy FROM w),
c AS (SELECT *, trim(sect || ' ' || dx) AS cx, trim(sect || ' ' || dy) AS cy FROM s),
t AS (SELECT item_id, how, 'char' AS kind, a AS u, b AS v FROM c UNION ALL SELECT item_id, how, 'token', cx, cy FROM c),
f AS (
  SELECT item_id, how, kind, 0 AS i, j, 0 AS best, u, length(u) AS steps, substr(v, j, 1) AS letter FROM t, LATERAL (SELECT unnest(range(1, length(v) + 1)) AS j) z WHERE length(u) > 0
  UNION ALL
  SELECT item_id, how, kind, i, j, max(here) OVER (PARTITION BY item_id, how, kind ORDER BY j ROWS UNBOUNDED PRECEDING), u, steps, letter
  FROM (SELECT item_id, how, kind, i + 1 AS i, j, greatest(best, coalesce(lag(best) OVER (PARTITION BY item_id, how, kind ORDER BY j), 0) + CASE WHEN substr(u, i + 1, 1) = letter THEN 1 ELSE 0 END) AS here, u, steps, letter FROM f WHERE i < steps) q
),
l AS (SELECT item_id, how, kind, max(best) AS n FROM f GROUP BY item_id, how, kind),
r AS (SELECT t.item_id, t.how, t.kind, CASE WHEN u = v THEN 1.0 ELSE 2 * coalesce(l.n, 0) / (length(u) + length(v))::DOUBLE END::DOUBLE AS ratio FROM t LEFT JOIN l USING (item_id, how, kind)),
o AS (SELECT item_id, how, max(ratio) FILTER (kind = 'char') AS ch, max(ratio) FILTER (kind = 'token') AS tk FROM r GROUP BY item_id, how)
SELECT item_id, how, round_even(100 * ch, 0) / 100 AS char_accuracy,
  round_even(100 * CASE WHEN a = b THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE greatest(tk, CASE WHEN sect = cx OR sect = cy THEN 1.0 ELSE 0 END, 2 * length(sect) / (length(sect) + length(cx))::DOUBLE, 2 * length(sect) / (length(sect) + length(cy))::DOUBLE) END, 0) / 100 AS token_accuracy,
  length(coalesce(expected, '')) AS char_count_expected, length(coalesce(actual, '')) AS char_count_actual
FROM c JOIN o USING (item_id, how) JOIN p USING (item_id, how)"""


@query(_ratios_sql())
def text_ratios(spark, sf_dir):
    """Character and token-set ratios of every pair."""
    found = R.text_accuracy(pairs(spark, sf_dir), "expected", "actual")
    return found.select("item_id", "how", "char_accuracy", "token_accuracy", *(F.col(f"char_count_{k}").cast("long").alias(f"char_count_{k}") for k in ("expected", "actual")))


@query()
def partial_ratios(spark, sf_dir):
    """The best place of the shorter text in the longer one, exact; in SQL each place would be a table of its own."""
    return R.text_accuracy(pairs(spark, sf_dir), "expected", "actual", exact=True).select("item_id", "how", F.round("partial_accuracy", 6).alias("partial_accuracy"))
