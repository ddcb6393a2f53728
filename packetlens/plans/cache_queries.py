"""Queries over caches: the events as accesses to entries of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.operators import caching as C

from .event_queries import events
from .registry import query

DAYS = 2
BUDGETS = (C.Budget("small", memory=60, seconds=DAYS * 86400), C.Budget("medium", memory=300, items=60, seconds=DAYS * 86400), C.Budget("large", seconds=DAYS * 86400))
ORDER = ["ts", "event_id"]


def size():
    return F.col("user_id") % 7 + 1


DISTANCES = """a AS (SELECT *, user_id % 7 + 1 AS size, row_number() OVER (ORDER BY ts, event_id) AS at_no FROM events),
l AS (SELECT *, lag(at_no) OVER (PARTITION BY user_id ORDER BY at_no) AS last_no FROM a),
b AS (SELECT DISTINCT l.at_no, j.user_id, j.size FROM l JOIN l j ON j.at_no > l.last_no AND j.at_no <= l.at_no),
d AS (SELECT l.event_id, l.user_id, l.ts, l.at_no, l.last_no, l.size, x.distance, x.items FROM l LEFT JOIN (SELECT at_no, CAST(sum(size) AS BIGINT) AS distance, count(*) AS items FROM b GROUP BY at_no) x USING (at_no))"""

OUTCOMES = f"""WITH RECURSIVE {DISTANCES},
g AS (SELECT * FROM (VALUES ('small', 60, 1000000000), ('medium', 300, 60), ('large', 1000000000, 1000000000)) v(budget, memory, items_most)),
r AS (SELECT d.*, budget, memory, items_most, coalesce(items = 1 OR distance <= memory AND items <= items_most, false) AS fits, row_number() OVER (PARTITION BY budget, user_id ORDER BY at_no) AS k FROM d, g),
f AS (SELECT budget, user_id, event_id, size, k, 'miss' AS outcome, ts AS made FROM r WHERE k = 1 UNION ALL
 SELECT r.budget, r.user_id, r.event_id, r.size, r.k, CASE WHEN NOT r.fits THEN 'miss' WHEN r.ts - f.made > INTERVAL {DAYS} DAYS THEN 'expired' ELSE 'hit' END,
  CASE WHEN r.fits AND NOT r.ts - f.made > INTERVAL {DAYS} DAYS THEN f.made ELSE r.ts END FROM f JOIN r ON r.budget = f.budget AND r.user_id = f.user_id AND r.k = f.k + 1)"""


@query(f"WITH {DISTANCES} SELECT event_id, size, distance, items FROM d")
def reuse_distances(spark, sf_dir):
    return C.reuse_distances(events(spark, sf_dir), "user_id", size(), ORDER).select("event_id", "size", "distance", "items")


@query(f"{OUTCOMES} SELECT event_id, max(outcome) FILTER (budget = 'small') AS small, max(outcome) FILTER (budget = 'medium') AS medium, max(outcome) FILTER (budget = 'large') AS large FROM f GROUP BY event_id")
def cache_outcomes(spark, sf_dir):
    return C.outcomes(events(spark, sf_dir), "user_id", size(), "ts", ORDER, BUDGETS).select("event_id", *(b.name for b in BUDGETS))


@query(f"""{OUTCOMES}, e AS (SELECT user_id, max(at_no) AS at_no, max(size) AS size FROM d GROUP BY user_id),
s AS (SELECT *, sum(size) OVER w AS distance, row_number() OVER w AS items FROM e WINDOW w AS (ORDER BY at_no DESC ROWS UNBOUNDED PRECEDING)),
h AS (SELECT budget, count(*) AS held, sum(size) AS held_size FROM s, g WHERE items = 1 OR distance <= memory AND items <= items_most GROUP BY budget),
c AS (SELECT budget, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome <> 'hit') AS misses, count(*) FILTER (outcome = 'expired') AS expired, coalesce(sum(size) FILTER (outcome = 'hit'), 0) AS saved FROM f GROUP BY budget)
SELECT budget, hits, misses, expired, misses - held AS evictions, round(hits / (hits + misses)::DOUBLE, 6) AS hit_rate, CAST(saved AS BIGINT) AS saved, held, CAST(held_size AS BIGINT) AS held_size FROM c JOIN h USING (budget)""")
def cache_budgets(spark, sf_dir):
    """Hits, misses and evictions of three caches over one log."""
    return C.totals(events(spark, sf_dir), "user_id", size(), "ts", ORDER, BUDGETS).withColumn("hit_rate", F.round("hit_rate", 6))
