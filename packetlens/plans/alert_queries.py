"""Alert rules over the events: a counter for each type that starts again after 150 events."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.operators import alerts as A
from packetlens.operators.scans import running

from .event_queries import events
from .registry import query

WIDTH, STEP, HOLD, MOST = 6 * 3600, 1800, 3 * 3600, 0.0011


def rates(spark, sf_dir):
    rows = running(events(spark, sf_dir), "event_type", ["ts", "event_id"], "nth").withColumn("counter", F.col("nth") % 150)
    return A.counter_rates(rows, "event_type", "ts", "counter", WIDTH, STEP)


RATES = f"""s AS (SELECT event_type, epoch_us(ts) AS t, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) % 150)::DOUBLE AS v FROM events),
m AS (SELECT event_type, t, max(v) AS v FROM s GROUP BY event_type, t),
g AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN 0 WHEN v >= lag(v) OVER w THEN v - lag(v) OVER w ELSE v END AS grown FROM m WINDOW w AS (PARTITION BY event_type ORDER BY t)),
e AS (SELECT event_type, at_no FROM (SELECT DISTINCT event_type FROM g), (SELECT unnest(range(min(t) // {STEP * 10**6}, max(t) // {STEP * 10**6} + {WIDTH // STEP + 1})) AS at_no FROM g)),
x AS (SELECT e.event_type, at_no, count(*) AS n, min(t) AS a, max(t) AS b, arg_min(v, t) AS v, sum(grown) - arg_min(grown, t) AS grown FROM e JOIN g ON g.event_type = e.event_type AND t > (at_no * {STEP} - {WIDTH}) * 1000000 AND t <= at_no * {STEP * 10**6} GROUP BY e.event_type, at_no HAVING count(*) > 1),
y AS (SELECT *, (b - a) / 1e6::DOUBLE AS span, (b - a) / 1e6::DOUBLE / (n - 1) AS mean, a / 1e6::DOUBLE - (at_no * {STEP} - {WIDTH}) AS s0, at_no * {STEP} - b / 1e6::DOUBLE AS e0 FROM x),
r AS (SELECT event_type, at_no, n, grown * (span + least(CASE WHEN s0 >= mean * 1.1 THEN mean / 2 ELSE s0 END, CASE WHEN grown > 0 THEN span * v / grown ELSE 1e18 END) + CASE WHEN e0 >= mean * 1.1 THEN mean / 2 ELSE e0 END) / span / {WIDTH} AS rate FROM y)"""


@query(f"WITH {RATES} SELECT event_type, make_timestamp(at_no * {STEP} * 1000000) AS at_time, n, round(rate, 6) AS rate FROM r")
def counter_rates(spark, sf_dir):
    return rates(spark, sf_dir).select("event_type", F.col("at").cast("timestamp_ntz").alias("at_time"), "n", F.round("rate", 6).alias("rate"))


@query(f"""WITH {RATES}, k AS (SELECT *, at_no - row_number() OVER (PARTITION BY event_type ORDER BY at_no) AS run FROM r WHERE rate > {MOST}),
i AS (SELECT event_type, min(at_no) AS a, max(at_no) AS b, count(*) AS evaluations, max(rate) AS peak FROM k GROUP BY event_type, run)
SELECT event_type, make_timestamp(a * {STEP} * 1000000) AS started, CASE WHEN (b - a) * {STEP} >= {HOLD} THEN make_timestamp((a * {STEP} + {HOLD}) * 1000000) END AS firing_from, make_timestamp((b + 1) * {STEP} * 1000000) AS ended, evaluations, round(peak, 6) AS peak FROM i""")
def alert_intervals(spark, sf_dir):
    """When rate > MOST was pending, and when it had held for HOLD seconds."""
    found = A.alert_intervals(rates(spark, sf_dir), "event_type", F.col("rate") > MOST, HOLD, STEP)
    return found.select("event_type", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "firing_from", "ended")), "evaluations", F.round("peak", 6).alias("peak"))
