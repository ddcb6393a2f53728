"""Queries over rows of several versions: sessions written as three versions knew them, and reports as nested JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.operators import versions as V
from packetlens.streaming.events import shared_folder

from .event_queries import events, folded
from .registry import query
from .technique_queries import SCORED, grid


def written(spark, sf_dir) -> str:
    """Sessions of users, by version, in one folder: a user's events are the segments, and its clicks the modifications."""
    number = F.get_json_object("props", "$.k").cast("long")
    segment = F.struct(F.col("event_id").cast("string").alias("segment_id"), number.alias("start_page"), (number + 1).alias("end_page"), (F.col("value") / 100).alias("confidence"), F.col("event_type").alias("document_type"))
    change = F.when(F.col("event_type") == "click", F.struct(F.lit("patch").alias("type"), F.col("event_id").cast("string").alias("segment_id"), F.col("ts").cast("string").alias("at")))
    own = events(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(segment)).alias("segments"), F.sort_array(F.collect_list(change)).alias("modifications"))
    rows = folded(spark, sf_dir).join(own, "user_id").withColumn("session_id", F.col("user_id"))
    upload = F.struct(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("upload_id"), F.size("segments").alias("total_pages"), F.when(F.col("user_id") % 2 == 0, True).alias("auto_confirmed"))
    rows = rows.withColumns({"proposal": F.struct("segments"), "metadata": upload})
    path = shared_folder(spark)
    for version in (1, 2, 3):
        V.append(rows.where(F.col("user_id") % 3 == version - 1), path, version)
    return path


@query("""WITH s AS (SELECT user_id AS session_id, CAST(user_id % 3 + 1 AS INTEGER) AS version, count(*) AS segments, count(*) FILTER (event_type = 'click') AS clicks, max(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) AS last_page, min(ts) AS created_at, min(event_id::VARCHAR) FILTER (event_type = 'click') AS first_click FROM events GROUP BY user_id)
SELECT session_id, version, created_at, segments, last_page, CASE WHEN version >= 2 THEN clicks ELSE 0 END AS modifications, CASE WHEN version >= 2 THEN first_click END AS first_patched, CASE WHEN version >= 3 THEN 'u' || (session_id % 40) END AS upload_id, CASE WHEN version >= 3 THEN segments ELSE 0 END AS total_pages, version >= 3 AND session_id % 2 = 0 AS auto_confirmed FROM s""")
def session_versions(spark, sf_dir):
    """Sessions of all versions as the latest one has them."""
    rows = V.detailed(V.sessions(spark, written(spark, sf_dir)))
    last, first = F.array_max("segments.end_page"), F.array_min("modifications.segment_id")
    return rows.select("session_id", "version", "created_at", F.size("segments").cast("long").alias("segments"), last.alias("last_page"), F.size("modifications").cast("long").alias("modifications"), first.alias("first_patched"), "upload_id", "total_pages", "auto_confirmed")


@query(f"WITH {SCORED} SELECT technique, count(*) AS runs, round(max(f1), 4) AS best_f1, max(tp) AS best_tp FROM f GROUP BY technique")
def technique_reports(spark, sf_dir):
    """Reports of the techniques' runs, read back from their JSON."""
    runs = grid(spark, sf_dir).select("technique", "threshold", "tp", F.round("f1", 4).alias("f1"))
    parsed = F.parse_json("report")
    return V.nested_report(runs, "technique", ["f1", "tp"]).select("technique", F.size(F.variant_get(parsed, "$.runs", "array<variant>")).cast("long").alias("runs"), F.variant_get(parsed, "$.summary.best_f1", "double").alias("best_f1"), F.variant_get(parsed, "$.summary.best_tp", "bigint").alias("best_tp"))
