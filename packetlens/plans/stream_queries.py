"""Streaming queries, run over the events that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.sources.packets import table
from packetlens.streaming import events as S
from packetlens.streaming import uploads as U

from .event_queries import bucket_sql
from .registry import query


@query("WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM w")
def stream_rates(spark, sf_dir):
    rows = S.drained(S.rates, S.stream(spark, sf_dir))
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM o)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTES AS ended, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, burst""")
def stream_sessions(spark, sf_dir):
    """All bursts, those still open when the input ends as well."""
    rows = S.drained(S.sessions, S.stream(spark, sf_dir))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")}).withColumn("total", F.round("total", 6))


@query(bucket_sql("user_id"))
def stream_token_bucket(spark, sf_dir):
    return S.drained(S.bucket_decisions, S.stream(spark, sf_dir))


@query("""WITH o AS (SELECT user_id, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 12 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, max(ts) AS last_heartbeat, max(ts) + INTERVAL 12 HOURS AS lost_at, count(*) AS beats FROM g GROUP BY user_id, run""")
def stream_lost_connections(spark, sf_dir):
    """Users whose events stopped for twelve hours."""
    rows = S.drained(lambda r: S.lost_connections(r, seconds=12 * 3600.0), S.stream(spark, sf_dir))
    at = F.timestamp_micros("last_micros")
    return rows.select("user_id", at.cast("timestamp_ntz").alias("last_heartbeat"), (at + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz").alias("lost_at"), "beats")


CHUNK_BYTES = 3000


@query(f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, greatest(1, (strlen(coalesce(html, '')) + {CHUNK_BYTES - 1}) // {CHUNK_BYTES}) AS n FROM pages),
q AS (SELECT *, page_id % 7 = 3 AND n > 1 AS lacks FROM p)
SELECT page_id AS file_id, CASE WHEN lacks THEN 'expired' ELSE 'complete' END AS status, CAST(CASE WHEN lacks THEN n - 1 ELSE n END AS INTEGER) AS n_chunks, CASE WHEN lacks THEN strlen(html) - {CHUNK_BYTES} ELSE strlen(html) END AS n_bytes, CASE WHEN NOT lacks THEN sha256(html) END AS content_sha256 FROM q""")
def stream_uploads(spark, sf_dir):
    """Pages as uploads in chunks, some sent twice, the first one of some never."""
    pages = spark.readStream.schema(table(spark, sf_dir, "pages").schema).parquet(f"{sf_dir}/pages.parquet*")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    sent = U.chunks(pages, "page_id", F.coalesce("html", F.lit("")), at, CHUNK_BYTES)
    sent = sent.where(~((F.col("file_id") % 7 == 3) & (F.col("total_chunks") > 1) & (F.col("chunk_number") == 0)))
    again = F.when(F.col("file_id") % 5 == 0, 2).otherwise(1)
    sent = sent.withColumn("sent", F.explode(F.array_repeat(F.lit(0), again))).drop("sent")
    return S.drained(U.assembled, sent).select("file_id", "status", "n_chunks", "n_bytes", F.sha2("content", 256).alias("content_sha256"))
