"""Queries over events, orders and layout blocks, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.config import ModelConfig
from packetlens.functions import text as T
from packetlens.operators import analytics as A
from packetlens.operators import layout as L
from packetlens.operators import limits
from packetlens.operators import model as M
from packetlens.operators import sessions as S
from packetlens.sources.packets import table

from .registry import query

R6 = lambda c: F.round(c, 6).alias(c)
NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


STATUS = {"view": "pending", "click": "modified", "purchase": "completed", "error": "cancelled"}


def status():
    out = F.lit("confirmed")
    for k, v in STATUS.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


STATUS_SQL = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE 'confirmed' END"
FOLDED = f"""s AS (SELECT user_id, min(ts) AS created_at, max(ts) AS updated_at, arg_max({STATUS_SQL}, (ts, event_id)) AS status, count(*) AS n_events, count(*) FILTER ({STATUS_SQL} = 'modified') AS n_modifications, max(ts) + INTERVAL 24 HOURS AS expires_at FROM events GROUP BY user_id)"""


def folded(spark, sf_dir):
    return S.fold(events(spark, sf_dir), "user_id", "ts", status())


@query(f"WITH {FOLDED} SELECT * FROM s")
def session_fold(spark, sf_dir):
    return folded(spark, sf_dir)


@query(f"WITH {FOLDED} SELECT user_id, status FROM s WHERE status IN ('pending', 'modified', 'confirmed') AND expires_at > {NOW}")
def active_sessions(spark, sf_dir):
    return S.active(folded(spark, sf_dir), now()).select("user_id", "status")


@query(f"WITH {FOLDED} SELECT user_id, created_at FROM s WHERE status = 'pending' ORDER BY created_at DESC, user_id LIMIT 20 OFFSET 5")
def session_page(spark, sf_dir):
    return S.listed(folded(spark, sf_dir), "pending", offset=5, key="user_id").select("user_id", "created_at")


@query(f"WITH {FOLDED} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in S.STATUSES) + ", min(created_at) AS first_created, max(created_at) AS last_created FROM s")
def session_statistics(spark, sf_dir):
    return S.statistics(folded(spark, sf_dir))


@query(f"WITH {FOLDED} SELECT user_id FROM s WHERE expires_at >= {NOW} AND status NOT IN ('completed', 'cancelled')")
def session_cleanup(spark, sf_dir):
    return S.kept(folded(spark, sf_dir), now()).select("user_id")


@query(f"WITH {FOLDED} SELECT user_id, greatest(expires_at, {NOW} + INTERVAL 24 HOURS) AS expires_at FROM s")
def session_extend(spark, sf_dir):
    return S.extended(folded(spark, sf_dir), now()).select("user_id", "expires_at")


@query(f"WITH x AS (SELECT event_id, user_id, {STATUS_SQL} AS s, lag({STATUS_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT event_id, b AS last, s AS status FROM x WHERE b IS NOT NULL AND NOT ((b = 'pending' AND s IN ('modified', 'confirmed', 'cancelled')) OR (b = 'modified' AND s IN ('confirmed', 'cancelled')) OR (b = 'confirmed' AND s IN ('completed', 'cancelled')))")
def illegal_transitions(spark, sf_dir):
    return S.illegal(events(spark, sf_dir), "user_id", "ts", status()).select("event_id", "last", "status")


def recursive(start: str, step: str, columns: str, last: str, key: str = "user_id") -> str:
    """SQL that folds each user's events in order: the state's columns at the first event, at each later one (f the state before, o
    the event), and what is selected of the folded rows."""
    return f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, {STATUS_SQL} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, t, k, {start} FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.t, o.k, {step} FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT {key}, {columns} FROM f{last}"""


LEGAL = "((f.status = 'pending' AND o.s IN ('modified', 'confirmed', 'cancelled')) OR (f.status = 'modified' AND o.s IN ('confirmed', 'cancelled')) OR (f.status = 'confirmed' AND o.s IN ('completed', 'cancelled')))"
REPLAY = recursive(
    f"CASE WHEN {LEGAL.replace('f.status', "'pending'")} THEN s ELSE 'pending' END AS status, CASE WHEN {LEGAL.replace('f.status', "'pending'")} OR s = 'pending' THEN 0 ELSE 1 END AS refused".replace("o.s", "s"),
    f"CASE WHEN {LEGAL} THEN o.s ELSE f.status END, f.refused + CASE WHEN {LEGAL} OR o.s = f.status THEN 0 ELSE 1 END", "arg_max(status, k) AS status, CAST(arg_max(refused, k) AS INTEGER) AS refused", " GROUP BY user_id",
)


def bucket_sql(key: str) -> str:
    """A bucket of three tokens that fills by one a day."""
    full = "least(3.0::DOUBLE, f.tokens + (o.t - f.t) * (1 / 86400.0::DOUBLE))"
    return recursive("2.0::DOUBLE AS tokens, true AS allowed", f"CASE WHEN {full} >= 1 THEN {full} - 1 ELSE {full} END, {full} >= 1", "event_id, allowed", "", key)


@query(REPLAY)
def session_replay(spark, sf_dir):
    return S.replayed(events(spark, sf_dir), "user_id", "ts", status())


@query("SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def session_upsert(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    old, new = (e.where(F.col("event_id") % 2 == k).select("user_id", "ts", "value", "at") for k in (0, 1))
    return S.upserted(old, new, "user_id", "at").select("user_id", "ts", "value")


@query(f"SELECT event_id FROM events WHERE ts >= {NOW} - INTERVAL 7 DAYS")
def retention(spark, sf_dir):
    return S.retained(events(spark, sf_dir), "ts", now(), "7 DAYS").select("event_id")


@query("WITH r AS (SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= DATE '1995-01-01') SELECT o_orderkey, total FROM r ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def results_search(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({"status": F.col("o_orderstatus"), "n_files": F.lit(1)})
    return A.search(rows, ["O", "P"], since="1995-01-01", least=0, page=2, key="o_orderkey", at="o_orderdate").select("o_orderkey", "total")


@query("SELECT count(*) FILTER (event_type IN ('purchase', 'error')) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, round(CASE WHEN count(*) FILTER (event_type IN ('purchase', 'error')) = 0 THEN 0.0 ELSE count(*) FILTER (event_type = 'purchase') / (count(*) FILTER (event_type IN ('purchase', 'error')))::DOUBLE * 100 END, 6) AS success_rate, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0), 6) AS total_size, round(avg(value) FILTER (event_type = 'purchase'), 6) AS average_size, min(ts) AS first_at, max(ts) AS last_at FROM events")
def download_analytics(spark, sf_dir):
    done, failed = (F.col("event_type") == x for x in ("purchase", "error"))
    return A.downloads(events(spark, sf_dir), done, failed, F.col("value")).withColumns({c: F.round(c, 6) for c in ("success_rate", "total_size", "average_size")})


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY count(*) DESC, min((ts, event_id)) LIMIT 10")
def popular_files(spark, sf_dir):
    return A.popular(events(spark, sf_dir), "user_id")


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1")
def downloads_by_hour(spark, sf_dir):
    return A.by_hour(events(spark, sf_dir))


PERFORMANCE = """x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k, value > 95 AS bad FROM events),
v AS (SELECT event_type, count(*) AS n, avg(value) AS mean, min(value) AS least, max(value) AS most, list_sort(list(value)) AS v, count(*) FILTER (bad) AS errors FROM x WHERE k <= 1000 GROUP BY event_type),
e AS (SELECT event_type, n, mean, least, most, v[least(n // 2, n - 1) + 1] AS p50, v[least(n * 95 // 100, n - 1) + 1] AS p95, errors, errors / n::DOUBLE AS error_rate FROM v)"""


def performance(spark, sf_dir):
    return A.endpoint_performance(events(spark, sf_dir), "event_type", "value", F.col("value") > 95)


@query(f"WITH {PERFORMANCE} SELECT event_type, n, round(mean, 6) AS mean, least, most, p50, p95, errors, round(error_rate, 6) AS error_rate FROM e")
def endpoint_performance(spark, sf_dir):
    return performance(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("mean", "error_rate")})


@query(f"WITH {PERFORMANCE} SELECT event_type FROM e WHERE n >= 100 AND (p95 > 2.0 OR error_rate > 0.05)")
def performance_alerts(spark, sf_dir):
    return A.alerts(performance(spark, sf_dir)).select("event_type")


@query("WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL) SELECT user_id, count(*) AS stages, round(avg(v), 6) AS overall FROM l GROUP BY user_id")
def progress_latest(spark, sf_dir):
    return A.progress(events(spark, sf_dir), "user_id", "event_type", "value").withColumn("overall", F.round("overall", 6))


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type, count(*) AS n, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM events GROUP BY 1, 2")
def rate_5m(spark, sf_dir):
    return A.rates(events(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 200.0]


def _quantile_sql() -> str:
    out = str(BOUNDS[-1])
    for i in reversed(range(len(BOUNDS))):
        low, below = ([0.0, *BOUNDS][i], f"le{i - 1}" if i else "0")
        out = f"CASE WHEN le{i} >= n * 0.95 THEN {low} + {BOUNDS[i] - low} * (n * 0.95 - {below}) / greatest(le{i} - {below}, 1) ELSE {out} END"
    return "WITH c AS (SELECT event_type, count(*)::DOUBLE AS n, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le{i}" for i, b in enumerate(BOUNDS)) + f" FROM events GROUP BY event_type) SELECT event_type, CAST(n AS BIGINT) AS n, round(({out})::DOUBLE, 6) AS quantile FROM c"


@query(_quantile_sql())
def histogram_p95(spark, sf_dir):
    return A.histogram_quantile(events(spark, sf_dir), "value", BOUNDS, 0.95, "event_type").withColumn("quantile", F.round("quantile", 6))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def sliding_window_count(spark, sf_dir):
    return limits.sliding_count(events(spark, sf_dir), "user_id", 3600).select("event_id", "n_recent")


@query(recursive("NULL::DOUBLE AS a, t AS b, true AS allowed", "CASE WHEN f.a IS NULL OR f.a < o.t - 86400 THEN f.b ELSE f.a END, CASE WHEN f.a IS NULL OR f.a < o.t - 86400 THEN o.t ELSE f.b END, f.a IS NULL OR f.a < o.t - 86400", "event_id, allowed", "", "CAST(user_id AS VARCHAR) AS user_id"))
def sliding_log_limit(spark, sf_dir):
    return limits.decided(events(spark, sf_dir), "user_id", lambda: limits.SlidingLog(2, 86400.0))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, t, k, t AS start, 1 AS n, true AS allowed FROM o WHERE k = 1 UNION ALL
 SELECT o.user_id, o.event_id, o.t, o.k, CASE WHEN o.t - f.start >= 86400 THEN o.t ELSE f.start END, CASE WHEN o.t - f.start >= 86400 THEN 1 WHEN f.n >= 2 THEN f.n ELSE f.n + 1 END, o.t - f.start >= 86400 OR f.n < 2 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, allowed FROM f""")
def fixed_window_limit(spark, sf_dir):
    return limits.decided(events(spark, sf_dir), "user_id", lambda: limits.FixedWindow(2, 86400.0))


@query(bucket_sql("CAST(user_id AS VARCHAR) AS user_id"))
def token_bucket_limit(spark, sf_dir):
    return limits.decided(events(spark, sf_dir), "user_id", lambda: limits.TokenBucket(3.0, 1 / 86400))


@query(recursive("[t]::DOUBLE[] AS log, true AS allowed, 0.0::DOUBLE AS wait", """CASE WHEN len(list_filter(f.log, lambda x: x > o.t - 86400)) < 2 THEN list_append(list_filter(f.log, lambda x: x > o.t - 86400), o.t) ELSE list_filter(f.log, lambda x: x > o.t - 86400) END,
 len(list_filter(f.log, lambda x: x > o.t - 86400)) < 2, CASE WHEN len(list_filter(f.log, lambda x: x > o.t - 86400)) < 2 THEN 0.0 ELSE greatest(0.0, list_filter(f.log, lambda x: x > o.t - 86400)[1] + 86400 - o.t) END""", "event_id, allowed, round(wait, 4) AS wait", "", "CAST(user_id AS VARCHAR) AS user_id"))
def sliding_log_wait(spark, sf_dir):
    return limits.refused_waits(events(spark, sf_dir), "user_id", 2, 86400.0).withColumn("wait", F.round("wait", 4))


# A bucket's level and needs in microseconds of filling, of which a token takes 43200 seconds.
_NEED, _DAY = "(1 + o.event_id % 2) * 43200000000", "129600000000"
_LEVEL = f"least({_DAY}, f.level + greatest(0, (o.t * 1e6)::BIGINT - f.served))"
_WAITED = f"greatest(0, {_NEED} - {_LEVEL})"


@query(recursive("129600000000 - (1 + event_id % 2) * 43200000000 AS level, (t * 1e6)::BIGINT AS served, 0::BIGINT AS wait_micros", f"{_LEVEL} + {_WAITED} - {_NEED}, greatest((o.t * 1e6)::BIGINT, f.served) + {_WAITED}, greatest((o.t * 1e6)::BIGINT, f.served) + {_WAITED} - (o.t * 1e6)::BIGINT", "event_id, wait_micros", ""))
def token_bucket_wait(spark, sf_dir):
    """Requests of one or two tokens that wait at a bucket of three, which fills by two a day."""
    tokens = 1 + F.col("event_id") % 2
    return limits.bucket_waits(events(spark, sf_dir), "user_id", 3.0, 1 / 43200, tokens).select("user_id", "event_id", F.round(F.col("wait") * 1e6).cast("long").alias("wait_micros"))


@query("SELECT a.event_id, count(*) AS n_active FROM events a JOIN events b ON a.user_id = b.user_id AND (b.ts, b.event_id) <= (a.ts, a.event_id) AND (b.event_id = a.event_id OR epoch_us(b.ts) + CAST(round(b.value * 1800000000) AS BIGINT) > epoch_us(a.ts)) GROUP BY a.event_id")
def active_requests(spark, sf_dir):
    """Each request runs for `value` half hours."""
    return limits.concurrency(events(spark, sf_dir), "user_id", F.col("value") * 1800).select("event_id", "n_active")


@query(recursive("[(t * 1e6)::BIGINT + took]::BIGINT[] AS ends, 0::BIGINT AS wait", """list_sort(list_append(CASE WHEN len(f.ends) < 2 THEN f.ends ELSE f.ends[2:] END, greatest((o.t * 1e6)::BIGINT, CASE WHEN len(f.ends) < 2 THEN 0 ELSE f.ends[1] END) + o.took)),
 greatest(0, CASE WHEN len(f.ends) < 2 THEN 0 ELSE f.ends[1] - (o.t * 1e6)::BIGINT END)""", "event_id, round(wait / 1e6, 3) AS wait", "", "CAST(user_id AS VARCHAR) AS user_id").replace("AS s, row_number()", "AS s, CAST(round(value * 1800000000) AS BIGINT) AS took, row_number()"))
def slot_wait(spark, sf_dir):
    """Two slots for each user, held for `value` half hours."""
    return limits.slot_waits(events(spark, sf_dir), "user_id", 2, F.col("value") * 1800).withColumn("wait", F.round("wait", 3))


@query("SELECT user_id, count(*) AS connections, min(ts) AS oldest FROM events GROUP BY user_id")
def connection_stats(spark, sf_dir):
    return A.connections(events(spark, sf_dir), "user_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10 AS admitted FROM events")
def admission(spark, sf_dir):
    return A.admitted(events(spark, sf_dir), "user_id").select("event_id", "admitted")


@query("WITH h AS (SELECT CASE WHEN value > 95 THEN 'failed' WHEN value > 80 THEN 'warning' ELSE 'healthy' END AS s FROM events) SELECT " + ", ".join(f"round(count(*) FILTER (s = '{x}') / count(*)::DOUBLE * 100, 2) AS {x}_percent" for x in ("healthy", "warning", "failed")) + ", arg_max(s, CASE s WHEN 'failed' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS worst FROM h")
def health_summary(spark, sf_dir):
    return A.health(events(spark, sf_dir).withColumn("status", F.when(F.col("value") > 95, "failed").when(F.col("value") > 80, "warning").otherwise("healthy")))


@query("WITH w AS (SELECT event_id, count(*) OVER w AS n, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)) SELECT event_id, round(CASE WHEN n >= 100 THEN m + 1e-9 END, 6) AS recent_mean FROM w")
def load_factor(spark, sf_dir):
    return A.load_factor(events(spark, sf_dir), "value").select("event_id", F.round(F.col("recent_mean") + 1e-9, 6).alias("recent_mean"))  # no ties at six places


@query("WITH e AS (SELECT event_id, value, '/api/' || CASE event_id % 4 WHEN 0 THEN 'login' WHEN 1 THEN 'upload' WHEN 2 THEN 'download' ELSE event_type END AS url FROM events) SELECT event_id, CASE WHEN value > 5 THEN 'very_slow' WHEN value > 1 THEN 'slow' ELSE 'normal' END AS speed, CASE WHEN contains(url, '/auth') OR contains(url, '/login') THEN 'auth' WHEN contains(url, '/upload') THEN 'upload' WHEN contains(url, '/download') THEN 'download' ELSE 'default' END AS route FROM e")
def request_classes(spark, sf_dir):
    k = F.col("event_id") % 4
    url = F.concat(F.lit("/api/"), F.when(k == 0, "login").when(k == 1, "upload").when(k == 2, "download").otherwise(F.col("event_type")))
    return events(spark, sf_dir).select("event_id", A.speed(F.col("value")).alias("speed"), A.route_group(url).alias("route"))


@query("WITH d AS (SELECT event_id, event_id * 397 AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN '< 1m' ELSE concat_ws(' ', CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd' END, CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || 'h' END, CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm' END) END AS uptime FROM d")
def uptime(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", T.duration(F.col("event_id") * 397).alias("uptime"))


def _answers(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("<thinking>"), F.col("props"), F.lit("</thinking><answer> different </answer>"))).when(F.col("event_id") % 5 == 1, "<thinking>short</thinking>\n<answer>SAME</answer>").when(F.col("event_id") % 5 == 2, "they are Different").when(F.col("event_id") % 5 == 3, "<answer>maybe</answer>").otherwise("")
    return events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", text.alias("response"))


_s = ModelConfig()
ANSWERS = f"""a AS (SELECT event_id, ts, user_id, event_type, event_id % 5 AS k, length(props) > 20 AS long FROM events),
r AS (SELECT *, k IN (0, 2) AS is_boundary, CASE k WHEN 0 THEN CASE WHEN long THEN {_s.boundary_high} ELSE {_s.boundary_medium} END WHEN 1 THEN {_s.same_medium} WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM a)"""


@query(f"WITH {ANSWERS} SELECT event_id, is_boundary, confidence FROM r")
def llm_parse(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    return rows.withColumns(M.parsed(F.col("response"))).select("event_id", "is_boundary", "confidence")


@query("SELECT conv_id, turn, substr(sha256(b), 1, 16) || ':' || substr(sha256(text), 1, 16) || ':m:default' AS key FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL")
def llm_cache_key(spark, sf_dir):
    from packetlens.operators.boundaries import in_order

    rows = table(spark, sf_dir, "conversations").withColumn("b", F.lag("text").over(in_order("conv_id", "turn"))).where("b is not null")
    return rows.select("conv_id", "turn", M.cache_key(F.col("b"), F.col("text"), F.lit("m"), F.lit(None).cast("string")).alias("key"))


def _cache(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumns(M.parsed(F.col("response")))
    return rows.select(F.col("event_id").cast("string").alias("key"), "user_id", "response", F.col("ts").alias("created_at"), F.col("ts").alias("accessed_at"), F.col("event_id").alias("access_count"), "confidence", "is_boundary")


@query(f"SELECT p.event_id, e.ts > {NOW} - INTERVAL 30 DAYS AS hit FROM (SELECT event_id FROM events WHERE event_type = 'click') p JOIN events e USING (event_id)")
def llm_cache_lookup(spark, sf_dir):
    pairs = events(spark, sf_dir).where("event_type = 'click'").select("event_id", F.col("event_id").cast("string").alias("key"))
    return M.looked_up(pairs, _cache(spark, sf_dir), now()).select("event_id", F.col("response").isNotNull().alias("hit"))


@query("SELECT user_id, CAST(arg_max(event_id, (ts, -CAST(rank AS BIGINT))) AS VARCHAR) AS key FROM (SELECT *, row_number() OVER (ORDER BY CAST(event_id AS VARCHAR)) AS rank FROM events) GROUP BY user_id")
def llm_cache_newest(spark, sf_dir):
    return M.newest(_cache(spark, sf_dir), "user_id").select("user_id", "key")


@query(f"WITH {ANSWERS} SELECT count(*) AS entries, round(avg(confidence), 6) AS mean_confidence, CAST(sum(event_id) AS BIGINT) AS accesses, count(*) FILTER (is_boundary) AS boundaries FROM r")
def cache_stats(spark, sf_dir):
    return M.cache_statistics(_cache(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("SELECT CAST(event_id AS VARCHAR) AS key FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT (SELECT CAST(floor(count(*) * 0.7) AS BIGINT) FROM events)")
def cache_trim(spark, sf_dir):
    return M.trimmed(_cache(spark, sf_dir)).select("key")


@query("SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN event_id % 10 = 0 THEN event_id + 1 ELSE event_id END AS access_count FROM events")
def cache_put(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    return M.put(cache, cache.where(F.col("key").cast("long") % 10 == 0)).select("key", "access_count")


_blank = M.PROMPT.replace("{page1_bottom}", "").replace("{page2_top}", "")


@query(rf"""WITH p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b, text FROM conversations),
l AS (SELECT *, string_split(regexp_replace(b, '^\s+|\s+$', '', 'g'), chr(10)) AS x, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS y FROM p WHERE b IS NOT NULL),
a AS (SELECT *, {len(_blank)} + length(array_to_string(x[greatest(len(x) - {_s.bottom_lines} + 1, 1):], chr(10))) + length(array_to_string(y[1:{_s.top_lines}], chr(10))) AS n, bool_or(turn % 2 = 0) OVER (PARTITION BY b, text) AS known FROM l)
SELECT conv_id, turn, NOT known AS is_boundary, (CASE WHEN known THEN {_s.same_low} WHEN length(n || ' characters') > 20 THEN {_s.boundary_high} ELSE {_s.boundary_medium} END)::DOUBLE AS confidence, CASE WHEN known THEN 'No reasoning provided' ELSE n || ' characters' END AS reasoning FROM a""")
def model_detector(spark, sf_dir):
    """With a stand-in for the model: cached answers first, then the model for the others."""
    from packetlens.operators.boundaries import in_order

    rows = table(spark, sf_dir, "conversations").withColumn("b", F.lag("text").over(in_order("conv_id", "turn"))).where("b is not null")
    pairs = rows.select("conv_id", "turn", M.cache_key(F.col("b"), F.col("text"), F.lit("m"), F.lit(None).cast("string")).alias("key"), M.prompt(F.col("b"), F.col("text")).alias("prompt"))
    cache = pairs.where("turn % 2 = 0").select("key", F.lit("<answer>SAME</answer>").alias("response"), now().alias("created_at")).distinct()
    return M.detect(pairs, cache, lambda p: f"<thinking>{len(p)} characters</thinking><answer>DIFFERENT</answer>", now()).select("conv_id", "turn", "is_boundary", "confidence", "reasoning")


BLOCKS = """b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS block, (l_partkey % 5) * 100.0::DOUBLE AS x0, (l_suppkey % 40) * 20.0::DOUBLE AS y0, (l_partkey % 5) * 100.0::DOUBLE + l_quantity::DOUBLE * 4 AS x1, (l_suppkey % 40) * 20.0::DOUBLE + 15 AS y1, 8.0::DOUBLE + l_linenumber AS size, l_returnflag AS font, l_linestatus || l_returnflag AS text FROM lineitem)"""


def blocks(spark, sf_dir):
    return spark.sql("WITH " + BLOCKS.replace("::DOUBLE", "D").replace("l_quantityD", "CAST(l_quantity AS DOUBLE)").replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM b", lineitem=table(spark, sf_dir, "lineitem"))


@query(f"WITH {BLOCKS}, o AS (SELECT page, font, count(*) AS n FROM b GROUP BY page, font), d AS (SELECT page, arg_min(font, (-n, font)) AS dominant_font, count(*) AS n_fonts FROM o GROUP BY page), s AS (SELECT page, round(avg(size), 6) AS mean_size, min(size) AS least_size, max(size) AS most_size FROM b GROUP BY page) SELECT * FROM s JOIN d USING (page)")
def font_stats(spark, sf_dir):
    return L.fonts(blocks(spark, sf_dir)).withColumn("mean_size", F.round("mean_size", 6))


@query(f"WITH {BLOCKS}, w AS (SELECT page, y0 < lag(y0) OVER (PARTITION BY page ORDER BY block) - 10 AND x0 <= lag(x0) OVER (PARTITION BY page ORDER BY block) AS bad FROM b) SELECT page, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE 1 - count(*) FILTER (bad) / count(*)::DOUBLE END, 6) AS reading_order FROM w GROUP BY page")
def reading_order(spark, sf_dir):
    return L.reading_order(blocks(spark, sf_dir)).select("page", R6("reading_order"))


@query(f"WITH {BLOCKS} SELECT page, bool_or(y0 < 80) AS has_header, bool_or(y1 > 720) AS has_footer FROM b GROUP BY page")
def headers_footers(spark, sf_dir):
    return L.edges(blocks(spark, sf_dir), 800.0)


@query(f"WITH {BLOCKS} SELECT page, round((least(sum(length(text)) / 1000.0::DOUBLE, 1.0) + 1 / (1 + var_pop(size) / 100) + 1 + avg(CASE WHEN (x1 - x0) * (y1 - y0) > 100 AND (x1 - x0) * (y1 - y0) < 100000 THEN 1.0 ELSE 0.0 END)) / 4, 6) AS layout_quality FROM b GROUP BY page")
def layout_quality(spark, sf_dir):
    return L.quality(blocks(spark, sf_dir)).select("page", R6("layout_quality"))


@query(f"""WITH RECURSIVE {BLOCKS}, o AS (SELECT page, y0 AS y, row_number() OVER (PARTITION BY page ORDER BY y0) AS k FROM b),
f AS (SELECT page, k, [y] AS tops, [1] AS n FROM o WHERE k = 1 UNION ALL
 SELECT g.page, g.k, CASE WHEN near > 0 THEN tops ELSE list_append(tops, y) END, CASE WHEN near > 0 THEN list_transform(n, lambda c, i: CASE WHEN i = near THEN c + 1 ELSE c END) ELSE list_append(n, 1) END
 FROM (SELECT o.page, o.k, y, tops, n, CASE WHEN close > 0 AND tops[close] <> 0 THEN close ELSE coalesce(list_position(tops, y), 0) END AS near
  FROM (SELECT o.page, o.k, o.y, f.tops, f.n, coalesce(list_position(list_transform(f.tops, lambda a: abs(a - o.y) < 5), true), 0) AS close FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1) o) g),
e AS (SELECT page, arg_max(n, k) AS n FROM f GROUP BY page)
SELECT page, CAST(len(n) AS BIGINT) AS n_rows, CAST(list_max(n) AS INTEGER) AS most_columns, len(n) > 2 AND list_max(n) > 1 AND list_sum(n) / len(n)::DOUBLE > 1.5 AS is_table, round(least(list_sum(n) / len(n)::DOUBLE / 3, 1.0), 6) AS confidence FROM e""")
def layout_tables(spark, sf_dir):
    return L.tables(blocks(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))
