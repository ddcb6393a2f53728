"""Queries over results, files, requests and previews, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.operators import boundaries as B
from packetlens.operators import results as R
from packetlens.operators import segments as G
from packetlens.operators import sessions as S
from packetlens.runtime import durable
from packetlens.sources import archives as Z
from packetlens.sources.packets import packet_pages, packets, table
from packetlens.streaming.events import shared_folder

from .event_queries import BLOCKS, FOLDED, NOW, blocks, events, folded, now
from .registry import query
from .text_queries import BOUNDARIES, PACKET, SEGMENTS, TYPED, _typed, found, starts

R6 = lambda c: F.round(c, 6).alias(c)


@query("SELECT event_type AS engine, count(*) AS pages, round(sum(value), 2) AS total_seconds, round(avg(value) + 1e-9, 2) AS mean_seconds FROM events GROUP BY GROUPING SETS ((), (event_type))")
def processing_stats(spark, sf_dir):
    rows = R.processing(events(spark, sf_dir).withColumn("engine", F.col("event_type")), seconds="value")
    return rows.select("engine", "pages", F.round("total_seconds", 2).alias("total_seconds"), F.round(F.col("mean_seconds") + 1e-9, 2).alias("mean_seconds"))


ACCURACY = f"{TYPED}, a AS (SELECT page_type, source AS doc_type, CAST(d.doc_id % 2 = 0 AS VARCHAR) AS scanned, least(n_chars, 1000) / 1000.0::DOUBLE AS accuracy FROM t JOIN documents d USING (doc_id, source))"


@query(f"WITH {ACCURACY} SELECT CASE WHEN grouping(page_type) = 0 THEN 'page_type' WHEN grouping(doc_type) = 0 THEN 'doc_type' WHEN grouping(scanned) = 0 THEN 'scanned' ELSE 'all' END AS level, coalesce(page_type, doc_type, scanned) AS member, count(*) AS pages, round(avg(accuracy), 6) AS mean, count(*) FILTER (accuracy < 0.85) AS low FROM a GROUP BY GROUPING SETS ((), (page_type), (doc_type), (scanned))")
def accuracy_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.least("n_chars", F.lit(1000)) / 1000).alias("accuracy"))
    rows = _typed(spark, sf_dir).join(d, "doc_id").select("page_type", F.col("source").alias("doc_type"), (F.col("doc_id") % 2 == 0).alias("scanned"), "accuracy")
    return R.accuracy(rows, ["page_type", "doc_type", "scanned"]).withColumn("mean", F.round("mean", 6))


@query("WITH n AS (SELECT l_orderkey AS o_orderkey, count(*) AS files FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, o_orderdate, o_totalprice::DOUBLE AS size, files FROM orders JOIN n USING (o_orderkey) WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1000) SELECT count(*) AS sessions, CAST(sum(files) AS BIGINT) AS files, round(sum(size), 2) AS size, round(avg(files), 6) AS mean_files, round(avg(size), 4) AS mean_size, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM r")
def results_summary(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("files"))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(n, "o_orderkey").withColumn("size", F.col("o_totalprice").cast("double"))
    out = R.summary(rows, "files", "size", "o_orderdate", "o_orderkey")
    return out.withColumns({"size": F.round("size", 2), "mean_files": F.round("mean_files", 6), "mean_size": F.round("mean_size", 4)})


ACTIONS = "CASE event_type WHEN 'click' THEN 'hit' WHEN 'view' THEN 'miss' WHEN 'error' THEN 'evict' ELSE 'put' END"


@query(f"WITH a AS (SELECT value, {ACTIONS} AS action FROM events), c AS (SELECT count(*) FILTER (action = 'hit') AS hits, count(*) FILTER (action = 'miss') AS misses, count(*) FILTER (action = 'evict') AS evictions, coalesce(sum(value) FILTER (action = 'hit'), 0.0) AS saved FROM a) SELECT hits, misses, evictions, round(CASE WHEN hits + misses = 0 THEN 0.0 ELSE hits / (hits + misses)::DOUBLE END, 6) AS hit_rate, round(saved, 4) AS saved, round(CASE WHEN hits = 0 THEN 0.0 ELSE saved / hits END, 6) AS saved_per_hit FROM c")
def cache_counters(spark, sf_dir):
    kind = F.col("event_type")
    log = events(spark, sf_dir).withColumn("action", F.when(kind == "click", "hit").when(kind == "view", "miss").when(kind == "error", "evict").otherwise("put"))
    return R.cache_counters(log, "action", "value").withColumns({"hit_rate": F.round("hit_rate", 6), "saved": F.round("saved", 4), "saved_per_hit": F.round("saved_per_hit", 6)})


@query(f"SELECT CAST(epoch({NOW}) - floor(epoch(min(ts))) AS BIGINT) AS oldest_age FROM events")
def oldest_entry(spark, sf_dir):
    return R.oldest_age(events(spark, sf_dir), "ts", now())


@query("SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def timing_stats(spark, sf_dir):
    return R.timings(events(spark, sf_dir), "value", "event_type").withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4)})


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, CAST(floor(avg(value) FILTER (value > 0) + 0.5) AS BIGINT) AS mean, max(value) FILTER (value > 0) AS most, count(*) FILTER (value > 100) AS slow FROM events")
def call_summary(spark, sf_dir):
    return R.call_summary(events(spark, sf_dir), "value", F.col("event_type") == "error", 100.0)


FILE = "'Invoice_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '_p1-' || (doc_id % 7 + 1) WHEN 1 THEN '_p-x' ELSE '_page' END || CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.zip' WHEN 2 THEN '.json' WHEN 3 THEN '.log' WHEN 4 THEN '.pdf' ELSE '.txt' END"
KIND = "CASE doc_id % 6 WHEN 1 THEN 'zip' WHEN 2 THEN 'manifest' WHEN 5 THEN 'manifest' WHEN 3 THEN 'log' ELSE 'pdf' END"


def files(spark, sf_dir):
    i = F.col("doc_id")
    pages = F.when(i % 3 == 0, F.concat(F.lit("_p1-"), (i % 7 + 1).cast("string"))).when(i % 3 == 1, "_p-x").otherwise("_page")
    ends = F.array(*(F.lit(x) for x in (".PDF", ".zip", ".json", ".log", ".pdf", ".txt")))[(i % 6).cast("int")]
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("Invoice_"), i.cast("string"), pages, ends).alias("filename"), F.col("n_chars").alias("size"))
    return rows.withColumn("kind", R.file_kind(F.col("filename")))


@query(f"WITH f AS (SELECT doc_id, {FILE} AS filename, {KIND} AS kind FROM documents) SELECT doc_id, kind, CASE kind WHEN 'pdf' THEN 'application/pdf' WHEN 'zip' THEN 'application/zip' WHEN 'manifest' THEN 'application/json' ELSE 'text/plain' END AS content_type, 'Invoice' AS document_type, CASE doc_id % 3 WHEN 0 THEN '1-' || (doc_id % 7 + 1) || CASE doc_id % 6 WHEN 0 THEN '.PDF' ELSE '.log' END WHEN 1 THEN '-x' || CASE doc_id % 6 WHEN 1 THEN '.zip' WHEN 4 THEN '' END END AS page_range FROM f")
def file_kinds(spark, sf_dir):
    rows = files(spark, sf_dir)
    parts = R.named_parts(F.col("filename"))
    return rows.select("doc_id", "kind", R.content_type(F.col("kind")).alias("content_type"), *(c.alias(k) for k, c in parts.items()))


@query(f"SELECT source, count(*) AS total_files, CAST(sum(n_chars) AS BIGINT) AS total_size, {NOW} + INTERVAL 24 HOURS AS expires_at FROM documents WHERE {KIND} IN ('pdf', 'zip') AND n_chars BETWEEN 100 AND 5000 GROUP BY source")
def download_manifest(spark, sf_dir):
    return R.download_manifest(R.chosen_files(files(spark, sf_dir), ["pdf", "zip"], 100, 5000), "source", now())


@query("WITH p AS (SELECT page_id, url, '/' || substr(url, 1, 20) || CASE page_id % 4 WHEN 0 THEN '/../x' WHEN 1 THEN '/%2E%2e/y' WHEN 2 THEN '/a b' ELSE '/ok' END AS path FROM pages) SELECT page_id, NOT regexp_matches(path, '(?i)\\.\\.|%2e%2e|%252e%252e') AND regexp_matches(path, '^[a-zA-Z0-9/_\\-.]+$') AS safe, regexp_matches(substr(url, 1, 4), '^[a-zA-Z0-9_\\-]+$') AS is_parameter FROM p")
def request_paths(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.concat(F.lit("/"), F.substring("url", 1, 20), F.when(k == 0, "/../x").when(k == 1, "/%2E%2e/y").when(k == 2, "/a b").otherwise("/ok"))
    return table(spark, sf_dir, "pages").select("page_id", R.is_safe_path(path).alias("safe"), F.substring("url", 1, 4).rlike(R.PARAMETER).alias("is_parameter"))


@query(r"WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || repeat('□', CAST(length(text) // 12 AS INTEGER)) ELSE substr(text, 1, turn * 4) END AS text FROM conversations) SELECT conv_id, turn, length(text) >= 10 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 2 AND CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[\x{fffd}\x{25a1}\x{25af}]', '', 'g'))) / length(text)::DOUBLE ELSE 0.0 END <= 0.1 AS passes FROM c")
def text_gate(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.expr("repeat('□', CAST(floor(length(text) / 12) AS INT))"))).otherwise(F.expr("substr(text, 1, CAST(turn * 4 AS INT))"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.passes_gate(text).alias("passes"))


@query(f"WITH {BLOCKS} SELECT page, block, x0 <= x1 AND y0 - 100 <= y1 AND least(x0, y0 - 100, x1, y1) >= 0 AS is_box FROM b")
def box_checks(spark, sf_dir):
    return blocks(spark, sf_dir).select("page", "block", R.is_box(F.col("x0"), F.col("y0") - 100, F.col("x1"), F.col("y1")).alias("is_box"))


@query(f"WITH {TYPED} SELECT doc_id, page_type FROM t WHERE page_type <> 'image_based'")
def readable_pages(spark, sf_dir):
    return R.readable(_typed(spark, sf_dir)).select("doc_id", "page_type")


@query("WITH b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn FROM b WHERE trim(before) <> '' AND trim(text) <> '' AND (turn IN (1, 3) OR turn - 1 IN (1, 3))")
def asked_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(B.in_order("conv_id", "turn")))
    return R.asked_pairs(rows, [1, 3], "turn").select("conv_id", "turn")


@query(f"{BOUNDARIES} SELECT packet_id, page_no, CASE WHEN boundary_type = 'document_start' THEN round(confidence, 6) END AS confidence FROM h UNION ALL SELECT packet_id, page_no, NULL FROM p WHERE page_no = 0")
def page_boundaries(spark, sf_dir):
    own = packets(spark, sf_dir)
    return R.first_boundary(own.pages.select("packet_id", "page_no"), starts(own).select("packet_id", "page_no", "confidence")).select("packet_id", "page_no", R6("confidence"))


UPLOADS = f"WITH {FOLDED}, x AS (SELECT user_id AS session_id, status, created_at, '/data/uploads/u' || (user_id % 50) || '/f' || user_id || '.pdf' AS pdf_path, CASE WHEN user_id % 3 = 0 THEN 'u' || (user_id % 40) END AS named FROM s), u AS (SELECT DISTINCT 'u' || (user_id % 60) AS upload_id FROM s)"


def upload_sessions(spark, sf_dir):
    i = F.col("user_id")
    text = i.cast("string")
    rows = folded(spark, sf_dir).withColumns({
        "session_id": i, "pdf_path": F.concat(F.lit("/data/uploads/u"), (i % 50).cast("string"), F.lit("/f"), text, F.lit(".pdf")),
        "metadata": F.when(i % 3 == 0, F.to_json(F.struct(F.concat(F.lit("u"), (i % 40).cast("string")).alias("upload_id")))).otherwise(F.lit("{}")),
    })
    return rows, rows.select(F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string")).alias("upload_id")).distinct()


@query(f"{UPLOADS} SELECT upload_id, coalesce((SELECT min(session_id) FROM x WHERE named = upload_id), (SELECT min(session_id) FROM x WHERE contains(pdf_path, '/' || upload_id || '/'))) AS session_id FROM u")
def session_by_upload(spark, sf_dir):
    return R.by_upload(*upload_sessions(spark, sf_dir))


@query(f"{UPLOADS} SELECT session_id, 'u' || (session_id % 50) AS upload_id, CASE WHEN 'u' || (session_id % 50) IN (SELECT upload_id FROM u) AND session_id % 50 < 30 THEN session_id % 50 * 10 END AS pages FROM x")
def session_uploads(spark, sf_dir):
    rows, uploads = upload_sessions(spark, sf_dir)
    number = F.substring("upload_id", 2, 9).cast("long")
    return R.with_upload(rows, uploads.where(number < 30).withColumn("pages", number * 10)).select("session_id", "upload_id", "pages")


@query(f"{SEGMENTS}, fi AS (SELECT packet_id, segment_no AS file_no, 'f' || segment_no AS filename FROM seg WHERE segment_no % 4 <> 0), sa AS (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY segment_no) AS k FROM seg), fb AS (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY file_no) AS k FROM fi) SELECT sa.packet_id, sa.segment_no, fb.filename FROM sa JOIN fb ON sa.packet_id = fb.packet_id AND sa.k = fb.k")
def output_files(spark, sf_dir):
    rows = found(spark, sf_dir)[0].select("packet_id", "segment_no")
    made = rows.where("segment_no % 4 <> 0").select("packet_id", F.col("segment_no").alias("file_no"), F.concat(F.lit("f"), F.col("segment_no").cast("string")).alias("filename"))
    return R.paired(rows, made).select("packet_id", "segment_no", "filename")


@query("SELECT event_id, '' AS split_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_pages, 0.0::DOUBLE AS processing_time, 'embeddings' AS detection_method, false AS is_boundary FROM events WHERE event_type = 'purchase'")
def result_rows(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("status", F.when(F.col("event_type") == "purchase", "completed").otherwise("pending"))
    return R.detailed(rows, "props").select("event_id", "split_id", "total_pages", "processing_time", "detection_method", "is_boundary")


@query(f"WITH {PACKET}, w AS (SELECT packet_id, string_agg('--- Page ' || (page_no + 1) || ' ---' || chr(10) || text || chr(10), chr(10) ORDER BY page_no) AS w FROM p WHERE page_no < 40 GROUP BY packet_id) SELECT packet_id, CASE WHEN length(w) > 5000 THEN substr(w, 1, 5000) || chr(10) || '... (truncated)' ELSE w END AS preview FROM w")
def text_preview(spark, sf_dir):
    return R.text_preview(packet_pages(spark, sf_dir), first=40)


@query(f"{SEGMENTS}, ss AS (SELECT DISTINCT packet_id FROM p), nn AS (SELECT packet_id, count(*) AS segments, CAST(sum(end_page - start_page + 1) AS BIGINT) AS pages FROM seg WHERE packet_id % 2 = 0 GROUP BY packet_id), mm AS (SELECT packet_id, count(*) AS modifications FROM seg WHERE packet_id % 3 = 0 GROUP BY packet_id) SELECT packet_id AS session_id, coalesce(segments, 0) AS segments, coalesce(pages, 0) AS pages, segments IS NOT NULL AS has_proposal, coalesce(modifications, 0) AS modifications FROM ss LEFT JOIN nn USING (packet_id) LEFT JOIN mm USING (packet_id)")
def session_details(spark, sf_dir):
    own = packets(spark, sf_dir)
    rows = durable(G.segments(starts(own), None, ends=own.ends).withColumnRenamed("packet_id", "session_id"))
    return R.details(own.ends.select(F.col("packet_id").alias("session_id")), rows.where("session_id % 2 = 0"), rows.where("session_id % 3 = 0")).select("session_id", "segments", "pages", "has_proposal", "modifications")


@query(f"WITH {FOLDED}, a AS (SELECT DISTINCT user_id + o AS user_id FROM s, (VALUES (0), (1000000)) v(o)) SELECT user_id, status, CASE WHEN expires_at IS NULL THEN 'missing' WHEN expires_at < {NOW} THEN 'expired' ELSE 'found' END AS outcome FROM a LEFT JOIN s USING (user_id)")
def session_read(spark, sf_dir):
    rows = folded(spark, sf_dir)
    ids = rows.select("user_id").union(rows.select(F.col("user_id") + 1_000_000))
    return S.read(rows, ids, now(), "user_id").select("user_id", "status", "outcome")


@query("SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS sequence, max(ts) OVER w AS last_heartbeat, CASE WHEN value < 30 THEN 'extracting' WHEN value < 60 THEN 'detecting' WHEN value < 90 THEN 'proposing' ELSE 'done' END AS stage FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def heartbeats(spark, sf_dir):
    return R.heartbeats(events(spark, sf_dir), "user_id").select("event_id", "sequence", "last_heartbeat", R.stage(F.col("value") / 100).alias("stage"))


@query("SELECT o_custkey, o_orderkey, CAST(sum(n) OVER w AS BIGINT) - n AS start_page, CAST(sum(n) OVER w AS BIGINT) - 1 AS end_page FROM (SELECT o_custkey, o_orderkey, o_orderkey % 9 + 1 AS n FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def contiguous_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 9 + 1).alias("n"))
    return R.contiguous(rows, "o_custkey", "o_orderkey", "n").select("o_custkey", "o_orderkey", "start_page", "end_page")


@query(f"WITH {BLOCKS} SELECT page, string_agg(text, chr(10) ORDER BY y0, x0, block) AS text, count(*) AS n_blocks, min(size) AS least_size, max(size) AS most_size, bool_or(y0 < 80) AS has_header, bool_or(y1 > 720) AS has_footer, CAST(sum(length(text)) + count(*) - 1 AS INTEGER) AS n_chars, CAST(count(*) AS INTEGER) AS n_words FROM b GROUP BY page")
def extracted_pages(spark, sf_dir):
    return R.extracted(blocks(spark, sf_dir))


def _edit_sql() -> str:
    return f"""{SEGMENTS}, x AS (SELECT *, CASE WHEN segment_no % 6 = 0 THEN 'remove' WHEN segment_no % 6 = 1 AND end_page > start_page THEN 'split' WHEN segment_no % 6 = 2 THEN 'rename' END AS edit FROM seg)
SELECT packet_id, edit, count(*) AS n FROM x WHERE edit IS NOT NULL GROUP BY packet_id, edit"""


@query(_edit_sql())
def edit_audit(spark, sf_dir):
    """The audit rows of edits that a proposal's packets had."""
    rows = found(spark, sf_dir)[0]
    kind = F.when(F.col("segment_no") % 6 == 0, "remove").when((F.col("segment_no") % 6 == 1) & (F.col("end_page") > F.col("start_page")), "split").when(F.col("segment_no") % 6 == 2, "rename")
    edits = rows.withColumn("edit", kind).where("edit is not null").select("packet_id", "segment_no", "edit", (F.col("start_page") + 1).alias("at"), F.lit("renamed.pdf").alias("name"))
    return G.edited(rows, edits)[1].groupBy("packet_id", "edit").agg(F.count("*").alias("n"))


@query(f"""{SEGMENTS}, x AS (SELECT *, segment_no % 6 = 1 AND end_page > start_page AS cut FROM seg WHERE segment_no % 6 <> 0)
SELECT packet_id, segment_no, start_page, CASE WHEN cut THEN start_page ELSE end_page END AS end_page, CASE WHEN segment_no % 6 = 2 THEN 'renamed.pdf' END AS filename FROM x
UNION ALL SELECT packet_id, segment_no, start_page + 1, end_page, NULL FROM x WHERE cut""")
def edited_segments(spark, sf_dir):
    """A proposal after splits, removals and new names."""
    rows = found(spark, sf_dir)[0]
    kind = F.when(F.col("segment_no") % 6 == 0, "remove").when((F.col("segment_no") % 6 == 1) & (F.col("end_page") > F.col("start_page")), "split").when(F.col("segment_no") % 6 == 2, "rename")
    edits = rows.withColumn("edit", kind).where("edit is not null").select("packet_id", "segment_no", "edit", (F.col("start_page") + 1).alias("at"), F.lit("renamed.pdf").alias("name"))
    return G.edited(rows, edits)[0].select("packet_id", "segment_no", "start_page", "end_page", "filename")




ARCHIVE_BYTES = 4000
MEMBERS = f"{SEGMENTS}, mm AS (SELECT seg.packet_id, seg.segment_no, string_agg(p.text, chr(12) ORDER BY p.page_no) AS content FROM seg JOIN p ON p.packet_id = seg.packet_id AND p.page_no BETWEEN start_page AND end_page GROUP BY seg.packet_id, seg.segment_no)"


@query(f"{MEMBERS}, aa AS (SELECT *, strlen(content) AS n, sum(strlen(content)) OVER (PARTITION BY packet_id ORDER BY segment_no) AS upto FROM mm) SELECT packet_id, (upto - n) // {ARCHIVE_BYTES} AS archive_no, count(*) AS members, CAST(sum(n) AS BIGINT) AS n_bytes, sha256(string_agg(content, '' ORDER BY segment_no)) AS content_sha256 FROM aa GROUP BY 1, 2")
def archived_segments(spark, sf_dir):
    """Segments written as archives of each packet, and read back by the offsets of their list."""
    rows, pages = found(spark, sf_dir, read=True)
    ranges = rows.select("packet_id", F.col("segment_no").alias("position"), "start_page", "end_page")
    path = shared_folder(spark)
    Z.write_ranges(ranges, pages, F.format_string("segment_%05d.txt", "position"), path, ARCHIVE_BYTES, compress="false", volumes="true")
    listed = Z.read_members(Z.manifest(spark, path), path)
    parts = listed.groupBy("packet_id", "archive_no").agg(F.count("*").alias("members"), F.sum("size").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("position", F.col("content").cast("string").alias("content")))).alias("m"))
    return parts.select("packet_id", "archive_no", "members", "n_bytes", F.sha2(F.array_join(F.transform("m", lambda x: x["content"]), ""), 256).alias("content_sha256"))


@query("WITH f AS (SELECT page_id, strlen(coalesce(html, '')) AS n FROM pages), c AS (SELECT page_id, n, unnest(range(0, greatest(n, 1), 1000)) AS at_byte FROM f) SELECT page_id, at_byte AS start_byte, least(1000, n - at_byte) AS n_bytes, round(CASE WHEN n = 0 THEN 1.0 ELSE least(at_byte + 1000, n) / n::DOUBLE END, 6) AS progress FROM c")
def chunked_reads(spark, sf_dir):
    rows = Z.read_in_chunks(table(spark, sf_dir, "pages"), F.col("page_id"), F.octet_length(F.coalesce("html", F.lit(""))), 1000)
    return rows.select(F.col("path").alias("page_id"), F.col("offset").alias("start_byte"), "n_bytes", R6("progress"))
