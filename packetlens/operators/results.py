"""Results of processing: summaries, files, previews, look-ups of sessions and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import ratio
from .ranking import with_rank

# Kinds of files, their content types, and what paths, parameters and headers may hold.
FILE_KINDS = {".pdf": "pdf", ".zip": "zip", ".json": "manifest", ".txt": "manifest", ".log": "log"}
CONTENT_TYPES = {"pdf": "application/pdf", "zip": "application/zip", "manifest": "application/json", "log": "text/plain", "preview": "image/png"}
TRAVERSAL = r"(?i)\.\.|%2e%2e|%252e%252e"
PATH, PARAMETER, HEADER = r"^[a-zA-Z0-9/_\-.]+$", r"^[a-zA-Z0-9_\-]+$", r"^[a-zA-Z0-9\-]+$"
ERROR_CHARACTERS = "[�□▯]"
PREVIEW_CHARACTERS, PREVIEW_CUT = 5000, "\n... (truncated)"


def processing(pages: DataFrame, engine: str = "engine", seconds: str = "seconds") -> DataFrame:
    """(engine, pages, total_seconds, mean_seconds): of each engine and, engine null, of all, in one aggregate."""
    sets = pages.groupingSets([[], [engine]], engine)
    return sets.agg(F.count("*").alias("pages"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_seconds"), F.coalesce(F.avg(seconds), F.lit(0.0)).alias("mean_seconds"))


def accuracy(pages: DataFrame, groups: list[str], value: str = "accuracy", low: float = 0.85) -> DataFrame:
    """Pages, mean accuracy and pages of low accuracy: of all, and by each of the groups; `level` names the group, `member` its value."""
    level = F.lit("all")
    for g in groups:
        level = F.when(F.grouping(g) == 0, g).otherwise(level)
    rows = pages.select(value, *(F.col(g).cast("string").alias(g) for g in groups)).groupingSets([[], *([g] for g in groups)], *groups)
    rows = rows.agg(level.alias("level"), F.count("*").alias("pages"), F.avg(value).alias("mean"), F.count_if(F.col(value) < low).alias("low"))
    return rows.select("level", F.coalesce(*groups).alias("member"), "pages", "mean", "low")


def summary(results: DataFrame, files: str, size: str, at: str, order: str, most: int = 1000) -> DataFrame:
    """Totals, means and range of time of the first results in the order."""
    rows = results.orderBy(order).limit(most)
    return rows.agg(F.count("*").alias("sessions"), F.coalesce(F.sum(files), F.lit(0)).alias("files"), F.coalesce(F.sum(size), F.lit(0.0)).alias("size"), F.avg(files).alias("mean_files"), F.avg(size).alias("mean_size"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def cache_counters(log: DataFrame, action: str, saved: str) -> DataFrame:
    """Hits, misses, evictions, share of hits and time saved, over a log of a cache's actions."""
    n = {a: F.count_if(F.col(action) == a) for a in ("hit", "miss", "evict")}
    spared = F.coalesce(F.sum(F.when(F.col(action) == "hit", F.col(saved))), F.lit(0.0))
    return log.agg(n["hit"].alias("hits"), n["miss"].alias("misses"), n["evict"].alias("evictions"), ratio(n["hit"], n["hit"] + n["miss"]).alias("hit_rate"), spared.alias("saved"), ratio(spared, n["hit"]).alias("saved_per_hit"))


def oldest_age(entries: DataFrame, created: str, now: Column) -> DataFrame:
    """Seconds since the oldest entry was made; null without entries."""
    return entries.agg((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.min(F.col(created)).cast("timestamp"))).alias("oldest_age"))


def timings(rows: DataFrame, seconds: str, *groups: str) -> DataFrame:
    return rows.groupBy(*groups).agg(F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.avg(seconds).alias("mean"), F.sum(seconds).alias("total"))


def call_summary(calls: DataFrame, duration: str, failed: Column, slow: float) -> DataFrame:
    """Calls, errors, rounded mean and largest of the positive durations, and slow calls."""
    d = F.when(F.col(duration) > 0, F.col(duration))
    return calls.agg(F.count("*").alias("total"), F.count_if(failed).alias("errors"), F.coalesce(F.floor(F.avg(d) + 0.5), F.lit(0)).alias("mean"), F.coalesce(F.max(d), F.lit(0.0)).alias("most"), F.count_if(F.col(duration) > slow).alias("slow"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def file_kind(path: Column) -> Column:
    """By the suffix; pdf for others."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in FILE_KINDS.items() for x in kv))[suffix(path)], F.lit("pdf"))


def content_type(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))[kind], F.lit("application/octet-stream"))


def named_parts(filename: Column) -> dict[str, Column]:
    """document_type, the part before the first _, and page_range, of the first part like p1-5 (null if there is none)."""
    parts = F.split(F.replace(filename, F.lit(".pdf"), F.lit("")), "_")
    pages = F.get(F.filter(parts, lambda x: x.startswith("p") & F.contains(x, F.lit("-"))), F.lit(0))
    return {"document_type": parts[0], "page_range": F.substring(pages, 2, 1 << 20)}


def chosen_files(files: DataFrame, kinds: list[str] | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """Files (kind, size) of the kinds and sizes; None filters nothing."""
    for keep in (F.col("kind").isin(*kinds) if kinds is not None else None, F.col("size") >= least if least is not None else None, F.col("size") <= most if most is not None else None):
        files = files if keep is None else files.where(keep)
    return files


def download_manifest(files: DataFrame, session: str, now: Column, hours: int = 24) -> DataFrame:
    """Number and size of a session's files, and when the manifest expires."""
    rows = files.groupBy(session).agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return rows.withColumn("expires_at", now + F.expr(f"INTERVAL {int(hours)} HOURS"))


def is_safe_path(path: Column) -> Column:
    return ~path.rlike(TRAVERSAL) & path.rlike(PATH)


def passes_gate(text: Column, least: int = 10, words: int = 2, errors: float = 0.1) -> Column:
    """Long enough, enough words, and few characters that stand for unread ones."""
    n = F.length(text)
    bad = F.regexp_count(text, F.lit(ERROR_CHARACTERS))
    return (n >= least) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= words) & (F.when(n > 0, bad / n).otherwise(0.0) <= errors)


def is_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x0 <= x1) & (y0 <= y1) & (F.least(x0, y0, x1, y1) >= 0)


def readable(pages: DataFrame, kind: str = "page_type") -> DataFrame:
    """Pages with text of their own: what is only an image is left to recognition."""
    return pages.where(F.col(kind) != "image_based")


def asked_pairs(pairs: DataFrame, targets: list[int] | None, page: str = "page_no", first: str = "before", second: str = "text") -> DataFrame:
    """Pairs (the later page's number, both texts) of which neither text is empty and, with targets, either page is one."""
    rows = pairs.where((F.trim(first) != "") & (F.trim(second) != ""))
    return rows if targets is None else rows.where(F.col(page).isin(*targets) | (F.col(page) - 1).isin(*targets))


def first_boundary(pages: DataFrame, boundaries: DataFrame, order: str = "confidence") -> DataFrame:
    """Each page with the first boundary of its number, null if there is none."""
    keys = ["packet_id", "page_no"]
    first = boundaries.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
    return pages.join(first, keys, "left")


def by_upload(sessions: DataFrame, uploads: DataFrame, key: str = "session_id") -> DataFrame:
    """(upload_id, session): of the sessions whose metadata name the upload the first, else the first whose path has a part of its
    name. Two equi-joins: paths are cut into their parts, so no pair of all uploads and sessions is made."""
    named = uploads.join(sessions.select(F.get_json_object("metadata", "$.upload_id").alias("upload_id"), F.col(key)), "upload_id")
    parts = sessions.select(F.col(key), F.explode(F.array_distinct(F.split("pdf_path", "[/.]"))).alias("upload_id"))
    placed = uploads.join(parts, "upload_id")
    first = lambda rows, name: rows.groupBy("upload_id").agg(F.min(key).alias(name))
    out = uploads.join(first(named, "__named"), "upload_id", "left").join(first(placed, "__placed"), "upload_id", "left")
    return out.select("upload_id", F.coalesce("__named", "__placed").alias(key))


def with_upload(sessions: DataFrame, uploads: DataFrame) -> DataFrame:
    """Sessions with the metadata of the upload that their path names, null if it is unknown."""
    return sessions.withColumn("upload_id", F.nullif(F.regexp_extract("pdf_path", r"uploads/([^/]+)", 1), F.lit(""))).join(uploads, "upload_id", "left")


def paired(segments: DataFrame, files: DataFrame, packet: str = "packet_id") -> DataFrame:
    """Segments and files of a packet by their place in its order; those beyond the shorter list are left out."""
    at = lambda rows, order: with_rank(rows, [order], packet, name="__at")
    return at(segments, "segment_no").join(at(files, "file_no"), [packet, "__at"]).drop("__at")


def detailed(sessions: DataFrame, metadata: str = "metadata") -> DataFrame:
    """A result row of each finished session: fields of its JSON metadata, with what stands for missing ones."""
    field = lambda name, kind, default: F.coalesce(F.get_json_object(metadata, f"$.{name}").cast(kind), default)
    return sessions.where(F.col("status").isin("completed", "confirmed")).select(
        "*", field("split_id", "string", F.lit("")).alias("split_id"), field("k", "long", F.lit(0)).alias("total_pages"),
        field("processing_time", "double", F.lit(0.0)).alias("processing_time"), field("detection_method", "string", F.lit("embeddings")).alias("detection_method"),
        field("is_boundary", "boolean", F.lit(False)).alias("is_boundary"),
    )


def details(sessions: DataFrame, proposals: DataFrame, modifications: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions with their proposal's numbers (has_proposal, segments, pages) and the number of modifications."""
    p = proposals.groupBy(key).agg(F.count("*").alias("segments"), F.sum(F.col("end_page") - F.col("start_page") + 1).alias("pages"))
    m = modifications.groupBy(key).agg(F.count("*").alias("modifications"))
    rows = sessions.join(p, key, "left").join(m, key, "left")
    return rows.withColumns({"has_proposal": F.col("segments").isNotNull(), **{c: F.coalesce(c, F.lit(0)) for c in ("segments", "pages", "modifications")}})


def text_preview(pages: DataFrame, packet: str = "packet_id", first: int = 3) -> DataFrame:
    """(packet, preview): the first pages under their numbers, cut at 5000 characters."""
    rows = pages.where(F.col("page_no") < first).groupBy(packet).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
    blocks = F.transform("pages", lambda x: F.concat(F.lit("--- Page "), (x["page_no"] + 1).cast("string"), F.lit(" ---\n"), x["text"], F.lit("\n")))
    whole = F.array_join(blocks, "\n")
    return rows.select(packet, F.when(F.length(whole) > PREVIEW_CHARACTERS, F.concat(F.substring(whole, 1, PREVIEW_CHARACTERS), F.lit(PREVIEW_CUT))).otherwise(whole).alias("preview"))


def heartbeats(rows: DataFrame, key: str) -> DataFrame:
    """The number of each beat of a connection, and the time of the last one."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return rows.withColumns({"sequence": F.row_number().over(w), "last_heartbeat": F.max("ts").over(w)})


# Stages of a task, the share at which each begins, and the progress message's name of it.
MILESTONES = {"extracting": 0.3, "detecting": 0.6, "proposing": 0.9, "done": 1.0}


def stage(progress: Column) -> Column:
    """The stage that a share of progress is in."""
    out = F.lit("done")
    for name, end in reversed(list(MILESTONES.items())[:-1]):
        out = F.when(progress < end, name).otherwise(out)
    return out


def contiguous(lengths: DataFrame, packet: str, order: str, length: str) -> DataFrame:
    """Ranges (start, end) of consecutive segments of the lengths."""
    w = Window.partitionBy(packet).orderBy(order)
    return lengths.withColumn("end_page", F.sum(length).over(w) - 1).withColumn("start_page", F.col("end_page") - F.col(length) + 1)


def extracted(blocks: DataFrame, page: str = "page", height: float = 800.0) -> DataFrame:
    """A row for each page: its text in reading order, counts, range of sizes, dominant font and whether it has a header or footer."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "block", "text"))), lambda x: x["text"]), "\n")
    rows = blocks.groupBy(page).agg(text.alias("text"), F.count("*").alias("n_blocks"), F.min("size").alias("least_size"), F.max("size").alias("most_size"), F.bool_or(F.col("y0") < 0.1 * height).alias("has_header"), F.bool_or(F.col("y1") > 0.9 * height).alias("has_footer"))
    return rows.withColumns({"n_chars": F.length("text"), "n_words": F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))})


def page_texts(pages: DataFrame, page: str = "page") -> DataFrame:
    """What detectors need of an extracted page."""
    return pages.select(page, "text", "n_words", "n_chars")
