"""Proposals, modifications, subscriptions, keys and tokens as tables and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = "segment_id string, start_page long, end_page long, document_type string, suggested_filename string, confidence double, summary string, metadata map<string, string>"
MODIFICATION = "modification_type string, segment_id string, timestamp timestamp, details map<string, string>"


def segment_id(packet: Column, start: Column, end: Column) -> Column:
    """The same for the same pages, however often it is computed."""
    return F.sha2(F.concat_ws(":", packet.cast("string"), start.cast("string"), end.cast("string")).cast("binary"), 256)


def proposals(segments: DataFrame, packet: str = "packet_id") -> DataFrame:
    """(packet, proposal JSON); detections are not part of it."""
    fields = [c for c in segments.columns if c != packet]
    return segments.groupBy(packet).agg(F.to_json(F.array_sort(F.collect_list(F.struct("start_page", *(c for c in fields if c != "start_page"))))).alias("proposal"))


def proposal_rows(rows: DataFrame, json: str = "proposal") -> DataFrame:
    keys = [c for c in rows.columns if c != json]
    return rows.select(*keys, F.explode(F.from_json(json, f"array<struct<{SEGMENT}>>")).alias("s")).select(*keys, "s.*")


def modifications(json: Column) -> Column:
    return F.from_json(json, f"array<struct<{MODIFICATION}>>")


def with_metadata(metadata: Column, changes: Column) -> Column:
    """The map with changed keys; later values win."""
    empty = F.create_map().cast("map<string, string>")
    old, new = F.coalesce(metadata, empty), F.coalesce(changes, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def subscriptions(log: DataFrame) -> DataFrame:
    """(session_id, client_id) whose latest action is to subscribe."""
    last = log.groupBy("session_id", "client_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("last"))
    return last.where("last = 'subscribe'").drop("last")


def fanned_out(messages: DataFrame, subscribed: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Each message for each subscriber of its session, but for excluded (session_id, client_id)."""
    to = subscribed.join(excluded, ["session_id", "client_id"], "left_anti") if excluded is not None else subscribed
    return messages.join(to, "session_id")


def usage(keys: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Of each key hash its last use and number of uses, and whether it is still valid."""
    used = requests.groupBy(F.sha2(F.col("key").cast("binary"), 256).alias("key_hash")).agg(F.max("ts").alias("last_used"), F.count("*").alias("uses"))
    rows = keys.join(used, "key_hash", "left")
    return rows.withColumns({"uses": F.coalesce("uses", F.lit(0)), "is_valid": F.col("expires_at").isNull() | (F.col("expires_at") > now)})


def allowed(requests: DataFrame, keys: DataFrame, scope: Column, now: Column) -> DataFrame:
    """Requests whose key is known, not expired, and has the scope or all (*)."""
    rows = requests.withColumn("key_hash", F.sha2(F.col("key").cast("binary"), 256)).join(keys, "key_hash")
    return rows.where((F.col("expires_at").isNull() | (F.col("expires_at") > now)) & (F.array_contains("scopes", scope) | F.array_contains("scopes", F.lit("*"))))


def downloadable(requests: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Requests (token, session_id, filename) that their token covers: alive, uses left, same session, file allowed."""
    t = tokens.select("token", F.col("session_id").alias("__s"), "expires_at", "max_downloads", "downloads", "files")
    rows = requests.join(t, "token").where((F.col("expires_at") > now) & (F.col("downloads") < F.col("max_downloads")) & (F.col("session_id") == F.col("__s")))
    return rows.where(F.col("files").isNull() | F.array_contains("files", F.col("filename"))).select(*requests.columns)


def directory_stats(files: DataFrame) -> DataFrame:
    """Of (path, length, modified): count and size by suffix, and the oldest and newest file."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.min_by("path", "modified").alias("oldest"), F.max_by("path", "modified").alias("newest"))


def audit_action(path: Column) -> Column:
    has = lambda x: F.contains(path, F.lit(x))
    return F.when(has("/upload"), "file_upload").when(has("/download"), "file_download").when(has("/auth"), "authentication").when(has("/session"), "session")


def checksums(content: Column) -> dict[str, Column]:
    return {"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256)}
