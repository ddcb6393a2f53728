"""Session rows with nested JSON that changed its form over time.

A row is written as its version knew it: the proposal and the status from the first on, modifications from the second, metadata from
the third. Nested parts are VARIANT columns, so a field that a later version adds changes no schema. Reading merges the files'
schemas, fills what older rows lack, and takes typed fields out of the variants; what has another type than asked for is null, not
an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nested parts with the version that brought them and what older rows have instead.
PARTS = {"proposal": (1, "{}"), "modifications": (2, "[]"), "metadata": (3, "{}")}
LATEST = 3
SEGMENT = "array<struct<segment_id: string, start_page: bigint, end_page: bigint, confidence: double, document_type: string>>"
MODIFICATION = "array<struct<type: string, segment_id: string, at: string>>"


def stored(sessions: DataFrame, version: int = LATEST) -> DataFrame:
    """(session_id, version, status, created_at, updated_at, expires_at, and the version's parts as VARIANT) of sessions with each part a
    struct, an array or a JSON text. Times are ISO texts, as rows of any age have them."""
    if not 1 <= version <= LATEST:
        raise ValueError(f"no version {version}")
    kinds = dict(sessions.dtypes)

    def nested(name: str) -> Column:
        return F.try_parse_json(F.col(name) if kinds[name] == "string" else F.to_json(name)).alias(name)

    times = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) for c in ("created_at", "updated_at", "expires_at")]
    return sessions.select("session_id", F.lit(version).alias("version"), "status", *times, *(nested(k) for k, (since, _) in PARTS.items() if since <= version))


def append(sessions: DataFrame, path: str, version: int = LATEST) -> None:
    """Writes the rows beside those of other versions."""
    stored(sessions, version).write.mode("append").parquet(path)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """All rows below the path as of the latest version, the parts still variants."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    for name, (_, default) in PARTS.items():
        empty = F.parse_json(F.lit(default))
        # A part that is JSON null counts as lacking.
        known = F.when(~F.is_variant_null(name), F.col(name)) if name in rows.columns else F.lit(None)
        rows = rows.withColumn(name, F.coalesce(known, empty) if name in rows.columns else empty)
    return rows.withColumns({c: F.to_timestamp_ntz(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")) for c in ("created_at", "updated_at", "expires_at")})


def detailed(rows: DataFrame) -> DataFrame:
    """Sessions with typed fields: segments, modifications, and of the metadata the upload, the number of pages and whether it was
    auto-confirmed, with the defaults of rows that lack them."""
    field = lambda path, kind: F.try_variant_get("metadata", path, kind)
    segments = F.coalesce(F.try_variant_get("proposal", "$.segments", SEGMENT), F.array().cast(SEGMENT))
    changes = F.coalesce(F.try_variant_get("modifications", "$", MODIFICATION), F.array().cast(MODIFICATION))
    return rows.select(
        "session_id", "version", "status", "created_at", "updated_at", "expires_at", segments.alias("segments"), changes.alias("modifications"),
        field("$.upload_id", "string").alias("upload_id"), F.coalesce(field("$.total_pages", "bigint"), F.lit(0).cast("long")).alias("total_pages"), F.coalesce(field("$.auto_confirmed", "boolean"), F.lit(False)).alias("auto_confirmed"),
    )


def nested_report(runs: DataFrame, key: str, summary: list[str]) -> DataFrame:
    """(key, report): for each key one JSON of its runs in order and, of the named numbers, the best value."""
    own = [c for c in runs.columns if c != key]
    best = F.struct(*(F.max(c).alias(f"best_{c}") for c in summary))
    grouped = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("runs"), best.alias("summary"))
    return grouped.select(key, F.to_json(F.struct("summary", "runs")).alias("report"))
