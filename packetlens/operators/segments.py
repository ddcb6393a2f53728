"""Boundaries to segments, their names, and edits of a proposal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.functions import text as T

from packetlens.runtime import durable, stored

from .ranking import with_rank
from .scans import BLOCK, looked_up, running, with_neighbour


def segments(starts: DataFrame, pages: DataFrame | None, corrected: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """(packet_id, segment_no, start_page, end_page, confidence) from document starts (packet_id, page_no, confidence).

    Each start runs to the page before the next one, the last to the packet's end. Segments that would end before they start -
    repeated starts, starts beyond the end - are dropped, but count in segment_no; a packet without starts has none. corrected:
    a packet begins with a segment, whether or not a start is found there. ends: (packet_id, n), the packets' numbers of pages if they are known; the pages are
    not read then. Starts are written once and numbered in blocks of pages, of which a scan has how many starts are before each.
    """
    ends = durable(ends.select("packet_id", "n") if ends is not None else pages.groupBy("packet_id").agg((F.max("page_no") + 1).alias("n")))
    rows = stored(starts.select("packet_id", "page_no", "confidence"))
    if corrected:
        first = ends.select("packet_id", F.lit(0).cast("long").alias("page_no"), F.lit(1.0).alias("confidence"))
        rows = rows.unionByName(first.join(rows.where("page_no = 0").select("packet_id"), "packet_id", "left_anti"))
    rows = rows.withColumn("__block", F.floor(F.col("page_no") / BLOCK))
    blocks = rows.groupBy("packet_id", F.col("__block").alias("__at")).agg(F.count("*").alias("n_own"), F.min("page_no").alias("first"))
    blocks = with_neighbour(running(blocks, "packet_id", ["__at"], "place", {"upto": "n_own"}), "packet_id", "place", {"after": "first"}, 1)
    blocks = blocks.select(F.col("packet_id").alias("__packet"), "__at", (F.col("upto") - F.col("n_own")).alias("before"), "after")
    w = Window.partitionBy("packet_id", "__block").orderBy("page_no", "confidence")
    rows = rows.withColumns({"place": F.row_number().over(w), "next": F.lead("page_no").over(w)})
    rows = rows.join(blocks, rows["packet_id"].eqNullSafe(blocks["__packet"]) & rows["__block"].eqNullSafe(blocks["__at"]))
    rows = looked_up(rows, ends, "packet_id").withColumn("end_page", F.coalesce("next", "after", "n") - 1)
    return rows.where("page_no <= end_page").select("packet_id", (F.col("before") + F.col("place")).cast("int").alias("segment_no"), F.col("page_no").alias("start_page"), "end_page", "confidence")


def with_pages(found: DataFrame, pages: DataFrame, first: int | None = None, value: str = "text") -> DataFrame:
    """A row for each page of each segment (only the first few) with the page's value, as an equi-join on the page number."""
    last = F.least("end_page", F.col("start_page") + (first - 1)) if first else F.col("end_page")
    return found.withColumn("page_no", F.explode(F.sequence("start_page", last))).join(pages.select("packet_id", "page_no", value), ["packet_id", "page_no"])


#: Pages of a segment that its name comes from.
NAMED_BY = 3


def named(found: DataFrame, pages: DataFrame | None, openings: DataFrame | None = None) -> DataFrame:
    """Adds document_type, date, identifier, suggested_filename and summary, from the first three pages at most. openings: (packet_id, page_no, opening), the texts of
    NAMED_BY pages from each segment's first one on, whosever they are, if they are known; the pages are not read then."""
    keys = found.columns
    if openings is not None:
        texts = openings.select("packet_id", F.col("page_no").alias("start_page"), "opening")
        own = F.slice("opening", F.lit(1), F.least(F.lit(NAMED_BY), F.col("end_page") - F.col("start_page") + 1).cast("int"))
        rows = found.join(texts, ["packet_id", "start_page"]).withColumn("texts", own).drop("opening")
    else:
        rows = with_pages(found, pages, NAMED_BY).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
        rows = rows.withColumn("texts", F.transform(F.filter("pages", lambda x: x["page_no"] < F.col("start_page") + NAMED_BY), lambda x: x["text"]))
    rows = rows.withColumns({"three": F.lower(F.array_join("texts", " ")), "two": F.array_join(F.slice("texts", 1, 2), " ")})
    rows = rows.withColumns({"document_type": T.document_type(F.col("three")), "date": T.date_of(F.col("two")), "summary": T.summary(F.col("texts")[0])})
    rows = rows.withColumn("identifier", T.identifier(F.col("two"), F.col("document_type")))
    return rows.select(*keys, "document_type", "date", "identifier", T.suggested_name(F.col("document_type"), F.col("date"), F.col("identifier"), F.col("segment_no")).alias("suggested_filename"), "summary")


def unique_names(rows: DataFrame, packet: str = "packet_id", order: str | list[str] = "segment_no", name: str = "suggested_filename") -> DataFrame:
    """Adds filename: a name's later bearers get _1, _2 .. before the suffix. A name may have very many bearers."""
    rows = with_rank(stored(rows), [order] if isinstance(order, str) else order, packet, name, name="__k")
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return rows.withColumn("filename", F.when(F.col("__k") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), (F.col("__k") - 1).cast("string"), suffix))).drop("__k")


def page_range(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("Page %d", start + 1)).otherwise(F.format_string("Pages %d-%d", start + 1, end + 1))


def violations(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Segments that overlap the one before, end beyond the packet, start below zero or have no valid confidence."""
    w = Window.partitionBy("packet_id").orderBy("start_page", "end_page")
    ends = pages.groupBy("packet_id").agg((F.max("page_no") + 1).alias("n"))
    rows = found.withColumn("last_end", F.lag("end_page").over(w)).join(ends, "packet_id")
    why = F.array_compact(F.array(F.when(F.col("last_end") >= F.col("start_page"), "overlap"), F.when(F.col("end_page") >= F.col("n"), "beyond"), F.when((F.col("start_page") < 0) | (F.col("end_page") < F.col("start_page")), "range"), F.when(~F.col("confidence").between(0, 1), "confidence")))
    return rows.withColumn("violations", why).where(F.size("violations") > 0).drop("last_end", "n")


def merge(found: DataFrame, group: Column) -> DataFrame:
    """Segments of one group (null: left alone) become one: from the first start to the last end, with the least confidence and
    the first type; gaps between them are taken in."""
    rows = found.withColumn("__g", group)
    single = rows.where("__g is null").drop("__g")
    kind = [F.min_by("document_type", "start_page").alias("document_type")] if "document_type" in found.columns else []
    joined = rows.where("__g is not null").groupBy("packet_id", "__g").agg(F.min("segment_no").alias("segment_no"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.min("confidence").alias("confidence"), *kind)
    return single.unionByName(joined.drop("__g"), allowMissingColumns=True)


def split(found: DataFrame, at: Column) -> DataFrame:
    """A segment with start < at <= end becomes two, the second from `at` on; others stay. A part is 1, 2 or, unsplit, 0."""
    cut = (at > F.col("start_page")) & (at <= F.col("end_page"))
    part = lambda s, e, k: F.struct(s.cast("long").alias("start_page"), e.cast("long").alias("end_page"), F.lit(k).alias("part"))
    start, end = F.col("start_page"), F.col("end_page")
    parts = F.when(cut, F.array(part(start, at - 1, 1), part(at, end, 2))).otherwise(F.array(part(start, end, 0)))
    rows = found.withColumn("__p", F.explode(parts))
    return rows.select("packet_id", "segment_no", F.col("__p.start_page"), F.col("__p.end_page"), "confidence", F.col("__p.part"))


PATCHABLE = ("document_type", "suggested_filename", "summary", "start_page", "end_page", "metadata")


def patched(found: DataFrame, changes: DataFrame) -> DataFrame:
    """Values of `changes` (packet_id, segment_no and some of PATCHABLE) where there are any; other fields can't be patched."""
    fields = [c for c in changes.columns if c in PATCHABLE and c in found.columns]
    new = changes.select("packet_id", "segment_no", *(F.col(c).alias(f"__{c}") for c in fields))
    rows = found.join(new, ["packet_id", "segment_no"], "left")
    return rows.withColumns({c: F.coalesce(f"__{c}", c) for c in fields}).select(*found.columns)


def without(found: DataFrame, ids: DataFrame) -> DataFrame:
    return found.join(ids, ["packet_id", "segment_no"], "left_anti")


def with_segment(found: DataFrame, added: DataFrame) -> DataFrame:
    """User segments: sure, and named by their pages unless they have a name."""
    name = F.coalesce(F.col("suggested_filename"), F.format_string("segment_%d_%d.pdf", F.col("start_page") + 1, F.col("end_page") + 1)) if "suggested_filename" in added.columns else F.format_string("segment_%d_%d.pdf", F.col("start_page") + 1, F.col("end_page") + 1)
    return found.withColumn("is_user_defined", F.lit(False)).unionByName(added.withColumns({"suggested_filename": name, "confidence": F.lit(1.0), "is_user_defined": F.lit(True)}), allowMissingColumns=True)


def edited(found: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The proposal after edits (packet_id, segment_no, edit, at, name), one for a segment, and an audit row for each that was applied:
    `remove`; `split`, in two at page `at`, if that is inside; `rename`, to `name`. Segments without an edit stay."""
    rows = found.join(edits.select("packet_id", "segment_no", "edit", "at", "name"), ["packet_id", "segment_no"], "left")
    cut = (F.col("edit") == "split") & (F.col("at") > F.col("start_page")) & (F.col("at") <= F.col("end_page"))
    applied = rows.where(cut | F.col("edit").isin("remove", "rename")).select("packet_id", "segment_no", "edit", F.to_json(F.struct("start_page", "end_page", "at", "name")).alias("details"))
    part = lambda s, e: F.struct(s.cast("long").alias("start_page"), e.cast("long").alias("end_page"))
    start, end = F.col("start_page"), F.col("end_page")
    parts = F.when(cut, F.array(part(start, F.col("at") - 1), part(F.col("at"), end))).otherwise(F.array(part(start, end)))
    kept = rows.where("edit is null or edit <> 'remove'").withColumn("__p", F.explode(parts)).withColumn("filename", F.when(F.col("edit") == "rename", F.col("name")))
    return kept.select("packet_id", "segment_no", F.col("__p.start_page"), F.col("__p.end_page"), "confidence", "filename"), applied


def manifest(named_rows: DataFrame) -> DataFrame:
    """(packet_id, n_segments, n_pages, manifest JSON): the segments of a packet in order, with pages from one."""
    entry = F.struct("segment_no", "filename", (F.col("start_page") + 1).alias("first_page"), (F.col("end_page") + 1).alias("last_page"), "document_type")
    rows = named_rows.groupBy("packet_id").agg(F.count("*").alias("n_segments"), F.sum(F.col("end_page") - F.col("start_page") + 1).alias("n_pages"), F.array_sort(F.collect_list(entry)).alias("segments"))
    return rows.select("packet_id", "n_segments", "n_pages", F.to_json("segments").alias("manifest"))


def write_segments(found: DataFrame, pages: DataFrame, path: str) -> None:
    """The pages of each segment below a folder of their own."""
    with_pages(found, pages).write.mode("overwrite").partitionBy("packet_id", "segment_no").parquet(path)


def preview(found: DataFrame, pages: DataFrame, n: int = 5) -> DataFrame:
    """The first pages of each segment."""
    return with_pages(found, pages, n)
