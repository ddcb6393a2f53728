"""Boundary detection between neighbouring pages: pairs, signals, similarity, votes. DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens import config as C
from packetlens.functions import text as T
from packetlens.functions import vector as V
from packetlens.runtime import stored

from . import model
from .scans import with_neighbour


def in_order(packet: str = "packet_id", page: str = "page_no"):
    """The one window that all neighbour operators share, so that they plan one exchange and one sort."""
    return Window.partitionBy(packet).orderBy(page)


def segments_of_text(pages: DataFrame) -> DataFrame:
    """Adds lines, top, bottom, email_top and terminal_bottom."""
    rows = pages.withColumn("lines", T.lines(F.col("text")))
    return rows.withColumns({"top": T.head(F.col("lines"), C.TOP), "bottom": T.tail(F.col("lines"), C.BOTTOM), "email_top": T.head(F.col("lines"), C.EMAIL_TOP), "terminal_bottom": T.tail(F.col("lines"), C.TERMINAL_BOTTOM)})


def signals(pages: DataFrame, settings: C.HeuristicConfig | None = None, packet: str = "packet_id", page: str = "page_no", dense: bool = False, parts: int | None = None) -> DataFrame:
    """One row for each page that has one before it, with a column for each signal of C.SIGNALS.

    dense: a packet's pages are numbered without gaps or repeats, so that they are dealt out in blocks, to `parts` tasks if that is given; else a packet is one task of the window.

    What looks at a single page is computed before the window, so that the window carries numbers and one short text.
    Blank lines at both ends and terminal phrases are those of the page before.
    """
    s = settings or C.HeuristicConfig()
    rows = segments_of_text(pages)
    rows = rows.withColumns({"top_upper": F.upper("top"), "end_lower": F.lower("terminal_bottom"), "matches": T.number_matches(F.col("bottom"), s.page_numbers)})
    end, start = T.blank_signals(F.col("lines"), s.blank_end, s.blank_start)
    rows = rows.select(
        packet, page, *(c for c in ("doc_key", "kind", "is_start") if c in pages.columns), "top", T.date_signal(F.col("top"), s.dates).alias("date_pattern"), T.keyword_in(F.col("top_upper"), s.keywords).alias("document_keywords"),
        T.email_signal(F.col("email_top"), s.email_headers).alias("email_header"), T.terminal_in(F.col("end_lower"), s.phrases).alias("own_terminal"), end.alias("own_end"), start.alias("own_start"), T.is_page_one(F.col("matches"), len(s.page_numbers)).alias("is_one"), T.numbers_in(F.col("matches")).alias("numbers"),
    ).withColumns({"least": F.array_min("numbers"), "most": F.array_max("numbers")}).drop("numbers")
    before = {f"last_{c}": c for c in ("top", "most", "own_terminal", "own_end", "own_start")}
    if dense:
        rows = with_neighbour(rows, packet, page, before, parts=parts).where("has_neighbour")
    else:
        w = in_order(packet, page)
        rows = rows.withColumns({**{new: F.lag(c).over(w) for new, c in before.items()}, "at": F.row_number().over(w)}).where("at > 1")
    rows = rows.withColumns({
        "page_numbering": T.numbering(F.col("is_one"), F.col("least"), F.col("last_most")), "terminal_phrases": F.col("last_own_terminal"),
        "header_footer_change": T.header_signal(F.col("top"), F.col("last_top")), "whitespace_end": F.col("last_own_end"), "whitespace_start": F.col("last_own_start"),
    })
    return rows.select(packet, page, *(c for c in ("doc_key", "kind", "is_start") if c in pages.columns), *C.SIGNALS)


def heuristic(pages: DataFrame, settings: C.HeuristicConfig | None = None, every: bool = False, dense: bool = False, parts: int | None = None) -> DataFrame:
    """(packet_id, page_no, confidence, boundary_type..): the later page of each pair that is a boundary, or, every, of all. dense, parts: as in `signals`."""
    s = settings or C.HeuristicConfig()
    rows = _judged(signals(pages, s, dense=dense, parts=parts), s)
    return rows if every else rows.where("boundary_type <> 'page_continuation'")


def _judged(rows: DataFrame, s: C.HeuristicConfig) -> DataFrame:
    """Adds confidence and boundary_type to rows with a column for each signal."""
    rows = rows.withColumn("confidence", T.combine({k: F.col(k) for k in C.SIGNALS}, s))
    on = lambda k, limit: (F.col(k) > limit) if s.weight(k) is not None else F.lit(False)
    kind = lambda sure: (
        F.when(sure < s.minimum, "page_continuation").when(on("email_header", 0.5), "document_start")
        .when(on("terminal_phrases", 0.5), "document_end").when(on("page_numbering", 0.8), "document_start").otherwise("section_break")
    )
    return rows.withColumn("boundary_type", T.bound(F.col("confidence"), kind))


def document_starts(pages: DataFrame, settings: C.HeuristicConfig | None = None, packet: str = "packet_id", page: str = "page_no", parts: int | None = None, opening: int = 0) -> DataFrame:
    """(packet_id, page_no, confidence) of the rows of `heuristic` that are document starts, of pages that are numbered without gaps or repeats. parts: as in `signals`.

    A start has an e-mail header or page numbers that begin again (`T.may_start`). What meets is the pages' texts, up to the limit that signals
    look at; only those that may start, with the page before, are searched for signals. They are written before the others of them go, as
    a filter on what is computed would compute it twice.

    opening: adds a column of this name, the whole texts of so many pages from the start on, null behind the packet's end: what looks at a document's first
    pages needs no meeting of its own with all texts.
    """
    s = settings or C.HeuristicConfig()
    kept = ["opening"] if opening else []
    short = F.substring("text", 1, C.TEXT_LIMIT)
    if opening:
        rows = with_neighbour(pages.select(packet, page, "text"), packet, page, {"last_text": "text"}, parts=parts, following=("opening", "text", opening))
        rows = rows.withColumns({"text": short, "last_text": F.substring("last_text", 1, C.TEXT_LIMIT)})
    else:
        rows = with_neighbour(pages.select(packet, page, short.alias("text")), packet, page, {"last_text": "text"}, parts=parts)
    rows = rows.where(F.col("has_neighbour") & T.may_start(F.col("text"), s)).select(packet, page, *kept, T.lines(F.col("text")).alias("lines"), T.lines(F.col("last_text")).alias("last_lines"))
    own, last = F.col("lines"), F.col("last_lines")
    rows = rows.select(packet, page, *kept, "last_lines", T.head(own, C.TOP).alias("top"), T.tail(own, C.BOTTOM).alias("bottom"), T.head(own, C.EMAIL_TOP).alias("email_top"), T.head(last, C.TOP).alias("last_top"), T.tail(last, C.BOTTOM).alias("last_bottom"), T.tail(last, C.TERMINAL_BOTTOM).alias("last_terminal"))
    rows = rows.withColumns({"top_upper": F.upper("top"), "end_lower": F.lower("last_terminal"), "matches": T.number_matches(F.col("bottom"), s.page_numbers)})
    end, start = T.blank_signals(last, s.blank_end, s.blank_start)
    rows = rows.select(
        packet, page, *kept, T.date_signal(F.col("top"), s.dates).alias("date_pattern"), T.keyword_in(F.col("top_upper"), s.keywords).alias("document_keywords"), T.email_signal(F.col("email_top"), s.email_headers).alias("email_header"),
        T.numbering(T.is_page_one(F.col("matches"), len(s.page_numbers)), F.array_min(T.numbers_in(F.col("matches"))), F.array_max(T.numbers(F.col("last_bottom"), s.page_numbers))).alias("page_numbering"),
        T.terminal_in(F.col("end_lower"), s.phrases).alias("terminal_phrases"), T.header_signal(F.col("top"), F.col("last_top")).alias("header_footer_change"), end.alias("whitespace_end"), start.alias("whitespace_start"),
    )
    rows = _judged(rows, s).select(packet, page, "confidence", "boundary_type", *kept)
    if opening:
        rows = rows.withColumn("opening", F.when(F.col("boundary_type") == "document_start", F.col("opening")))
    return stored(rows).where("boundary_type = 'document_start'").drop("boundary_type")


def by_similarity(vectors: DataFrame, threshold: float = 0.5, packet: str = "packet_id", page: str = "page_no") -> DataFrame:
    """Every pair of neighbours, at the earlier page: similarity, boundary_type and confidence; an all-zero vector has similarity
    NaN, which is no boundary and has confidence 1."""
    w = in_order(packet, page)
    rows = vectors.withColumns({"next": F.lead("embedding").over(w), "next_page": F.lead(page).over(w)}).where("next_page is not null")
    rows = rows.withColumn("similarity", V.cosine(F.col("embedding"), F.col("next")))
    start = (F.col("similarity") < threshold) & ~F.isnan("similarity")
    sure = F.when(F.isnan("similarity"), 1.0).otherwise(F.least(F.lit(1.0), F.abs(F.col("similarity") - threshold) * 2))
    return rows.select(packet, page, "next_page", "similarity", F.when(start, "document_start").otherwise("page_continuation").alias("boundary_type"), sure.alias("confidence"))


def by_votes(hashes: DataFrame, votes: int = 1, packet: str = "packet_id", page: str = "page_no") -> DataFrame:
    """Pairs at the earlier page, from three 64-bit hashes (phash, ahash, dhash): distances, votes, similarity, confidence."""
    w = in_order(packet, page)
    rows = hashes.withColumns({f"next_{h}": F.lead(h).over(w) for h in V.HASHES} | {"next_page": F.lead(page).over(w)}).where("next_page is not null")
    rows = rows.withColumns({f"{h}_distance": V.hamming(F.col(h), F.col(f"next_{h}")) for h in V.HASHES})
    d = {h: F.col(f"{h}_distance") for h in V.HASHES}
    rows = rows.withColumns({"votes": V.votes(d), "similarity": V.hash_similarity(d)})
    rows = rows.withColumn("confidence", V.vote_confidence(F.col("votes"), F.col("similarity")))
    return rows.select(packet, page, *(f"{h}_distance" for h in V.HASHES), "votes", "similarity", "confidence", (F.col("votes") >= votes).alias("is_boundary"))


Detector = Callable[[DataFrame], DataFrame]
#: A detector takes pages and returns boundaries; used with DataFrame.transform.
DETECTORS: dict[str, Callable[..., Detector]] = {
    "heuristic": lambda settings=None: lambda pages: heuristic(pages, settings),
    "embeddings": lambda threshold=0.5: lambda vectors: by_similarity(vectors, threshold),
    "visual": lambda votes=1: lambda hashes: by_votes(hashes, votes).where("is_boundary"),
    "llm": lambda cache, ask, now: lambda pairs: model.detect(pairs, cache, ask, now).where("is_boundary"),
}
THRESHOLDS = {"heuristic": 0.7, "visual": 0.5, "llm": 0.8, "embeddings": 0.5}


def detector(name: str, **settings) -> Detector:
    if name not in DETECTORS:
        raise ValueError(f"no detector {name}; there are {', '.join(DETECTORS)}")
    return DETECTORS[name](**settings)


def production_detector() -> Detector:
    return detector("embeddings", threshold=0.5)


def confident(rows: DataFrame, kind: str, threshold: float | None = None) -> DataFrame:
    """Rows of at least the threshold; none, and zero, mean the detector's own."""
    return rows.where(F.col("confidence") >= (threshold or THRESHOLDS.get(kind, 0.7)))


def context(pages: DataFrame, size: int = 3, packet: str = "conv_id", page: str = "turn") -> DataFrame:
    """Adds `around`, the pages from size // 2 before to size // 2 after, and `centre`, the page's place in it."""
    if size % 2 == 0:
        raise ValueError("a centred window has an odd size")
    half, w = size // 2, in_order(packet, page)
    return pages.withColumns({"around": F.collect_list(F.struct(page, "text")).over(w.rowsBetween(-half, half)), "centre": F.least(F.row_number().over(w) - 1, F.lit(half))})


def similar_neighbours(pages: DataFrame, packet: str = "conv_id", page: str = "turn") -> DataFrame:
    """Word-set similarity of each page with the one before."""
    w = in_order(packet, page)
    return pages.withColumn("before", F.lag("text").over(w)).where("before is not null").select(packet, page, T.jaccard(F.col("before"), F.col("text")).alias("similarity"))


# What is said of a pair of pages, by its similarity.
SHIFTS = ("Strong semantic shift detected between pages %d and %d (similarity: %.3f)", "Significant semantic difference between pages %d and %d (similarity: %.3f)", "Semantic boundary detected between pages %d and %d (similarity: %.3f)")
LIKE = ("Pages %d and %d are semantically very similar (similarity: %.3f)", "Pages %d and %d show semantic continuity (similarity: %.3f)", "Pages %d and %d are marginally similar (similarity: %.3f)")


def explained(similarity: Column, boundary: Column, page: Column, next_page: Column) -> Column:
    say = lambda text: F.format_string(text, page, next_page, similarity)
    apart = F.when(similarity < 0.2, say(SHIFTS[0])).when(similarity < 0.35, say(SHIFTS[1])).otherwise(say(SHIFTS[2]))
    return F.when(boundary, apart).when(similarity > 0.8, say(LIKE[0])).when(similarity > 0.65, say(LIKE[1])).otherwise(say(LIKE[2]))
