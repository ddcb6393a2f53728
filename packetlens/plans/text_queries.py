"""Queries over page text and boundaries, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens import config as C
from packetlens.functions import text as T
from packetlens.functions import vector as V
from packetlens.operators import boundaries as B
from packetlens.operators import evaluate as E
from packetlens.operators import segments as G
from packetlens.runtime import stored
from packetlens.sources.packets import Packets, packet_oracle, packet_pages, packets, page_type, table

from .registry import query, quoted

NL = "chr(10)"
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
PACKET = f"p AS ({packet_oracle()})"
LINES = f"""{PACKET}, l AS (SELECT *, string_split(substr(text, 1, 5000), {NL}) AS lines FROM p),
s AS (SELECT *, array_to_string(lines[1:3], {NL}) AS top, array_to_string(lines[greatest(len(lines) - 2, 1):], {NL}) AS bottom,
  array_to_string(lines[1:8], {NL}) AS email_top, array_to_string(lines[greatest(len(lines) - 9, 1):], {NL}) AS terminal_bottom FROM l)"""


def case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def matches(x: str, patterns: tuple[str, ...], flags: str = "(?im)") -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted(flags + p)})" for p in patterns) + ")"


def signal_sql(s: C.HeuristicConfig) -> str:
    """Further CTEs after LINES: `g`, with a column for each signal on the later page of each pair."""
    date = case([(matches("top", s.dates), "0.8")], "0.0")
    key = case([(f"contains(upper(top), {quoted(k)})", case([(f"starts_with({STRIP('upper(top)')}, {quoted(k)})", "0.9"), (f"contains(substr(upper(top), 1, 100), {quoted(k)})", "0.7")], "0.5")) for k in s.keywords], "0.0")
    n = " + ".join(f"CAST(starts_with({STRIP('x')}, {quoted(f)}) AS INTEGER)" for f in C.EMAIL_FIELDS)
    email = case([(matches("email_top", s.email_headers), "0.95"), (f"coalesce(list_sum(list_transform(string_split(email_top, {NL})[1:5], lambda x: {n})), 0) >= 2", "0.85")], "0.0")
    low = "lower(terminal_bottom)"
    end = case([(f"contains({low}, {quoted(p.lower())})", case([(f"length({STRIP(f'substr({low}, strpos({low}, {quoted(p.lower())}) + {len(p)})')}) < 100", "0.7")], "0.3")) for p in s.phrases], "0.0")
    nums = "list_transform(flatten(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(bottom, {quoted('(?im)' + p)}, 0)" for p in s.page_numbers) + "), lambda m: regexp_extract_all(m, '\\d+', 0))), lambda d: CAST(d AS BIGINT))"
    one = "(" + " OR ".join(f"contains(regexp_extract(bottom, {quoted('(?im)' + p)}, 0), 'Page 1 ')" for p in s.page_numbers) + ")"
    texts = f"list_transform(lines, lambda x: {STRIP('x')} <> '')"
    return f""", o AS (SELECT *, {date}::DOUBLE AS date_pattern, {key}::DOUBLE AS document_keywords, {email}::DOUBLE AS email_header, {end}::DOUBLE AS own_terminal, {nums} AS numbers,
  list_position({texts}, true) AS first_line, list_position(list_reverse({texts}), true) AS last_line, {one} AS is_one FROM s),
o2 AS (SELECT *, CASE WHEN last_line > 0 AND (last_line - 1) / len(lines)::DOUBLE > {s.blank_end} THEN 0.8 ELSE 0.0 END AS own_end, CASE WHEN first_line > 0 AND (first_line - 1) / len(lines)::DOUBLE > {s.blank_start} THEN 0.6 ELSE 0.0 END AS own_start FROM o),
b AS (SELECT *, lag(top) OVER w AS last_top, lag(numbers) OVER w AS last_numbers, lag(own_terminal) OVER w AS terminal_phrases, lag(own_end) OVER w AS we, lag(own_start) OVER w AS ws, row_number() OVER w AS pos FROM o2 WINDOW w AS (PARTITION BY packet_id ORDER BY page_no)),
g AS (SELECT packet_id, page_no, doc_key, kind, is_start, date_pattern, document_keywords, CASE WHEN is_one THEN 0.95 WHEN list_max(last_numbers) > 5 AND list_min(numbers) = 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS page_numbering, email_header, terminal_phrases,
  CASE WHEN top = last_top THEN 0.0 WHEN top = '' OR last_top = '' THEN 0.7 ELSE 0.5 END::DOUBLE AS header_footer_change, we::DOUBLE AS whitespace_end, ws::DOUBLE AS whitespace_start FROM b WHERE pos > 1)"""


def boundary_sql(s: C.HeuristicConfig) -> str:
    """After signal_sql: `h`, with confidence and boundary_type of every pair."""
    used = [k for k in C.SIGNALS if s.weight(k) is not None]
    weight = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {k} > 0 THEN {s.weight(k)}::DOUBLE ELSE 0.0 END" for k in used)])
    total = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {k} > 0 THEN {s.weight(k)}::DOUBLE * {k} ELSE 0.0 END" for k in used)])
    active = " + ".join(["0", *(f"CAST({k} > 0.3 AS INTEGER)" for k in used)])
    kinds = [("confidence < " + str(s.minimum), "'page_continuation'")] + [(f"{k} > {x}", f"'{v}'") for k, x, v in (("email_header", 0.5, "document_start"), ("terminal_phrases", 0.5, "document_end"), ("page_numbering", 0.8, "document_start")) if k in used]
    return f""", c1 AS (SELECT *, CASE WHEN {weight} > 0 THEN ({total}) / ({weight}) ELSE 0.0 END AS mean, {active} AS active FROM g),
c2 AS (SELECT *, CASE WHEN mean >= {s.ensemble} THEN CASE WHEN active >= 3 THEN least(mean * 1.2::DOUBLE, 1.0) WHEN active >= 2 THEN least(mean * 1.1::DOUBLE, 1.0) ELSE mean END ELSE mean END AS confidence FROM c1),
h AS (SELECT *, {case(kinds, "'section_break'")} AS boundary_type FROM c2)"""


DEFAULT = C.HeuristicConfig()
BOUNDARIES = f"WITH {LINES}{signal_sql(DEFAULT)}{boundary_sql(DEFAULT)}"
SEGMENTS = f"""{BOUNDARIES}, ends AS (SELECT packet_id, max(page_no) + 1 AS n FROM p GROUP BY packet_id),
st AS (SELECT packet_id, page_no, confidence, row_number() OVER w AS segment_no, lead(page_no) OVER w AS nxt FROM h WHERE boundary_type = 'document_start' WINDOW w AS (PARTITION BY packet_id ORDER BY page_no, confidence)),
seg AS (SELECT packet_id, CAST(segment_no AS INTEGER) AS segment_no, page_no AS start_page, coalesce(nxt, n) - 1 AS end_page, confidence FROM st JOIN ends USING (packet_id) WHERE page_no <= coalesce(nxt, n) - 1)"""


def starts(own: Packets) -> DataFrame:
    return B.document_starts(own.pages, parts=own.parts)


def judged(spark: SparkSession, sf_dir: str, settings: C.HeuristicConfig | None = None, every: bool = False) -> DataFrame:
    own = packets(spark, sf_dir)
    return B.heuristic(own.pages, settings, every, dense=True, parts=own.parts)


def found(spark: SparkSession, sf_dir: str, read: bool = False) -> tuple[DataFrame, DataFrame]:
    """Segments and pages. read: the pages are used again, so they are written once, which takes less disk than making them twice."""
    own = packets(spark, sf_dir)
    if read:
        own = replace(own, pages=stored(own.pages.select("packet_id", "page_no", "text")))
    return G.segments(starts(own), None, ends=own.ends), own.pages


def found_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with their names. Each text meets others once, where starts are looked for; what names are made of is kept with the starts."""
    own = packets(spark, sf_dir)
    pages = stored(own.pages.select("packet_id", "page_no", "text"))
    first = B.document_starts(pages, parts=own.parts, opening=G.NAMED_BY)
    return G.named(G.segments(first, None, ends=own.ends), None, first)


R6 = lambda c: F.round(c, 6).alias(c)


@query("WITH " + PACKET + " SELECT * FROM p")
def packet_view(spark, sf_dir):
    return packet_pages(spark, sf_dir)


@query(f"WITH {LINES} SELECT packet_id, page_no, top, bottom, email_top, terminal_bottom FROM s")
def text_segments(spark, sf_dir):
    return B.segments_of_text(packet_pages(spark, sf_dir)).select("packet_id", "page_no", "top", "bottom", "email_top", "terminal_bottom")


@query(f"""WITH j AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split({STRIP("text")}, {NL}), lambda x: {STRIP("x")}), lambda x: x <> ''), ' ') AS j FROM documents),
c AS (SELECT doc_id, j, substr(j, 1, 512) AS cut FROM j), b AS (SELECT *, length(cut) - strpos(reverse(cut), ' ') AS blank FROM c)
SELECT doc_id, CASE WHEN length(j) <= 512 THEN j WHEN strpos(cut, ' ') > 0 AND blank > 409.6 THEN substr(cut, 1, blank) ELSE cut END AS semantic_text FROM b""")
def semantic_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.semantic(F.col("text")).alias("semantic_text"))


def _signals(*names: str):
    sql = f"WITH {LINES}{signal_sql(DEFAULT)} SELECT packet_id, page_no, {', '.join(names)} FROM g"
    return sql, lambda spark, sf_dir: B.signals((own := packets(spark, sf_dir)).pages, dense=True, parts=own.parts).select("packet_id", "page_no", *names)


for _name, _columns in (("date_signal", ["date_pattern"]), ("keyword_signal", ["document_keywords"]), ("email_signal", ["email_header"]), ("terminal_signal", ["terminal_phrases"]), ("whitespace_signal", ["whitespace_end", "whitespace_start"]), ("page_numbering_signal", ["page_numbering"]), ("header_change_signal", ["header_footer_change"])):
    query(*_signals(*_columns)[:1], name=_name)(_signals(*_columns)[1])


def _preset(name: str):
    s = C.PRESETS[name]()
    sql = f"WITH {LINES}{signal_sql(s)}{boundary_sql(s)} SELECT packet_id, page_no, round(confidence, 6) AS confidence, boundary_type FROM h WHERE boundary_type <> 'page_continuation'"
    return sql, lambda spark, sf_dir: judged(spark, sf_dir, s).select("packet_id", "page_no", R6("confidence"), "boundary_type")


for _name in C.PRESETS:
    query(_preset(_name)[0], name="heuristic_boundaries" + ("" if _name == "default" else f"_{_name}"))(_preset(_name)[1])


def vectors(spark, sf_dir):
    """A hundred vectors in order of their number stand for a packet."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("packet_id"), F.col("vec_id").alias("page_no"), "embedding", "label")


SIMILAR = """v AS (SELECT CAST(floor(vec_id / 100) AS BIGINT) AS packet_id, vec_id AS page_no, embedding, label FROM embeddings),
n AS (SELECT *, lead(embedding) OVER w AS nxt, lead(page_no) OVER w AS next_page, lead(label) OVER w AS next_label FROM v WINDOW w AS (PARTITION BY packet_id ORDER BY page_no)),
q AS (SELECT packet_id, page_no, next_page, label <> next_label AS truth, greatest(0.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], nxt::DOUBLE[]))) AS similarity FROM n WHERE nxt IS NOT NULL)"""


@query(f"WITH {SIMILAR} SELECT packet_id, page_no, next_page, round(similarity, 6) AS similarity, CASE WHEN similarity < 0.5 THEN 'document_start' ELSE 'page_continuation' END AS boundary_type, round(least(1.0, abs(similarity - 0.5) * 2), 6) AS confidence FROM q")
def embeddings_boundaries(spark, sf_dir):
    return B.by_similarity(vectors(spark, sf_dir)).select("packet_id", "page_no", "next_page", R6("similarity"), "boundary_type", R6("confidence"))


def _said(texts: tuple[str, ...], limits: tuple[str, str]) -> str:
    out = [quoted(t.replace("%d", "{}").replace("%.3f", "{:.3f}")) for t in texts]
    say = [f"format({t}, page_no, next_page, similarity)" for t in out]
    return f"CASE WHEN similarity {limits[0]} THEN {say[0]} WHEN similarity {limits[1]} THEN {say[1]} ELSE {say[2]} END"


@query(f"WITH {SIMILAR} SELECT page_no, CASE WHEN similarity < 0.1 THEN {_said(B.SHIFTS, ('< 0.2', '< 0.35'))} ELSE {_said(B.LIKE, ('> 0.8', '> 0.65'))} END AS reasoning FROM q")
def boundary_reasoning(spark, sf_dir):
    return B.by_similarity(vectors(spark, sf_dir), 0.1).select("page_no", B.explained(F.col("similarity"), F.col("boundary_type") == "document_start", F.col("page_no"), F.col("next_page")).alias("reasoning"))


def judged_pairs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    change = F.lead("label").over(B.in_order()) != F.col("label")
    return B.by_similarity(v).join(v.select("packet_id", "page_no", change.alias("truth")), ["packet_id", "page_no"])


LIMITS = [0.0001, 0.05, 0.1, 0.15, 0.2, 0.5]
SCORES = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy"
F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END"
SWEPT = f"""WITH {SIMILAR}, t AS (SELECT unnest({LIMITS})::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (similarity < threshold AND truth) AS tp, count(*) FILTER (similarity < threshold AND NOT truth) AS fp, count(*) FILTER (similarity >= threshold AND NOT truth) AS tn, count(*) FILTER (similarity >= threshold AND truth) AS fn FROM q, t GROUP BY threshold),
m AS (SELECT *, {SCORES} FROM c), f AS (SELECT *, {F1} AS f1 FROM m)"""
ROUNDED = ["precision", "recall", "accuracy", "f1"]
SQL_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ROUNDED)


@query(f"{SWEPT} SELECT threshold, tp, fp, tn, fn, {SQL_ROUNDED} FROM f")
def threshold_sweep(spark, sf_dir):
    return E.sweep(judged_pairs(spark, sf_dir), "similarity", "truth", LIMITS).select("threshold", "tp", "fp", "tn", "fn", *(R6(c) for c in ROUNDED))


@query(f"{SWEPT} SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY round(f1, 9) DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return E.best(E.sweep(judged_pairs(spark, sf_dir), "similarity", "truth", LIMITS)).select("threshold", R6("f1"))


@query(f"""WITH {SIMILAR}, k AS (SELECT similarity, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM q GROUP BY similarity),
r AS (SELECT similarity, sum(p) OVER (ORDER BY similarity) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY similarity) / sum(n) OVER () AS fpr FROM k),
d AS (SELECT (fpr - coalesce(lag(fpr) OVER (ORDER BY similarity), 0)) * (tpr + coalesce(lag(tpr) OVER (ORDER BY similarity), 0)) / 2 AS step FROM r) SELECT round(sum(step), 6) AS auc FROM d""")
def roc_auc(spark, sf_dir):
    return E.auc(judged_pairs(spark, sf_dir).withColumn("score", -F.col("similarity")), "score", "truth").select(R6("auc"))


@query(f"{BOUNDARIES}, c AS (SELECT kind, count(*) FILTER (boundary_type = 'document_start' AND is_start) AS tp, count(*) FILTER (boundary_type = 'document_start' AND NOT is_start) AS fp, count(*) FILTER (boundary_type <> 'document_start' AND NOT is_start) AS tn, count(*) FILTER (boundary_type <> 'document_start' AND is_start) AS fn FROM h GROUP BY kind), m AS (SELECT *, {SCORES} FROM c), f AS (SELECT *, {F1} AS f1 FROM m) SELECT kind, tp, fp, tn, fn, {SQL_ROUNDED} FROM f")
def confusion_metrics(spark, sf_dir):
    rows = judged(spark, sf_dir, every=True)
    return E.metrics(rows, F.col("boundary_type") == "document_start", F.col("is_start"), "kind").select("kind", "tp", "fp", "tn", "fn", *(R6(c) for c in ROUNDED))


@query(f"{BOUNDARIES}, a AS (SELECT packet_id, page_no FROM h WHERE boundary_type = 'document_start'), t AS (SELECT packet_id, page_no FROM p WHERE is_start AND page_no > 0) SELECT *, 'false_positive' AS failure FROM (SELECT * FROM a EXCEPT SELECT * FROM t) UNION ALL SELECT *, 'false_negative' FROM (SELECT * FROM t EXCEPT SELECT * FROM a)")
def failure_analysis(spark, sf_dir):
    own = packets(spark, sf_dir)
    return E.failures(starts(own), own.first_pages.where("page_no > 0"), ["packet_id", "page_no"])


@query(f"{BOUNDARIES} SELECT boundary_type, count(*) AS n, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most FROM h GROUP BY boundary_type")
def detection_stats(spark, sf_dir):
    return E.stats(judged(spark, sf_dir, every=True), "boundary_type").select("boundary_type", "n", R6("mean"), R6("least"), R6("most"))


@query(f"{BOUNDARIES} SELECT packet_id, page_no, round(confidence, 6) AS confidence FROM h WHERE boundary_type <> 'page_continuation' AND confidence >= 0.7")
def confident_boundaries(spark, sf_dir):
    return B.confident(judged(spark, sf_dir), "heuristic", 0.0).select("packet_id", "page_no", R6("confidence"))


@query(f"{SEGMENTS} SELECT packet_id, segment_no, start_page, end_page, round(confidence, 6) AS confidence FROM seg")
def segments(spark, sf_dir):
    return found(spark, sf_dir)[0].select("packet_id", "segment_no", "start_page", "end_page", R6("confidence"))


@query(f"""{BOUNDARIES}, ends AS (SELECT packet_id, max(page_no) + 1 AS n FROM p GROUP BY packet_id), a AS (SELECT packet_id, page_no, confidence FROM h WHERE boundary_type = 'document_start' UNION ALL SELECT packet_id, 0, 1.0 FROM ends),
st AS (SELECT packet_id, page_no, confidence, row_number() OVER w AS segment_no, lead(page_no) OVER w AS nxt FROM a WINDOW w AS (PARTITION BY packet_id ORDER BY page_no, confidence))
SELECT packet_id, CAST(segment_no AS INTEGER) AS segment_no, page_no AS start_page, coalesce(nxt, n) - 1 AS end_page, round(confidence, 6) AS confidence FROM st JOIN ends USING (packet_id) WHERE page_no <= coalesce(nxt, n) - 1""")
def segments_corrected(spark, sf_dir):
    own = packets(spark, sf_dir)
    return G.segments(starts(own), None, corrected=True, ends=own.ends).select("packet_id", "segment_no", "start_page", "end_page", R6("confidence"))


def _named_sql() -> str:
    score = lambda ps: " + ".join(f"CAST(regexp_matches(three, {quoted('(?i)' + p)}) AS INTEGER)" for p in ps)
    names = list(C.DOCUMENT_TYPES)
    most = f"greatest({', '.join(f'n{i}' for i in range(len(names)))})"
    kinds = case([(f"{most} = 0", "'Document'")] + [(f"n{i} = {most}", f"'{k}'") for i, k in enumerate(names)], "NULL")
    pad = lambda x: f"CASE WHEN length({x}) < 2 THEN lpad({x}, 2, '0') ELSE {x} END"
    part = lambda p, g: f"regexp_extract(two, {quoted(p)}, {g})"
    kinds_of_date = ((r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", (3, 1, 2)), (r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", (1, 2, 3)), (r"(\w+)\s+(\d{1,2}),?\s+(\d{4})", (3, 1, 2)), (r"(\d{1,2})\s+(\w+)\s+(\d{4})", (3, 1, 2)))
    date = case([(f"regexp_matches(two, {quoted(p)})", f"{part(p, y)} || '-' || {pad(part(p, m))} || '-' || {pad(part(p, d))}") for p, (y, m, d) in kinds_of_date], "NULL")
    key = case([(f"document_type = '{k}' AND regexp_matches(two, {quoted('(?i)' + p)})", f"lower(regexp_replace(regexp_extract(two, {quoted('(?i)' + p)}, 1), '[^\\w\\-_]', '', 'g'))") for k, ps in C.IDENTIFIERS.items() for p in ps], "NULL")
    return f"""{SEGMENTS}, pg AS (SELECT seg.*, p.page_no, p.text FROM seg JOIN p ON p.packet_id = seg.packet_id AND p.page_no BETWEEN start_page AND least(end_page, start_page + 2)),
tx AS (SELECT packet_id, segment_no, start_page, end_page, confidence, lower(string_agg(text, ' ' ORDER BY page_no)) AS three, string_agg(text, ' ' ORDER BY page_no) FILTER (page_no < start_page + 2) AS two, min_by(text, page_no) AS one FROM pg GROUP BY ALL),
sc AS (SELECT *, {', '.join(f'{score(ps)} AS n{i}' for i, ps in enumerate(C.DOCUMENT_TYPES.values()))} FROM tx), ty AS (SELECT *, {kinds} AS document_type, {date} AS date FROM sc), ke AS (SELECT *, {key} AS identifier FROM ty),
su AS (SELECT *, regexp_replace(array_to_string(string_split({STRIP("one")}, {NL})[1:5], ' '), '^\\s+|\\s+$', '', 'g') AS joined FROM ke),
nm AS (SELECT packet_id, segment_no, start_page, end_page, confidence, document_type, date, identifier, regexp_replace(translate(concat_ws('_', lower(document_type), date, coalesce(identifier, CASE WHEN length(segment_no::VARCHAR) < 3 THEN lpad(segment_no::VARCHAR, 3, '0') ELSE segment_no::VARCHAR END)) || '.pdf', '<>:"/\\|?*', '_________'), '_+', '_', 'g') AS suggested_filename,
 CASE WHEN length(joined) > 200 THEN substr(joined, 1, 197) || '...' ELSE joined END AS summary FROM su)"""


NAMED = _named_sql()


@query(f"{NAMED} SELECT packet_id, segment_no, document_type, date, identifier, suggested_filename, summary FROM nm")
def segment_names(spark, sf_dir):
    return found_named(spark, sf_dir).select("packet_id", "segment_no", "document_type", "date", "identifier", "suggested_filename", "summary")


@query(f"{NAMED}, k AS (SELECT *, row_number() OVER (PARTITION BY suggested_filename ORDER BY packet_id, segment_no) - 1 AS k FROM (SELECT packet_id, segment_no, document_type || '.pdf' AS suggested_filename FROM nm)) SELECT packet_id, segment_no, CASE WHEN k = 0 THEN suggested_filename ELSE regexp_replace(suggested_filename, '\\.[^.]*$', '') || '_' || k || '.pdf' END AS filename FROM k")
def unique_filenames(spark, sf_dir):
    rows = found_named(spark, sf_dir).select("packet_id", "segment_no", F.concat("document_type", F.lit(".pdf")).alias("suggested_filename"))
    return G.unique_names(rows.withColumn("one", F.lit(0)), "one", ["packet_id", "segment_no"]).select("packet_id", "segment_no", "filename")


@query(f"{NAMED} SELECT packet_id, count(*) AS n_segments, CAST(sum(end_page - start_page + 1) AS BIGINT) AS n_pages FROM nm GROUP BY packet_id")
def manifest(spark, sf_dir):
    return G.manifest(G.unique_names(found_named(spark, sf_dir))).select("packet_id", F.size(F.from_json("manifest", "array<struct<segment_no:int,filename:string>>")).cast("long").alias("n_segments"), "n_pages")


@query(f"{SEGMENTS} SELECT seg.packet_id, segment_no, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM seg JOIN p ON p.packet_id = seg.packet_id AND page_no BETWEEN start_page AND end_page GROUP BY ALL")
def segment_text(spark, sf_dir):
    rows, pages = found(spark, sf_dir, read=True)
    measured = pages.withColumn("n", F.length("text"))  # no text goes through the join
    return G.with_pages(rows, measured, value="n").groupBy("packet_id", "segment_no").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_chars"))


@query(f"{SEGMENTS} SELECT seg.packet_id, segment_no, page_no, sha256(text) AS digest FROM seg JOIN p ON p.packet_id = seg.packet_id AND page_no BETWEEN start_page AND least(end_page, start_page + 4)")
def segment_preview(spark, sf_dir):
    return G.preview(*found(spark, sf_dir, read=True)).select("packet_id", "segment_no", "page_no", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(f"{SEGMENTS}, x AS (SELECT packet_id, segment_no, start_page, end_page + CASE WHEN segment_no % 7 = 0 THEN 1 ELSE 0 END AS end_page FROM seg), y AS (SELECT *, lag(end_page) OVER (PARTITION BY packet_id ORDER BY start_page, end_page) AS last_end FROM x) SELECT packet_id, segment_no, coalesce(last_end >= start_page, false) AS overlap, end_page >= n AS beyond FROM y JOIN ends USING (packet_id) WHERE last_end >= start_page OR end_page >= n")
def segment_overlap_check(spark, sf_dir):
    rows, pages = found(spark, sf_dir)
    longer = rows.withColumn("end_page", F.col("end_page") + (F.col("segment_no") % 7 == 0).cast("int"))
    return G.violations(longer, pages).select("packet_id", "segment_no", F.array_contains("violations", "overlap").alias("overlap"), F.array_contains("violations", "beyond").alias("beyond"))


@query(f"{SEGMENTS}, x AS (SELECT *, CASE WHEN segment_no % 4 < 2 THEN segment_no // 4 END AS g FROM seg) SELECT packet_id, segment_no, start_page, end_page, round(confidence, 6) AS confidence FROM x WHERE g IS NULL UNION ALL SELECT packet_id, min(segment_no), min(start_page), max(end_page), round(min(confidence), 6) FROM x WHERE g IS NOT NULL GROUP BY packet_id, g")
def merge_segments(spark, sf_dir):
    rows = found(spark, sf_dir)[0]
    return G.merge(rows, F.when(F.col("segment_no") % 4 < 2, F.floor(F.col("segment_no") / 4))).select("packet_id", "segment_no", "start_page", "end_page", R6("confidence"))


@query(f"{SEGMENTS} SELECT packet_id, segment_no, start_page, end_page, 0 AS part FROM seg WHERE end_page = start_page UNION ALL SELECT packet_id, segment_no, start_page, start_page, 1 FROM seg WHERE end_page > start_page UNION ALL SELECT packet_id, segment_no, start_page + 1, end_page, 2 FROM seg WHERE end_page > start_page")
def split_segments(spark, sf_dir):
    return G.split(found(spark, sf_dir)[0], F.col("start_page") + 1).select("packet_id", "segment_no", "start_page", "end_page", "part")


@query(f"{SEGMENTS} SELECT packet_id, segment_no, start_page, CASE WHEN segment_no % 5 = 0 THEN start_page ELSE end_page END AS end_page FROM seg WHERE segment_no % 3 <> 0")
def patch_and_remove_segments(spark, sf_dir):
    rows = found(spark, sf_dir)[0]
    changes = rows.where("segment_no % 5 = 0").select("packet_id", "segment_no", F.col("start_page").alias("end_page"), F.lit(0.0).alias("confidence"))
    return G.without(G.patched(rows, changes), rows.where("segment_no % 3 = 0").select("packet_id", "segment_no")).select("packet_id", "segment_no", "start_page", "end_page")


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM conversations),
n AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM w)
SELECT conv_id, turn, round(CASE WHEN len(w) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b)))::DOUBLE END, 6) AS similarity FROM n WHERE pos > 1""")
def jaccard_adjacent(spark, sf_dir):
    return B.similar_neighbours(table(spark, sf_dir, "conversations")).select("conv_id", "turn", R6("similarity"))


@query("SELECT conv_id, turn, least(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, 1)::INTEGER AS centre, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n_around, string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around FROM conversations")
def context_window(spark, sf_dir):
    rows = B.context(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "centre", F.size("around").cast("long").alias("n_around"), F.array_join(F.transform("around", lambda x: x["text"]), "|").alias("around"))


def _marker_sql() -> str:
    any_of = lambda ms: "(" + " OR ".join(f"contains(lower(text), {quoted(m)})" for m in ms) + ")"
    columns = [f"{any_of(ms)} AS {k}" for k, ms in T.MARKERS.items()] + ["regexp_matches(lower(text), 'page \\d+') AS page_number", f"regexp_matches({STRIP('text')}, {quoted(T.TITLE)}) AS document_title"]
    return f"WITH {PACKET} SELECT packet_id, page_no, {', '.join(columns)} FROM p"


@query(_marker_sql())
def document_markers(spark, sf_dir):
    return packet_pages(spark, sf_dir).select("packet_id", "page_no", *(c.alias(k) for k, c in T.markers(F.col("text")).items()))


@query(f"WITH {PACKET} SELECT packet_id, page_no, array_to_string(list_concat({', '.join(f'regexp_extract_all(text, {quoted("(?i)" + d)}, 0)' for d in T.ALL_DATES)}), ',') AS dates FROM p")
def date_findall(spark, sf_dir):
    return packet_pages(spark, sf_dir).select("packet_id", "page_no", F.array_join(T.all_dates(F.col("text")), ",").alias("dates"))


def _typed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", page_type(F.length(T.strip(F.col("text"))), (F.col("doc_id") % 3).cast("int"), (F.col("doc_id") % 50).cast("double")).alias("page_type"))


TYPED = f"t AS (SELECT doc_id, source, CASE WHEN length({STRIP('text')}) < 10 AND doc_id % 3 > 0 THEN 'image_based' WHEN length({STRIP('text')}) < 10 THEN 'empty' WHEN doc_id % 50 < 5 AND doc_id % 3 > 0 THEN 'mixed' ELSE 'searchable' END AS page_type FROM documents)"


@query(f"WITH {TYPED} SELECT source, page_type, count(*) AS n FROM t GROUP BY source, page_type")
def page_type_summary(spark, sf_dir):
    return _typed(spark, sf_dir).groupBy("source", "page_type").agg(F.count("*").alias("n"))


@query(f"WITH {TYPED} SELECT source, count(*) AS n_pages, count(*) FILTER (page_type IN ('image_based', 'mixed')) AS needs_ocr, round(count(*) FILTER (page_type IN ('image_based', 'mixed')) * 1.5 + count(*) FILTER (page_type = 'searchable') * 0.1, 6)::DOUBLE AS seconds, count(*) * 1.5::DOUBLE AS megabytes FROM t GROUP BY source")
def processing_estimate(spark, sf_dir):
    ocr = F.count_if(F.col("page_type").isin("image_based", "mixed"))
    return _typed(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_pages"), ocr.alias("needs_ocr"), F.round(ocr * F.lit(1.5) + F.count_if(F.col("page_type") == "searchable") * F.lit(0.1), 6).alias("seconds"), (F.count("*") * F.lit(1.5)).alias("megabytes"))


SHARES = r"""mm AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) AS special, length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) AS digits, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper,
 list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT *, CASE WHEN n > 0 THEN special / n::DOUBLE ELSE 0.0 END AS special_share, CASE WHEN n > 0 THEN digits / n::DOUBLE ELSE 0.0 END AS digit_share, CASE WHEN n > 0 THEN upper / n::DOUBLE ELSE 0.0 END AS upper_share, CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w)::DOUBLE ELSE 0.0 END AS mean_word, """ + " + ".join(f"CAST((n - length(replace(text, {quoted(s)}, ''))) / 3 AS INTEGER)" for s in T.SUSPICIOUS) + " AS suspicious FROM mm)"


def _metrics(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", "text", T.special_share(x).alias("special_share"), T.share(x, T.DIGITS).alias("digit_share"), T.share(x, T.UPPER).alias("upper_share"), T.mean_word_length(x).alias("mean_word"), T.occurrences(x, T.SUSPICIOUS).alias("suspicious"))


@query(f"WITH {SHARES} SELECT doc_id, round(special_share, 6) AS special_share, round(digit_share, 6) AS digit_share, round(upper_share, 6) AS upper_share, round(mean_word, 6) AS mean_word, suspicious FROM q")
def ocr_quality_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("doc_id", R6("special_share"), R6("digit_share"), R6("upper_share"), R6("mean_word"), "suspicious")


SCORE = "greatest(0.0, least(1.0, CASE WHEN mean_word < 2 THEN 0.7 WHEN mean_word > 15 THEN 0.8 ELSE 1.0 END * CASE WHEN special_share > 0.3 THEN 0.8 ELSE 1.0 END * CASE WHEN upper_share > 0.8 THEN 0.9 ELSE 1.0 END * 0.97 * CASE WHEN suspicious > 5 THEN 0.8 ELSE 1.0 END))::DOUBLE"


def _scored(spark, sf_dir):
    return _metrics(spark, sf_dir).withColumn("score", T.quality(F.col("mean_word"), F.col("special_share"), F.col("upper_share"), F.lit(0.97), F.lit(0.0), F.col("suspicious")))


@query(f"WITH {SHARES} SELECT doc_id, round({SCORE}, 6) AS score FROM q")
def ocr_quality_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", R6("score"))


@query(f"WITH {SHARES}, s AS (SELECT doc_id, {SCORE} AS score FROM q), c AS (SELECT count(*) FILTER (score < 0.9 AND quality = 0) AS tp, count(*) FILTER (score < 0.9 AND quality <> 0) AS fp, count(*) FILTER (score >= 0.9 AND quality <> 0) AS tn, count(*) FILTER (score >= 0.9 AND quality = 0) AS fn FROM s JOIN labels USING (doc_id)), m AS (SELECT *, {SCORES} FROM c), f AS (SELECT *, {F1} AS f1 FROM m) SELECT tp, fp, tn, fn, {SQL_ROUNDED} FROM f")
def quality_vs_labels(spark, sf_dir):
    rows = _scored(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return E.metrics(rows, F.col("score") < 0.9, F.col("quality") == 0).select("tp", "fp", "tn", "fn", *(R6(c) for c in ROUNDED))


@query(f"WITH {SHARES} SELECT doc_id, CASE WHEN {STRIP('text')} = '' THEN 0.0 ELSE round(least(CASE WHEN special_share > 0.3 THEN 0.8 ELSE 1.0 END * CASE WHEN len(w) > 0 AND mean_word < 2 THEN 0.7 ELSE 1.0 END * CASE WHEN len(string_split(text, {NL})) > 5 THEN 1.1 ELSE 1.0 END, 1.0), 2) END::DOUBLE AS confidence FROM q")
def text_confidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.confidence(F.col("text"), F.size(F.split("text", "\n", -1))).alias("confidence"))


@query("""WITH h AS (SELECT CAST(floor(doc_id / 50) AS BIGINT) AS packet_id, doc_id AS page_no, md5(text) AS m, sha256(text) AS s FROM documents),
x AS (SELECT packet_id, page_no, ('0x' || substr(m, 1, 15))::BIGINT AS phash, ('0x' || substr(m, 17, 15))::BIGINT AS ahash, ('0x' || substr(s, 1, 15))::BIGINT AS dhash FROM h),
n AS (SELECT packet_id, page_no, lead(page_no) OVER w AS nxt, bit_count(xor(phash, lead(phash) OVER w)) AS p, bit_count(xor(ahash, lead(ahash) OVER w)) AS a, bit_count(xor(dhash, lead(dhash) OVER w)) AS d FROM x WINDOW w AS (PARTITION BY packet_id ORDER BY page_no)),
v AS (SELECT *, CAST(p > 10 AS INTEGER) + CAST(a > 12 AS INTEGER) + CAST(d > 12 AS INTEGER) AS votes, (1 - p / 64.0::DOUBLE) * 0.5 + (1 - a / 64.0::DOUBLE) * 0.25 + (1 - d / 64.0::DOUBLE) * 0.25 AS sim FROM n WHERE nxt IS NOT NULL)
SELECT packet_id, page_no, votes, round(sim, 6)::DOUBLE AS similarity, round(least(1.0, 0.5 + votes / 3.0::DOUBLE * 0.3 + (1 - sim) * 0.2), 6)::DOUBLE AS confidence, votes >= 1 AS is_boundary FROM v""")
def hash_votes(spark, sf_dir):
    part = lambda h, a: F.conv(F.substring(h, a, 15), 16, 10).cast("long")
    text = F.col("text").cast("binary")
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("packet_id"), F.col("doc_id").alias("page_no"), part(F.md5(text), 1).alias("phash"), part(F.md5(text), 17).alias("ahash"), part(F.sha2(text, 256), 1).alias("dhash"))
    return B.by_votes(rows).select("packet_id", "page_no", "votes", R6("similarity"), R6("confidence"), "is_boundary")


_INJECT = "(" + " OR ".join(f"regexp_matches(x, {quoted('(?i)' + p)})" for p in T.INJECTIONS) + ")"


@query(f"SELECT page_id, {_INJECT.replace('(x,', '(url,')} AS in_url, {_INJECT.replace('(x,', '(html,')} AS in_html FROM pages")
def injection_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.injected(F.col("url")).alias("in_url"), T.injected(F.col("html")).alias("in_html"))


@query("SELECT page_id, regexp_replace(translate(url, '<>:\"/\\|?*', '_________'), '_+', '_', 'g') AS safe_name, regexp_replace(regexp_replace(url, '[^A-Za-z0-9\\-_. ]', '_', 'g'), '[_\\s]+', '_', 'g') AS strict_name FROM pages")
def sanitized_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe_name"), T.strict_name(F.col("url")).alias("strict_name"))


@query(f"SELECT page_id, sha256(substr({STRIP('''replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\'\'', '&#x27;')''')}, 1, 10000)) AS digest FROM pages")
def sanitized_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.html_safe(F.col("html")).cast("binary"), 256).alias("digest"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def checksum_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return rows.where("n > 1")


@query("""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda x: x <> '') AS e, list_filter(regexp_split_to_array(lower(d.text), '\\s+'), lambda x: x <> '') AS a FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
k AS (SELECT item_id, len(list_intersect(list_distinct(e), list_distinct(a))) AS k, len(e) AS ne, len(a) AS na FROM w), r AS (SELECT item_id, CASE WHEN na = 0 THEN 0.0 ELSE k / na::DOUBLE END AS precision, CASE WHEN ne = 0 THEN 0.0 ELSE k / ne::DOUBLE END AS recall FROM k)
SELECT item_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM r""")
def word_accuracy(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("actual"))
    found_words = E.word_accuracy(T.words(F.lower("text")), T.words(F.lower("actual")))
    return b.join(d, "item_id").select("item_id", *(F.round(c, 6).alias(k) for k, c in found_words.items()))
