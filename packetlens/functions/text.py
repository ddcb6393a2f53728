"""Column builders for page text: segments, signals, names, quality. No UDFs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlens import config as C

WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: The characters of WHITE, for trimming without a pattern.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(x: Column) -> Column:
    """All white space off both ends, not only blanks."""
    return F.btrim(x, F.lit(BLANKS))


def has_text(x: Column) -> Column:
    """strip(x) != "", without the copies that trimming makes."""
    return x.rlike("[^" + WHITE[1:])


def words(x: Column) -> Column:
    """The text cut at white space, without empty parts."""
    return F.filter(F.split(x, rf"{WHITE}+", -1), lambda w: w != "")


def first_of(conditions: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out = otherwise
    for condition, value in reversed(conditions):
        out = F.when(condition, value).otherwise(out)
    return out


def lines(text: Column, limit: int | None = C.TEXT_LIMIT) -> Column:
    return F.split(F.substring(text, 1, limit) if limit else text, "\n", -1)


def head(rows: Column, n: int) -> Column:
    return F.array_join(F.slice(rows, 1, n), "\n")


def tail(rows: Column, n: int) -> Column:
    return F.array_join(F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), n), "\n")


def semantic(text: Column, limit: int = 512) -> Column:
    """Trimmed lines with text, joined by a blank and cut at the limit; back to the last blank if that is beyond 80 %."""
    joined = F.array_join(F.filter(F.transform(F.split(strip(text), "\n", -1), strip), lambda x: x != ""), " ")
    cut = F.substring(joined, 1, limit)
    blank = F.length(cut) - F.instr(F.reverse(cut), " ")
    back = (F.instr(cut, " ") > 0) & (blank > limit * 0.8)
    return F.when(F.length(joined) <= limit, joined).when(back, cut.substr(F.lit(1), blank)).otherwise(cut)


def any_match(x: Column, patterns: Sequence[str], flags: str = "(?im)") -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | ((F.contains(x, F.lit(C.NEEDED[p])) & x.rlike(flags + p)) if p in C.NEEDED else x.rlike(flags + p))
    return out


def date_signal(top: Column, patterns: Sequence[str] = C.DATES) -> Column:
    return F.when(any_match(top, patterns), 0.8).otherwise(0.0)


def keyword_signal(top: Column, keywords: Sequence[str] = C.KEYWORDS) -> Column:
    return keyword_in(F.upper(top), keywords)


def keyword_in(upper: Column, keywords: Sequence[str] = C.KEYWORDS) -> Column:
    """Of upper-case text, which is used often, so better a column."""
    start, early = F.ltrim(upper, F.lit(BLANKS)), F.substring(upper, 1, 100)
    found = [(F.contains(upper, F.lit(k)), F.when(start.startswith(k), 0.9).when(F.contains(early, F.lit(k)), 0.7).otherwise(0.5)) for k in keywords]
    return first_of(found, F.lit(0.0))


def email_signal(top: Column, patterns: Sequence[str] = C.EMAIL_HEADERS) -> Column:
    # Lines that begin with a field, after white space; a line begins with one field at most.
    field = rf"(?md)^(?:(?!\n){WHITE})*(?:{'|'.join(C.EMAIL_FIELDS)})"
    n = F.regexp_count(head(F.split(top, "\n", -1), 5), F.lit(field))
    return F.when(any_match(top, patterns), 0.95).when(F.contains(top, F.lit(":")) & (n >= 2), 0.85).otherwise(0.0)


def terminal_signal(bottom: Column, phrases: Sequence[str] = C.PHRASES) -> Column:
    return terminal_in(F.lower(bottom), phrases)


def terminal_in(lower: Column, phrases: Sequence[str] = C.PHRASES) -> Column:
    """Of lower-case text, which is used often, so better a column."""
    rest = lambda p: F.length(strip(lower.substr(F.instr(lower, p) + len(p), F.length(lower))))
    return first_of([(F.contains(lower, F.lit(p.lower())), F.when(rest(p.lower()) < 100, 0.7).otherwise(0.3)) for p in phrases], F.lit(0.0))


def blank_signals(rows: Column, end: float = 0.6, start: float = 0.3) -> tuple[Column, Column]:
    """For blank lines at the end and at the start of a page; (0, 0) for one without text."""
    text = F.transform(rows, has_text)
    first, last, n = F.array_position(text, True), F.array_position(F.reverse(text), True), F.size(rows)

    def signal(at: int, place: Column, limit: float, value: float) -> Column:
        found = F.when((place > 0) & ((place - 1) / n > limit), value).otherwise(0.0)
        return found if limit < 0 else F.when(n == 0, 0.0).when(has_text(F.element_at(rows, at)), 0.0).otherwise(found)  # most pages need one line

    return signal(-1, last, end, 0.8), signal(1, first, start, 0.6)


def number_matches(bottom: Column, patterns: Sequence[str] = C.PAGE_NUMBERS) -> Column:
    """All matches of each of the page-number patterns."""
    return F.array(*(F.regexp_extract_all(bottom, F.lit("(?im)" + p), F.lit(0)) for p in patterns))


def numbers(bottom: Column, patterns: Sequence[str] = C.PAGE_NUMBERS) -> Column:
    """All numbers in all matches of the page-number patterns."""
    return numbers_in(number_matches(bottom, patterns))


def numbers_in(matches: Column) -> Column:
    digits = F.regexp_extract_all(F.array_join(F.flatten(matches), " "), F.lit(r"\d+"), F.lit(0))
    return digits.try_cast("array<bigint>")


def is_page_one(matches: Column, n: int = len(C.PAGE_NUMBERS)) -> Column:
    """Has the first match of one of n patterns `Page 1 `, by case?"""
    one = F.lit(False)
    for i in range(n):
        one = one | F.coalesce(F.contains(F.get(matches[i], F.lit(0)), F.lit("Page 1 ")), F.lit(False))
    return one


def numbering_signal(bottom: Column, own: Column, before: Column, patterns: Sequence[str] = C.PAGE_NUMBERS) -> Column:
    """own, before: numbers of the page and of the one before."""
    return numbering(is_page_one(number_matches(bottom, patterns), len(patterns)), F.array_min(own), F.array_max(before))


def numbering(one: Column, least: Column, most_before: Column) -> Column:
    """one: is it marked as page one? least: of the page's numbers; most_before: the largest number of the page before."""
    return F.when(one, 0.95).when((least == 1) & (most_before > 5), 0.9).otherwise(0.0)


def may_start(text: Column, settings: C.HeuristicConfig) -> Column:
    """False only where a page can be no document start, whatever is before it: it has no colon, as e-mail headers have, and,
    where all page numbers are whole runs of digits, no run that ends in a one without 1 to 9 before it. Null for a text that is null, which is none either."""
    out = F.lit(False)
    if settings.weight("email_header") is not None:
        plain = all(C.NEEDED.get(p) == ":" for p in settings.email_headers)
        out = out | (F.contains(text, F.lit(":")) if plain else F.lit(True))
    if settings.weight("page_numbering") is not None:
        plain = all(p in C.WHOLE_NUMBERS for p in settings.page_numbers)
        out = out | (text.rlike(r"1(?!\d)(?<![1-9]1)") if plain else F.lit(True))
    return out


def header_signal(top: Column, before: Column) -> Column:
    return F.when(top == before, 0.0).when((top == "") | (before == ""), 0.7).otherwise(0.5)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def combine(signals: dict[str, Column], settings: C.HeuristicConfig) -> Column:
    """Weighted mean of the enabled signals over zero; from the ensemble threshold on, more for two or three that agree.
    Without any enabled pattern the confidence is 0."""
    used = [(v, float(w)) for k, v in signals.items() if (w := settings.weight(k)) is not None]
    if not used:
        return F.lit(0.0)
    weight, total, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for v, w in used:
        weight, total, n = weight + F.when(v > 0, w).otherwise(0.0), total + F.when(v > 0, w * v).otherwise(0.0), n + (v > 0.3).cast("int")

    def boosted(m: Column, n: Column) -> Column:
        more = F.when(n >= 3, F.least(m * 1.2, F.lit(1.0))).when(n >= 2, F.least(m * 1.1, F.lit(1.0))).otherwise(m)
        return F.when(m >= settings.ensemble, more).otherwise(m)

    mean = F.when(weight > 0, total / F.when(weight > 0, weight).otherwise(1.0)).otherwise(0.0)
    return bound(F.struct(mean.alias("m"), n.alias("n")), lambda s: boosted(s["m"], s["n"]))


def document_type(text: Column) -> Column:
    """The type with most matching patterns, the earlier on a tie; Document without any."""
    scores = [F.struct(sum((text.rlike("(?i)" + p).cast("int") for p in patterns[1:]), text.rlike("(?i)" + patterns[0]).cast("int")).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, patterns) in enumerate(C.DOCUMENT_TYPES.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"]).otherwise("Document")


def date_of(text: Column) -> Column:
    """The first date, year first. Where the last part has four characters it counts as the year; names of months stay."""
    kinds = ((r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", (3, 1, 2)), (r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", (1, 2, 3)), (r"(\w+)\s+(\d{1,2}),?\s+(\d{4})", (3, 1, 2)), (r"(\d{1,2})\s+(\w+)\s+(\d{4})", (3, 1, 2)))
    part = lambda p, g: F.regexp_extract(text, p, g)
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    return first_of([(text.rlike(p), F.concat_ws("-", part(p, y), pad(part(p, m)), pad(part(p, d)))) for p, (y, m, d) in kinds], F.lit(None).cast("string"))


def identifier(text: Column, kind: Column) -> Column:
    found = [((kind == k) & text.rlike("(?i)" + p), F.lower(F.regexp_replace(F.regexp_extract(text, "(?i)" + p, 1), r"[^\w\-_]", ""))) for k, patterns in C.IDENTIFIERS.items() for p in patterns]
    return first_of(found, F.lit(None).cast("string"))


def safe_name(name: Column) -> Column:
    """Characters that file systems refuse become _, runs of _ one; beyond 255 characters 250 and the last suffix."""
    clean = F.regexp_replace(F.translate(name, '<>:"/\\|?*', "_" * 9), "_+", "_")
    stem = F.regexp_replace(clean, r"\.[^.]*$", "")
    return F.when(F.length(clean) > 255, F.concat(F.substring(stem, 1, 250), F.lit("."), F.substring_index(clean, ".", -1))).otherwise(clean)


def strict_name(name: Column) -> Column:
    """Characters but letters, digits and -_. become _, runs of blanks and _ one; nothing or dots become `document`."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9\-_. ]", "_"), r"[_\s]+", "_")
    return F.when(clean.isin("", ".", ".."), "document").otherwise(strip(clean))


def suggested_name(kind: Column, date: Column, key: Column, number: Column) -> Column:
    last = F.coalesce(key, F.when(F.length(number.cast("string")) < 3, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))
    return safe_name(F.concat(F.concat_ws("_", F.lower(kind), date, last), F.lit(".pdf")))


def summary(text: Column) -> Column:
    joined = strip(F.array_join(F.slice(F.split(strip(text), "\n", -1), 1, 5), " "))
    return F.when(F.length(joined) > 200, F.concat(F.substring(joined, 1, 197), F.lit("..."))).otherwise(joined)


#: The words that mark a kind of document.
MARKERS = {
    "email_header": ("from:", "to:", "subject:", "date:"), "letter_greeting": ("dear ", "to whom it may concern"), "letter_closing": ("sincerely", "regards", "respectfully"),
    "invoice_header": ("invoice", "bill to", "invoice number"), "memo_header": ("memorandum", "memo to", "memo from"), "form_header": ("form ", "application", "request for"),
}
TITLE = r"(?m)^[A-Z][A-Z\s]{5,}$"
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
ALL_DATES = (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b", rf"\b{MONTHS}[a-z]* \d{{1,2}},? \d{{4}}\b", rf"\b\d{{1,2}} {MONTHS}[a-z]* \d{{4}}\b")


def markers(text: Column) -> dict[str, Column]:
    lower = F.lower(text)
    out = {}
    for name, found in MARKERS.items():
        hit = F.lit(False)
        for m in found:
            hit = hit | F.contains(lower, F.lit(m))
        out[name] = hit
    return out | {"page_number": lower.rlike(r"page \d+"), "document_title": strip(text).rlike(TITLE)}


def all_dates(text: Column) -> Column:
    """Every match of four patterns, one pattern after the other, repeats included."""
    return F.concat(*(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)) for p in ALL_DATES))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-case words; 0 if either has none."""
    x, y = (F.array_distinct(words(F.lower(t))) for t in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def share(text: Column, characters: str) -> Column:
    """Share of the characters of a class; 0 of an empty text."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, f"[^{characters}]", "")) / F.greatest(F.length(text), F.lit(1))).otherwise(0.0)


LETTERS_DIGITS, DIGITS, UPPER = r"\p{L}\p{N}", r"\p{Nd}", r"\p{Lu}"


def special_share(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, rf"[{LETTERS_DIGITS}\s]", "")) / F.greatest(F.length(text), F.lit(1))).otherwise(0.0)


def mean_word_length(text: Column) -> Column:
    """Characters that are not white over runs of these; no list of words is made."""
    shown = F.translate(text, BLANKS, "")
    runs = F.length(F.translate(F.regexp_replace(text, rf"[^{WHITE[1:-1]}]+", "x"), BLANKS, ""))
    return F.when(runs > 0, F.length(shown) / F.greatest(runs, F.lit(1))).otherwise(0.0)


def confidence(text: Column, blocks: Column) -> Column:
    one = F.when(special_share(text) > 0.3, 0.8).otherwise(1.0) * F.when((F.size(words(text)) > 0) & (mean_word_length(text) < 2), 0.7).otherwise(1.0)
    return F.when(strip(text) == "", 0.0).otherwise(F.round(F.when(blocks > 5, F.least(one * 1.1, F.lit(1.0))).otherwise(one), 2))


def quality(mean_word: Column, special: Column, upper: Column, line_confidence: Column, empty_lines: Column, suspicious: Column) -> Column:
    """Penalties on the mean confidence of lines."""
    score = F.when(mean_word < 2, 0.7).when(mean_word > 15, 0.8).otherwise(1.0) * F.when(special > 0.3, 0.8).otherwise(1.0)
    score = score * F.when(upper > 0.8, 0.9).otherwise(1.0) * line_confidence * F.when(empty_lines > 0.3, 0.9).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * F.when(suspicious > 5, 0.8).otherwise(1.0)))


def occurrences(text: Column, parts: Sequence[str]) -> Column:
    """Non-overlapping occurrences of each part, added up."""
    return sum((((F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)).cast("int") for p in parts[1:]), ((F.length(text) - F.length(F.replace(text, F.lit(parts[0]), F.lit("")))) / len(parts[0])).cast("int"))


#: What no input may contain.
SUSPICIOUS = ("|||", "```", "...", "___", "!!!")
INJECTIONS = (
    r"(\b(SELECT|INSERT|UPDATE|DELETE|DROP|UNION|CREATE|ALTER)\b)", r"(-{2}|\/\*|\*\/)", r"(\bOR\b\s*\d+\s*=\s*\d+)", r"(\bAND\b\s*\d+\s*=\s*\d+)",
    r"<script[^>]*>.*?</script>", r"javascript:", r"on\w+\s*=", r"<iframe[^>]*>", r"<object[^>]*>", r"<embed[^>]*>",
)


def injected(value: Column) -> Column:
    return any_match(value, INJECTIONS, "(?i)")


def html_safe(text: Column, limit: int = 10_000) -> Column:
    """Escaped for HTML, without NUL, trimmed and cut."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\0", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.substring(strip(out), 1, limit)


def duration(seconds: Column, with_seconds: bool = False) -> Column:
    """`1d 2h 3m`; with seconds, these too where there are no days."""
    d, h, m, s = F.floor(seconds / 86400), F.floor(F.pmod(seconds, F.lit(86400)) / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.floor(F.pmod(seconds, F.lit(60)))
    unit = lambda x, u: F.when(x > 0, F.concat(x.cast("string"), F.lit(u)))
    parts = [unit(d, "d"), unit(h, "h"), unit(m, "m")] + ([F.when(d == 0, unit(s, "s"))] if with_seconds else [])
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", "< 1s" if with_seconds else "< 1m").otherwise(joined)
