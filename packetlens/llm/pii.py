"""Personal data by candidate gradient boosting, in DataFrame functions only.

Fixed patterns with checks find the base spans. Generators of high recall propose further spans, overlapping ones too: tokens
with an @, addresses with a spelled @ or dot, numbers with and without blanks, four numbers with any kind of dots. Each proposal
has features of its format and of the text around it, all of a few values. Boosted trees score it for each kind; proposals
over the kind's calibrated threshold are added; of those that overlap, the ones that are kept are apart from each other and
have the largest scores together.

No text says what is personal data, so the labels are made: the base spans of all documents, written in other ways that the
base patterns miss (without the plus, with other separators, with a spelled @), in their own surroundings, are of the kind;
proposals of the texts themselves that meet no base span are not, nor are base spans that were spoiled (a wrong check digit,
a part over 255, digits grouped like an order, a date or an ISBN), or written as ordinary forms of the same look: lists by commas,
amounts, versions, sections, ratios, times, words before a spelled address, and numbers with more list items or a unit beside them. What defines a base span is thus never what the trees can go by. Training
sees counts by feature combination over all documents; what comes to the driver is one row for each combination that
occurs, of a fixed number that can. Each half of the documents calibrates the trees that the other half gave; the two
scores' mean is the score. The trees are then one expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Repeats are possessive where what follows can't begin with what they take, so that long
#: runs cost no backtracking; an email's first part is only tried where it can begin.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
IP_PARTS = rf"^(?:{PART}|0+)(?:\.(?:{PART}|0+)){{3}}$"
#: Of a generator, the kinds that it proposes, its pattern, and what a text must match for it to be tried.
GENERATORS: dict[str, tuple[tuple[str, ...], str, str]] = {
    "token": (("email",), r"[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D@]++", "@"),
    "spelled": (("email",), r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20dot\x20[A-Za-z0-9._%+-]++)*+\x20?[\[({<]?\x20?(?:@|at)\x20?[\])}>]?\x20?[A-Za-z0-9-]++(?:\x20?[\[({<]?\x20?(?:\.|dot)\x20?[\])}>]?\x20?[A-Za-z0-9-]++)++", r"(?i)@|[\x20\[({<]at\x20?[\])}>]?\x20?[a-z0-9-]++\x20?[\[({<]?\x20?(?:\.|dot)"),
    "number": (("card", "phone"), r"[+(]?[0-9](?:[\x20().,:/_-]{0,2}+[0-9])++", "[0-9]"),
    "tight": (("card", "phone"), r"[+(]?[0-9](?:[().,:/_-]{0,2}+[0-9])++", "[0-9]"),
    "quad": (("ip",), r"(?i)(?<![0-9])[0-9]{1,3}(?:\x20?[\[({]?(?:[.,_-]|dot)[\])}]?\x20?[0-9]{1,3}){3}(?![0-9])", "[0-9]"),
}
#: Digits that a number needs to be proposed at all.
LEAST_DIGITS = 7
CUES = r"(?i)(tel|phone|call|fon|mobil|fax|mail|contact|kontakt|host|addr|card|visa|konto|iban)"
BLOCK = 512
#: What stands after or before a number that counts or is an item of a list, and characters of a match's surroundings.
UNITS = r"(?i)^\x20?(?:[%‰€$£°]|(?:eur|usd|euros?|dollars?|percent|prozent|kg|km|cm|mm|[mg]b|ms|min|pages?|pieces?|items?|times|rows|votes|points|people)\b)"
LISTED_AFTER, LISTED_BEFORE = r"^\x20?[,;:/=]?\x20?[0-9]", r"[0-9]\x20?[,;:/=]?\x20?$"
COUNTED_BEFORE = r"(?i)(?:[$€£#§]|\b(?:eur|usd|no|nr|num|version|release|section|chapter|page|pages|kapitel|seite|ratio|score|isbn|order|id))[.:]?\x20?v?$"
BEFORE, AFTER = 24, 16

#: Trees: rounds, shrinkage, smoothing of leaves; the share of proposals over a threshold that must be of the kind (a lower bound, as
#: found ones that are personal data after all count against it); and the number of
#: proposals with the kind's overall share that count beside those over the threshold, so that few of these prove little.
ROUNDS, RATE, RIDGE, PRECISION, PRIOR = 40, 0.3, 1.0, 0.8, 0.5


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(x), use)[0]


def running(numbers: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running sums or maxima (as `both` says; zero is neutral) of an array<int>, in blocks, so that appending does not
    copy all for each element."""
    none = F.array().cast("array<int>")
    state = lambda t, o=none: F.struct(t.alias("t"), o.alias("o"))
    fold = lambda x, base: F.aggregate(x, state(base), lambda s, y: state(both(s["t"], y), F.array_append(s["o"], both(s["t"], y))))["o"]
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")), lambda b: F.slice(numbers, b * BLOCK + 1, BLOCK))
    of_blocks = lambda blocks: fold(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), both)), F.lit(0))
    inner = let(cut, lambda blocks: let(of_blocks(blocks), lambda t: F.flatten(F.transform(blocks, lambda x, i: fold(x, F.when(i == 0, 0).otherwise(t[F.greatest(i - 1, F.lit(0))]))))))
    return F.when(F.size(numbers) > 0, inner).otherwise(none)


def running_sums(numbers: Column) -> Column:
    return running(numbers, lambda a, b: a + b)


def clear_of(rows: Column, base: Column) -> Column:
    """Of spans those that overlap no base span (base spans are apart from each other), by start; by running maxima, so in
    steps as many as there are spans."""
    mark = lambda x, own, i: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), i.alias("at"))
    every = F.array_sort(F.concat(F.transform(base, lambda x: mark(x, 0, F.lit(0))), F.transform(rows, lambda x, i: mark(x, 1, i))))
    largest = lambda a, b: F.greatest(a, b)
    far = 1 << 30
    reach = lambda v: running(F.transform(v, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0)), largest)
    ahead = lambda v: F.reverse(running(F.reverse(F.transform(v, lambda x: F.when(x["own"] == 0, far - x["start"]).otherwise(0))), largest))
    free = lambda v: let(reach(v), lambda r: let(ahead(v), lambda a: F.filter(v, lambda x, i: (x["own"] == 1) & (r[i] <= x["start"]) & (far - a[i] >= x["end"]))))
    return F.when(F.size(base) == 0, rows).otherwise(let(every, lambda v: F.transform(free(v), lambda x: rows[x["at"]])))


def working(rows: DataFrame) -> str:
    """A prefix that no column of the rows begins with."""
    prefix = "pii_"
    while any(c.lower().startswith(prefix) for c in rows.columns):
        prefix += "_"
    return prefix


def with_matches(rows: DataFrame, patterns: dict[str, tuple[str, str]], text: str) -> DataFrame:
    """For each (pattern, what a text must match) a column of array<struct<start, end, found, before, after>>: code points of each leftmost
    match from the end of the last on, end exclusive; up to BEFORE characters before it and AFTER after it, short of the neighbouring match."""
    names = list(patterns)
    if not names:
        return rows
    own = working(rows.select(text, *(F.lit(0).alias(n) for n in names), *(c for c in rows.columns if c != text)))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"{own}m_{n}": F.when(F.col(text).rlike(need), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none) for n, (p, need) in patterns.items()})
    rows = rows.withColumns({f"{own}p_{n}": F.when(F.size(f"{own}m_{n}") > 0, F.split(F.col(text), p, -1)).otherwise(none) for n, (p, _) in patterns.items()})
    rows = rows.withColumns({f"{own}e_{n}": running_sums(F.zip_with(F.slice(f"{own}p_{n}", 1, F.size(f"{own}m_{n}")), f"{own}m_{n}", lambda p, m: F.length(p) + F.length(m))) for n in names})

    def spans(n: str) -> Column:
        zipped, piece = F.arrays_zip(F.col(f"{own}e_{n}").alias("e"), F.col(f"{own}m_{n}").alias("m")), F.col(f"{own}p_{n}")
        return F.transform(zipped, lambda x, i: F.struct((x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("found"), F.substring(piece[i], -BEFORE, BEFORE).alias("before"), F.substring(piece[i + 1], 1, AFTER).alias("after")))

    return rows.withColumns({n: spans(n) for n in names}).drop(*(f"{own}{k}_{n}" for n in names for k in "mpe"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits (of 19 at most) pass the Luhn check?"""
    back = F.reverse(number)
    worth = lambda i: F.substring(back, i, 1).cast("int") * (2 - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + F.when(worth(i) > 9, worth(i) - 9).otherwise(worth(i)))
    return total % 10 == 0


def holds(kind: str, found: Column) -> Column:
    """The check of a kind on a match of its pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(IP_PARTS)
    number = digits(found)
    if kind == "card":
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(F.lit(False))
    return F.length(number).between(9, 15)


#: What a text must match for a base pattern to be tried.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"}


def with_base(rows: DataFrame, text: str, own: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """{own}{kind}: the matches of each kind's pattern that hold, as of with_matches."""
    rows = with_matches(rows, {f"{own}{k}": (PATTERNS[k], NEEDS[k]) for k in kinds}, text)
    valid = lambda k: F.filter(f"{own}{k}", lambda x: holds(k, x["found"]))
    return rows.withColumns({f"{own}{k}": valid(k) for k in kinds})


def placed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


# Other ways to write a base span, and spans that look like one and are none.


def _grouped(number: Column, by: str) -> Column:
    """Digits in fours."""
    return F.regexp_replace(number, r"(.{4})(?=.)", "$1" + by)


def variants(kind: str, found: Column) -> list[Column]:
    """A base span in forms that its pattern misses. Commas join no address: four numbers with commas are a list."""
    if kind == "email":
        local, host = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
        dotted = lambda x, by: F.replace(x, F.lit("."), F.lit(by))
        pairs = ((local, " @ ", host), (local, "[at]", host), (local, " (at) ", host), (local, " [at] ", dotted(host, " [dot] ")), (local, " at ", dotted(host, " dot ")), (dotted(local, " dot "), " at ", dotted(host, " dot ")))
        return [F.concat(a, F.lit(at), h) for a, at, h in pairs]
    if kind == "ip":
        return [F.replace(found, F.lit("."), F.lit(by)) for by in (" . ", "[.]", "(.)", " dot ")]
    if kind == "card":
        return [_grouped(digits(found), by) for by in (".", "/", "  ", "_")]
    bare = F.substring(found, 2, 1 << 20)
    spaced = lambda by: F.regexp_replace(bare, r"[\x20().-]+", by)
    return [bare, F.regexp_replace(found, r"^\+[0-9]{1,3}[\x20.-]+", ""), spaced("."), spaced("/"), F.concat(F.lit("00"), spaced(" "))]


def spoiled(kind: str, x: Column) -> list[tuple[Column, Column, Column]]:
    """A base span turned into what is none: (found, before, after)."""
    found, before, after = x["found"], x["before"], x["after"]
    own = lambda *texts: [(t, before, after) for t in texts]
    if kind == "email":
        local, host = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
        name = F.substring_index(host, ".", 1)
        spelled = F.replace(host, F.lit("."), F.lit(" dot "))
        # Ordinary words, the text's own before the span and common ones, that an address follows.
        word = F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1)
        words = [F.when(word != "", word).otherwise("look"), *map(F.lit, ("look", "see", "us", "visit", "meet"))]
        return own(*(F.concat(local, F.lit(at), name) for at in ("@", " @ ")), F.concat(local, F.lit(" at "), name, F.lit(". "), F.initcap(name)), *(F.concat(w, F.lit(" at "), h) for w in words for h in (spelled, host)))
    if kind == "ip":
        parts = F.split(found, r"\.")
        cut = lambda n: F.transform(parts, lambda g: F.substring(g, 1, n))
        lists = [(F.concat_ws(by, own_parts), before, after) for own_parts in (parts, cut(1), cut(2)) for by in (",", ", ", " , ", "-", "_")]
        short = [(F.concat_ws(by, cut(n)), before, after) for n in (1, 2) for by in (" . ", "[.]", "(.)", " dot ", ".")]
        longer = [(F.concat_ws(by, parts), F.concat(before, F.lit(b)), F.lit(a)) for by in (" . ", ", ", ".") for b, a in (("", by + "7"), ("12" + by, ""))]
        over = own(*(F.replace(F.regexp_replace(found, "^[0-9]+", "999"), F.lit("."), F.lit(by)) for by in (" . ", "[.]", "(.)", ",", " dot ")))
        return [*lists, *short, *longer, *over]
    number = digits(found)
    at = lambda i, n: F.substring(number, i, n)
    beside = lambda t: [(t, F.concat(before, F.lit(b)), F.lit(a)) for b, a in (("12, ", ", 7 and"), ("", " euros"), ("$ ", ""))]
    if kind == "card":
        other = F.concat(F.regexp_replace(number, "[0-9]$", ""), ((F.substring(number, -1, 1).cast("int") + 1) % 10).cast("string"))
        unlike = ((r"^(.{3})(.{7})(.*)$", "$1-$2-$3"), (r"^(.{4})(.{2})(.{2})(.{2})(.{2})(.*)$", "$1-$2-$3 $4:$5:$6"), (r"^(.{3})(.)(.{3})(.{5})(.*)$", "$1-$2-$3-$4-$5"))
        amounts = [F.regexp_replace(t, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", by) for t in (number,) for by in (",", ".", " ")]
        lists = [_grouped(number, by) for by in (", ", ",", "; ")]
        return [*own(other, *lists, *(_grouped(other, by) for by in (".", "/", "  ", "_")), *(F.regexp_replace(number, a, b) for a, b in unlike), *amounts), *beside(number)]
    year, month, day = (F.concat(F.lit(x), at(i, n)) for x, i, n in (("20", 1, 2), ("0", 3, 1), ("1", 4, 1)))
    dates = [F.concat_ws(by, *parts) for by, parts in (("-", (year, month, day)), (".", (day, month, year)), ("/", (day, month, year)))]
    spans = [F.concat(dates[i], F.lit(by), dates[i]) for i, by in ((0, "/"), (1, "-"))] + [F.concat(year, F.lit("-"), year)]
    clock = F.concat(dates[0], F.lit(" 1"), at(5, 1), F.lit(":2"), at(6, 1))
    book = F.concat(F.lit("978-"), at(1, 1), F.lit("-"), at(2, 3), F.lit("-"), at(5, 5), F.lit("-"), at(1, 1))
    lists = [F.concat_ws(by, at(1, 1), at(2, 1), at(3, 2), at(5, 2), at(7, 2)) for by in (", ", ",", "/", " ", ".", "-")] + [F.concat_ws(by, at(1, 2), at(3, 3), at(6, 3), at(1, 3)) for by in (", ", ",", " ", ".")]
    amounts = [F.regexp_replace(t, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", by) for t in (number, at(1, 9), at(1, 7)) for by in (",", ".", " ")]
    return [*own(number, at(1, 8), at(1, 9), at(1, 10), *dates, *spans, clock, book, F.concat(at(1, 3), F.lit("."), at(4, 9)), *lists, *amounts), *beside(F.regexp_replace(F.substring(found, 2, 1 << 20), r"[\x20().-]+", " "))]


# Features of a proposal: name -> (column, number of values). Values are 0.. .


def _steps(x: Column, *limits: int) -> Column:
    """How many of the limits x reaches."""
    out = F.lit(0)
    for limit in limits:
        out = out + (x >= limit).cast("int")
    return out


def _flag(x: Column) -> Column:
    return F.coalesce(x.cast("int"), F.lit(0))


def _first_of(*cases: Column) -> Column:
    """The place of the first case that holds, else their number."""
    out = F.lit(len(cases))
    for i in reversed(range(len(cases))):
        out = F.when(cases[i], i).otherwise(out)
    return out


def features(kind: str, x: Column) -> dict[str, tuple[Column, int]]:
    found = x["found"]
    joins = r"[\p{L}0-9]"
    around = {"joined_before": (_flag(F.substring(x["before"], -1, 1).rlike(joins)), 2), "joined_after": (_flag(F.substring(x["after"], 1, 1).rlike(joins)), 2), "cue": (_flag(x["before"].rlike(CUES)), 2)}
    if kind == "email":
        local = F.regexp_extract(found, r"^([^@\x20\[({<]*)", 1)
        return around | {
            "at": (_first_of(found.rlike(r"[^\x20]@[^\x20]"), F.contains(found, F.lit("@")), found.rlike(r"(?i)[\[({<]\x20?at"), found.rlike(r"(?i)\x20at\x20")), 5),
            "dot": (_first_of(found.rlike(r"(?i)[\[({<]\x20?dot"), found.rlike(r"(?i)\x20dot\x20"), found.rlike(r"\.\x20"), found.rlike(r"(?:@|at[\])}>]?)[^.]*\.[^.]")), 5),
            "top": (_steps(F.length(F.regexp_extract(found, r"[^A-Za-z]([A-Za-z]+)[^A-Za-z0-9]*$", 1)), 1, 2, 4, 7), 5),
            "spelled_local": (_flag(found.rlike(r"(?i)^[^@]*\x20dot\x20.*\x20at\x20")), 2), "local": (_steps(F.length(local), 1, 3), 3), "local_digit": (_flag(local.rlike("[0-9._]")), 2), "capital_end": (_flag(found.rlike(r"[^A-Za-z][A-Z][a-z]*$")), 2),
        }
    number, groups = digits(found), F.filter(F.split(found, r"[^0-9]+", -1), lambda g: g != "")
    most = F.array_max(F.transform(groups, lambda g: F.length(g)))
    around |= {"unit": (_flag(x["after"].rlike(UNITS)), 2), "listed": (_flag(x["after"].rlike(LISTED_AFTER)) + 2 * _flag(x["before"].rlike(LISTED_BEFORE)), 4), "counted": (_flag(x["before"].rlike(COUNTED_BEFORE)), 2)}
    if kind == "ip":
        return around | {
            "size": (_steps(F.length(number), 5, 7, 9), 4), "dashed": (_flag(found.rlike("[-_]")), 2), "dotted": (_flag(F.contains(found, F.lit("."))), 2), "big": (_flag(F.exists(groups, lambda g: g.cast("int") > 255)), 2), "longest": (_steps(most, 2, 3), 3), "bracketed": (_flag(found.rlike(r"[\[({]")), 2), "spelled": (_flag(found.rlike("(?i)dot")), 2),
            "comma": (_flag(F.contains(found, F.lit(","))), 2), "spaces": (_steps(F.length(F.regexp_replace(found, "[^ ]", "")), 1, 4, 6), 4), "zero": (_flag(found.rlike(r"^0|[^0-9]0[0-9]")), 2),
        }
    return around | {
        "digits": (_steps(F.length(number), 9, 10, 11, 12, 14, 16, 17, 20), 9), "groups": (_steps(F.size(groups), 2, 3, 4, 5, 6), 6), "longest": (_steps(most, 4, 5, 7, 9, 12), 6),
        "plus": (_flag(found.startswith("+")), 2), "zeros": (_flag(found.startswith("00")), 2), "paren": (_flag(F.contains(found, F.lit("("))), 2), "slashed": (_flag(found.rlike("[/_.]")), 2),
        "clock": (_flag(found.rlike("[:,]")), 2), "thousands": (_flag(found.rlike(r"^[0-9]{1,3}(?:([., ])[0-9]{3})(?:\1[0-9]{3})*$")), 2), "dated": (_flag(found.rlike(r"(?:19|20)[0-9]{2}")), 2), "shortest": (_steps(F.array_min(F.transform(groups, lambda g: F.length(g))), 2, 3, 4), 4), "quad": (_flag(found.rlike(r"^[0-9]{1,3}(?:[.,][0-9]{1,3}){3}$")), 2), "luhn": (_flag(F.when(F.length(number).between(12, 19), luhn(number))), 2),
    }


def proposed(kind: str, own: str) -> Column:
    """Proposals of the kind's generators that overlap no base span of the kind."""
    rows = F.concat(*(f"{own}{g}" for g in generators_of(kind)))
    if kind in ("card", "phone"):
        rows = F.filter(rows, lambda x: F.length(digits(x["found"])) >= LEAST_DIGITS)
    return let(rows, lambda r: clear_of(r, F.col(f"{own}{kind}")))


def generators_of(kind: str) -> list[str]:
    return [g for g, (kinds, _, _) in GENERATORS.items() if kind in kinds]


def with_proposals(rows: DataFrame, kinds: tuple[str, ...], text: str, own: str) -> DataFrame:
    live = {g: (p, need) for g, (ks, p, need) in GENERATORS.items() if set(ks) & set(kinds)}
    return with_matches(rows, {f"{own}{g}": x for g, x in live.items()}, text)


def counts(rows: DataFrame) -> DataFrame:
    """(fold, kind, values, n, positive) over made and found examples of all kinds in (text, fold) rows; values: of the kind's features,
    in order."""
    own = "pii_"
    rows = with_proposals(with_base(rows, "text", own), KINDS, "text", own)

    def examples(kind: str) -> Column:
        def one(found: Column, before: Column, after: Column, y: int) -> Column:
            return F.struct(found.alias("found"), before.alias("before"), after.alias("after"), F.lit(y).alias("y"))

        made = F.flatten(F.transform(f"{own}{kind}", lambda x: F.array(*(one(v, x["before"], x["after"], 1) for v in variants(kind, x["found"])), *(one(*v, 0) for v in spoiled(kind, x)))))
        met = F.transform(proposed(kind, own), lambda x: one(x["found"], x["before"], x["after"], 0))
        return F.concat(made, met)

    out = None
    for kind in KINDS:
        # A kind at a time is exploded, so that only its own examples are beside a text.
        own_rows = rows.select("fold", F.explode(examples(kind)).alias("x"))
        values = F.array(*(c.cast("int") for c, _ in features(kind, F.col("x")).values()))
        own_rows = own_rows.select("fold", F.lit(KINDS.index(kind)).alias("kind"), values.alias("values"), F.col("x.y").alias("y"))
        out = own_rows if out is None else out.unionByName(own_rows)
    return out.groupBy("fold", "kind", "values").agg(F.count("*").alias("n"), F.sum("y").alias("positive"))


Tree = tuple[str, int, tuple[str, int, float, float], tuple[str, int, float, float]]


class Boosted:
    """Trees of two levels for each half of the documents, their biases, and the margin from which on a proposal is selected (None:
    never). A node (feature, limit, low, high) goes low where the feature is below the limit. The margin is the mean of the halves'."""

    def __init__(self, halves: list[tuple[float, list[Tree]]], threshold: float | None):
        self.halves, self.threshold = halves, threshold

    @classmethod
    def fit(cls, rows: list[dict], sizes: dict[str, int]) -> Boosted:
        """Each half of the rows is calibrated by the trees of the other one."""
        halves = [grown([r for r in rows if r["fold"] == k], sizes) for k in (0, 1)]
        held = sorted(((margin(halves[1 - r["fold"]], r), r["n"], r["positive"]) for r in rows), reverse=True)
        every, share = sum(n for _, n, _ in held), sum(p for _, _, p in held)
        share = share / every if every else 0.0
        levels: dict[float, list[int]] = {}
        for m, a, b in held:
            own = levels.setdefault(m, [0, 0])
            own[0], own[1] = own[0] + a, own[1] + b
        threshold, n, positive = None, 0, 0
        for m, (a, b) in levels.items():  # from the best score down; a score at which most are not of the kind is no threshold
            n, positive = n + a, positive + b
            if 2 * b >= a and positive + PRIOR * share >= PRECISION * (n + PRIOR):
                threshold = m - 1e-9
        return cls(halves, threshold)

    def margin(self, row: dict) -> float:
        return sum(margin(h, row) for h in self.halves) / 2

    def margin_sql(self, of: str) -> str:
        """The trees as one SQL expression over the fields of a struct."""
        node = lambda x: f"CASE WHEN {of}.{x[0]} < {x[1]} THEN {x[2] / 2!r}D ELSE {x[3] / 2!r}D END"
        trees = [f"CASE WHEN {of}.{f} < {c} THEN {node(low)} ELSE {node(high)} END" for _, own in self.halves for f, c, low, high in own]
        return " + ".join([f"{sum(bias for bias, _ in self.halves) / 2!r}D", *trees])


def grown(fit: list[dict], sizes: dict[str, int]) -> tuple[float, list[Tree]]:
    """Logistic boosting with second-order leaves on weighted feature combinations: the bias and the trees. Without examples of
    both classes the trees are leaves near zero."""
    n, positive = sum(r["n"] for r in fit), sum(r["positive"] for r in fit)
    bias, trees = math.log((positive + 0.5) / (n - positive + 0.5)), []
    if not fit:
        return bias, trees
    at = {f: np.array([r[f] for r in fit]) for f in sizes}
    weight, hits = (np.array([r[k] for r in fit], float) for k in ("n", "positive"))
    now = np.full(len(fit), bias)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-now))
        g, h = hits - weight * p, weight * p * (1 - p)

        def best(own: np.ndarray, g=g, h=h) -> tuple[str, int, float, float]:
            """The split of the rows with the largest gain, the first of equals, and its leaves."""
            found = (-1.0, next(iter(sizes)), 1, 0.0, 0.0)
            for f, k in sizes.items():
                gs, hs = (np.cumsum(np.bincount(at[f][own], x[own], k)) for x in (g, h))
                for c in range(1, k):
                    gl, hl, gr, hr = gs[c - 1], hs[c - 1], gs[-1] - gs[c - 1], hs[-1] - hs[c - 1]
                    gain = gl * gl / (hl + RIDGE) + gr * gr / (hr + RIDGE)
                    if gain > found[0] + 1e-9:
                        found = (gain, f, c, float(RATE * gl / (hl + RIDGE)), float(RATE * gr / (hr + RIDGE)))
            return found[1:]

        f, c, _, _ = best(np.ones(len(fit), bool))
        high = at[f] >= c
        sides = [best(high == side) for side in (False, True)]
        trees.append((f, c, *sides))
        for side, (sf, sc, a, b) in zip((False, True), sides, strict=True):
            own = high == side
            now[own] += np.where(at[sf][own] < sc, a, b)
    return bias, trees


def margin(half: tuple[float, list[Tree]], row: dict) -> float:
    bias, trees = half
    for f, c, low, high in trees:
        f, c, a, b = low if row[f] < c else high
        bias += a if row[f] < c else b
    return bias


def sizes_of(kind: str) -> dict[str, int]:
    return {f: k for f, (_, k) in features(kind, F.struct(*(F.lit("").alias(c) for c in ("found", "before", "after")))).items()}


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[str, Boosted]:
    """A model for each kind, from all documents; documents of one id are in one half."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 2).cast("int").alias("fold"))
    found = counts(rows).collect()
    models = {}
    for i, kind in enumerate(KINDS):
        sizes = sizes_of(kind)
        own = [{"fold": r.fold, "n": r.n, "positive": r.positive, **dict(zip(sizes, r["values"], strict=True))} for r in found if r.kind == i]
        models[kind] = Boosted.fit(sorted(own, key=lambda r: [r[f] for f in ("fold", *sizes)]), sizes)
    return models


def with_added(rows: DataFrame, kind: str, model: Boosted, own: str) -> DataFrame:
    """Adds {own}added_{kind}, array<struct<start, kind, end, weight>> of the proposals over the threshold, without marks at their ends; weight: how
    far over it they are, and a little."""
    head = lambda x: F.length(F.regexp_extract(x["found"], r"^[^\p{L}\p{N}+(]*", 0))
    tail = lambda x: F.length(F.regexp_extract(x["found"], r"[^\p{L}\p{N}]*$", 0))
    of = lambda x: F.struct((x["start"] + head(x)).alias("start"), (x["end"] - tail(x)).alias("end"), *(c.alias(f) for f, (c, _) in features(kind, x).items()))
    rows = rows.withColumn(f"{own}of", F.transform(proposed(kind, own), of))
    scored = f"transform(`{own}of`, x -> named_struct('start', x.start, 'kind', {KINDS.index(kind)}, 'end', x.end, 'weight', {model.margin_sql('x')} - {model.threshold!r}D + 0.01D))"
    return rows.withColumn(f"{own}added_{kind}", F.expr(f"filter({scored}, x -> x.weight >= 0.01D AND x.start < x.end)")).drop(f"{own}of")


def with_spans(rows: DataFrame, models: dict[str, Boosted], text: str, own: str) -> DataFrame:
    """The rows with {own}{kind}, the base matches, and {own}spans, base and added spans sorted by start, kind and end, each once; added
    ones are apart from each other."""
    live = tuple(k for k in KINDS if models[k].threshold is not None)
    rows = with_proposals(with_base(rows, text, own), live, text, own)
    for kind in live:
        rows = with_added(rows, kind, models[kind], own)
    none = F.array().cast("array<struct<start: int, kind: int, end: int, weight: double>>")
    rows = rows.withColumn(f"{own}found", F.array_sort(F.concat(none, *(f"{own}added_{k}" for k in live))))
    base = [placed(F.col(f"{own}{k}"), k) for k in KINDS]
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return rows.withColumn(f"{own}spans", F.array_sort(F.array_distinct(F.concat(*base, plain(apart(F.col(f"{own}found")))))))


def apart(spans: Column) -> Column:
    """Of spans (start, kind, end, weight over zero), sorted, those apart from each other that weigh most together. Spans that overlap, directly or
    through others, are a cluster, found by running maxima of the ends; in a cluster, in order of their ends, the best choice up
    to a span is that without it, or with it and the best one that ends before it starts. A cluster takes steps as the square
    of its spans, which generators keep few: matches of one generator are apart."""
    ends = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

    def clusters(v: Column, reach: Column) -> Column:
        heads = F.filter(F.transform(v, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(reach, i - 1)), i).otherwise(-1)), lambda i: i >= 0)
        return let(heads, lambda h: F.transform(h, lambda a, i: F.slice(v, a + 1, F.coalesce(F.get(h, i + 1), F.size(v)) - a)))

    picked = "array<struct<start: int, kind: int, end: int, weight: double>>"
    start = F.array(F.struct(F.lit(0).alias("end"), F.lit(0.0).alias("weight"), F.array().cast(picked).alias("picked")))

    def best(cluster: Column) -> Column:
        def step(done: Column, x: Column) -> Column:
            before = F.element_at(F.filter(done, lambda d: d["end"] <= x["start"]), -1)
            taken = F.struct(x["end"].alias("end"), (before["weight"] + x["weight"]).alias("weight"), F.array_append(before["picked"], x).alias("picked"))
            return F.when(taken["weight"] > F.element_at(done, -1)["weight"], F.array_append(done, taken)).otherwise(done)

        by_end = F.array_sort(cluster, lambda a, b: F.when(a["end"] != b["end"], a["end"] - b["end"]).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
        return F.when(F.size(cluster) == 1, cluster).otherwise(F.aggregate(by_end, start, step, lambda done: F.element_at(done, -1)["picked"]))

    return F.when(F.size(spans) < 2, spans).otherwise(let(spans, lambda v: let(ends, lambda reach: F.flatten(F.transform(clusters(v, reach), best)))))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", models: dict[str, Boosted] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    Counts and digest are of the base spans, spans has these and the added ones. A null or empty text has none. Repeated
    rows are all returned; an empty table gives no rows; other columns are not read. A very long text is worked on as a whole in
    its task.
    """
    models = models or train(docs, doc_id, text)
    own = "pii_"
    rows = with_spans(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), models, "text", own)
    base = F.array_sort(F.concat(*(placed(F.col(f"{own}{k}"), k) for k in KINDS)))
    return rows.select("doc_id", *(F.size(f"{own}{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col(f"{own}spans")).alias("spans"))


def redacted(rows: DataFrame, models: dict[str, Boosted], text: str = "text") -> DataFrame:
    """The rows with the text's spans replaced by the name of their kind in brackets; overlapping spans become one, under the
    name of the first. A null text stays null."""
    columns, own = rows.columns, working(rows)
    whole = F.col(f"{own}text")
    out = with_spans(rows.withColumn(f"{own}text", F.coalesce(F.col(text), F.lit(""))), models, f"{own}text", own)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        more = F.array_append(F.array_append(s["parts"], F.substring(whole, s["at"] + 1, x["start"] - s["at"])), names[x["kind"]])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] < s["at"], s["parts"]).otherwise(more).alias("parts"))

    spans = F.col(f"{own}spans")
    done = F.aggregate(spans, state, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(whole, s["at"] + 1, F.length(whole))))
    return out.withColumn(text, F.when(F.col(text).isNotNull() & (F.size(spans) > 0), done).otherwise(F.col(text))).select(*columns)
