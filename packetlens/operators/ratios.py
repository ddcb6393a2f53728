"""How alike a read text is to the expected one: character, partial and token-set ratios.

A ratio is twice the longest common subsequence over both lengths. A row of the subsequence table is one integer, of which an
addition carries all columns at once. A partial ratio is the best over all places of the shorter text in the longer one: a
place's score is bounded by the characters that both have, and by its neighbours' scores, which differ by one at most for each step,
so only places that could still be the best are compared.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import word_accuracy

RATIOS = "char_accuracy double, partial_accuracy double, token_accuracy double"


def positions(text: str) -> dict[str, int]:
    """For each character the places where it stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """The length of the longest common subsequence; places: positions(a)."""
    if not a or not b:
        return 0
    places = positions(a) if places is None else places
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        if match := row & places.get(c, 0):
            row = (row + match | row - match) & every
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else 2 * common(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text (of equals the first) to as many characters of the longer one, or to fewer at its end.
    An empty text is part of any."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short or short in long:
        return 1.0
    m, n = len(short), len(long)
    codes = np.array([ord(c) for c in long])
    most = np.zeros(n, np.int64)
    for c, times in Counter(short).items():
        upto = np.concatenate([[0], np.cumsum(codes == ord(c))])
        most += np.minimum(upto[np.minimum(np.arange(n) + m, n)] - upto[:-1], times)
    lengths = m + np.minimum(m, n - np.arange(n))
    places, best, steps = positions(short), 0.0, np.arange(n)
    bound = 2 * most / lengths
    while (at := int(bound.argmax())) >= 0 and bound[at] > best:
        found = common(short, long[at : at + m], places)
        best = max(best, 2 * found / lengths[at])
        most = np.minimum(most, found + np.abs(steps - at))
        bound = 2 * most / lengths
        bound[at] = -1.0
        most[at] = -1
    return best


def tokens(text: str) -> list[str]:
    """Distinct words of ASCII letters, digits and underscores, lower-cased, in order; other ASCII characters part them, all others are dropped."""
    return sorted(set(re.sub(r"[^A-Za-z0-9_]", " ", text.encode("ascii", "ignore").decode()).lower().split()))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the words that both have, and these with the rest of either text; texts without words have none."""
    if a == b:
        return 1.0
    x, y = tokens(a), tokens(b)
    if not x or not y:
        return 0.0
    both = " ".join(t for t in x if t in set(y))
    first, second = (" ".join([*([both] if both else []), *(t for t in own if t not in set(other))]) for own, other in ((x, y), (y, x)))
    return max(ratio(both, first), ratio(both, second), ratio(first, second))


def hundredths(share: float) -> float:
    return round(100 * share) / 100


def text_accuracy(rows: DataFrame, expected: str, actual: str, exact: bool = False) -> DataFrame:
    """The rows with word_precision, word_recall, word_f1, char_accuracy, partial_accuracy, token_accuracy, and counts of words and characters of both
    texts; ratios are of lower-cased texts with single spaces, in whole hundredths unless exact. Null is empty. Two empty texts are
    alike. A row's time grows with the product of its texts' lengths, 64 characters at a time."""

    @F.pandas_udf(RATIOS)
    def ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        said = (lambda x: x) if exact else hundredths
        found = [(said(ratio(x, y)), said(partial_ratio(x, y)), said(token_set_ratio(x, y))) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(found, columns=["char_accuracy", "partial_accuracy", "token_accuracy"])

    def normal(name: str) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s+", " "))

    words = {k: F.filter(F.split(normal(c), " "), lambda x: x != "") for k, c in (("expected", expected), ("actual", actual))}
    shares = {f"word_{k}": c for k, c in word_accuracy(words["expected"], words["actual"]).items()}
    counts = {f"word_count_{k}": F.size(w) for k, w in words.items()} | {f"char_count_{k}": F.char_length(F.coalesce(c, F.lit(""))) for k, c in (("expected", expected), ("actual", actual))}
    out = rows.withColumns({**shares, **counts, "__ratios": ratios(normal(expected), normal(actual))})
    return out.select(*rows.columns, *shares, *counts, "__ratios.*")
