"""Quality rules: fixed limits, then robust multivariate outliers.

Each document has five rates of its words: characters, short words, marks, capitals, and words that stand twice within fifty.
The vector is their logarithms. A short text's rates scatter more than a long one's, so all are first mixed with 200 words of
the language's median rates, which makes vectors of texts of 50 words and of 5000 scatter about alike.

For each language and source, location and scatter are estimated by the minimum covariance determinant: from three starts
(medians and quartiles, the language's estimate, all of the group) concentration steps refit on the 75 % of documents at the
smallest Mahalanobis distances while the determinant shrinks, and the start with the least determinant stands. The scatter
is regularised: it is mixed with that of the language as if 20 more documents had it, and the language's with that of all, so
a group of any size has an estimate of its own and a small one is near its language's. A document too far from its group's
centre is rejected.

A step is one aggregate: sums for each group, start and bin of the distance; the cut falls between bins. Groups of up to
GROUP_ROWS documents (languages of up to LANGUAGE_ROWS) go through all their steps in one task, on their vectors alone; in larger ones a step is an aggregate over all
of them, which deals out a group of any size. Both follow one law. Vectors are integers (fixed point), so sums are
exact and a repeated run gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, pieces, record_batch

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Words of median rates that every text is mixed with; the rate that a logarithm takes for none; characters of a short word;
#: words within which a repeated one counts.
PRIOR_WORDS, NONE_RATE, SHORT, NEAR = 200, 0.02, 3, 50
DIMS, SCALE = 5, 512
#: Share of a group's documents that the estimate rests on, of normal vectors that stay, and documents that the wider scatter
#: and centre count for.
COVER, STAY, WIDER = 0.75, 0.999999, 20
#: What a step must take off the logarithm of the determinant for another one to follow.
LEAST_GAIN = 0.01
#: Scatter that is taken for none, in any direction: that of the fixed point itself.
LEAST_SCATTER = 1.0
BINS, BINS_PER_LOG = 128, 16
#: Documents of a language, and of a language's source, whose steps are taken in one task. Fewer of a language, as there are few of them to
#: share the work.
LANGUAGE_ROWS, GROUP_ROWS = 3_000, 10_000
#: Groups whose estimates are sent to every task; beyond, they are joined by key.
BROADCAST_GROUPS = 20_000

SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS)] = True
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
MARK = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
CAPITAL = np.array([65 <= c < 91 for c in range(256)])
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("word_chars", "n_short", "n_marks", "n_capitals", "n_near")
COUNTED = (*BASE, *RATES[1:])


def statistics(text: bytes) -> tuple[int, ...]:
    """The values of COUNTED for a text."""
    words = text.split()
    n = len(words)
    data = np.frombuffer(text, np.uint8)
    chars = int(np.count_nonzero((data & 0xC0) != 0x80) - np.count_nonzero(WHITE[data]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = near = 0
    if n:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, size = np.fromiter(map(number.__getitem__, words), np.int64, n), len(number)
        near = n - len(np.unique(np.arange(n) // NEAR * size + ids))
    if n >= 3:
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1].ravel()
        inverse, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)[1:]
        at = np.flatnonzero(counts[inverse.ravel()] > 1)
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[at + k] = True
        repeated = int(inside.sum())
    short = int((np.fromiter(map(len, words), np.int64, n) <= SHORT).sum())
    return n, chars, int(np.count_nonzero(SYMBOL[data])), len(lines) - len(set(lines)), repeated, short, int(np.count_nonzero(MARK[data])), int(np.count_nonzero(CAPITAL[data])), near


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, *COUNTED); lang and source are empty where missing."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, texts in pieces(batch):
                values = np.array([statistics(t) for t in texts], np.int64)
                yield record_batch(doc_id=part.column(0), lang=part.column(1), source=part.column(2), **{k: values[:, i] for i, k in enumerate(COUNTED)})

        return each

    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *group, F.col("text").alias("text"))
    return map_batches(rows, make, "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in COUNTED))


def _log(rate: Column) -> Column:
    return F.round(F.log(NONE_RATE + rate) * SCALE).cast("int")


X = [f"x{i}" for i in range(DIMS)]
UPPER = list(zip(*(x.tolist() for x in np.triu_indices(DIMS)), strict=True))
QUARTILES = "lang string, source string, q1 array<double>, q2 array<double>, q3 array<double>"


def _quartiles(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of (lang, source, dim, value, n): the values at a quarter, half and three quarters of the counts of each dimension."""
    found = np.zeros((3, DIMS))
    for k, own in pdf.groupby("dim"):
        own = own.sort_values("value")
        total = np.cumsum(own["n"].to_numpy())
        found[:, int(k)] = own["value"].to_numpy()[np.searchsorted(total, np.array([0.25, 0.5, 0.75]) * total[-1])]
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "source": [pdf["source"].iloc[0]], **{f"q{i + 1}": [found[i].tolist()] for i in range(3)}})


def quartiles(rows: DataFrame, values: list[Column]) -> DataFrame:
    """QUARTILES of integer values by (lang, source), from counts of each value: what a group brings together is bounded by the
    values that there are, not by its documents."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), v.alias("value")) for i, v in enumerate(values)))).alias("e")
    counts = rows.select("lang", "source", each).groupBy("lang", "source", "e.dim", "e.value").agg(F.count("*").alias("n"))
    return counts.groupBy("lang", "source").applyInPandas(_quartiles, QUARTILES)


def vectors(sound: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (of COUNTED columns) with x0.. ; the median rates of each language are those of `sound`."""
    raw = [_log(F.col(c) / F.greatest("n_words", F.lit(1))) for c in RATES]
    median = quartiles(sound.withColumn("source", F.lit("")), raw).select("lang", F.col("q2").alias("typical"))
    mixed = [_log((F.col(c) + PRIOR_WORDS * (F.exp(F.col("typical")[i] / SCALE) - NONE_RATE)) / (F.col("n_words") + PRIOR_WORDS)) for i, c in enumerate(RATES)]
    return rows.join(F.broadcast(median) if median.count() <= BROADCAST_GROUPS else median, "lang", "left").withColumns(dict(zip(X, mixed, strict=True))).drop("typical")


def chi_square(x: float, dims: int) -> float:
    """Distribution function."""
    found = math.erf(math.sqrt(x / 2)) if dims % 2 else 1 - math.exp(-x / 2)
    for k in range(2 - dims % 2, dims, 2):
        found -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return found


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < p else (low, middle)
    return low


#: Makes the scatter of the inner COVER of normal vectors that of all.
CONSISTENT = COVER / chi_square(chi_square_quantile(COVER), DIMS + 2)
CUT = chi_square_quantile(STAY)


def regular(scatter: np.ndarray) -> np.ndarray:
    """The scatter, in no direction below LEAST_SCATTER."""
    value, along = np.linalg.eigh(scatter)
    return along * np.maximum(value, LEAST_SCATTER) @ along.T


def half(full: np.ndarray) -> list[float]:
    return [float(full[i, j]) for i, j in UPPER]


def whole(upper: list[float]) -> np.ndarray:
    full = np.zeros((DIMS, DIMS))
    for (i, j), x in zip(UPPER, upper, strict=True):
        full[i, j] = full[j, i] = x
    return full


def moments(sums: np.ndarray, squares: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter (upper half in, full out) from sums."""
    centre = sums / n
    return centre, whole((squares / n).tolist()) - np.outer(centre, centre)


def distance(centre: Column, inverse: Column) -> Column:
    """The squared Mahalanobis distance of x0.. ."""
    away = [F.col(x) - centre[i] for i, x in enumerate(X)]
    terms = [inverse[k] * away[i] * away[j] * (1 if i == j else 2) for k, (i, j) in enumerate(UPPER)]
    return sum(terms[1:], terms[0])


#: A group's estimate from one start. n: documents of the inner share; target: the wider scatter that it is mixed with.
STATE = "lang string, source string, start int, n long, centre array<double>, scatter array<double>, inverse array<double>, target array<double>, log_det double, active boolean"


def sums() -> list[Column]:
    return [F.sum(F.col(x).cast("long")).alias(f"s{i}") for i, x in enumerate(X)] + [F.sum(F.col(X[i]).cast("long") * F.col(X[j])).alias(f"s{i}_{j}") for i, j in UPPER]


def _state(lang: str, source: str, start: int, n: float, centre: np.ndarray, scatter: np.ndarray, target: np.ndarray, log_det: float | None = None) -> dict:
    """The scatter is mixed with the target for the distances and the determinant."""
    mixed = regular((n * scatter + WIDER * target) / (n + WIDER))
    log_det = float(np.linalg.slogdet(mixed)[1]) if log_det is None else log_det
    return {"lang": lang, "source": source, "start": start, "n": int(n), "centre": centre.tolist(), "scatter": half(scatter), "inverse": half(np.linalg.inv(mixed)), "target": half(target), "log_det": log_det, "active": True}


def refit(bins: pd.DataFrame) -> pd.DataFrame:
    """STATE of one group and start from the bins (with the group's target), in order of distance, that hold its inner COVER."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy()
    own = bins.iloc[: int(np.searchsorted(np.cumsum(n), math.ceil(COVER * n.sum()))) + 1]
    m = float(own["n"].sum())
    centre, scatter = moments(own[[f"s{i}" for i in range(DIMS)]].sum().to_numpy(float), own[[f"s{i}_{j}" for i, j in UPPER]].sum().to_numpy(float), m)
    first = bins.iloc[0]
    return pd.DataFrame([_state(first["lang"], first["source"], int(first["start"]), m, centre, scatter * CONSISTENT, whole(first["target"]))])


def _starts(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three states of each group row (quartiles, sums, n, and the wider centre and target). No determinant is kept of them."""
    for pdf in groups:
        out = []
        for r in pdf.to_dict("records"):
            q1, q2, q3 = (np.array(r[f"q{i}"]) for i in (1, 2, 3))
            mean, scatter = moments(np.array([r[f"s{i}"] for i in range(DIMS)], float), np.array([r[f"s{i}_{j}"] for i, j in UPPER], float), float(r["n"]))
            target = np.diag(((q3 - q1) / 1.349) ** 2) if r["target"] is None else whole(r["target"])
            wider = q2 if r["wider"] is None else np.array(r["wider"])
            for start, (centre, own) in enumerate(((q2, np.diag(((q3 - q1) / 1.349) ** 2)), (wider, target), (mean, scatter))):
                out.append(_state(r["lang"], r["source"], start, float(r["n"]), centre, own, target, math.inf))
        if out:
            yield pd.DataFrame(out)


def _bins(x: np.ndarray, state: dict) -> pd.DataFrame:
    """What `refit` takes, of a group's vectors."""
    away = [x[:, i] - state["centre"][i] for i in range(DIMS)]
    d = sum((state["inverse"][k] * away[i] * away[j] * (1 if i == j else 2) for k, (i, j) in enumerate(UPPER)), np.zeros(len(x)))
    at = np.minimum(np.floor(np.log1p(np.maximum(d, 0.0)) * BINS_PER_LOG), BINS - 1).astype(np.int64)
    total = {"n": np.ones(len(x)), **{f"s{i}": x[:, i] for i in range(DIMS)}, **{f"s{i}_{j}": x[:, i] * x[:, j] for i, j in UPPER}}
    used = np.unique(at)
    columns = {k: np.bincount(at, weights=v, minlength=BINS)[used] for k, v in total.items()}
    return pd.DataFrame({"bin": used, **columns, **{k: state[k] for k in ("lang", "source", "start")}, "target": [state["target"]] * len(used)})


def _settled(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    """The best of a group's starts, all steps taken."""
    x = rows[X].to_numpy(float)
    done = []
    for state in states.sort_values("start").to_dict("records"):
        while state["active"]:
            new = refit(_bins(x, state)).to_dict("records")[0]
            gain = state["log_det"] - new["log_det"]
            state = (new if gain > 0 else state) | {"active": gain > LEAST_GAIN}
        done.append(state)
    best = min(done, key=lambda e: (e["log_det"], e["start"])) if done else None
    return pd.DataFrame([best] if best else [], columns=["lang", "source", "n", "centre", "scatter", "target"])


def small(found: DataFrame) -> DataFrame:
    """Broadcast, if the rows are few."""
    return F.broadcast(found) if found.count() <= 3 * BROADCAST_GROUPS else found


def estimates(rows: DataFrame, wider: DataFrame | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(lang, source, n, centre, scatter): for each group of (lang, source, x0..) rows the regularised minimum covariance determinant
    estimate, from three starts. wider: (lang, wider, target), the centre and scatter of each language."""
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *sums()).join(quartiles(rows, [F.col(x) for x in X]), ["lang", "source"])
    none = F.lit(None).cast("array<double>")
    groups = groups.join(small(wider), "lang", "left") if wider is not None else groups.withColumns({"wider": none, "target": none})
    starts = durable(groups.mapInPandas(_starts, STATE))
    few = starts.where(F.col("n") <= group_rows)
    now = starts.where(F.col("n") > group_rows)
    keys = few.select("lang", "source").distinct()
    own = rows.join(small(keys), ["lang", "source"], "left_semi").groupBy("lang", "source").cogroup(few.groupBy("lang", "source"))
    in_tasks = own.applyInPandas(_settled, "lang string, source string, n long, centre array<double>, scatter array<double>, target array<double>")
    left = now.count()
    if not left:
        return in_tasks
    while left:
        few = (lambda x: F.broadcast(x)) if left <= 3 * BROADCAST_GROUPS else (lambda x: x)
        old = now.where("active")
        asked = rows.join(few(old.select("lang", "source", "start", "centre", "inverse")), ["lang", "source"])
        bin_no = F.least(F.floor(F.log1p(F.greatest(distance(F.col("centre"), F.col("inverse")), F.lit(0.0))) * BINS_PER_LOG), F.lit(BINS - 1)).alias("bin")
        bins = asked.groupBy("lang", "source", "start", bin_no).agg(F.count("*").alias("n"), *sums())
        new = bins.join(few(old.select("lang", "source", "start", "target")), ["lang", "source", "start"]).groupBy("lang", "source", "start").applyInPandas(refit, STATE)
        # A step that hardly shrinks the determinant ends its start: each goes on for finitely many steps.
        both = now.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
        best = F.min_by(F.struct("n", "centre", "scatter", "inverse", "target", "log_det", "turn"), F.struct("log_det", "turn")).alias("e")
        found = both.groupBy("lang", "source", "start").agg(best, (F.max(F.when(F.col("turn") == 0, F.col("log_det"))) - F.max(F.when(F.col("turn") == 1, F.col("log_det")))).alias("gain"))
        now = durable(found.select("lang", "source", "start", *(f"e.{c}" for c in ("n", "centre", "scatter", "inverse", "target", "log_det")), F.coalesce(F.col("gain") > LEAST_GAIN, F.lit(False)).alias("active")))
        left = now.where("active").count()
    best = F.min_by(F.struct("n", "centre", "scatter", "target"), F.struct("log_det", "start")).alias("e")
    return now.groupBy("lang", "source").agg(best).select("lang", "source", "e.*").unionByName(in_tasks)


def _pooled(groups: DataFrame) -> DataFrame:
    """(lang, wider, target) from the languages' estimates: the scatter is mixed with that of all languages, document for document."""
    parts = [F.sum(F.col("n") * F.col("scatter")[k]) for k in range(len(UPPER))]
    every = groups.agg(F.array(*(p / F.sum("n") for p in parts)).alias("every"))
    mixed = F.zip_with("scatter", "every", lambda a, b: (F.col("n") * a + WIDER * b) / (F.col("n") + WIDER))
    return groups.crossJoin(F.broadcast(every)).select("lang", F.col("centre").alias("wider"), mixed.alias("target"))


def _final(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and inverse scatter of each group, both mixed with the language's."""
    for pdf in groups:
        n = pdf["n"].to_numpy(float)
        centre = [((m * np.array(c) + WIDER * np.array(w)) / (m + WIDER)).tolist() for m, c, w in zip(n, pdf["centre"], pdf["wider"], strict=True)]
        inverse = [half(np.linalg.inv(regular((m * whole(s) + WIDER * whole(t)) / (m + WIDER)))) for m, s, t in zip(n, pdf["scatter"], pdf["target"], strict=True)]
        yield pd.DataFrame({"lang": pdf["lang"], "source": pdf["source"], "centre": centre, "inverse": inverse})


def group_estimates(rows: DataFrame, group_rows: int = GROUP_ROWS, language_rows: int = LANGUAGE_ROWS) -> DataFrame:
    """(lang, source, centre, inverse) for every language and source of (lang, source, x0..) rows."""
    wider = durable(_pooled(estimates(rows.withColumn("source", F.lit("")), None, min(group_rows, language_rows))))
    found = estimates(rows, wider, group_rows).drop("target").join(small(wider), "lang")
    return durable(found.mapInPandas(_final, "lang string, source string, centre array<double>, inverse array<double>"))


def judged(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, *BASE, base_failed, kept, distance) for every row of docs (doc_id, text, lang, source).

    base_failed: fewer than 50 words, or over half of them in repeated runs. Others are judged by the estimate of their
    language and source, made of the rows that the base limits keep. Missing lang or source count as empty ones. distance is
    the squared Mahalanobis distance, null where the base failed. Repeated rows count and are returned as often as they
    stand; an empty table gives no rows; other columns are not read. A very long text is counted as a whole, alone in its
    task: about 25 bytes of memory for each of its own.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = durable(with_statistics(docs).withColumn("base_failed", failed))
    rows = durable(vectors(rows.where("not base_failed"), rows).select("doc_id", "lang", "source", *BASE, "base_failed", *X))
    found = group_estimates(rows.where("not base_failed").select("lang", "source", *X), group_rows)
    out = rows.join(small(found), ["lang", "source"], "left").withColumn("distance", F.when(~F.col("base_failed"), distance(F.col("centre"), F.col("inverse"))))
    return out.select("doc_id", *BASE, "base_failed", F.coalesce(~F.col("base_failed") & (F.col("distance") <= CUT), F.lit(False)).alias("kept"), "distance")
