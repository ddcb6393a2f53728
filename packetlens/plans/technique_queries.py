"""A grid of runs over the techniques: embeddings as small pages, the truth a change of label."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.operators import boundaries as B
from packetlens.operators import techniques as Q

from .registry import query
from .text_queries import F1, R6, SCORES, vectors

RUNS = {"histogram": [0.5, 0.6, 0.7, 0.8], "ssim": [-0.2, 0.0, 0.1, 0.7], "phash": [5, 10, 24, 28, 32, 36], "embeddings": None, "combined": [0.4, 0.5, 0.6]}


def pairs(spark, sf_dir):
    w = B.in_order()
    v = vectors(spark, sf_dir)
    v = v.select("packet_id", "page_no", "embedding", F.lead("embedding").over(w).alias("next"), (F.lead("label").over(w) != F.col("label")).alias("truth"))
    return Q.scored(v.where("next is not null"), "embedding", "next", list(RUNS))


def grid(spark, sf_dir):
    return Q.grid(pairs(spark, sf_dir), "truth", RUNS)


_HIST = "list_transform(range(16), lambda k: len(list_filter(list_transform({}, lambda x: least(greatest(CAST(floor((x + 1) / 0.125) AS INTEGER), 0), 15)), lambda q: q = k)))"
_SUM = "list_sum(list_transform(list_zip({}, {}), lambda z: {}))"
_DOT = lambda a, b: _SUM.format(a, b, "z[1] * z[2]")
SCORED = f"""v AS (SELECT embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER w AS b, lead(label) OVER w <> label AS truth FROM embeddings WINDOW w AS (PARTITION BY vec_id // 100 ORDER BY vec_id)),
w AS (SELECT *, len(a) AS n, {_DOT('a', 'a')} AS aa, {_DOT('b', 'b')} AS bb, {_DOT('a', 'b')} AS ab, list_sum(a) / len(a) AS ma, list_sum(b) / len(b) AS mb FROM v WHERE b IS NOT NULL),
x AS (SELECT truth, list_sum(list_transform(list_zip({_HIST.format('a')}, {_HIST.format('b')}), lambda z: least(z[1], z[2]))) / n::DOUBLE AS histogram,
  (2 * ma * mb + 0.0004) * (2 * (ab / n - ma * mb) + 0.0036) / ((ma * ma + mb * mb + 0.0004) * (aa / n - ma * ma + bb / n - mb * mb + 0.0036)) AS ssim,
  len(list_filter(list_zip(a, b), lambda z: (z[1] > 0) <> (z[2] > 0)))::DOUBLE AS phash, n,
  CASE WHEN sqrt(aa) * sqrt(bb) = 0 THEN NULL ELSE greatest(0.0, least(1.0, ab / (sqrt(aa) * sqrt(bb)))) END AS embeddings FROM w),
y AS (SELECT *, 0.5 * (1 - phash / n) + 0.25 * histogram + 0.25 * coalesce(embeddings, histogram) AS combined FROM x),
r AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {float(t)}::DOUBLE)" for n, own in RUNS.items() for t in (own or [0.5]))}) q(technique, threshold)),
s AS (SELECT technique, threshold, truth, coalesce(CASE technique {' '.join(f"WHEN '{n}' THEN {n} {'>' if n == 'phash' else '<'} threshold" for n in RUNS)} END, false) AS hit FROM y, r WHERE truth IS NOT NULL),
c AS (SELECT technique, threshold, count(*) FILTER (hit AND truth) AS tp, count(*) FILTER (hit AND NOT truth) AS fp, count(*) FILTER (NOT hit AND NOT truth) AS tn, count(*) FILTER (NOT hit AND truth) AS fn FROM s GROUP BY technique, threshold),
m AS (SELECT *, {SCORES} FROM c), f AS (SELECT *, {F1} AS f1 FROM m)"""


@query(f"WITH {SCORED} SELECT technique, threshold, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM f")
def technique_grid(spark, sf_dir):
    """All runs of all techniques from one scan."""
    return grid(spark, sf_dir).select("technique", "threshold", "tp", "fp", "tn", "fn", *map(R6, ("precision", "recall", "accuracy", "f1")))


@query(f"WITH {SCORED}, b AS (SELECT technique, count(*) AS runs, arg_max((threshold, f1), (round(f1, 9), -threshold)) AS b FROM f GROUP BY technique) SELECT technique, runs, b[1] AS threshold, round(b[2], 6) AS f1, CAST(row_number() OVER (ORDER BY round(b[2], 9) DESC, technique) AS INTEGER) AS place FROM b")
def technique_ranking(spark, sf_dir):
    """The techniques' best runs, the best first."""
    return Q.ranking(grid(spark, sf_dir)).select("technique", "runs", "threshold", R6("f1"), "place")
