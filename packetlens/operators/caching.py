"""What a cache of any size would have made of an access log: reuse distances, and hits, misses and evictions under LRU, a memory budget,
a limit of items and a time to live.

An LRU cache holds the entries used last that fit it, so an access is a hit if what was used since the key's last access, each key once
and this one included, fits. That reuse distance does not depend on the budget: one pass answers all budgets. It is the weight of all
accesses since the last one, less that of accesses whose own last access is later still. Those are counted in ranges of time: among
accesses with their last access in the same range, among accesses in the same range, and, for all other ranges, from sums by pair of
ranges. A task holds one range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.runtime import durable

from .scans import running, with_last

#: Accesses of a range at least; there are at most as many ranges as accesses of a range.
RANGE_ROWS = 50_000


@dataclass(frozen=True)
class Budget:
    """A cache's limits; None is no limit. memory is in the unit of an entry's size, seconds is an entry's time to live since it was made."""

    name: str
    memory: int | None = None
    items: int | None = None
    seconds: float | None = None


def later_above(key: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row the weights of the rows before it whose key is greater; weights: a column for each kind. By merging: at each level
    rows of a right half look up their place among the sorted keys of the left half."""
    n = len(key)
    out = np.zeros_like(weights)
    ranks = np.unique(key, return_inverse=True)[1].astype(np.int64)
    at, width = np.arange(n), 1
    while width < n:
        pair, left = at // (2 * width), at // width % 2 == 0
        composed = pair * n + ranks
        order = np.flatnonzero(left)
        order = order[np.argsort(composed[order], kind="stable")]
        before = np.concatenate([np.zeros((1, weights.shape[1]), weights.dtype), np.cumsum(weights[order], axis=0)])
        right = np.flatnonzero(~left)
        low = np.searchsorted(composed[order], composed[right], side="right")
        high = np.searchsorted(composed[order], (pair[right] + 1) * n, side="left")
        out[right] += before[high] - before[low]
        width *= 2
    return out


def _in_range(rows: DataFrame, by: str, key: str, names: Sequence[str]) -> DataFrame:
    """`later_above` among the rows of one range `by`, in order of `at`."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        found = later_above(pdf[key].to_numpy(), pdf[["size", "one"]].to_numpy(np.int64))
        return pdf[["at"]].assign(**{n: found[:, i] for i, n in enumerate(names)})

    return rows.select("at", "size", "one", key, F.col(by).alias("__by")).groupBy("__by").applyInPandas(each, f"at long, {', '.join(f'{n} long' for n in names)}")


def _earlier_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """(range, last_range, more_size, more_items): what accesses in earlier ranges with their last access in a later range weigh. Windows hold
    one row for each range."""
    cells = rows.groupBy("range", "last_range").agg(F.sum("size").alias("size"), F.count("*").alias("items"))
    every = rows.sparkSession.range(ranges)
    grid = every.select(F.col("id").alias("range"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))).alias("last_range"))
    grid = grid.join(cells, ["range", "last_range"], "left").na.fill(0, ["size", "items"])
    down = Window.partitionBy("last_range").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("range").orderBy(F.desc("last_range")).rowsBetween(Window.unboundedPreceding, -1)
    for w in (down, later):
        grid = grid.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("size", "items")})
    return grid.select("range", "last_range", F.col("size").alias("more_size"), F.col("items").alias("more_items"))


def reuse_distances(log: DataFrame, key: str, size: Column, order: Sequence[Column | str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The log with at (from 1, in the order, which must leave no ties), size, last (the key's access before, or null), distance and items:
    the size and number of entries used since then, this one included; null at a key's first access. An entry's size must not
    change. A key that has very many accesses is cut like all others."""
    rows = running(log.withColumn("size", size.cast("long")), None, order, "at", {"upto": "size"})
    rows = with_last(rows, key, ["at"], {"last": "at", "upto_last": "upto"})
    n = log.count()
    span = max(range_rows, math.isqrt(max(n - 1, 0)) + 1)
    rows = durable(rows.withColumns({"one": F.lit(1).cast("long"), "range": F.floor((F.col("at") - 1) / span).cast("long"), "last_range": F.floor((F.col("last") - 1) / span).cast("long")}))
    again = rows.where("last is not null")
    # Of the accesses before this one, those whose last access came after this one's: in the same range as this one's last, or in a later one.
    near = _in_range(again, "last_range", "last", ["near_size", "near_items"])
    own = _in_range(again, "range", "last_range", ["own_size", "own_items"])
    found = rows.join(near, "at", "left").join(own, "at", "left").join(_earlier_ranges(again, max(1, -(-n // span))), ["range", "last_range"], "left")
    twice = {k: sum((F.col(f"{p}_{k}") for p in ("near", "own", "more")), F.lit(0)) for k in ("size", "items")}
    distance = F.when(F.col("last").isNotNull(), F.col("upto") - F.col("upto_last") - twice["size"])
    items = F.when(F.col("last").isNotNull(), F.col("at") - F.col("last") - twice["items"])
    return found.select(*log.columns, "at", "size", "last", distance.alias("distance"), items.alias("items"))


def _fits(b: Budget) -> Column:
    """Was the entry still there? One that is larger than the budget stays until another one comes."""
    memory = F.lit(True) if b.memory is None else (F.col("distance") <= b.memory) | (F.col("items") == 1)
    items = F.lit(True) if b.items is None else (F.col("items") <= b.items) | (F.col("items") == 1)
    return F.coalesce(F.col("items").isNotNull() & memory & items, F.lit(False))


def outcomes(log: DataFrame, key: str, size: Column, at: str, order: Sequence[Column | str], budgets: Sequence[Budget], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The log with distances and, for each budget, what the access is: `hit`, `miss` (the entry is not there) or `expired` (it is there, but
    made too long ago; it is made anew). at: a timestamp. Accesses of a key stream through one task in order; of each budget it holds
    the time when the entry was made."""
    rows = reuse_distances(log, key, size, order, range_rows)
    rows = rows.withColumns({f"__fits{i}": _fits(b) for i, b in enumerate(budgets)}).withColumn("__t", F.unix_micros(F.col(at).cast("timestamp")))
    schema = ", ".join(["at long", *(f"o{i} string" for i in range(len(budgets)))])

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [0.0] * len(budgets)
        for pdf in parts:
            out = {"at": pdf["at"].to_numpy()}
            for i, b in enumerate(budgets):
                said = []
                for t, fits in zip(pdf["t"].to_numpy() / 1e6, pdf[f"f{i}"].to_numpy(), strict=True):
                    old = fits and b.seconds is not None and t - made[i] > b.seconds
                    said.append("miss" if not fits else "expired" if old else "hit")
                    if said[-1] != "hit":
                        made[i] = t
                out[f"o{i}"] = said
            yield pd.DataFrame(out)

    keyed = rows.select(F.col(key).alias("k"), "at", F.col("__t").alias("t"), *(F.col(f"__fits{i}").alias(f"f{i}") for i in range(len(budgets))))
    told = keyed.repartition("k").sortWithinPartitions("k", "at").mapInPandas(fold, schema)
    rows = rows.drop("__t", *(f"__fits{i}" for i in range(len(budgets)))).join(told, "at")
    return rows.withColumnsRenamed({f"o{i}": b.name for i, b in enumerate(budgets)})


def totals(log: DataFrame, key: str, size: Column, at: str, order: Sequence[Column | str], budgets: Sequence[Budget], range_rows: int = RANGE_ROWS) -> DataFrame:
    """(budget, hits, misses, expired, evictions, hit_rate, saved, held, held_size): saved is the size of what hits brought; evictions are
    the entries that had to go and the expired ones; held is what is there at the end. An expired entry counts as a miss too."""
    rows = durable(outcomes(log, key, size, at, order, budgets, range_rows))
    # What was used last, with all that was used after it: what is there at the end.
    ends = rows.groupBy(key).agg(F.max("at").alias("at"), F.max("size").alias("size"))
    ends = running(ends, None, [F.desc("at")], "items", {"distance": "size"})
    kept = [ends.where(_fits(b)).agg(F.lit(b.name).alias("budget"), F.count("*").alias("held"), F.coalesce(F.sum("size"), F.lit(0)).alias("held_size")) for b in budgets]
    each = [(F.count_if(F.col(b.name) == k)).alias(f"{b.name}_{k}") for b in budgets for k in ("hit", "miss", "expired")]
    brought = [F.coalesce(F.sum(F.when(F.col(b.name) == "hit", F.col("size"))), F.lit(0)).alias(f"{b.name}_saved") for b in budgets]
    whole = rows.agg(*each, *brought)
    lines = F.array(*(F.struct(F.lit(b.name).alias("budget"), *(F.col(f"{b.name}_{k}").alias(k) for k in ("hit", "miss", "expired", "saved"))) for b in budgets))
    lines = whole.select(F.explode(lines).alias("x")).select("x.*").join(reduce(DataFrame.unionByName, kept), "budget")
    misses = F.col("miss") + F.col("expired")
    rate = F.when(F.col("hit") + misses > 0, F.col("hit") / (F.col("hit") + misses)).otherwise(0.0)
    return lines.select("budget", F.col("hit").alias("hits"), misses.alias("misses"), "expired", (F.col("miss") - F.col("held") + F.col("expired")).alias("evictions"), rate.alias("hit_rate"), "saved", "held", "held_size")
