"""Running sums, counts, maxima and hash products along an order, for tables and groups of any size.

One range shuffle deals the rows by group and order, so that a group with very many rows is cut as well. A task scans its range
with a few numbers in memory; the scanned rows are written once, and of each range its first and last row come to the driver,
which composes what comes before a range's first group.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens.runtime import durable, releasing

#: Rows of a side that is broadcast; a larger one is joined by a shuffle.
SMALL_ROWS = 100_000


@dataclass(frozen=True)
class Product:
    """A hash product of a column of numbers from 0: a run of n numbers e is the pair n and sum of e[i] * base**i, i from 0, modulo a
    prime below 2**31; pairs (n, v) and (m, w) compose to (n + m, v + base**n * w)."""

    column: str
    base: int
    prime: int


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo the prime."""
    out, factor, left = np.ones(len(exponents), np.int64), base % prime, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * factor % prime, out)
        factor, left = factor * factor % prime, left >> 1
    return out


def _begins(keys: list[pa.Array], last: list[pa.Array] | None, n: int) -> np.ndarray:
    """Does a row begin a group? last: the keys of the row before, if there is one."""
    out = np.zeros(n, bool)
    out[0] = last is None
    for i, key in enumerate(keys):
        before = pa.concat_arrays([key.slice(0, 1) if last is None else last[i], key.slice(0, n - 1)])
        differs = pc.or_(pc.fill_null(pc.not_equal(key, before), False), pc.not_equal(pc.is_null(key), pc.is_null(before)))
        out |= differs.to_numpy(zero_copy_only=False)
    return out


class _Scan:
    """The open group of a task, and the columns that a batch gets."""

    def __init__(self, sums: Sequence[str], maxima: Sequence[str], products: Sequence[Product]):
        self.sums, self.maxima, self.products = sums, maxima, products
        self.n, self.totals, self.last, self.is_first = 0, [0] * len(sums) + [-np.inf] * len(maxima) + [0] * len(products), None, True

    def columns(self, batch: pa.RecordBatch, by: list[str]) -> list[np.ndarray]:
        """first group?, count, then of each sum, maximum and product the value up to the row, of each product also that before it."""
        rows = batch.num_rows
        keys = [batch.column(batch.schema.get_field_index(c)) for c in by]
        begins = _begins(keys, self.last, rows)
        self.last = [key.slice(rows - 1, 1) for key in keys]
        later = begins.copy()
        if self.n == 0:  # the first row of the range
            later[0] = False
        first = np.logical_and(self.is_first, np.cumsum(later) == 0)
        self.is_first = bool(first[-1])
        at = np.maximum.accumulate(np.where(begins, np.arange(rows), -1))
        opened = at >= 0
        count = np.arange(rows) + 1 - np.where(opened, at, -self.n)

        def since(values: np.ndarray, total: int) -> np.ndarray:
            sums = np.cumsum(values)
            return sums - np.where(opened, sums[at] - values[at], -total)

        out, ended = [first, count], []
        for name, total in zip(self.sums, self.totals, strict=False):
            out.append(since(pc.fill_null(batch.column(batch.schema.get_field_index(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64), total))
            ended.append(int(out[-1][-1]))
        for name, total in zip(self.maxima, self.totals[len(self.sums) :], strict=False):
            value = pc.fill_null(batch.column(batch.schema.get_field_index(name)), -np.inf).to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(begins), rows).tolist()
            value = value.copy()
            value[: cuts[0]] = np.maximum(np.maximum.accumulate(value[: cuts[0]]), total)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                np.maximum.accumulate(value[a:b], out=value[a:b])
            out.append(value)
            ended.append(float(value[-1]))
        for p, total in zip(self.products, self.totals[len(self.sums) + len(self.maxima) :], strict=True):
            value = batch.column(batch.schema.get_field_index(p.column)).to_numpy(zero_copy_only=False).astype(np.int64)
            term = value % p.prime * powers(p.base, count - 1, p.prime) % p.prime
            now = since(term, total) % p.prime
            out += [now, (now - term) % p.prime]
            ended.append(int(now[-1]))
        self.n, self.totals = int(count[-1]), ended
        return out


def running(rows: DataFrame, by: str | Sequence[str] | None, order: Sequence[Column | str], count: str = "n", sums: dict[str, str] | None = None, products: dict[str, Product] | None = None, maxima: dict[str, str] | None = None, parts: int | None = None, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """`rows` with the count (from 1), sums, maxima and products of each row's group `by` up to and with that row.

    by: a column or several, in which nulls are values; None: all rows are one group. sums: new name to long column (null: 0). maxima: new
    name to double column (null: least). parts: the number of ranges, if it is known how many there should be. keep: how the scanned rows are written. products: new name to Product; `<name>_before` is the product without the row. Rows that the order leaves equal stand in any order. The
    driver gets two rows for each range, of numbers and keys alone.
    """
    sums, products, maxima = sums or {}, products or {}, maxima or {}
    by = [by] if isinstance(by, str) else list(by or ())
    names = [*sums, *maxima, *(x for p in products for x in (p, f"{p}_before"))]
    made = ["__first", count, *names]
    if clash := {c.lower() for c in rows.columns} & {c.lower() for c in made}:
        raise ValueError(f"columns that are there already: {', '.join(sorted(clash))}")
    schema = T.StructType([*rows.schema.fields, T.StructField("__first", T.BooleanType()), T.StructField(count, T.LongType()), *(T.StructField(x, T.DoubleType() if x in maxima else T.LongType()) for x in names), T.StructField("__part", T.IntegerType()), T.StructField("__edge", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held, began = _Scan(list(sums.values()), list(maxima.values()), list(products.values())), None, False
        part = TaskContext.get().partitionId()

        def finished(batch: pa.RecordBatch, columns: list[np.ndarray], edge: np.ndarray) -> pa.RecordBatch:
            arrays = [*batch.columns, *map(pa.array, columns), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(edge)]
            return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *made, "__part", "__edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield finished(*held)
            edge = np.zeros(batch.num_rows, np.int32)
            edge[0] += not began
            began, held = True, (batch, scan.columns(batch, by), edge)
        if held is not None:
            held[2][-1] += 2  # the last row of the range
            yield finished(*held)

    keys = [*map(F.col, by), *order]
    found = keep((rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys).mapInArrow(releasing(run), schema))
    kept = [f"__{x}" for x in (count, *sums, *maxima, *products)]
    edges = found.where("__edge > 0").select("__part", "__edge", "__first", F.array(*(F.col(c).cast("string") for c in by)).alias("__by"), *(F.col(x).alias(f"__{x}") for x in (count, *sums, *maxima, *products))).collect()
    before = _before(edges, len(sums), len(maxima), list(products.values()), kept)
    fields = ["__part int", *(f"{x} {'double' if x[2:] in maxima else 'long'}" for x in kept), *(f"__{x}_scale long" for x in products)]
    joined = found.join(F.broadcast(rows.sparkSession.createDataFrame(before, ", ".join(fields))), "__part", "left")
    added = F.col("__first") & F.col(kept[0]).isNotNull()
    out = [F.when(added, F.col(x) + F.col(f"__{x}")).otherwise(F.col(x)).alias(x) for x in (count, *sums)]
    out += [F.greatest(F.col(x), F.when(added, F.col(f"__{x}"))).alias(x) for x in maxima]
    for x, p in products.items():
        out += [F.when(added, (F.col(f"__{x}") + F.col(f"__{x}_scale") * F.col(c)) % p.prime).otherwise(F.col(c)).alias(c) for c in (x, f"{x}_before")]
    return joined.select(*rows.columns, *out)


def _before(edges: list, n_sums: int, n_maxima: int, products: list[Product], kept: list[str]) -> list[tuple]:
    """A row for each range whose first group began in an earlier one: the range, what that group had so far, and each product's
    factor for what follows."""
    out: list[tuple] = []
    open_key, so_far = None, None
    firsts = {r["__part"]: r for r in edges if r["__edge"] & 1}
    for last in sorted((r for r in edges if r["__edge"] & 2), key=lambda r: r["__part"]):
        first = firsts[last["__part"]]
        carried = so_far if so_far is not None and first["__by"] == open_key else None
        own = [last[x] for x in kept]
        if carried is not None:
            scales = [pow(p.base, carried[0], p.prime) for p in products]
            out.append((last["__part"], *carried, *scales))
            if last["__first"]:
                sums, maxima = 1 + n_sums, 1 + n_sums + n_maxima
                pairs = list(zip(carried, own, strict=True))
                own = [a + b for a, b in pairs[:sums]] + [max(x) for x in pairs[sums:maxima]] + [(a + s * b) % p.prime for (a, b), s, p in zip(pairs[maxima:], scales, products, strict=True)]
        open_key, so_far = last["__by"], own
    return out


#: Numbers of a group whose rows a task sorts together; with the row beside them they are few enough for a window to keep them in a plain array.
BLOCK = 4000


def with_neighbour(rows: DataFrame, by: str, place: str, columns: dict[str, str], step: int = -1, block: int = BLOCK, parts: int | None = None, following: tuple[str, str, int] | None = None) -> DataFrame:
    """`rows` with columns (new: old) of the row before (step -1) or after (1) in the group, and `has_neighbour`: whether there is one. place: long
    numbers of a group's rows, without gaps or repeats. Rows meet in blocks of numbers, to which the row beside the block is copied, so
    that a group of any size is dealt out in one exchange. parts: the number of its partitions, if it is known how many there should be. following: (new, old, n),
    an array of the column for the row and the n - 1 with the next larger numbers, null where there are none; n is at most a block."""
    of = lambda shift: F.floor((F.col(place) - shift) / block)
    new, old, n = following or ("", "", 1)
    # A row is used by those of its own block and, at the block's edges, by rows beside it.
    shifts = list(dict.fromkeys((0, step, n - 1)))
    at = [F.struct(of(shift).alias("block"), F.lit(shift == 0).alias("own")) for shift in shifts]
    inside = functools.reduce(lambda a, b: a & b, (of(shift) == of(0) for shift in shifts[1:]))
    copies = F.when(inside, F.array(at[0])).otherwise(F.array(*at) if len(at) == 2 else F.array_distinct(F.filter(F.array(*at), lambda x: x["own"] | (x["block"] != of(0)))))
    dealt = rows.withColumn("__c", F.explode(copies)).select(*rows.columns, "__c.block", "__c.own").withColumnsRenamed({"block": "__block", "own": "__own"})
    dealt = dealt.repartition(parts, by, "__block") if parts else dealt
    w = Window.partitionBy(by, "__block").orderBy(F.col(place) if step < 0 else F.col(place).desc())
    run = {new: F.array(*(F.col(old) if k == 0 else (F.lead if step < 0 else F.lag)(old, k).over(w) for k in range(n)))} if following else {}
    found = dealt.withColumns({**{name: F.lag(c).over(w) for name, c in columns.items()}, "has_neighbour": F.row_number().over(w) > 1, **run})
    return found.where("__own").drop("__block", "__own")


def with_last(rows: DataFrame, by: str, order: Sequence[Column | str], columns: dict[str, str], count: str = "nth") -> DataFrame:
    """`rows` with their count in their group, and of the row before it in the group each column under a new name (new: old); null for
    the first. Rows meet under group and count, so that a group of very many rows is dealt out."""
    rows = durable(running(rows, by, order, count))
    before = rows.select(F.col(by).alias("__by"), (F.col(count) + 1).alias("__count"), *(F.col(old).alias(new) for new, old in columns.items()))
    return rows.join(before, rows[by].eqNullSafe(before["__by"]) & (rows[count] == before["__count"]), "left").drop("__by", "__count")


def looked_up(rows: DataFrame, table: DataFrame, key: str, small: bool | None = None) -> DataFrame:
    """Rows with the columns of the one row of `table` that has the same key, null being a value. A table of at most SMALL_ROWS rows,
    which are counted, is broadcast; a larger one is joined by a shuffle, in which adaptive execution cuts a frequent key."""
    small = len(table.select(F.lit(1)).limit(SMALL_ROWS + 1).collect()) <= SMALL_ROWS if small is None else small
    other = table.withColumnRenamed(key, "__key")
    return rows.join(F.broadcast(other) if small else other, rows[key].eqNullSafe(other["__key"])).drop("__key")
