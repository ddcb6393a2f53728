"""Alert rules over counters: rates at evaluation times, and the intervals in which a rule is pending or fires.

A counter only grows, but for resets, after which it starts from zero. Samples are summed up by evaluation step before they are
dealt out to the windows that hold them, and running sums are cut by ranges of time, so a series of any length is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import running, with_last

SECOND = 1_000_000


def counter_rates(samples: DataFrame, key: str, at: str, value: str, width: int, step: int) -> DataFrame:
    """(key, at, n, rate): at each multiple of `step` seconds, the growth a second of a series in the `width` seconds up to it, carried on to
    the window's ends as Prometheus does: to an end that is further from the samples than 1.1 times their mean distance by half of
    that, and never to before where the counter would have been zero. Windows with fewer than two samples give no row. width must be a multiple of
    step; samples of one time are one, with the greatest value."""
    if width % step:
        raise ValueError("width must be a multiple of step")
    rows = samples.groupBy(key, F.unix_micros(F.col(at).cast("timestamp")).alias("t")).agg(F.max(value).cast("double").alias("v"))
    rows = with_last(rows, key, ["t"], {"before": "v", "t_before": "t"})
    grown = F.when(F.col("before").isNull(), 0.0).when(F.col("v") >= F.col("before"), F.col("v") - F.col("before")).otherwise(F.col("v"))
    rows = rows.withColumns({"grown": grown, "step": F.ceil(F.col("t") / (step * SECOND)).cast("long")})
    # What a step's samples grew by, but for the first one, which counts if an earlier one is in the window too.
    first = F.min(F.struct("t", "v", "grown"))
    steps = rows.groupBy(key, "step").agg(F.count("*").alias("n"), first.alias("first"), F.max("t").alias("last"), F.sum("grown").alias("grown"))
    steps = steps.withColumn("at", F.explode(F.sequence(F.col("step"), F.col("step") + (width // step - 1))))
    seen = steps.groupBy(key, "at").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("grown").alias("grown")).where("n > 1")
    span, mean = (F.col("last") - F.col("first.t")) / SECOND, F.col("span") / (F.col("n") - 1)
    seen = seen.withColumns({"grown": F.col("grown") - F.col("first.grown"), "span": span, "to_start": (F.col("first.t") / SECOND) - (F.col("at") * step - width), "to_end": F.col("at") * step - F.col("last") / SECOND})
    seen = seen.withColumns({c: F.when(F.col(c) >= mean * 1.1, mean / 2).otherwise(F.col(c)) for c in ("to_start", "to_end")})
    zero = F.when((F.col("grown") > 0) & (F.col("first.v") >= 0), F.col("span") * (F.col("first.v") / F.col("grown")))
    rate = F.col("grown") * ((F.col("span") + F.least("to_start", zero) + F.col("to_end")) / F.col("span")) / width
    return seen.select(key, F.timestamp_seconds(F.col("at") * step).alias("at"), "n", rate.alias("rate"))


def alert_intervals(rates: DataFrame, key: str, breach: Column, hold: int, step: int, value: str = "rate") -> DataFrame:
    """(key, started, firing_from, ended, evaluations, peak) of each run of evaluations, `step` seconds apart, at which a series breaches:
    it is pending from the first one and fires from the one `hold` seconds later, if the run lasts so long; ended is the first
    evaluation after it. An evaluation without a value ends a run."""
    rows = rates.where(breach).withColumn("__no", F.floor(F.unix_timestamp(F.col("at")) / step).cast("long"))
    rows = running(rows, key, ["__no"], "__nth").withColumn("__run", F.col("__no") - F.col("__nth"))
    runs = rows.groupBy(key, "__run").agg(F.min("__no").alias("a"), F.max("__no").alias("b"), F.count("*").alias("evaluations"), F.max(value).alias("peak"))
    when = lambda c: F.timestamp_seconds(c * step)
    held = -(-hold // step)
    return runs.select(key, when(F.col("a")).alias("started"), F.when(F.col("b") - F.col("a") >= held, when(F.col("a") + held)).alias("firing_from"), when(F.col("b") + 1).alias("ended"), "evaluations", "peak")
