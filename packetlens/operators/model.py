"""The model-backed detector: prompts, answers, and the cache of answers as a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from packetlens.config import ModelConfig
from packetlens.functions import text as T

from .ranking import with_rank

PROMPT = "Do these two pages belong to one document?\n\nEnd of the first page:\n{page1_bottom}\n\nStart of the second page:\n{page2_top}\n\nThink in <thinking> tags, then say SAME or DIFFERENT in <answer> tags."


def ends(text: Column, n: int, bottom: bool) -> Column:
    rows = F.split(T.strip(text), "\n", -1)
    return T.tail(rows, n) if bottom else T.head(rows, n)


def prompt(first: Column, second: Column, settings: ModelConfig | None = None) -> Column:
    s = settings or ModelConfig()
    return F.replace(F.replace(F.lit(PROMPT), F.lit("{page1_bottom}"), ends(first, s.bottom_lines, True)), F.lit("{page2_top}"), ends(second, s.top_lines, False))


def parsed(response: Column, settings: ModelConfig | None = None) -> dict[str, Column]:
    """is_boundary, confidence and reasoning of an answer. Without a valid answer tag the words decide, at 0.7."""
    s = settings or ModelConfig()
    thinking = T.strip(F.regexp_extract(response, r"(?is)<thinking>(.*?)</thinking>", 1))
    tagged, upper = response.rlike(r"(?is)<answer>.*?</answer>"), F.upper(response)
    answer = F.upper(T.strip(F.regexp_extract(response, r"(?is)<answer>(.*?)</answer>", 1)))
    different, same, none = F.contains(upper, F.lit("DIFFERENT")), F.contains(upper, F.lit("SAME")), response.isNull() | (response == "")
    boundary = F.when(none, False).when(tagged, answer == "DIFFERENT").otherwise(different)
    level = lambda high, medium, low: F.when(F.length(thinking) > 20, high).when(thinking != "", medium).otherwise(low)
    sure = F.when(answer == "DIFFERENT", level(s.boundary_high, s.boundary_medium, s.boundary_medium)).when(answer == "SAME", level(s.same_high, s.same_medium, s.same_low)).otherwise(0.5)
    confidence = F.when(none, 0.0).when(tagged, sure).when(different | same, 0.7).otherwise(0.0)
    other = F.when(tagged, F.when(answer.isin("SAME", "DIFFERENT"), "No reasoning provided").otherwise("Uncertain response")).when(different | same, "Inferred from response").otherwise("Invalid response format")
    reasoning = F.when(none, "No response from LLM").when(~tagged & ~different & ~same, "Invalid response format").when(thinking != "", thinking).otherwise(other)
    return {"is_boundary": boundary, "confidence": confidence, "reasoning": reasoning}


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def cache_key(first: Column, second: Column, model: Column, version: Column) -> Column:
    return F.concat_ws(":", short_hash(first), short_hash(second), model, F.coalesce(version, F.lit("default")))


def looked_up(pairs: DataFrame, cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Pairs with their answer from entries younger than the days, null where there is none."""
    fresh = cache.where(F.col("created_at") > now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return pairs.join(fresh.select("key", "response", "created_at"), "key", "left")


def newest(cache: DataFrame, *keys: str) -> DataFrame:
    """The entry of each key that was used last."""
    return cache.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("accessed_at"), "key"))).where("__n = 1").drop("__n")


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Entries replaced by new ones of their key, with one more access."""
    counts = cache.select("key", F.col("access_count").alias("__old"))
    rows = new.join(counts, "key", "left").withColumn("access_count", F.coalesce("__old", F.lit(0)) + 1).select(*cache.columns)
    return cache.join(new.select("key"), "key", "left_anti").unionByName(rows)


def cache_statistics(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("accesses"), F.count_if("is_boundary").alias("boundaries"))


def trimmed(cache: DataFrame, keep: float = 0.7) -> DataFrame:
    """The share of entries used last."""
    ranked = with_rank(cache, [F.desc("accessed_at"), "key"], name="__rank")
    return ranked.where(F.col("__rank") <= int(cache.count() * keep)).drop("__rank")


def answered(misses: DataFrame, ask: Callable[[str], str], retries: int = 3, wait: float = 0.0) -> DataFrame:
    """Adds `response` to rows with a prompt by calling a model; an error, after the retries, becomes a row with error. Between
    tries, it waits for 1, 2, 4 .. times `wait` seconds."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out, errors = [], []
            for p in pdf["prompt"]:
                answer, error = None, None
                for k in range(retries):
                    try:
                        answer, error = ask(p), None
                        break
                    except Exception as e:  # noqa: BLE001 a model's own errors become rows
                        error = str(e)
                        if wait and k + 1 < retries:
                            time.sleep(wait * 2**k)
                out.append(answer)
                errors.append(error)
            yield pdf.assign(response=out, error=errors)

    schema = StructType([*misses.schema.fields, StructField("response", StringType()), StructField("error", StringType())])
    return misses.mapInPandas(run, schema)


def detect(pairs: DataFrame, cache: DataFrame, ask: Callable[[str], str], now: Column) -> DataFrame:
    """Answers from the cache, from the model for the others."""
    found = looked_up(pairs, cache, now).drop("created_at")
    known = found.where("response is not null").withColumn("error", F.lit(None).cast("string"))
    rows = known.unionByName(answered(found.where("response is null").drop("response"), ask))
    return rows.withColumns(parsed(F.col("response")))


def remembered(cache: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The cache with the answers of `detect` (key, response, confidence, is_boundary): each of a key that was answered without
    error, one of each key."""
    new = found.where("error is null and response is not null").groupBy("key").agg(F.max(F.struct("response", "confidence", "is_boundary")).alias("a")).select("key", "a.*")
    new = new.withColumns({"created_at": now, "accessed_at": now, "access_count": F.lit(0)})
    return put(cache, new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(cache.schema[c].dataType).alias(c) for c in cache.columns)))
