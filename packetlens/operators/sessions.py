"""Sessions as a folded log of events, their listing, lifetime and retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a session may go from each status.
TRANSITIONS = {"pending": ("modified", "confirmed", "cancelled"), "modified": ("confirmed", "cancelled"), "confirmed": ("completed", "cancelled"), "completed": (), "cancelled": ()}
ACTIVE = ("pending", "modified", "confirmed")
STATUSES = ("pending", "modified", "confirmed", "completed", "cancelled")
EDITABLE = ("pending", "modified")
LIFETIME = "INTERVAL 24 HOURS"


def fold(log: DataFrame, key: str, at: str, status: Column) -> DataFrame:
    """One row a session from its log: the state that the last event leaves, counts, and expiry 24 hours after the last event.
    Partial aggregates, not a sort of each session, so a session with very many events costs no single task."""
    last = F.struct(F.col(at), F.col("event_id"))
    rows = log.withColumn("status", status)
    out = rows.groupBy(key).agg(F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.max_by("status", last).alias("status"), F.count("*").alias("n_events"), F.count_if(F.col("status") == "modified").alias("n_modifications"))
    return out.withColumn("expires_at", F.col("updated_at") + F.expr(LIFETIME))


def illegal(log: DataFrame, key: str, at: str, status: Column) -> DataFrame:
    """Steps of a session's log that TRANSITIONS does not have."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    rows = log.withColumn("status", status).withColumn("last", F.lag("status").over(w)).where("last is not null")
    allowed = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)).cast("array<string>"))))
    return rows.where(~F.array_contains(allowed[F.col("last")], F.col("status")))


def replayed(log: DataFrame, key: str, at: str, status: Column) -> DataFrame:
    """The state after a log whose illegal steps are refused: a fold in order, for logs that may break the rules. Rows stream
    through by key and time; a task holds one session's state, however long its log."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list = []  # key, status, refused
        for pdf in parts:
            done = []
            for k, to in zip(pdf["key"].tolist(), pdf["status"].tolist(), strict=True):
                if not now or k != now[0]:
                    done += [now] if now else []
                    now = [k, "pending", 0]
                if to in TRANSITIONS[now[1]]:
                    now[1] = to
                elif to != now[1]:
                    now[2] += 1
            if done:
                yield pd.DataFrame(done, columns=["key", "status", "refused"])
        if now:
            yield pd.DataFrame([now], columns=["key", "status", "refused"])

    rows = log.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), "event_id", status.alias("status"))
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "event_id").select("key", "status")
    return rows.mapInPandas(run, "key string, status string, refused int").select(F.col("key").cast(log.schema[key].dataType).alias(key), "status", "refused")


def active(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("status").isin(*ACTIVE) & (F.col("expires_at") > now))


def listed(sessions: DataFrame, status: str | None = None, order: str = "created_at", descending: bool = True, offset: int = 0, limit: int = 20, key: str = "session_id") -> DataFrame:
    rows = sessions.where(F.col("status") == status) if status else sessions
    return rows.orderBy(F.col(order).desc() if descending else F.col(order), key).offset(offset).limit(limit)


def statistics(sessions: DataFrame) -> DataFrame:
    """Counts of every status, zero where there is none, and the range of creation."""
    return sessions.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"))


def kept(sessions: DataFrame, now: Column) -> DataFrame:
    """What a clean-up leaves: neither expired, nor completed or cancelled."""
    return sessions.where((F.col("expires_at") >= now) & ~F.col("status").isin("completed", "cancelled"))


def extended(sessions: DataFrame, now: Column, hours: int = 24, never_shorter: bool = True) -> DataFrame:
    later = now + F.expr(f"INTERVAL {int(hours)} HOURS")
    return sessions.withColumn("expires_at", F.greatest("expires_at", later) if never_shorter else later)


def upserted(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key, for a table without MERGE."""
    rows = old.unionByName(new)
    return rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in old.columns)), at).alias("r")).select("r.*")


def retained(rows: DataFrame, at: str, now: Column, interval: str) -> DataFrame:
    return rows.where(F.col(at) >= now - F.expr(f"INTERVAL {interval}"))


def read(sessions: DataFrame, ids: DataFrame, now: Column, key: str = "session_id") -> DataFrame:
    """Each asked id with its session and an outcome: found, expired or missing."""
    outcome = F.when(F.col("expires_at").isNull(), "missing").when(F.col("expires_at") < now, "expired").otherwise("found")
    return ids.join(sessions, key, "left").withColumn("outcome", outcome)
