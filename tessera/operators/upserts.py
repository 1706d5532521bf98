"""Mutations on immutable tables: joins and folds over arrivals. Each returns the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """New rows of keys that old lacks, the first of each, after old's."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's row replaces old's of the same key."""
    both = old.withColumn("_p", F.lit(1)).unionByName(new.withColumn("_p", F.lit(0)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_p"))).where("_r = 1").drop("_p", "_r")


def coalesced_queue(log: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """One entry for each key: the last reason, when it was queued, how often."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(F.col(at), F.col("event_id"))).alias("reason"), F.max(at).alias("queued_at"), F.count(F.lit(1)).alias("requests"))


def dequeued(queue: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Entries whose key and generation weren't done; a newer generation stays."""
    return queue.join(done.select(*keys), keys, "left_anti")


def last_state(log: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """The last state of each key and the number of changes."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("changes"))


def patched(rows: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """M22, slug path: edits(key, suppress, columns): suppressed rows go, then non-NULL edits apply."""
    e = edits.select(F.col(key), F.col("suppress"), *(F.col(c).alias(f"e_{c}") for c in columns))
    got = rows.join(e, key, "left").where(~F.coalesce("suppress", F.lit(False)))
    return got.select(*(F.coalesce(F.col(f"e_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))
