"""Structured Streaming: deduplicated ingest, per-key state, what is new since a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, directory: str, pattern: str = "events.parquet*") -> DataFrame:
    """A file stream of events; the schema is the files' own."""
    schema = spark.read.parquet(f"{directory}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 16).parquet(directory).withColumn("ts", F.col("ts").cast("timestamp"))


def dedup_ingest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, however late; the keys seen are the state, kept with the checkpoint."""
    return stream.dropDuplicates(keys)


def run_states(states: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drains a streaming aggregation; each micro-batch writes the whole state anew, and the last one is read."""
    last = []

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        last.append(batch)

    q = states.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return states.sparkSession.read.parquet(f"{path}/batch={last[-1]}")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drains all input that is there into Parquet, exactly once."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def next_offset(log: DataFrame, column: str) -> DataFrame:
    """One past the largest id."""
    return log.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next_offset"))


def new_since(log: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Rows whose key the baseline lacks. (Without any baseline: operators.store.new_ids.)"""
    return log.join(baseline.select(key).distinct(), key, "left_anti")
