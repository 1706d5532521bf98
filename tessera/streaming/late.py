"""Late data: a stream of rows upserted into a table partitioned by date, and the dates to build anew.

Each micro-batch queues the dates that its rows change, adds files to those that only gain rows, and rewrites only those that lose one. The queue's part of a batch is written before
the table and kept when the batch is run again, so a crash between the two loses no date, and a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a date that one task writes, about.
FILE_ROWS = 500_000


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table, empty before the first batch."""
    return spark.read.schema(like.schema).parquet(path) if _exists(spark, path) else like.limit(0)


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))).where("_n = 1").drop("_n")


def _deal(rows: DataFrame, key: str, date: str) -> DataFrame:
    """rows of a stored table, a date in one part, or in several of about FILE_ROWS where it has more."""
    most = rows.groupBy(date).count().agg(F.max("count")).first()[0] or 0
    return rows.repartition(F.col(date), F.pmod(F.xxhash64(key), F.lit(most // FILE_ROWS + 1)))


def put(batch: DataFrame, number: int, base: str, key: str, order: list[str], date: str, content: list[str]) -> None:
    """One micro-batch. Rows of null date are refused. A row that is newer than its key's takes its place; a date is queued if a row came, left, or changed in one of content.

    A batch meets the table once, and what it changes is stored: rows that came (gain), and rows that the table loses. Dates that only gain get files more, those that lose a row are written whole,
    and rows that are there already change nothing. What a crash left half done is seen as such when the batch runs again.
    """
    spark, names = batch.sparkSession, batch.columns
    part, queue = f"{base}/staging/batch-{number}", f"{base}/queue/batch={number}"
    have = _table(spark, f"{base}/table", batch)
    fresh = newest(batch.where(F.col(date).isNotNull()), key, order)
    met = fresh.join(have.select(F.col(key).alias("_key"), F.struct(*names).alias("_old")), F.col(key) == F.col("_key"), "left")
    same = lambda cols: reduce(and_, (F.col(c).eqNullSafe(F.col("_old")[c]) for c in cols), F.lit(True))
    known, own = F.col("_key").isNotNull(), Window.partitionBy(key).orderBy(key)
    # a key has several old rows only where a crash left them
    wins = F.bool_and(~known | (F.struct(*order) >= F.struct(*(F.col("_old")[c].alias(c) for c in order)))).over(own)
    met = met.select(*names, F.when(known, F.col("_old")[date]).alias("_date"), (~known | ~same([*content, date])).alias("_queue"), (known & ~same(names)).alias("_lost"), wins.alias("_wins"), F.bool_or(known & same(names)).over(own).alias("_there"), F.row_number().over(own).alias("_n"))
    met = met.select(*names, "_date", "_queue", "_lost", "_wins", (~F.col("_there") & (F.col("_n") == 1)).alias("_gain"))
    met.where("_wins and (_lost or _gain)").drop("_wins").write.mode("overwrite").parquet(f"{part}-changes")
    changes = spark.read.parquet(f"{part}-changes")
    if not _exists(spark, f"{queue}/_SUCCESS"):
        dates = changes.where("_queue").select(F.explode(F.array_distinct(F.array_compact(F.array(F.col(date), F.col("_date"))))).alias("date")).distinct()
        dates.select("date", F.lit(number).cast("long").alias("queued_at")).write.mode("overwrite").parquet(queue)
    lost, gain = changes.where("_lost"), changes.where("_gain").select(*names)
    lost.select(F.col("_date").alias("_d")).distinct().write.mode("overwrite").parquet(f"{part}-dates")
    touched = spark.read.parquet(f"{part}-dates")
    at = F.col(date) == F.col("_d")
    _deal(gain.join(touched, at, "left_anti"), key, date).write.mode("append").partitionBy(date).parquet(f"{base}/table")
    if touched.isEmpty():
        return
    # what is read and written anew goes through a table of its own
    rest = have.join(touched, at, "left_semi").join(lost.select(key, F.col("_date").alias(date)), [key, date], "left_anti")
    rest.unionByName(gain.join(touched, at, "left_semi")).write.mode("overwrite").parquet(part)
    staged = spark.read.schema(batch.schema).parquet(part)
    _deal(staged, key, date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(f"{base}/table")
    # dates that lost their last row; a batch touches few
    for (gone,) in touched.join(staged.select(F.col(date).alias("_d")), "_d", "left_anti").collect():
        _delete(spark, f"{base}/table/{date}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(gone))}")


def run(stream: DataFrame, base: str, checkpoint: str, key: str, order: list[str], date: str, content: list[str]) -> DataFrame:
    """Drains what is there; the offset is committed with the batch. The table after it."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, n: put(b, n, base, key, order, date, content)).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/table")


def queued(spark: SparkSession, base: str) -> DataFrame:
    """date, queued_at (the last batch that queued it)."""
    return spark.read.parquet(f"{base}/queue").groupBy("date").agg(F.max("queued_at").alias("queued_at"))


def drain(table: DataFrame, base: str, date: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Builds the dates queued after their last build, and only them; build gives rows with the date from the table's rows. All built rows after it.

    A date is marked as built with the queue entry that was seen, so one that is queued again meanwhile stays queued.
    """
    spark, out, marks = table.sparkSession, f"{base}/built", f"{base}/marks"
    wanted = queued(spark, base)
    if _exists(spark, marks):
        done = spark.read.parquet(marks).groupBy("date").agg(F.max("queued_at").alias("done"))
        wanted = wanted.join(done, "date", "left").where("done is null or queued_at > done").select("date", "queued_at")
    number = spark.read.parquet(marks).select("run").agg(F.max("run")).first()[0] + 1 if _exists(spark, marks) else 0
    wanted.write.mode("overwrite").parquet(f"{base}/wanted/run={number}")
    wanted = spark.read.parquet(f"{base}/wanted/run={number}")
    rows = build(table.join(wanted.select(F.col("date").alias("_d")), F.col(date) == F.col("_d"), "left_semi"))
    rows.repartition(F.col(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(out)
    wanted.write.mode("overwrite").parquet(f"{marks}/run={number}")
    return spark.read.schema(rows.schema).parquet(out)
