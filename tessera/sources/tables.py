"""Readers: driver tables, lenient and strict JSON corpora, and the card view of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to as many tasks as shuffles have. Adaptive execution puts parts together by bytes; narrow rows have few, and memory follows their number."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def lenient_corpus(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All documents that parse, newest first; malformed ones are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("date is not null").orderBy(F.desc("date"))


def strict_corpus(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Fails on bad JSON, and on a document without a date or with sites that are no array."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    shape = F.col("date").isNotNull() & F.col("digest").isNotNull() & F.col("digest.sites").isNotNull()
    return rows.where(F.coalesce(F.when(shape, True), F.raise_error(F.lit("a document lacks date, digest or digest.sites")).cast("boolean"))).orderBy(F.desc("date"))


def day(df: DataFrame, date) -> DataFrame:
    """One date's documents; prunes partitions where the corpus is partitioned by date."""
    return df.where(F.col("date") == F.lit(date))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study corpus: one row for each order with its facets, strong key (nct) and weak key (acronym)."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    wide = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return wide.select(
        F.col("o_orderkey").alias("card_id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("c_mktsegment").alias("site"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("verdict"),
        F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")).alias("modality"),
        F.col("n_name").alias("meeting"),
        F.col("r_name").alias("intent"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 7).cast("string")).alias("methodology"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("nct"),
        F.expr("o_custkey div 2").alias("acronym"),
        F.col("o_totalprice").alias("point"),
    )
