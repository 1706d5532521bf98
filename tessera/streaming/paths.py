"""Where streams keep their state and output: the shared folder of the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines see; only a local session may do without."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base}/tessera"
