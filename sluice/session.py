"""The session that queries expect: UTC, adaptive plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "sluice", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; only where that is unset, as in tests, a temporary one."""
    return spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "sluice-checkpoints")


def stored(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """df (with a folder for each value of the columns by) written to the folder of spark.checkpoint.dir and read back, so that what follows sees the same rows and partitions each time."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/sluice-{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)
