"""Cutting lineage: a DataFrame that is used several times is written once to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(spark: SparkSession, tag: str) -> str:
    """A new place in the folder named in spark.checkpoint.dir; only where it is unset in local mode (tests) a folder of our own is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="probita-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forgotten(df: DataFrame) -> None:
    """Delete the files of a table of :func:`materialized` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
