"""Incremental ingestion: a file stream of documents into the warehouse, with the checkpoint as the crawl's state.

Each run takes what is new (``availableNow``) and stops; a restarted run goes on after the last committed batch. A micro-batch is one
commit over all tables under its number, so one that is repeated after a crash is in once, whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.warehouse import Warehouse


def stream(spark: SparkSession, base: str, max_files: int = 1000) -> DataFrame:
    rows = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*declaration_*.json").option("maxFilesPerTrigger", max_files).load(base)
    return rows.select("value", F.col("_metadata.file_path").alias("path"))


def ingest(spark: SparkSession, base: str, out: str, checkpoint: str, max_files: int = 1000) -> Warehouse:
    """Take all files not seen yet into the warehouse at ``out``, then return."""
    house = Warehouse(spark, out)
    q = stream(spark, base, max_files).writeStream.foreachBatch(lambda df, n: house.apply(df, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return house
