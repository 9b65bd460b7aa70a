"""Raw documents at rest: scans, an idempotent store by filing year, and exports. Keyed tables are in ``lake``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sections import filing_year, parsed

CSV_COLUMNS = ("declaration_id", "user_declarant_id", "declaration_year", "name", "work_post", "work_place", "total_score", "rules", "explanation")


def scan(spark: SparkSession, base: str, year: int | None = None) -> DataFrame:
    """(value, path) of every ``*declaration_*.json`` below ``base``, one document per file; ``path`` is the order of documents (see
    :func:`in_order`). ``year`` reads that folder only."""
    path = f"{base}/{year}" if year is not None else base
    try:
        rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*declaration_*.json").text(path, wholetext=True)
    except Exception as e:  # a missing folder is an empty table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string, path string")
    return rows.select("value", F.input_file_name().alias("path"))


def in_order(docs: DataFrame) -> DataFrame:
    """Documents sorted by path, as a sequential reader would meet them."""
    return docs.orderBy("path")


def documents(spark: SparkSession, base: str, year: int | None = None) -> DataFrame:
    return parsed(scan(spark, base, year))


def store(raw: DataFrame, base: str, overwrite: bool = False, count: bool = False) -> DataFrame | int:
    """Append documents (``value``) as a table partitioned by filing year, each id once; ids that are there stay unless
    ``overwrite``. Returns what was written, or with ``count`` how many (counted before the write)."""
    spark = raw.sparkSession
    new = filing_year(parsed(raw.withColumn("document", F.col("value")))).groupBy("declaration_id").agg(F.min(F.struct("filed", "document")).alias("d"))
    new = new.select("declaration_id", "d.document", "d.filed")  # of several documents of an id the one filed first, then the least text
    old = stored(spark, base)
    if old is not None and not overwrite:
        new = new.join(old.select("declaration_id"), "declaration_id", "left_anti")
    n = new.count() if count else None
    if old is None:
        new.write.partitionBy("filed").parquet(base)
    elif overwrite:
        _swap(old.join(new.select("declaration_id"), "declaration_id", "left_anti").unionByName(new), base, ["filed"])
    else:
        new.write.mode("append").partitionBy("filed").parquet(base)
    return new if n is None else n


def stored(spark: SparkSession, base: str) -> DataFrame | None:
    recovered(spark, base)
    try:
        return spark.read.schema("declaration_id string, document string, filed string").parquet(base)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _files(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    base = base.rstrip("/")
    return path(base).getFileSystem(spark._jsc.hadoopConfiguration()), path(base), path(f"{base}__new"), path(f"{base}__old")


def recovered(spark: SparkSession, base: str) -> None:
    """Finish or undo a swap that was cut off: the table is in place, or its old state comes back."""
    fs, now, _, old = _files(spark, base)
    if fs.exists(old):
        fs.delete(old, True) if fs.exists(now) else fs.rename(old, now)


def _swap(df: DataFrame, base: str, by: list[str]) -> None:
    """Replace a table that ``df`` itself reads: write beside it, move the old one aside, rename, and only then drop the old one.

    At any moment the old or the new state is whole on disk; :func:`recovered` puts it in place after a crash."""
    fs, now, new, old = _files(df.sparkSession, base)
    df.write.mode("overwrite").partitionBy(*by).parquet(new.toString())
    if not (fs.rename(now, old) and fs.rename(new, now)):
        raise OSError(f"cannot replace {base}")
    fs.delete(old, True)


def has_rows(spark: SparkSession, base: str) -> bool:
    """Existence probe; anything that can't be read counts as empty."""
    try:
        return not spark.read.parquet(base).limit(1).isEmpty()
    except Exception:
        return False


def table_or_raw(spark: SparkSession, table: str, raw: str) -> DataFrame:
    """Stored documents if there are any, else those of the raw folder."""
    if has_rows(spark, table):
        return parsed(stored(spark, table).withColumnRenamed("document", "value").drop("declaration_id", "filed"))
    return documents(spark, raw)


def as_text(df: DataFrame) -> list[Column]:
    """Columns for a text sink: nested values as JSON, others cast."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return [(F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string")).alias(f.name) for f in df.schema.fields]


def export_table(df: DataFrame, path: str) -> None:
    """Any table as CSV with a header, for Spark's reader as it is by default: quotes are escaped by a backslash, blanks at the ends stay.
    Texts with line ends need ``multiLine``; an empty text comes back as null."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*as_text(df)).write.mode("overwrite").option("header", True).options(**keep).csv(path)


def export_csv(scored: DataFrame, path: str) -> None:
    """Ranked scores with a header; rules joined by ", ", explanations with their figures. Parts have no byte order mark; see :func:`export_single_csv`."""
    from ..operators.rules import explanation
    from ..operators.serving import name

    df = scored.withColumns({"name": name(), "explanation": explanation(F.col("rules"))}).withColumn("rules", F.concat_ws(", ", "rules"))
    df.orderBy(F.desc("total_score"), "declaration_id").select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def export_single_csv(rows: Iterable, columns: Iterable[str], path: str) -> None:
    """A bounded report (a top-k list) as one local file with a byte order mark."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(columns)
        w.writerows(rows)
