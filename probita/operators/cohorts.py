"""Peer cohorts: exact order statistics per (post_type, year) without sorting a cohort in one task.

Values are counted per cohort first; approximate quantiles only deal them into bins, within which running counts are
taken, and bins are small. So ranks and cut values are exact and a huge cohort is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.values import dbl, rounded
from ..plans.stage import materialized

KEYS = ["post_type", "declaration_year"]
LEAST, BINS = 5, 64
#: The features that cohorts compare.
COMPARED = [*KEYS, "total_income", "total_assets", "cash_ratio", "confidential_ratio"]


def members(df: DataFrame) -> DataFrame:
    """Rows that belong to a cohort, with the four values; zero incomes and assets count as missing."""
    rows = df.filter((F.coalesce("post_type", F.lit("")) != "") & F.col("declaration_year").isNotNull())
    return rows.select("declaration_id", *KEYS, dbl(F.nullif("total_income", F.lit(0))).alias("income"), dbl(F.nullif("total_assets", F.lit(0))).alias("assets"), F.col("cash_ratio").alias("cash"), F.col("confidential_ratio").alias("conf"))


def large_enough(rows: DataFrame) -> DataFrame:
    """Cohorts with at least five known incomes."""
    return rows.groupBy(*KEYS).agg(F.count("income").alias("n_income"), F.count("assets").alias("n_assets"), F.count("cash").alias("n_cash"), F.count("conf").alias("n_conf")).filter(F.col("n_income") >= LEAST)


def measures(rows: DataFrame) -> DataFrame:
    """Members -> (keys, measure, v): a row for each known value of the four."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("income", "assets", "cash", "conf")])
    return rows.select(*KEYS, F.explode(each).alias("x")).select(*KEYS, "x.*").filter("v is not null")


def running(hist: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, c) with c the number of rows of each distinct value -> (keys, value, upto, n). Bins hold about as many distinct values each.

    The bins are written once: approximate quantiles come out differently from run to run, and counts before a bin must be of the bins that rows are in."""
    marks = hist.groupBy(*keys).agg(F.percentile_approx(value, [i / BINS for i in range(1, BINS)], 1000).alias("marks"), F.sum("c").alias("n"))
    binned = materialized(hist.join(marks, keys).withColumn("bin", F.size(F.filter("marks", lambda m: m < F.col(value)))).drop("marks"), "bins")
    per = binned.groupBy(*keys, "bin").agg(F.sum("c").alias("in_bin"))
    per = per.withColumn("before", F.coalesce(F.sum("in_bin").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("in_bin")
    inner = F.sum("c").over(W.partitionBy(*keys, "bin").orderBy(value))
    return binned.withColumn("inner", inner).join(per, [*keys, "bin"]).select(*keys, value, (F.col("inner") + F.col("before")).alias("upto"), "n")


def ranked(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, value, upto, n): for each distinct value how many of the cohort's n are at most it."""
    keys = keys or KEYS
    return running(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")), value, keys)


def least_rank(value: str, p: float) -> Column:
    """The least value whose rank (share of values at most it) reaches ``p``."""
    return F.min(F.when(F.col("upto") / F.col("n") >= p, F.col(value)))


def at_index(value: str, p: float) -> Column:
    """The value at index min(floor(n p), n - 1) of the sorted values."""
    return F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value)))


def cuts(rows: DataFrame) -> DataFrame:
    """(keys, income_p99, income_p95, assets_p99, assets_p95, cash_p99, conf_median): cut values per cohort, null under five values.

    The four measures are ranked in one pass, as rows of (measure, value)."""
    return cuts_of(measures(rows).groupBy(*KEYS, "measure", "v").agg(F.count(F.lit(1)).alias("c")))


def cuts_of(hist: DataFrame) -> DataFrame:
    """The cut values from exact counts (keys, measure, v, c), however these came about."""
    seen = running(hist, "v", [*KEYS, "measure"])
    of = lambda m, x: F.when(F.max(F.when(F.col("measure") == m, F.col("n"))) >= LEAST, F.min(F.when((F.col("measure") == m) & x, F.col("v"))))
    rank = lambda p: F.col("upto") / F.col("n") >= p
    index = lambda p: F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    out = seen.groupBy(*KEYS).agg(
        F.max(F.when(F.col("measure") == "income", F.col("n"))).alias("n_income"), of("income", rank(0.99)).alias("income_p99"), of("income", rank(0.95)).alias("income_p95"),
        of("assets", rank(0.99)).alias("assets_p99"), of("assets", rank(0.95)).alias("assets_p95"), of("cash", rank(0.99)).alias("cash_p99"), of("conf", index(0.5)).alias("conf_median"),
    )
    return out.filter(F.col("n_income") >= LEAST).drop("n_income")


def with_cuts(df: DataFrame) -> DataFrame:
    """``df`` with its cohorts' cut values. These are written first, so that their true size decides on the join: as few cohorts as there
    are years and kinds of posts are broadcast, where the estimate would have all rows of a cohort shuffled to one task."""
    return df.join(materialized(cuts(members(df)), "cuts"), KEYS, "left")


def outlier_score(rank: Column, threshold: float = 0.95) -> Column:
    """0 below the threshold, else how far the rank is towards 1."""
    return F.when(rank >= threshold, rounded(F.least(F.lit(1.0), (rank - threshold) / (1 - threshold)), 3)).otherwise(F.lit(0.0))


def ranks(df: DataFrame, value: str, hist: DataFrame | None = None) -> DataFrame:
    """declaration_id, rank, n of each member that has the value, in cohorts that are large enough. ``hist``: exact counts (keys, measure, v, c) that are known already."""
    rows = members(df)
    known = measures(rows).groupBy(*KEYS, "measure", "v").agg(F.count(F.lit(1)).alias("c")) if hist is None else hist
    if value == "income":
        seen = running(known.filter(F.col("measure") == value).select(*KEYS, F.col("v").alias(value), "c"), value, KEYS).filter(F.col("n") >= LEAST)
    else:
        large = known.filter("measure = 'income'").groupBy(*KEYS).agg(F.sum("c").alias("n_income")).filter(F.col("n_income") >= LEAST).select(*KEYS)
        seen = running(known.filter(F.col("measure") == value).select(*KEYS, F.col("v").alias(value), "c"), value, KEYS).join(large, KEYS, "left_semi")
    return rows.select("declaration_id", *KEYS, value).join(seen.hint("merge"), [*KEYS, value]).select("declaration_id", *KEYS, value, (F.col("upto") / F.col("n")).alias("rank"), "n")


def layer2(df: DataFrame, hist: DataFrame | None = None) -> DataFrame:
    """declaration_id, income_outlier, wealth_outlier: scores added at three points each to the total."""
    part = lambda v: ranks(df, v, hist).filter(F.col("n") >= LEAST).select("declaration_id", outlier_score(F.col("rank")).alias(f"{v}_outlier"))
    out = df.select("declaration_id").join(part("income").hint("merge"), "declaration_id", "left").join(part("assets").hint("merge"), "declaration_id", "left")
    return out.select("declaration_id", F.coalesce("income_outlier", F.lit(0.0)).alias("income_outlier"), F.coalesce("assets_outlier", F.lit(0.0)).alias("wealth_outlier"))
