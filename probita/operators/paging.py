"""Deep pages without sorting everything again: a listing kept in ranges of its order, with the rows of each range counted.

The listing is dealt into ranges by its sort keys and id once (``Listing.write``). A page at an offset adds up the counts, one
number a range, and reads the ranges in question only; the page after a given row (keyset) starts at that row's range.
Rows are the same as :func:`serving.page` gives: nulls last in both directions, the id as the last key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.stage import forgotten, materialized
from .features import ID
from .serving import SORTS, ordered

RANGE, ROWS_A_RANGE = "_range", 10_000


class Listing:
    def __init__(self, spark: SparkSession, place: str, sort_by: str = "score", sort_dir: str = "desc"):
        self.spark, self.place, self.sort_by, self.sort_dir = spark, place.rstrip("/"), sort_by, sort_dir
        self.keys = [*SORTS.get(sort_by, SORTS["score"]), ID]

    @classmethod
    def write(cls, scored: DataFrame, place: str, sort_by: str = "score", sort_dir: str = "desc", rows_a_range: int = ROWS_A_RANGE) -> Listing:
        """Deal ``scored`` into ranges below ``place`` (a folder that isn't there yet)."""
        out = cls(scored.sparkSession, place, sort_by, sort_dir)
        order = [F.col(k).asc_nulls_last() if sort_dir == "asc" or k == ID else F.col(k).desc_nulls_last() for k in out.keys]
        scored = materialized(scored, "listing")  # counted, sampled for the ranges' ends and dealt: three reads
        n = max(1, -(-scored.count() // rows_a_range))
        ranges = scored.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id())
        ranges.write.partitionBy(RANGE).parquet(f"{out.place}/rows")
        first = W.partitionBy(RANGE).orderBy(*order)  # a range has about ``rows_a_range`` rows
        ends = out.rows.select(RANGE, *out.keys).withColumns({"i": F.row_number().over(first), "n": F.count(F.lit(1)).over(W.partitionBy(RANGE))}).filter("i = 1")
        ends.select(RANGE, "n", F.struct(*out.keys).alias("first")).coalesce(1).write.parquet(f"{out.place}/ranges")
        forgotten(scored)
        return out

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/rows")

    def _ranges(self) -> list:
        """A row per range, in order."""
        return self.spark.read.parquet(f"{self.place}/ranges").orderBy(RANGE).collect()

    def _of(self, ranges: list[int]) -> DataFrame:
        return ordered(self.rows.filter(F.col(RANGE).isin(ranges)).drop(RANGE), self.sort_by, self.sort_dir)

    def total(self) -> int:
        return sum(r.n for r in self._ranges())

    def page(self, *, limit: int = 50, offset: int = 0) -> DataFrame:
        """``limit`` rows from ``offset`` on."""
        before, some, skip = 0, [], 0
        for r in self._ranges():
            if before + r.n > offset and before < offset + limit:
                skip = before if not some else skip
                some.append(r[RANGE])
            before += r.n
        return self._of(some).offset(offset - skip).limit(limit)

    def after(self, row, *, limit: int = 50) -> DataFrame:
        """The ``limit`` rows after ``row``, which has the listing's keys."""
        ranges, at = self._ranges(), {k: row[k] for k in self.keys}
        behind = [r for r in ranges if self._compared(r["first"], at) <= 0]
        start = ranges.index(behind[-1]) if behind else 0
        some, n = [], 0
        for i, r in enumerate(ranges[start:]):
            some.append(r[RANGE])
            n += r.n if i else 0  # the first one may end at the row
            if n >= limit:
                break
        return self._of(some).filter(self._beyond(at)).limit(limit)

    def _compared(self, a, b) -> int:
        def one(k: str) -> int:
            x, y = a[k], b[k]
            if x is None or y is None:
                return (x is None) - (y is None)
            if isinstance(x, str):
                x, y = x.encode(), y.encode()
            less = (x > y) - (x < y)
            return less if self.sort_dir == "asc" or k == ID else -less

        return next((c for c in map(one, self.keys) if c), 0)

    def _beyond(self, at: dict):
        """The condition that a row comes after ``at``."""
        out, same = F.lit(False), F.lit(True)
        for k in self.keys:
            x, v = F.col(k), at[k]
            if v is None:
                more = F.lit(False)
            else:
                more = (x > F.lit(v) if self.sort_dir == "asc" or k == ID else x < F.lit(v)) | x.isNull()
            out = out | (same & F.coalesce(more, F.lit(False)))
            same = same & x.eqNullSafe(F.lit(v))
        return out
