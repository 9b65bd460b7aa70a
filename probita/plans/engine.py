"""The engine's front: one object over a set of normalised tables, from raw documents, the driver's tables or a warehouse.

An engine that :meth:`Engine.open` gives reads what is stored: features, timelines and cut values are not made again, and
one declaration or one person reads the buckets of its keys only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohorts, features, rules, search, serving, timeline
from ..operators.paging import Listing
from ..operators.sections import normalised
from ..operators.tables import Tables
from ..sources import raw
from . import adapter
from .stage import folder, materialized
from .warehouse import ID, PERSON, SECTIONS, Warehouse


class Engine:
    def __init__(self, tables: Tables):
        self.tables = tables

    @classmethod
    def from_documents(cls, spark: SparkSession, base: str, year: int | None = None) -> Engine:
        return cls(normalised(raw.documents(spark, base, year)))

    @classmethod
    def from_driver_tables(cls, spark: SparkSession, sf_dir: str) -> Engine:
        return cls(adapter.tables(spark, sf_dir))

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> Engine:
        """The newest state of the warehouse at ``root``, or that of a version that is still there."""
        return Stored(Warehouse(spark, root), version)

    @cached_property
    def features(self) -> DataFrame:
        return materialized(features.wide(self.tables), "features")

    @cached_property
    def scores(self) -> DataFrame:
        """Features with hits, sub-scores and total, and the hits as JSON; cohort rules included."""
        df = rules.scored(rules.declaration_hits(cohorts.with_cuts(self.features), with_cohort=True))
        return materialized(df.withColumn("rule_details_json", rules.details_json(F.col("hits"))), "scores")

    @cached_property
    def timelines(self) -> DataFrame:
        return timeline.timelines(self.features, self.tables, lambda snaps: materialized(snaps, "snapshots"))

    def layer2(self) -> DataFrame:
        return cohorts.layer2(self.features)

    def list_declarations(self, **how) -> tuple[DataFrame, int]:
        return serving.list_declarations(self.scores, **how)

    def stats(self) -> DataFrame:
        return serving.stats(self.scores)

    def declaration(self, declaration_id: str) -> DataFrame:
        return serving.detail(self.scores, self.tables, declaration_id)

    def person_timeline(self, uid: int) -> DataFrame:
        """The scored timeline of one person, made of this person's declarations only."""
        if uid <= 0:
            raise ValueError("uid must be positive")
        own = of_person(self.tables, uid)
        return timeline.timelines(features.wide(own), own)

    def top(self, n: int, least: float = 0.0) -> DataFrame:
        """The review list: persons with two snapshots or more, best score first."""
        return serving.ranked_persons(self.timelines, top=n, min_score=least)

    def report(self, *, year: int | None = None, limit: int | None = None, min_score: float = 0.0, top: int = 20, detailed: int = 5) -> str:
        """The ranked list as text, the first few persons with their rules. ``limit``: of the declarations of ``year`` only so many, by id."""
        return serving.report(serving.ranked_persons(self._of(year, limit), top=top, min_score=min_score), detailed)

    def _of(self, year: int | None, limit: int | None) -> DataFrame:
        if year is None and limit is None:
            return self.timelines
        df = self.features if year is None else self.features.filter(F.col("declaration_year") == year)
        return timeline.timelines(df if limit is None else df.orderBy("declaration_id").limit(limit), self.tables)

    def persist(self, out: str) -> Warehouse:
        """The tables as the next batch of the warehouse at ``out``: declarations that are there are replaced."""
        house = Warehouse(self.tables.profile.sparkSession, out)
        house.apply_tables(self.tables, house.lake.current().done("tables") + 1)
        return house

    def export_csv(self, path: str) -> None:
        raw.export_csv(self.scores, path)


def of_person(t: Tables, uid: int) -> Tables:
    """Each section with the rows of one person's declarations only."""
    profile = t.profile.filter(F.col(PERSON) == uid)
    ids = profile.select(ID)
    return Tables(profile=profile, **{n: getattr(t, n).join(ids, ID, "left_semi") for n in SECTIONS if n != "profile"})


class Stored(Engine):
    def __init__(self, house: Warehouse, version: int | None = None):
        self.house, self.state = house, house.lake.current(version)
        if not self.state.parts("profile"):
            raise ValueError(f"no declarations at {house.lake.root}")

    @cached_property
    def tables(self) -> Tables:
        return self.house.tables(self.state)

    @cached_property
    def features(self) -> DataFrame:
        return self.state.read("features")

    @cached_property
    def timelines(self) -> DataFrame:
        return self.state.read("timelines")

    def _scored(self, rows: DataFrame) -> DataFrame:
        cut = rows.join(self.state.read("cohort_cuts"), cohorts.KEYS, "left")
        df = rules.scored(rules.declaration_hits(cut, with_cohort=True))
        return df.withColumn("rule_details_json", rules.details_json(F.col("hits")))

    @cached_property
    def scores(self) -> DataFrame:
        return self._scored(self.features)

    def found(self, query: str, *, min_score: float = 0.0, wildcard: bool = True) -> DataFrame:
        """The rows of :func:`serving.filtered`: candidates from the postings of the query's trigrams, then verified."""
        grams = search.needed(query, wildcard)
        if not grams:
            return serving.filtered(self.scores, query=query, min_score=min_score, wildcard=wildcard)
        want = self.house.spark.createDataFrame([(g,) for g in grams], "gram string")
        ids = search.candidates(self.state.read("postings", want), len(grams))
        return serving.filtered(self._scored(self.state.read("features", ids)), query=query, min_score=min_score, wildcard=wildcard)

    def list_declarations(self, *, query: str = "", min_score: float = 0.0, **how) -> tuple[DataFrame, int]:
        serving.checked(min_score=min_score, query=query)
        df = self.found(query, min_score=min_score)
        return serving.page(df, **how), df.count()

    def listing(self, sort_by: str = "score", sort_dir: str = "desc") -> Listing:
        """All scores in ranges of an order, for deep pages; written once."""
        return Listing.write(self.scores, folder(self.house.spark, "listing"), sort_by, sort_dir)

    def layer2(self) -> DataFrame:
        return cohorts.layer2(self.features, self.house.histogram(self.state))

    def declaration(self, declaration_id: str) -> DataFrame:
        one = {ID: declaration_id}
        tables = Tables(**{n: self.state.read(n, where=one) for n in SECTIONS})
        return serving.detail(self._scored(self.state.read("features", where=one)), tables, declaration_id)

    def sections_of(self, uid: int) -> Tables:
        """A person's sections: the buckets of this person's declarations are read, no others."""
        ids = self.state.read("persons", where={PERSON: uid}).select(ID)
        return self.house.tables(self.state, ids)

    def person_timeline(self, uid: int) -> DataFrame:
        if uid <= 0:
            raise ValueError("uid must be positive")
        return self.state.read("timelines", where={PERSON: uid})

    def quarantine(self) -> DataFrame | None:
        return self.state.read("quarantine")
