"""Declarations at rest, kept up to date batch by batch: sections, features, timelines and cohorts move together.

One batch is one commit of the store: all sections of its declarations replace what was stored of these; features are made for the
batch alone; timelines are made again for the persons that it touches; cohorts are exact counts of (cohort, measure,
value), to which a batch adds its declarations and from which it takes those that it replaces, and cut values are read
again for the cohorts whose counts changed. A batch whose number is in already changes nothing.

Documents that can't be read, or have no id, go to ``quarantine`` with path, text and reason. Of several documents of an id
in one batch the one with the least path counts (then the least text); of several batches the latest.
``ingested`` has a row of counts per batch: fetched = saved + repeated + unreadable + without_id.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohorts, features, search, timeline
from ..operators.sections import filing_year, normalised, parsed
from ..operators.tables import Tables
from ..sources.lake import Lake, Snapshot, Table, compact
from .stage import forgotten, materialized

ID, PERSON = "declaration_id", "user_declarant_id"
SECTIONS = tuple(f.name for f in fields(Tables))
COHORT = tuple(cohorts.KEYS)
#: About how many postings a declaration has.
GRAMS_EACH = 60
OF_DECLARATION = {"group": "declaration", "key": (ID,)}
TABLES = {
    **{name: Table((ID,), **OF_DECLARATION) for name in (*SECTIONS, "features", "documents")},
    "postings": Table(("gram",), **OF_DECLARATION),
    "persons": Table((PERSON,), **OF_DECLARATION),
    "filings": Table((PERSON,), **OF_DECLARATION),
    "timelines": Table((PERSON,), "person", (PERSON,)),
    "cohort_counts": Table(COHORT, summed="c"),
    "cohort_cuts": Table(COHORT, "cohort", COHORT),
    "quarantine": Table(("path",)),
    "ingested": Table(("batch",)),
    "failed": Table(("year",), "failure", ("year",)),
    "crawled": Table(("year",)),
}


def sorted_out(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, path) -> (parsed documents, one per id; the others with ``reason``: unreadable, without_id or repeated)."""
    if "path" not in raw.columns:
        raw = raw.withColumn("path", F.lit(None).cast("string"))
    docs = parsed(raw.withColumn("text_", F.col("value")))
    docs = docs.withColumn("reason", F.when(F.col("data").isNull(), "unreadable").when(F.coalesce("id", "doc_id").isNull(), "without_id"))
    good = docs.filter("reason is null")
    first = F.min_by(F.struct(*[c for c in docs.columns if c != ID]), F.struct(F.col("path").isNull(), "path", F.sha2("text_", 256)))
    kept = good.groupBy(ID).agg(first.alias("d"), F.count(F.lit(1)).alias("n_")).select(ID, "d.*", "n_")
    return kept, docs.filter("reason is not null").select("path", F.col("text_").alias("value"), "reason")


def weighed(df: DataFrame, weight: int) -> DataFrame:
    """Features -> (cohort, measure, v, c): a row for each known value, c its weight."""
    return cohorts.measures(cohorts.members(df)).withColumn("c", F.lit(weight).cast("long"))


def filings(df: DataFrame, t: Tables) -> DataFrame:
    """What timelines take of each declaration."""
    rows = timeline.filings(df, t, more=(F.col("declaration_year"), timeline.full_name().alias("name")))
    return rows.drop("bank", "n_monetary", "n_estate", "n_vehicles", "institution")


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, dedupe_property: bool = False):
        self.spark, self.lake, self.dedupe_property = spark, Lake(spark, root, TABLES), dedupe_property

    def apply(self, raw: DataFrame, number: int, stream: str = "documents", more=lambda draft: None) -> Snapshot:
        """Take a batch of documents (value, path) in; one commit, of which ``more`` can make more."""
        draft = self.lake.draft()
        if draft.done(stream) >= number:
            return self.lake.current()
        kept, odd = sorted_out(raw)
        kept, odd = kept.persist(), odd.persist()
        try:
            seen = kept.agg(F.count(F.lit(1)).alias("saved"), F.coalesce(F.sum("n_"), F.lit(0)).alias("n")).first()
            bad = {r.reason: r["count"] for r in odd.groupBy("reason").count().collect()}  # two reasons
            draft.put("quarantine", odd.withColumn("batch", F.lit(number)))
            row = (number, seen.n + sum(bad.values()), seen.saved, seen.n - seen.saved, bad.get("unreadable", 0), bad.get("without_id", 0))
            draft.put("ingested", self.spark.createDataFrame([row], "batch long, fetched long, saved long, repeated long, unreadable long, without_id long"))
            if seen.saved:
                texts = filing_year(kept).select(ID, "filed", "path", F.col("text_").alias("value"))
                self._replace(draft, normalised(kept, self.dedupe_property), seen.saved, {"documents": texts})
            more(draft)
            draft.mark(stream, number)
            draft.merge()
            return draft.publish()
        finally:
            kept.unpersist()
            odd.unpersist()

    def apply_tables(self, t: Tables, number: int, stream: str = "tables") -> Snapshot:
        """The same for declarations that are tables already."""
        draft = self.lake.draft()
        if draft.done(stream) >= number:
            return self.lake.current()
        n = t.profile.count()
        if n:
            self._replace(draft, t, n)
        draft.mark(stream, number)
        draft.merge()
        return draft.publish()

    def _replace(self, draft, t: Tables, n: int, also: dict[str, DataFrame] | None = None) -> None:
        ids = t.profile.select(ID)
        old = draft.read("features", ids)  # as they were before the batch
        gone = None if old is None else materialized(old.select(ID, PERSON, *cohorts.COMPARED), "gone")  # files: read in as many tasks as they need
        n_gone = 0 if gone is None else gone.count()
        if n_gone:
            draft.kill("declaration", gone.select(ID), n_gone)
        if draft.parts("features") and not draft.parts("filings"):  # a store of earlier code
            draft.put("filings", filings(draft.read("features"), self.tables(draft)), draft.rows("features"))
        for name, rows in {**{name: getattr(t, name) for name in SECTIONS}, **(also or {})}.items():
            draft.put(name, rows, n)
        own = Tables(**{name: draft.fresh(name) for name in SECTIONS})  # the sections just written: made once
        draft.put("persons", t.profile.select(PERSON, ID), n)
        draft.put("postings", search.postings(t.profile), GRAMS_EACH * n)
        draft.put("features", features.wide(own), n)
        fresh = draft.fresh("features")
        draft.put("filings", filings(fresh, own), n)
        counts = weighed(fresh, 1) if gone is None else weighed(fresh, 1).unionByName(weighed(gone, -1))
        self._cohorts(draft, counts.groupBy(*COHORT, "measure", "v").agg(F.sum("c").alias("c")).filter("c <> 0"), n)
        touched = own.profile.select(PERSON) if gone is None else own.profile.select(PERSON).unionByName(gone.select(PERSON))
        self._timelines(draft, touched.filter(F.col(PERSON).isNotNull()).distinct())
        if gone is not None:
            forgotten(gone)

    def _cohorts(self, draft, counts: DataFrame, n: int) -> None:
        draft.put("cohort_counts", counts, n)
        changed = materialized(draft.fresh("cohort_counts").select(*COHORT).distinct(), "changed")
        if draft.parts("cohort_cuts"):
            draft.kill("cohort", changed)
        draft.put("cohort_cuts", cohorts.cuts_of(self.histogram(draft, changed)))
        forgotten(changed)

    @staticmethod
    def histogram(state: Snapshot, keys: DataFrame | None = None) -> DataFrame:
        """(cohort, measure, v, c): the exact counts of the declarations that are in, of some cohorts or all."""
        return state.read("cohort_counts", keys).groupBy(*COHORT, "measure", "v").agg(F.sum("c").alias("c")).filter("c > 0")

    def _timelines(self, draft, persons: DataFrame) -> None:
        persons = materialized(persons, "touched")
        n = persons.count()
        if n:
            if draft.parts("timelines"):
                draft.kill("person", persons, n)
            draft.put("timelines", timeline.in_one_pass(draft.read("filings", persons)), n)
        forgotten(persons)

    @staticmethod
    def tables(state: Snapshot, ids: DataFrame | None = None) -> Tables:
        """The sections of some declarations, or of all."""
        return Tables(**{name: state.read(name, ids) for name in SECTIONS})

    def compact(self, full: bool = False) -> bool:
        return compact(self.lake, full)

    def vacuum(self, keep: int = 2) -> int:
        return self.lake.vacuum(keep)
