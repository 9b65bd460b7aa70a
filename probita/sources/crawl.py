"""A resumable crawl of a paged REST collection into the warehouse.

The listing is a stream whose offset is the page: each batch lists some pages, one task a page. Ids that are stored already, or
come twice, are left out by a join that reads the buckets of these ids only; the others are fetched by tasks, at most ``at_once``
at a time, written once to the shared folder, and taken in as one commit. No document passes through the driver.

Page numbers and the commit go together: Spark's checkpoint repeats a batch that was cut off, and the warehouse, which has the number of
each batch that is in, takes it once. What fails (a page that can't be listed, a document that can't be fetched or isn't
JSON) becomes a row of ``failed`` and is tried again at the start of the next run; an item without id is counted, since there
is nothing to fetch. ``crawled`` has a row of counts per batch. A crawl that has reached the last page begins at page 1 next time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..plans.stage import forgotten, materialized
from ..plans.warehouse import ID, Warehouse
from .rest import FIRST_PAUSE, MAX_PAGES, PAGE, fetcher, tried

LISTED = "page int, id string, error string"
FETCHED = "id string, value string, error string"
COUNTS = "year int, round int, batch long, first_page int, last_page int, listed long, known long, fetched long, failed long, without_id long"
PAGES_A_BATCH, AT_ONCE = 10, 5


def listed(options: dict, page: int) -> list[dict]:
    params = {"declaration_year": options["year"], "page": page}
    return tried(fetcher(options.get("fetcher")), f"{options['url']}/documents/list", params, float(options.get("pause", FIRST_PAUSE))).get("data") or []


class Page(InputPartition):
    def __init__(self, page: int):
        super().__init__(page)


class PageReader(DataSourceStreamReader):
    """Ids of the pages up to ``most``, as far as the collection goes. A page that can't be listed doesn't end it."""

    def __init__(self, options: dict):
        self.o = options

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        page, most = int(self.o.get("first", 0)), int(self.o.get("most", MAX_PAGES))
        while page < most:
            try:
                n = len(listed(self.o, page + 1))
            except (OSError, ValueError):
                n = PAGE
            page += n > 0
            if n < PAGE:
                break
        return {"page": page}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(p) for p in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            items = listed(self.o, partition.value)
        except (OSError, ValueError) as e:
            yield partition.value, None, f"page: {e}"[:500]
            return
        for x in items:
            known = isinstance(x, dict) and x.get("id") is not None
            yield partition.value, str(x["id"]) if known else None, None if known else "without_id"

    def commit(self, end: dict) -> None:
        pass


class DeclarationPages(DataSource):
    """``spark.readStream.format("declarations_pages").option("url", ...).option("year", 2024).load()``"""

    @classmethod
    def name(cls) -> str:
        return "declarations_pages"

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def fetched(ids: DataFrame, options: dict, at_once: int = AT_ONCE) -> DataFrame:
    """(id, value, error) of each id: the document's text, or why there is none."""
    url, pause = options["url"], float(options.get("pause", FIRST_PAUSE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = fetcher(options.get("fetcher"))
        for b in batches:
            for i in b.column(0).to_pylist():  # a document at a time: they can be large
                value, error = None, None
                try:
                    value = json.dumps(tried(fetch, f"{url}/documents/{i}", {}, pause), ensure_ascii=False)
                except (OSError, ValueError) as e:
                    error = str(e)[:500]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (i, value, error)], names=["id", "value", "error"])

    return ids.select("id").repartition(at_once).mapInArrow(run, FETCHED)


class Crawl:
    def __init__(self, house: Warehouse, url: str, year: int, checkpoint: str, *, fetch: str | None = None, pages_a_batch: int = PAGES_A_BATCH, max_pages: int = MAX_PAGES, at_once: int = AT_ONCE, pause: float = FIRST_PAUSE):
        self.house, self.year, self.checkpoint, self.pages_a_batch, self.max_pages, self.at_once = house, year, checkpoint.rstrip("/"), pages_a_batch, max_pages, at_once
        self.options = {"url": url, "year": str(year), "pause": str(pause), **({"fetcher": fetch} if fetch else {})}
        house.spark.dataSource.register(DeclarationPages)

    def counts(self) -> DataFrame | None:
        return self.house.lake.current().read("crawled", where={"year": self.year})

    def failed(self) -> DataFrame | None:
        """(year, id, page, error) of what is still to be had; pages have no id."""
        return self.house.lake.current().read("failed", where={"year": self.year})

    def _place(self) -> tuple[int, int]:
        """(round, last page of it that is in)."""
        done = self.house.lake.current()
        turn = max(0, done.done(f"round-{self.year}"))
        return turn, max(0, done.done(f"page-{self.year}-{turn}"))

    def run(self, max_docs: int | None = None) -> int:
        """Go on where the last run stopped, to the last page or until ``max_docs`` documents are fetched in this run; how many were."""
        n = self._again()
        while max_docs is None or n < max_docs:
            turn, page = self._place()
            took = self._batch(turn, page)
            if took is None:
                draft = self.house.lake.draft()
                draft.mark(f"round-{self.year}", turn + 1)
                draft.publish()
                break
            n += took
        return n

    def _batch(self, turn: int, page: int) -> int | None:
        """One batch of the stream; documents fetched, or None where no page was left."""
        took: list[int] = []
        o = {**self.options, "first": page, "most": min(page + self.pages_a_batch, self.max_pages)}
        rows = self.house.spark.readStream.format("declarations_pages").options(**o).load()
        each = lambda df, n: took.append(self._take(df, n, turn)) if self.house.lake.current().done(f"crawl-{self.year}-{turn}") < n else took.append(0)
        query = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.checkpoint}/{self.year}/{turn}").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(took) if took else None

    def _take(self, rows: DataFrame, number: int, turn: int) -> int:
        rows = materialized(rows, "crawl-listed")
        try:
            n = rows.agg(
                F.min("page").alias("first"), F.max("page").alias("last"), F.count("id").alias("listed"), F.count_if(F.col("error") == "without_id").alias("without_id"),
            ).first()
            if n.last is None:
                return 0
            pages = rows.filter("id is null and error <> 'without_id'").select("id", "page", "error")
            marks = {f"crawl-{self.year}-{turn}": number, f"page-{self.year}-{turn}": n.last}
            count = {"round": turn, "batch": number, "first_page": n.first, "last_page": n.last, "listed": n.listed, "without_id": n.without_id}
            return self._fetch(rows.filter("id is not null"), pages, marks, count)
        finally:
            forgotten(rows)

    def _fetch(self, ids: DataFrame, pages: DataFrame, marks: dict, count: dict, again: bool = False) -> int:
        """Fetch what isn't stored and take it in, with the marks and counts, in one commit. ``again``: what failed before is settled by it."""
        state, ids = self.house.lake.current(), ids.groupBy("id").agg(F.min("page").alias("page"))
        stored = state.read("documents", ids.select(F.col("id").alias(ID)))
        new = ids if stored is None else ids.join(stored.select(F.col(ID).alias("id")), "id", "left_anti")
        got = materialized(fetched(new, self.options, self.at_once), "crawl-fetched")
        try:
            n = got.agg(F.count("value").alias("good"), F.count("error").alias("bad")).first()
            failed = got.filter("value is null").join(ids, "id").select("id", "page", "error").unionByName(pages).withColumn("year", F.lit(self.year))
            row = {"year": self.year, "known": count["listed"] - n.good - n.bad, "fetched": n.good, "failed": n.bad, **count}

            def more(draft) -> None:
                if again:
                    draft.kill("failure", failed_before(self.house.spark, self.year))
                draft.put("failed", failed)
                draft.put("crawled", self.house.spark.createDataFrame([row], COUNTS))
                for stream, number in marks.items():
                    draft.mark(stream, number)

            docs = got.filter("value is not null").select("value", F.concat(F.lit(f"{self.options['url']}/documents/"), "id").alias("path"))
            self.house.apply(docs, state.done("crawl") + 1, "crawl", more)
            return n.good
        finally:
            forgotten(got)

    def _again(self) -> int:
        """Try what failed once more; what fails again stays failed."""
        failed = self.failed()
        if failed is None:
            return 0
        failed = materialized(failed, "crawl-failed")
        try:
            if failed.isEmpty():
                return 0
            pages = [r.page for r in failed.filter("id is null").select("page").distinct().limit(self.max_pages).collect()]
            reader = PageReader(self.options)
            listing = self.house.spark.createDataFrame([(p,) for p in pages], "page int").repartition(max(1, min(len(pages), self.at_once)), "page").mapInArrow(_listing(reader), LISTED)
            listing = materialized(listing, "crawl-listed")
            ids = failed.filter("id is not null").select("id", "page").unionByName(listing.filter("id is not null").select("id", "page"))
            turn, page = self._place()
            count = {"round": turn, "batch": -1, "first_page": page, "last_page": page, "listed": ids.count(), "without_id": listing.filter("error = 'without_id'").count()}
            return self._fetch(ids, listing.filter("id is null and error <> 'without_id'").select("id", "page", "error"), {}, count, again=True)
        finally:
            forgotten(failed)


def failed_before(spark: SparkSession, year: int) -> DataFrame:
    """The key under which all failures of a year are: those of earlier commits end with it."""
    return spark.createDataFrame([(year,)], "year int")


def _listing(reader: PageReader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                rows = list(reader.read(Page(p)))
                cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["page", "id", "error"])

    return run
