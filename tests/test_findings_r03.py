"""A test for each finding of round 3 that held."""

import pytest

from probita.plans import catalogue

from .test_catalogue import DIR, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", ["placeholder_status", "safe_number", "known_placeholder", "rule_distribution_labelled"])
def test_query_runs_and_equals_sql(spark, duck, name):  # noqa: F811
    df = catalogue.QUERIES[name](spark, DIR)
    cur = duck.execute(catalogue.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


def test_a_cash_score_that_rounds_to_zero_is_no_hit(spark):
    """A cash share of 0.80005 scores 0.000: the rule doesn't fire; at 0.9 it does."""
    from probita.operators import rules

    df = spark.createDataFrame([(1, 8000.5, 1999.5), (2, 9000.0, 1000.0)], "i int, cash double, bank double")
    assert {r.i: r.hit for r in df.select("i", rules.cash_hit().isNotNull().alias("hit")).collect()} == {1: False, 2: True}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bins_are_written_once(spark):
    """Approximate quantiles are not evaluated again for the rows after the counts before each bin."""
    from probita.operators import cohorts

    df = spark.createDataFrame([("a", 2000, float(i % 97)) for i in range(500)], "post_type string, declaration_year int, income double")
    assert "percentile_approx" not in plan(cohorts.ranked(df, "income"))


def test_a_listing_reads_its_rows_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from probita.operators.paging import Listing

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).select(F.col("id").cast("string").alias("declaration_id"), F.col("id").cast("double").alias("total_score"))
    listing = Listing.write(df.mapInArrow(counted, df.schema), f"file://{tmp_path}/listing", rows_a_range=10)
    assert seen.value == 100 and [r.total_score for r in listing.page(limit=2, offset=30).collect()] == [69.0, 68.0]


@pytest.mark.parametrize("name", ["cr10_unknown_major", "cr6_area", "tq2_orphans", "cr13_no_info", "cr9_rentable", "tq1_dates"])
def test_a_rule_reads_its_own_sections_and_broadcasts_no_features(spark, name):
    text = plan(catalogue.QUERIES[name](spark, DIR))
    assert "events.parquet" not in text and not [x for x in text.split("\n") if "BroadcastHashJoin" in x and "LeftOuter" in x]


def test_documents_are_spread(spark):
    df = spark.range(25_000).coalesce(1)
    assert catalogue.spread(df).rdd.getNumPartitions() == max(3, spark.sparkContext.defaultParallelism)


def test_profiles_are_made_after_a_shuffle_by_declaration(spark):
    """The least text is sorted for in tasks of a bounded number of rows, which hold the whole declaration already."""
    from probita.plans import adapter

    assert "REPARTITION_BY_NUM" in plan(adapter.tables(spark, DIR).profile)


def test_only_wanted_postings(spark):
    from probita.operators import search

    df = spark.createDataFrame([("a", "Anna", None, "Bell", "Kyiv")], "declaration_id string, firstname string, middlename string, lastname string, work_place string")
    assert sorted(r.gram for r in search.postings(df, ["ann", "yiv", "xyz"]).collect()) == ["ann", "yiv"]


def test_text_sink_keeps_odd_texts(spark, tmp_path):
    """Quotes, backslashes, commas, line ends and blanks at the ends, as Spark's reader takes them by default."""
    from probita.sources import raw

    texts = ['["a",null]', "a\\", 'a\\"b', '"', '""', "\\", "a,b\\", " a ", "\ta\t", "a\nb", "\r\nx", 'x"y\\"z', " ", '"\\', 'a"\\', ",\\", "\\,", '{"k":"\\u0041"}', None]
    raw.export_table(spark.createDataFrame(list(enumerate(texts)), "n int, v string"), f"file://{tmp_path}/t")
    got = spark.read.option("header", True).option("multiLine", True).csv(f"file://{tmp_path}/t").collect()
    assert [r.v for r in sorted(got, key=lambda r: int(r.n))] == texts
