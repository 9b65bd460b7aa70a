import duckdb
import pytest

from probita.operators import cohorts, serving
from probita.plans import catalogue

DIR = "/root/testdata/sf0.001"
FAST = ["placeholder_status", "safe_number", "currency_code", "year_extract", "owner_resolution", "cash_bank_split", "ownership_summary", "legacy_score", "cr3_acquisition", "cr12_concentration", "declaration_score", "cohort_percentile_rank", "cr16_outliers", "yoy_changes", "timeline_score", "list_page", "rule_distribution", "property_regroup", "document_profile", "document_vehicles", "document_monetary", "document_accounts", "document_keys", "sanitized_documents", "explanations", "rules_text_array", "combined_score", "timeline_names", "income_recipients", "asset_turnover", "timeline_explanations", "cr12_person", "rule_labels", "stored_combined_score", "search_by_trigrams", "list_page_ranges"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(cols, got):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(repr(tuple(round(float(r[i]), 9) if isinstance(r[i], float) else r[i] for i in order)) for r in got)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cur = duck.execute(catalogue.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_ranks_are_exact(spark):
    import random

    random.seed(3)
    vals = [random.choice([1.0, 2.0, 2.0, 7.0, random.random() * 9]) for _ in range(700)]
    df = spark.createDataFrame([("a", 2000, v) for v in vals], "post_type string, declaration_year int, income double")
    got = {r.income: r.upto for r in cohorts.ranked(df, "income").collect()}
    assert got == {v: sum(x <= v for x in vals) for v in set(vals)}


def test_limits():
    with pytest.raises(ValueError):
        serving.checked(limit=201)
    with pytest.raises(ValueError):
        serving.checked(offset=-1)
    assert serving.page_count(0) == 1 and serving.page_count(101) == 3
