"""Tests for the findings of round 3 on time and memory at size."""

import pytest

from probita.operators import cohorts, features, timeline
from probita.plans import catalogue

from .test_catalogue import DIR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """(tag, columns) of the tables that a query of the catalogue writes."""
    seen, real = [], catalogue.materialized
    monkeypatch.setattr(catalogue, "materialized", lambda df, tag: seen.append((tag, df.columns)) or real(df, tag))
    return seen


def test_timelines_write_snapshots_only(spark, written):
    c = catalogue.Context(spark, DIR)
    df = c.timelines()
    assert [tag for tag, _ in written] == ["snapshots"] and "BroadcastHashJoin" not in plan(df)
    for part in (timeline.per_year, timeline.names):
        assert "Join" not in plan(part(c.yearly))  # the profile alone


def test_texts_are_lowered_before_the_shuffle(spark):
    c = catalogue.Context(spark, DIR)
    for part in ("incomes", "monetary", "real_estate", "vehicles"):
        text = plan(features.PARTS[part](c.t_once))
        last = max(text.find(x) for x in ("HashAggregate", "SortAggregate"))
        assert "lower(" in text and "lower(" not in text[last : text.find("SortMergeJoin")]


def test_layer2_writes_what_it_compares(spark, written):
    catalogue.QUERIES["layer2_scores"](spark, DIR)
    assert written == [("scores", ["declaration_id", "total_score", *cohorts.COMPARED])]


def test_a_search_by_name_aggregates_the_found_declarations_only(spark):
    assert plan(catalogue.QUERIES["list_search"](spark, DIR)).count("LeftSemi") >= 7


def test_many_keys_of_a_store_are_merged_not_broadcast(spark, tmp_path):
    from probita.sources import lake

    store = lake.Lake(spark, f"file://{tmp_path}/store", {"t": lake.Table(("k",), "g", ("k",))})
    draft = store.draft()
    draft.put("t", spark.range(50).selectExpr("id AS k"))
    draft.publish()
    draft = store.draft()
    draft.kill("g", spark.range(10).selectExpr("id AS k"))
    draft.put("t", spark.range(5).selectExpr("id AS k"))
    state, keys = draft.publish(), spark.range(8, 20).selectExpr("id AS k")
    state.rows = lambda name: lake.BROADCAST_ROWS + 1
    df = state.read("t", keys)
    assert "Broadcast" not in plan(df) and sorted(r.k for r in df.collect()) == list(range(10, 20))
    assert sorted(r.k for r in state.read("t").collect()) == [*range(5), *range(10, 50)]


def test_combined_score_writes_hits_and_what_peers_compare(spark, written):
    df = catalogue.QUERIES["combined_score"](spark, DIR)
    assert written == [("hits", ["declaration_id", *cohorts.COMPARED, "cash", "stem_cash", "fx_cash", "hits"])]
    assert "/cuts-" in plan(df) and "SortMergeJoin" not in plan(df)  # no declarations are shuffled by their cohort


def test_wanted_features_go_through_joins_as_structs(spark):
    df = catalogue.Context(spark, DIR).features("incomes monetary", "total_income one_off cash n_monetary")
    got = df.select("declaration_id", "total_income", "one_off", "cash", "n_monetary")
    text = plan(got)
    assert "n_sources" not in df.columns and all(x in text.split("SortMergeJoin")[0] for x in (".total_income AS", ".n_monetary"))  # taken out above the joins
    whole = catalogue.Context(spark, DIR).features("incomes monetary").select(got.columns)
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()


def test_conditions_are_not_evaluated_in_a_filter_over_an_array(spark):
    from probita.operators import rules

    assert "filter(" not in str(rules.hits(rules.conditions(), [(6, rules.cash_hit())]))
