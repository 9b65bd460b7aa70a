"""Tests for the findings of round 4: what a stored batch reads and joins."""

import pytest
from probita.operators import timeline
from probita.plans import catalogue, warehouse
from probita.plans.stage import materialized
from probita.sources import lake
from pyspark.sql import functions as F

from .test_catalogue import DIR
from .test_growth_r03 import plan
from .test_warehouse import filed, person, rebuilt, same


def test_new_parts_are_not_joined_with_dead_keys(spark, tmp_path):
    store = lake.Lake(spark, f"file://{tmp_path}/store", {"t": lake.Table(("k",), "g", ("k",))})
    for n in (50, 10):
        draft = store.draft()
        draft.kill("g", spark.range(n).selectExpr("id AS k"))
        draft.put("t", spark.range(n).selectExpr("id AS k", f"{n} AS v"))
        assert "Join" not in plan(draft.fresh("t")) and draft.fresh("t").count() == n
        assert plan(draft.read("t")).count("LeftAnti") == (n == 10)
        draft.publish()
    state, keys = store.current(), spark.range(5, 15).selectExpr("id AS k")
    assert {(r.k, r.v) for r in state.read("t", keys).collect()} == {(k, 10 if k < 10 else 50) for k in range(5, 15)}
    for p in state.parts("t") + state.parts("dead_g"):
        p.pop("batches")  # manifests of earlier code don't say
    assert {(r.k, r.v) for r in state.read("t").collect()} == {(k, 10 if k < 10 else 50) for k in range(50)}
    assert lake.compact(store, full=True) and store.current().parts("t")[0]["batches"] == [1, 2]


def test_timelines_in_one_pass(spark):
    """Equal to the timelines of snapshots, without a join and with one shuffle."""
    c = catalogue.Context(spark, DIR)
    df = materialized(c.yearly, "features")
    df = df.unionByName(df.filter("user_declarant_id % 7 = 0").withColumns({"declaration_id": F.concat("declaration_id", F.lit("x")), "declaration_year": F.lit(None).cast("int"), "lastname": F.lit("of no year")}))
    rows = materialized(warehouse.filings(df, c.t_once), "filings")
    got = timeline.in_one_pass(rows)
    assert "Join" not in plan(got) and plan(got).count("Exchange") == 1
    same(got, timeline.timelines(df, c.t_once, lambda snaps: materialized(snaps, "snapshots")))


@pytest.fixture
def house(spark, tmp_path):
    return warehouse.Warehouse(spark, f"file://{tmp_path}/w")


def test_batches_are_filters(spark, monkeypatch):
    """The two batches of the stored queries: no section is joined with the profile to find its rows, and together they have all of them."""
    seen = []
    monkeypatch.setattr(warehouse.Warehouse, "apply_tables", lambda self, t, number: seen.append(t))
    monkeypatch.setattr("probita.plans.engine.Engine.open", lambda spark, root: None)
    c = catalogue.Context(spark, DIR)
    catalogue._in_batches(c)
    first, second = seen
    for name in ("profile", "incomes", "real_estate", "monetary", "vehicles"):
        assert "Join" not in plan(getattr(second, name))
    ids = lambda which: c.t_once.profile.filter(which).select("declaration_id")
    same(first.profile.select("declaration_id"), ids("declaration_year < 1996 OR user_declarant_id % 5 = 0"))
    same(second.profile.select("declaration_id"), ids("declaration_year >= 1996 OR user_declarant_id % 5 = 0"))
    same(second.accounts, c.t_once.accounts.join(second.profile.select("declaration_id"), "declaration_id", "left_semi"))


def test_a_batch_reads_no_older_sections(spark, house, monkeypatch):
    """Features and timelines are made of what the batch has put and of the filings of its persons."""
    house.apply(filed(spark, ("a", person(1, 2020, 5, 5)), ("b", person(2, 2020, 6, 6))), 0)
    read, real = [], lake.Snapshot.read
    monkeypatch.setattr(lake.Snapshot, "read", lambda self, name, *a, **k: read.append(name) or real(self, name, *a, **k))
    house.apply(filed(spark, ("c", person(1, 2020, 7, 7)), ("d", person(1, 2021, 7, 900_000))), 1)
    assert sorted(read) == ["cohort_counts", "features", "filings"]


def test_a_store_without_filings(spark, house, monkeypatch):
    """One that earlier code has written gets them with its next batch."""
    first = [(str(u), person(u, 2020, 1000 * u, 900_000)) for u in range(1, 4)]
    second = [("late", person(2, 2021, 5, 3_000_000)), ("corrected", person(1, 2020, 77, 5_000_000))]
    house.apply(filed(spark, *first), 0)
    real = lake.Lake.current

    def without(self, version=None):
        state = real(self, version)
        if state.manifest["version"] == 1:
            state.manifest["tables"].pop("filings", None)
        return state

    with monkeypatch.context() as m:
        m.setattr(lake.Lake, "current", without)
        state = house.apply(filed(spark, *second), 1)
    t, wide = rebuilt(spark, {d["id"]: (p, d) for p, d in first + second}.values())
    wide = materialized(wide, "test-wide")
    same(state.read("timelines"), timeline.timelines(wide, t, lambda snaps: materialized(snaps, "snapshots")))
    same(state.read("filings"), warehouse.filings(wide, t).select(state.read("filings").columns))
