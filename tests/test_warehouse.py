"""The versioned store, the warehouse over it, and the crawl into it."""

import json
import os
from pathlib import Path

import pytest
from probita.operators import cohorts, features, rules, timeline
from probita.operators.sections import normalised, parsed
from probita.plans.engine import Engine
from probita.plans.stage import materialized
from probita.plans.warehouse import ID, PERSON, SECTIONS, Warehouse
from probita.sources import lake as store
from probita.sources.crawl import Crawl
from pyspark.sql import functions as F
from tests import fake_api
from tests.test_documents import DOC, doc_year

TABLES = {"t": store.Table(("id",), "id", ("id",)), "u": store.Table(("id",), "id", ("id",)), "sums": store.Table(("k",), summed="c")}


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, n int")


def taken(state, name="t"):
    df = state.read(name)
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r)) if df is not None else None


def commit(lake, df, names=("t", "u"), n=0):
    draft = lake.draft()
    draft.kill("id", df.select("id"), n)
    for name in names:
        draft.put(name, df, n)
    return draft.publish()


def test_versions_and_replacement(spark, tmp_path):
    lake = store.Lake(spark, f"file://{tmp_path}", TABLES)
    assert lake.current().read("t") is None and lake.versions() == []
    commit(lake, rows(spark, ("a", 1), ("a", 2), ("b", 3), (None, 4)))
    commit(lake, rows(spark, ("a", 9), (None, 5)))
    assert taken(lake.current()) == taken(lake.current(), "u")
    assert sorted(lake.current().read("t").collect(), key=repr) == sorted([("a", 9), ("b", 3), (None, 5)], key=repr)
    assert len(lake.current(1).read("t").collect()) == 4  # the version before is still there
    other = lake.draft()
    commit(lake, rows(spark, ("c", 1)))
    other.put("t", rows(spark, ("x", 1)))
    with pytest.raises(Exception, match="exist"):
        other.publish()  # another writer was first
    with pytest.raises(ValueError):
        lake.draft().put("t", rows(spark, ("a", 1)).withColumn("_batch", F.lit(1)))


def test_every_step_cut_off_leaves_one_whole_version(spark, tmp_path, monkeypatch):
    lake = store.Lake(spark, f"file://{tmp_path}", TABLES)
    commit(lake, rows(spark, *[(f"k{i}", 0) for i in range(50)]))
    before = taken(lake.current())
    for step in ("_write", "_write_aside", "_rename"):
        for nth in range(3 if step == "_write" else 1):  # three parts are written
            left = [nth]
            kind = store.Draft if step == "_write" else store.Lake
            real = getattr(kind, step)

            def cut(self, *a, left=left, real=real):
                if not left[0]:
                    raise OSError("cut off")
                left[0] -= 1
                return real(self, *a)

            with monkeypatch.context() as m:
                m.setattr(kind, step, cut)
                with pytest.raises(OSError):
                    commit(lake, rows(spark, ("k1", 7), ("new", 7)))
            fresh = store.Lake(spark, f"file://{tmp_path}", TABLES).current()
            assert taken(fresh) == taken(fresh, "u") == before
    commit(lake, rows(spark, ("k1", 7), ("new", 7)))
    assert ("k1", 7) in taken(lake.current()) and len(taken(lake.current())) == 51
    lake.vacuum(1)
    assert len(os.listdir(tmp_path / "data" / "t")) == 2 and len(taken(lake.current())) == 51


def files_read(df):
    """Files that the scans of a plan are left with after pruning."""
    out, todo = 0, [df._jdf.queryExecution().sparkPlan()]
    while todo:
        p = todo.pop()
        if "FileSourceScanExec" in p.getClass().getSimpleName():
            out += int(p.selectedPartitions().totalNumberOfFiles())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def files(tmp_path):
    return {p for p in Path(tmp_path).rglob("*.parquet")}


def test_small_batches_touch_few_files(spark, tmp_path, monkeypatch):
    """A batch of 1% of the keys writes under 5% of the files and rewrites none; a lookup of few keys reads their buckets only."""
    monkeypatch.setattr(store, "ROWS_A_BUCKET", 50)
    lake = store.Lake(spark, f"file://{tmp_path}", TABLES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    commit(lake, spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("n")), n=5000)
    before = files(tmp_path)
    commit(lake, spark.range(0, 5000, 100).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("n")), n=50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    new = files(tmp_path) - before
    assert before <= files(tmp_path) and len(before) >= 300 and len(new) < 0.05 * len(before)
    state = lake.current()
    one = state.read("t", where={"id": "4200"})
    assert [tuple(r) for r in one.collect()] == [("4200", 1)] and files_read(one) <= 6  # a bucket of each part, and of the dead keys for each
    some = state.read("t", spark.createDataFrame([("7",), ("100",), ("none",)], "id string"))
    assert sorted(map(tuple, some.collect())) == [("100", 1), ("7", 0)] and files_read(some) <= 16
    assert state.read("t").filter("n = 1").count() == 50 and state.read("t").count() == 5000


def test_merging(spark, tmp_path):
    lake = store.Lake(spark, f"file://{tmp_path}", TABLES)
    for i in range(9):
        draft = lake.draft()
        batch = rows(spark, (f"k{i}", i), ("hot", i))
        draft.kill("id", batch.select("id"))
        draft.put("t", batch)
        draft.put("sums", spark.createDataFrame([("x", 1), ("y", 1 if i % 2 else -1)], "k string, c long"))
        draft.merge()
        draft.publish()
    state = lake.current()
    assert len(state.parts("t")) <= 5 and taken(state) == sorted([("hot", 8), *[(f"k{i}", i) for i in range(9)]])
    assert {r.k: r.c for r in state.read("sums").groupBy("k").agg(F.sum("c").alias("c")).collect()} == {"x": 9, "y": -1}
    assert store.compact(lake, full=True)
    state = lake.current()
    assert len(state.parts("t")) == 1 and state.rows("t") == 10 and state.parts("dead_id") == [] and taken(state)[0] == ("hot", 8)
    commit(lake, rows(spark, ("hot", 99)), ("t",))
    assert taken(lake.current())[0] == ("hot", 99) and lake.vacuum(1) > 0 and len(taken(lake.current())) == 10


def test_empty_batches(spark, tmp_path):
    lake = store.Lake(spark, f"file://{tmp_path}", TABLES)
    commit(lake, rows(spark))
    assert taken(lake.current()) == [] and lake.current().read("t", where={"id": "a"}).count() == 0
    commit(lake, rows(spark, ("a", 1)))
    assert taken(lake.current()) == [("a", 1)]


# the warehouse


def filed(spark, *docs):
    """(value, path) rows of documents, given as (path, document or text)."""
    return spark.createDataFrame([(d if isinstance(d, str) or d is None else json.dumps(d), p) for p, d in docs], "value string, path string")


def person(uid, year, income, cost, n=0, **more):
    d = doc_year(year, income, cost, n=n)
    d["data"]["step_1"] = {"data": {"workPost": "a", "postType": f"kind {uid % 2}", "firstname": "P", "lastname": str(uid)}}
    return d | {"id": f"{uid}-{year}-{n}", "user_declarant_id": uid, **more}


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    key = lambda df: sorted(map(repr, df.select(*names).collect()))
    assert key(a) == key(b)


def rebuilt(spark, docs):
    t = normalised(parsed(filed(spark, *docs)))
    return t, features.wide(t)


def test_warehouse_equals_a_rebuild(spark, tmp_path):
    """After late and corrected declarations (one moves to another person and cohort) all is as if made at once."""
    first = [(f"p{u}-{y}", person(u, y, 1000 * u + y, 900_000 + 50_000 * u * (y - 2019))) for u in range(1, 9) for y in (2020, 2022)]
    second = [("late", person(3, 2021, 5, 3_000_000)), ("corrected", person(4, 2022, 77, 5_000_000)), ("new", person(20, 2022, 9, 9)), ("nobody", person(5, 2023, 1, 1) | {"user_declarant_id": None}), ("moved", person(5, 2020, 4242, 1) | {"user_declarant_id": 8})]
    house = Warehouse(spark, f"file://{tmp_path}/w")
    house.apply(filed(spark, *first), 0)
    state = house.apply(filed(spark, *second), 1)
    version = house.lake.versions()[-1]
    house.apply(filed(spark, *first), 1)  # a repeated batch
    assert house.lake.versions()[-1] == version
    t, wide = rebuilt(spark, {d["id"]: (p, d) for p, d in first + second}.values())
    wide = materialized(wide, "test-wide")
    lines = materialized(timeline.timelines(wide, t), "test-timelines")
    for name in SECTIONS:
        same(state.read(name), getattr(t, name))
    same(state.read("features"), wide)
    same(state.read("timelines"), lines)
    same(state.read("cohort_cuts"), cohorts.cuts(cohorts.members(wide)))
    same(house.histogram(state), cohorts.measures(cohorts.members(wide)).groupBy("post_type", "declaration_year", "measure", "v").agg(F.count(F.lit(1)).alias("c")))
    assert house.compact(full=True) and house.vacuum(1) > 0
    e = Engine.open(spark, f"file://{tmp_path}/w")
    same(e.timelines, lines)
    same(e.scores.drop("rule_details_json", "hits"), rules.scored(rules.declaration_hits(cohorts.with_cuts(wide), with_cohort=True)).drop("hits"))
    same(e.layer2(), cohorts.layer2(wide))
    same(e.person_timeline(4), lines.filter(F.col(PERSON) == 4))
    assert e.declaration("3-2021-0").first().total_score == e.scores.filter(F.col(ID) == "3-2021-0").first().total_score
    same(e.sections_of(8).incomes, t.incomes.join(t.profile.filter(F.col(PERSON) == 8).select(ID), ID, "left_semi"))
    with pytest.raises(ValueError):
        Engine.open(spark, f"file://{tmp_path}/none")


def test_a_cut_off_batch_shows_nothing(spark, tmp_path, monkeypatch):
    """Whatever part of a batch was written before it was cut off, all tables stay at the last commit."""
    house = Warehouse(spark, f"file://{tmp_path}/w")
    house.apply(filed(spark, ("a", person(1, 2020, 5, 5))), 0)
    real, seen = store.Draft._write, []
    for cut in (3, 14):
        left = [cut]

        def write(self, *a, left=left):
            if not left[0]:
                raise OSError("cut off")
            left[0] -= 1
            return real(self, *a)

        with monkeypatch.context() as m:
            m.setattr(store.Draft, "_write", write)
            with pytest.raises(OSError):
                house.apply(filed(spark, ("b", person(1, 2020, 6, 6)), ("c", person(2, 2020, 6, 6))), 1)
        state = Warehouse(spark, f"file://{tmp_path}/w").lake.current()
        seen.append([state.read(n).count() for n in ("profile", "incomes", "features", "timelines", "ingested")])
    assert seen == [[1, 1, 1, 1, 1]] * 2
    state = house.apply(filed(spark, ("b", person(1, 2020, 6, 6)), ("c", person(2, 2020, 6, 6))), 1)
    assert [state.read(n).count() for n in ("profile", "incomes", "features", "timelines", "ingested")] == [2, 2, 2, 2, 2]


def test_no_document_is_lost(spark, tmp_path):
    """Broken, id-less and repeated documents: counts add up, all odd ones are kept with path and text, the least path of an id counts."""
    no_id = {k: v for k, v in DOC.items() if k not in ("id", "doc_id")}
    batch = [("3", "{oops"), ("1", "{oops"), ("2", ""), ("4", no_id), ("5", no_id), ("9", person(1, 2020, 1, 1)), ("7", person(1, 2020, 2, 2)), ("8", person(1, 2020, 3, 3)), ("6", person(2, 2020, 1, 1)), ("n", None)]
    house = Warehouse(spark, f"file://{tmp_path}/w")
    state = house.apply(filed(spark, *batch), 0)
    one = state.read("ingested").first()
    assert (one.fetched, one.saved, one.repeated, one.unreadable, one.without_id) == (10, 2, 2, 4, 2)
    odd = {(r.path, r.value, r.reason) for r in state.read("quarantine").collect()}
    assert odd == {("3", "{oops", "unreadable"), ("1", "{oops", "unreadable"), ("2", "", "unreadable"), ("n", None, "unreadable"), ("4", json.dumps(no_id), "without_id"), ("5", json.dumps(no_id), "without_id")}
    assert {r.path for r in state.read("documents").collect()} == {"7", "6"}
    assert state.read("incomes").filter("declaration_id = '1-2020-0'").first().amount == 2


def test_few_scans_for_one_person(spark, tmp_path, monkeypatch):
    """One person's timeline and sections read a few of many buckets."""
    monkeypatch.setattr(store, "ROWS_A_BUCKET", 4)
    house = Warehouse(spark, f"file://{tmp_path}/w")
    house.apply(filed(spark, *[(str(u), person(u, 2020 + u % 2, u, u)) for u in range(1, 130)]), 0)
    e = Engine.open(spark, f"file://{tmp_path}/w")
    assert e.state.parts("timelines")[0]["buckets"] >= 32
    total = {name: files_read(e.state.read(name)) for name in ("timelines", "profile", "incomes", "real_estate")}
    assert min(total.values()) >= 25
    assert files_read(e.person_timeline(7)) <= 2
    for name, rows_ in vars(e.sections_of(7)).items():
        if name in total:
            assert files_read(rows_) <= 2  # and that of the person's ids


# the crawl


def api(base, pages, **more):
    base.mkdir(exist_ok=True)
    (base / "pages.json").write_text(json.dumps({"pages": pages, "document": DOC, **more}))


@pytest.fixture
def texts_only(monkeypatch):
    """Batches keep texts and profiles only: what is made of them is tested above."""

    def replace(self, draft, t, n, also):
        for name, rows_ in {**also, "profile": t.profile}.items():
            draft.put(name, rows_, n)

    monkeypatch.setattr(Warehouse, "_replace", replace)


def crawl_of(spark, tmp_path, **how):
    return Crawl(Warehouse(spark, f"file://{tmp_path}/w"), str(tmp_path / "api"), 2024, f"file://{tmp_path}/ck", fetch="tests.fake_api:fetch", pause=0, **how)


def test_crawl(spark, tmp_path, texts_only):
    """Pages once each, known ids not fetched, failures kept and tried again, items without id counted."""
    full = lambda p: [{"id": f"d{p}-{i}"} for i in range(100)]
    pages = {"1": [*full(1)[:98], {"name": "no id"}, {"id": "d1-0"}], "2": full(2), "3": [{"id": "d3-0"}, {"id": "d3-1"}]}
    api(tmp_path / "api", pages, down=["d1-5"], broken=["d3-1"])
    c = crawl_of(spark, tmp_path, pages_a_batch=1)
    assert c.run(max_docs=50) == 97  # stops after the first batch
    c = crawl_of(spark, tmp_path, pages_a_batch=2)
    assert [tuple(r) for r in c.failed().select("id", "page").collect()] == [("d1-5", 1)]
    done = fake_api.asked(tmp_path / "api")
    assert done.count("d1-0@None") == 1 and done.count("d1-5@None") == 3  # tries
    assert c.run() == 101
    assert {r.id for r in c.failed().collect()} == {"d1-5", "d3-1"}
    state = c.house.lake.current()
    assert state.read("documents").count() == 97 + 101 and state.read("profile").count() == 198
    got = {r.last_page: (r.listed, r.fetched, r.failed, r.without_id) for r in c.counts().filter("batch >= 0").collect()}
    assert got == {1: (99, 97, 1, 1), 3: (102, 101, 1, 0)}
    api(tmp_path / "api", pages)  # all is well now; a new round begins at page 1
    before = fake_api.asked(tmp_path / "api")
    assert c.run() == 2 and c.failed().count() == 0 and c.house.lake.current().read("documents").count() == 200
    after = fake_api.asked(tmp_path / "api")
    assert len([x for x in after if not x.startswith("list")]) - len([x for x in before if not x.startswith("list")]) == 2


def test_crawl_goes_on_after_failed_pages_and_kills(spark, tmp_path, texts_only, monkeypatch):
    pages = {str(p): [{"id": f"d{p}-{i}"} for i in range(100 if p < 3 else 3)] for p in range(1, 4)}
    api(tmp_path / "api", pages, down=["2"])
    c = crawl_of(spark, tmp_path, pages_a_batch=5)
    real = store.Draft.publish

    def killed(self):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(store.Draft, "publish", killed)
        with pytest.raises(Exception, match="killed"):
            c.run()
    assert c.counts() is None and real is store.Draft.publish
    c = crawl_of(spark, tmp_path, pages_a_batch=5)
    assert c.run() == 103 and [(r.id, r.page) for r in c.failed().collect()] == [(None, 2)]
    api(tmp_path / "api", pages)
    assert c.run(max_docs=1) == 100 and c.failed().count() == 0
    assert c.house.lake.current().read("documents").count() == 203
