import json

from probita.operators import features, rules, timeline
from probita.operators.sections import normalised, parsed
from probita.sources import raw, rest
from probita.streaming.ingest import ingest

DOC = {
    "id": "fx-001", "declaration_year": 2024, "declaration_type": 1, "user_declarant_id": 501,
    "data": {
        "step_1": {"data": {"firstname": "Test", "lastname": "Person", "workPost": "Clerk", "postType": "A", "country": "1"}},
        "step_2": {"isNotApplicable": 0, "data": [{"id": 77001, "subjectRelation": "дружина", "firstname": "Fam", "lastname": "Person"}]},
        "step_3": {"data": [{"objectType": "Квартира", "totalArea": "52,5", "cost_date_assessment": "900 000", "owningDate": "01.02.2024", "iteration": "10",
                             "rights": [{"ownershipType": "X", "percent-ownership": "50", "rightBelongs": "1"}, {"ownershipType": "X", "percent-ownership": "50", "rightBelongs": "77001"}]}]},
        "step_11": {"data": [{"objectType": "Salary", "sizeIncome": "300000", "person_who_care": [{"person": "1"}], "iteration": "20"}]},
        "step_12": {"data": [{"objectType": "Готівкові кошти", "sizeAssets": "10000", "assetsCurrency": "USD (Долар США)", "organization": "[Не застосовується]", "organization_extendedstatus": "1", "rights": [{"ownershipType": "X", "rightBelongs": "1"}], "iteration": "30"}]},
    },
}


def docs(spark, *ds):
    return parsed(spark.createDataFrame([(json.dumps(d, ensure_ascii=False),) for d in ds], "value string"))


def doc(**steps):
    return {"id": "d", "declaration_year": 2024, "user_declarant_id": 1, "data": {k: {"isNotApplicable": 0, "data": v} for k, v in steps.items()}}


def test_sample_document(spark):
    t = normalised(docs(spark, DOC))
    assert sorted(r.right_belongs_resolved for r in t.real_estate.collect()) == ["declarant", "дружина (Fam Person)"]
    w = features.wide(t)
    f = w.first()
    assert (float(f.total_income), float(f.cash), f.bank, float(f.total_assets), float(f.largest_acquisition)) == (300000, 370000, None, 2170000, 900000)
    assert (f.fields, f.unknown_fields, f.confidential_ratio) == (7, 1, 0)
    s = rules.scored(rules.declaration_hits(w)).first()
    assert [(h.rule, h.score) for h in s.hits] == [("cash_to_bank_ratio", 1.0), ("CR3", 6.75)]
    assert s.raw_total_score == 7.75 and s.total_score == 47.58
    assert normalised(docs(spark, DOC), dedupe_property=True).real_estate.count() == 1


def test_guards_and_shapes(spark):
    none = doc(step_11=[{"sizeIncome": "1"}])
    none["data"]["step_11"]["isNotApplicable"] = 1
    assert normalised(docs(spark, none)).incomes.count() == 0
    assert normalised(docs(spark, doc(step_3={"a": {"objectType": "x"}}))).real_estate.count() == 0  # an object is no list here
    t = normalised(docs(spark, doc(step_6={"a": {"brand": "BMW", "costDate": "5"}, "b": 3, "c": {"empty": True}}, step_17=[
        {"establishment_ua_company_name": "Bank", "persons_has_accounts": {"k": {"person_has_account": "1"}}}, {"establishment_ua_company_name": "B2", "person_who_care": [{"person": "j"}]}])))
    assert t.vehicles.filter("brand = 'BMW'").count() == 1
    assert sorted(r.account_owner_resolved for r in t.accounts.collect()) == ["declarant", "third_party"]


def test_rights(spark):
    item = lambda *r: {"objectType": "x", "rights": [{"rightBelongs": v} if v else {} for v in r]}
    got = normalised(docs(spark, doc(step_3=[item(), item("1", "j"), item("9"), item(None)]))).real_estate.orderBy("pos").collect()
    assert [r.right_belongs_resolved for r in got] == [None, "declarant", "third_party", "unknown:9", "unknown:"]


def test_all_sources_and_rights_beyond_the_first(spark):
    many = {"sources": [{"source_ua_company_name": f"s{i}"} for i in range(1500)]}, {"rights": [{"rightBelongs": f"r{i}"} for i in range(1500)]}
    t = normalised(docs(spark, doc(step_11=[many[0], {"sources": []}, {}], step_12=[many[1], {"rights": []}, {}])))
    sources, rights = ([r[0] for r in d.orderBy("pos").collect()] for d in (t.incomes.select("extra_sources", "pos"), t.monetary.select("extra_rights", "pos")))
    assert [[x.source_name for x in r] for r in sources] == [[f"s{i}" for i in range(1, 1500)], [], []]
    assert [[x.person_ref for x in r] for r in rights] == [[f"r{i}" for i in range(1, 1500)], [], []]


def test_store_is_idempotent(spark, tmp_path):
    one = spark.createDataFrame([(json.dumps(DOC),)], "value string")
    base = f"file://{tmp_path}/store"
    raw.store(one, base)
    raw.store(one, base)
    assert raw.stored(spark, base).count() == 1 and raw.stored(spark, base).first().filed == "2024"
    raw.store(one, base, overwrite=True)
    assert raw.stored(spark, base).count() == 1 and raw.has_rows(spark, base) and not raw.has_rows(spark, base + "x")


def test_swap_survives_a_crash(spark, tmp_path):
    """A store moved aside by a swap that was cut off comes back before it is read or written."""
    base = f"file://{tmp_path}/store"
    raw.store(spark.createDataFrame([(json.dumps(DOC),)], "value string"), base)
    (tmp_path / "store").rename(tmp_path / "store__old")
    raw.store(spark.createDataFrame([(json.dumps(DOC | {"id": "b"}),)], "value string"), base, overwrite=True)
    assert sorted(r.declaration_id for r in raw.stored(spark, base).collect()) == ["b", "fx-001"] and not (tmp_path / "store__old").exists()


def test_text_sink(spark, tmp_path):
    """Typed and nested columns as texts."""
    rows = spark.createDataFrame([(1, 2.5, ["a", None], None), (2, None, [], (3, "x"))], "n int, v double, xs array<string>, s struct<a: int, b: string>")
    raw.export_table(rows, f"file://{tmp_path}/t")
    got = spark.read.option("header", True).csv(f"file://{tmp_path}/t").orderBy("n").collect()
    assert [tuple(r) for r in got] == [("1", "2.5", '["a",null]', None), ("2", None, "[]", '{"a":3,"b":"x"}')]


def test_years_through_the_front(spark, tmp_path):
    """Only the folder of a year is read: a document of another year there that can't be read doesn't matter."""
    from probita.plans.engine import Engine

    for year in (2023, 2024):
        (tmp_path / str(year)).mkdir()
        (tmp_path / str(year) / "declaration_1.json").write_text(json.dumps(DOC | {"id": f"y{year}", "declaration_year": year}))
    e = Engine.from_documents(spark, str(tmp_path), 2023)
    assert [r.declaration_id for r in e.tables.profile.collect()] == ["y2023"]
    assert all("/2023/" in f for f in raw.scan(spark, str(tmp_path), 2023).inputFiles())


def test_documents_in_order_of_paths(spark, tmp_path):
    for year, i in ((2024, 1), (2023, 2), (2023, 1)):
        (tmp_path / str(year)).mkdir(exist_ok=True)
        (tmp_path / str(year) / f"declaration_{i}.json").write_text(json.dumps(DOC | {"id": f"{year}-{i}"}))
    got = raw.in_order(raw.documents(spark, str(tmp_path)))
    assert [r.declaration_id for r in got.collect()] == ["2023-1", "2023-2", "2024-1"]
    assert raw.documents(spark, str(tmp_path), 2023).count() == 2


def test_stored_documents_before_raw_ones(spark, tmp_path):
    (tmp_path / "declaration_1.json").write_text(json.dumps(DOC))
    base = f"file://{tmp_path}/store"
    assert raw.table_or_raw(spark, base, str(tmp_path)).first().declaration_id == "fx-001"
    raw.store(spark.createDataFrame([(json.dumps(DOC | {"id": "kept"}),)], "value string"), base)
    assert raw.table_or_raw(spark, base, str(tmp_path)).first().declaration_id == "kept"


def test_single_csv_has_a_byte_order_mark(tmp_path):
    raw.export_single_csv([("й", 1)], ["name", "n"], str(tmp_path / "top.csv"))
    assert (tmp_path / "top.csv").read_bytes() == "\ufeffname,n\r\nй,1\r\n".encode()


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "raw" / "2024"
    src.mkdir(parents=True)
    for i in range(3):
        (src / f"declaration_{i}.json").write_text(json.dumps(DOC | {"id": f"x{i}"}))
    (src / "declaration_bad.json").write_text("{oops")
    out, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/ckpt"
    ingest(spark, str(tmp_path / "raw"), out, mark)
    (src / "declaration_9.json").write_text(json.dumps(DOC | {"id": "x0", "declaration_year": 2023}))
    state = ingest(spark, str(tmp_path / "raw"), out, mark).lake.current()
    assert state.read("profile").count() == 3 and state.read("real_estate").count() == 6
    assert state.read("profile").filter("declaration_year = 2023").count() == 1
    bad = state.read("quarantine").collect()
    assert [(r.value, r.reason, r.path.rsplit("/", 1)[1]) for r in bad] == [("{oops", "unreadable", "declaration_bad.json")]
    assert raw.documents(spark, str(tmp_path / "raw"), 2024).count() == 5 and raw.scan(spark, str(tmp_path / "none")).count() == 0


def test_rest_pages():
    calls = []

    def fetch(url, params):
        calls.append(params["page"])
        if params["page"] == 2 and calls.count(2) == 1:
            raise OSError("once")
        return {"data": [{"id": i} for i in range(100 if params["page"] < 3 else 7)]}

    assert [(p, len(x)) for p, x in rest.pages(fetch, "u", {}, pause=0)] == [(1, 100), (2, 100), (3, 7)]
    assert calls == [1, 2, 2, 3]


def test_client_errors_are_not_tried_again():
    import urllib.error

    calls = []

    def fetch(url, params):
        calls.append(url)
        raise urllib.error.HTTPError(url, 404 if url == "gone" else 503, "", None, None)

    for url, n in (("gone", 1), ("busy", 3)):
        calls.clear()
        try:
            rest.tried(fetch, url, {}, 0)
        except urllib.error.HTTPError:
            assert len(calls) == n


def person(spark, *years):
    return normalised(docs(spark, *[doc_year(*y) for y in years]))


def doc_year(year, income, cost, kind=1, n=0, role="a"):
    d = doc(step_3=[{"objectType": "Квартира", "city": "x", "cost_date_assessment": str(cost), "rights": [{"rightBelongs": "1"}]}], step_11=[{"objectType": "gift", "sizeIncome": str(income)}])
    d["data"]["step_1"] = {"data": {"workPost": role}}
    return d | {"id": f"{year}-{n}", "declaration_year": year, "declaration_type": kind}


def test_timeline_rules(spark):
    t = person(spark, (2020, 100000, 10), (2021, 100000, 10), (2022, 100000, 2_000_000), (2022, 5, 1, 1, 1), (2022, 5, 1, 1, 2))
    w = features.wide(t)
    assert {r.year: r["estate"] for r in timeline.snapshots(w, t).collect()}[2022] == 2_000_000  # the first stays on ties
    got = timeline.timelines(w, t).first()
    assert got.max_declarations == 3 and got.BR1 == 1.6 and got.CR15 == 4.8 and got.CR5 == 6.75 and got.CR14 == 6.0
    gap = person(spark, (2018, 10, 5), (2021, 50, 5), (2022, 1, 1, 3))
    assert timeline.changes(timeline.snapshots(features.wide(gap), gap)).select("from_year", "to_year").collect() == [(2018, 2021)]
