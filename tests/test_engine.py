import json
import random
import re

from probita.functions import fixed
from probita.functions.sanitize import sanitize_json
from probita.plans.engine import Engine
from pyspark.sql import functions as F
from tests.test_documents import DOC


def test_engine_over_documents(spark, tmp_path):
    src = tmp_path / "2024"
    src.mkdir()
    for i in range(3):
        (src / f"declaration_{i}.json").write_text(json.dumps(DOC | {"id": f"x{i}", "user_declarant_id": i + 1}))
    e = Engine.from_documents(spark, str(tmp_path))
    page, total = e.list_declarations(limit=2, query="person")
    assert total == 3 and [r.declaration_id for r in page.collect()] == ["x0", "x1"]
    assert e.stats().first().flagged == 3 and len(e.declaration("x1").first().real_estate) == 2
    assert e.person_timeline(2).first().n_snapshots == 1 and e.layer2().count() == 3
    for _ in range(2):
        e.persist(f"file://{tmp_path}/out")
    assert Engine.open(spark, f"file://{tmp_path}/out").scores.count() == 3
    e.export_csv(f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first().rules == "cash_to_bank_ratio, CR3"


def walked(x):
    """Brute force: the same by walking the parsed tree."""
    if isinstance(x, dict):
        return {k: walked(v) for k, v in x.items()}
    if isinstance(x, list):
        return [walked(v) for v in x]
    if not isinstance(x, str):
        return x
    if x in fixed.PLACEHOLDERS:
        return {"value": None, "status": fixed.PLACEHOLDERS[x]}
    return {"value": None, "status": "redacted_other", "original": x} if re.match(r"^\[.+\]$", x) else x


def test_sanitize(spark):
    """Any nesting, any characters beside brackets, keys that look like placeholders, escapes; no Python in the plan."""
    rng = random.Random(4)
    bits = ["[", "]", '"', "\\", ",", ":", "{", "}", "\n", "\t", "\u0001", "/", "$1", "a", "ї", "😀", " ", *fixed.PLACEHOLDERS]

    def text():
        t = "".join(rng.choices(bits, k=rng.randrange(5)))
        return rng.choice([t, f"[{t}]", f"[{t}]", rng.choice(bits)])

    def tree(depth):
        kind = rng.randrange(6) if depth else 5
        if kind < 2:
            return {text(): tree(depth - 1) for _ in range(rng.randrange(5))}
        if kind < 4:
            return [tree(depth - 1) for _ in range(rng.randrange(5))]
        return rng.choice([text(), text(), text(), None, True, 7, -1.5])

    x = {"a": ["[Не відомо]", {"b": "[щось]"}], "c": 1, "d": "x"}
    trees = [x, "[Не відомо]", "[]\n", "[a]\n", [], {}, "", {"k,": "[x]", "q": '],["[x]",'}, *(tree(5) for _ in range(2000))]
    rows = [(i, json.dumps(t, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, t in enumerate(trees)]
    df = spark.createDataFrame([*rows, (-1, "{bad"), (-2, None), (-3, ""), (-4, '{"a": 1, "a": 2}')], "i int, t string").select("i", sanitize_json(F.col("t")).alias("t"))
    got = {r.i: r.t for r in df.collect()}
    assert [json.loads(got[i]) for i, _ in rows] == [walked(t) for t in trees]
    assert [got[i] for i in (-1, -2, -3, -4)] == [None] * 4
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_report_and_explanations(spark, tmp_path):
    src = tmp_path / "raw"
    src.mkdir()
    for year in (2022, 2023, 2024):
        (src / f"declaration_{year}.json").write_text(json.dumps(DOC | {"id": f"y{year}", "declaration_year": year}))
    e = Engine.from_documents(spark, str(src))
    text = e.report(top=5)
    assert text.splitlines()[0].endswith("501  Test Person") and "over 3 years and 2 changes" in text
    assert e.report(year=2024) == "" and e.report(min_score=100.0) == ""
    e.export_csv(f"file://{tmp_path}/csv")
    got = spark.read.option("header", True).option("multiLine", True).csv(f"file://{tmp_path}/csv").first().explanation
    assert got.splitlines()[0] == "- cash_to_bank_ratio: Cash far above bank deposits (cash 370,000, bank n/a)"
    assert got.splitlines()[1] == "- CR3: Acquisition far above annual income (acquired 900,000, income 300,000)"


def test_trigrams():
    from probita.operators import search

    assert search.needed("Iv_anov%") == ["ano", "nov"] and search.needed("a_7") == [] and search.needed("a_7b", wildcard=False) == ["_7b", "a_7"]
    assert search.needed("x\\%abc") == [] and search.needed("İstanbul") == []


def test_stored_search_and_pages(spark, tmp_path):
    """Search by postings gives the rows of the plain scan; pages of ranges those of the whole order, and read a few ranges only."""
    from probita.operators import serving
    from probita.operators.paging import Listing
    from probita.plans.warehouse import Warehouse
    from tests.test_documents import doc
    from tests.test_warehouse import files_read

    names = ["Ivan Petrenko", "Anna Ivanova", "Olha Li", "ПЕТРО Іваненко", "a%b c_d"]
    docs = []
    for i in range(30):
        d = doc(step_11=[{"objectType": "x", "sizeIncome": str(1000 * (i % 7))}], step_12=[{"objectType": "Готівкові кошти", "sizeAssets": str(90_000 * (i % 5)), "assetsCurrency": "UAH"}])
        first, last = names[i % 5].split(" ")
        d["data"]["step_1"] = {"data": {"firstname": first, "lastname": last, "workPlace": f"Office {i % 3}"}}
        docs.append((json.dumps(d | {"id": f"d{i:02}", "user_declarant_id": i + 1}), f"p{i}"))
    house = Warehouse(spark, f"file://{tmp_path}/w")
    house.apply(spark.createDataFrame(docs[:20], "value string, path string"), 0)
    house.apply(spark.createDataFrame(docs[15:], "value string, path string"), 1)
    e = Engine.open(spark, f"file://{tmp_path}/w")
    scores = e.scores.cache()
    for query, wildcard in (("ivan", True), ("IVANOVA", True), ("n_v%va", True), ("office 1", True), ("petrenko ivan", False), ("ффф", True), ("іван", True), ("%b", True), ("o 1", False)):
        want = {r.declaration_id for r in serving.filtered(scores, query=query, wildcard=wildcard).collect()}
        assert {r.declaration_id for r in e.found(query, wildcard=wildcard).select("declaration_id").collect()} == want, query
    listing = Listing.write(scores, f"file://{tmp_path}/l", "assets", "desc", rows_a_range=4)
    every = [r.declaration_id for r in serving.ordered(scores, "assets", "desc").select("declaration_id").collect()]
    assert listing.total() == 30
    for offset, limit in ((0, 3), (5, 7), (27, 10), (40, 5)):
        assert [r.declaration_id for r in listing.page(offset=offset, limit=limit).collect()] == every[offset : offset + limit]
    assert files_read(listing.page(offset=20, limit=2)) <= 2 < files_read(listing.rows)
    last = listing.page(offset=11, limit=1).first()
    assert [r.declaration_id for r in listing.after(last, limit=6).collect()] == every[12:18]
    for row in listing.page(limit=30).collect()[::7]:
        at = every.index(row.declaration_id)
        assert [r.declaration_id for r in listing.after(row, limit=4).collect()] == every[at + 1 : at + 5]
    named = Listing.write(scores, f"file://{tmp_path}/n", "name", "desc", rows_a_range=7)
    whole = [r.declaration_id for r in serving.ordered(scores, "name", "desc").select("declaration_id").collect()]
    assert [r.declaration_id for r in named.page(limit=30).collect()] == whole
    assert [r.declaration_id for r in named.after(named.page(offset=3, limit=1).first(), limit=5).collect()] == whole[4:9]
    scores.unpersist()
