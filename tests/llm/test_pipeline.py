import corpus_pipeline
from probita.llm.common import staged
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, DIR), f"test-{name}")
        seen[name] = out.count()
        if name != "packing":
            assert out.columns == columns
            docs = out
    assert 200 >= seen["quality_rules"] >= seen["near_dedup"] > 100
    assert seen["personal_data"] == seen["near_dedup"]
    assert docs.filter(F.col("text").rlike(r"\+1 \([0-9]{3}\) 555")).isEmpty()


def test_stages_carry_clashing_columns(spark):
    """Extra columns named like the stages' own pass through all stages but the last."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    for c in ("uid", "digest", "n_words", "size", "source_size", "key", "node", "start", "stratum", "s"):
        docs = docs.withColumn(c, F.lit(7))
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, DIR), f"test-clash-{name}")
        assert out.count() > 0
        if name != "packing":
            assert out.columns == docs.columns and out.filter("uid <> 7 or s <> 7").isEmpty()
            docs = out


def test_last_stages_conserve_texts(spark):
    """Mixing takes whole words of the texts it had, at most three times each; packing packs every word."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    mix = staged(stages["mixing"](spark, docs, DIR), "test-mix")
    words = lambda d: {r.doc_id: r.n for r in d.select("doc_id", F.expr("size(array_remove(split(coalesce(text, ''), '[ \\t-\\r]+'), ''))").alias("w")).groupBy("doc_id").agg(F.sum("w").alias("n")).collect()}
    had, took = words(docs), words(mix)
    assert set(took) <= set(had) and all(n <= 3 * had[i] for i, n in took.items())
    assert abs(sum(took.values()) - sum(had.values())) <= 128 * 10
    packed = stages["packing"](spark, mix, DIR).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.size("ids")).alias("m"))
    assert packed.filter("n <> m").isEmpty() and packed.count() == len(took)


def test_empty_and_null_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "a b c", "en", "s", 5)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            n = stage(spark, docs, DIR).count()
            assert n <= 3 * len(rows) and (rows or not n)
