"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each rule rejects a text when one of its ratios exceeds a cutoff. Cutoffs come from a fixed grid and are certified
on labelled good rows, which nothing is fitted to: within each stratum (``lang``) a quarter of the labelled good texts, by
id, orders all steps (a rule's next stricter cutoff) into one sequence of joint cutoffs, those that reject the fewest of the
quarter first and of equal ones those farther from its largest ratio. Along it the other three quarters test the combined
verdict of all rules: it counts as safe only if the exact binomial tail P(X <= k | n, alpha) is at most delta/m, where n is
the number of those texts, k how many of them any rule rejects and m the number of strata (Bonferroni; the joint cutoffs
are nested and their order does not depend on the rows tested, so testing them from the loosest on up to the first failure
needs no further correction). The strictest safe joint cutoffs apply; a rule none of whose steps came by then is off there.
So with probability 1 - delta every stratum loses at most ``alpha`` of its good texts to the rules; with four strata about
200 labelled good texts are enough to certify cutoffs that none of them exceeds.

Defined results: a null or empty text has no words and fails the base rule; a null ``lang`` is a stratum of its own;
repeated rows each get a row; labels that disagree for an id count as bad; other columns are carried unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import forgotten, fresh, rows_among, staged, table, words

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule -> ratio from the counts; all are per word, but for duplicate lines.
RULES = {
    "symbols": lambda c: c["n_symbols"] / c["n_words"],
    "shouts": lambda c: c["n_bangs"] / c["n_words"],
    "dup_lines": lambda c: c["n_dup_lines"] / c["n_lines"],
    "repeats": lambda c: c["n_repeat_words"] / c["n_words"],
    "runs": lambda c: c["n_runs"] / c["n_words"],
    "long_words": lambda c: c["word_chars"] / c["n_words"] / 40,
}
CUTOFFS = [round(0.02 * 1.32**i, 4) for i in range(15)]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, bound as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words covered by 5-word windows whose hash occurs twice or more; ``hashes`` in window order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda e, at: F.coalesce(F.get(s, at)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(_let(pairs, places), total)).otherwise(F.lit(0).cast("long"))


def with_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one struct column of counts per text, and that column's name."""
    w, h, out = fresh(docs, "_q_words"), fresh(docs, "_q_windows"), fresh(docs, "_q_counts")
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(w, words(F.col(text)))
    n = F.size(w)
    df = df.withColumn(h, F.when(n >= 6, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(w, i, 5)))).otherwise(F.array().cast("array<long>")))
    squeezed = F.translate(t, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("lines"),
        F.when(n >= 6, _covered(F.col(h))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_bangs"),
        F.size(F.filter(F.col(w), lambda x, i: F.coalesce(F.get(F.col(w), i - 1) == x, F.lit(False)))).cast("long").alias("n_runs"),
    )
    return df.withColumn(out, counts).drop(w, h), out


def _counts(c: str) -> dict[str, Column]:
    got = {k: F.col(c)[k] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_bangs", "n_runs")}
    return got | {"n_lines": F.col(c)["lines"]["n"], "n_dup_lines": F.col(c)["lines"]["d"]}


def base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def ratios(c: dict[str, Column]) -> dict[str, Column]:
    return {k: F.when(c["n_words"] > 0, f(c)).otherwise(F.lit(0.0)) for k, f in RULES.items()}


def _log_tail(n: Column, k: Column, p: Column) -> Column:
    """log P(X <= k) for X ~ Binomial(n, p): the exact sum, term by term in logarithms."""
    ratio = lambda i: F.log((n - i + 1) / i) + F.log(p / (1 - p))
    start = F.struct((n * F.log(1 - p)).alias("term"), (n * F.log(1 - p)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + ratio(i)
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, step)["sum"]


def thresholds(rated: DataFrame, labels: DataFrame, *, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """(stratum, symbols, shouts, ...): the strictest certified joint cutoffs, null where a rule has none.

    ``rated``: doc_id, stratum and a column per rule, base failures left out; ``labels``: doc_id, quality."""
    good = good_ids(labels)
    above = lambda r: sum((F.when(F.col(r) > c, 1).otherwise(0) for c in CUTOFFS), F.lit(0))  # noqa: E731  how many cutoffs reject the row
    orders = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    held = rated.join(good, "doc_id").select("stratum", orders.alias("orders"), F.array(*[F.struct(F.lit(n).alias("rule"), above(r).alias("level"), F.col(r).alias("ratio")) for n, r in enumerate(RULES)]).alias("x"))
    level = held.filter("orders").select("stratum", F.explode("x").alias("x")).groupBy("stratum", "x.rule", "x.level").agg(F.count(F.lit(1)).alias("n"), F.max("x.ratio").alias("top"))
    hits = level.groupBy("stratum", "rule").agg(F.max("top").alias("top"), F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("by"))  # at most 16 levels
    grid = hits.select("stratum", "rule", "top", F.posexplode(F.array(*[F.lit(c) for c in CUTOFFS])).alias("i", "cutoff"), "by")
    k = lambda reached: F.aggregate(F.filter(F.map_entries("by"), reached), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    first = W.partitionBy("stratum").orderBy(k(lambda e: e["key"] > F.col("i")), F.col("top") / F.col("cutoff"), F.desc("i"), "rule")
    path = grid.select("stratum", "rule", "i", "cutoff", F.row_number().over(first).alias("step"))
    path = path.groupBy("stratum").agg(F.collect_list(F.struct("rule", "i", "cutoff", "step")).alias("path"))  # a step per rule and cutoff
    path = path.select(F.col("stratum").alias("of"), "path", F.map_from_entries(F.transform("path", lambda e: F.struct(e["rule"] * len(CUTOFFS) + e["i"], e["step"]))).alias("at"))
    same = F.col("stratum").eqNullSafe(F.col("of"))
    # The first step that rejects a text: of each rule the loosest cutoff that does, of these the earliest; null where none does.
    fatal = F.array_min(F.transform("x", lambda e: F.when(e["level"] > 0, F.element_at("at", e["rule"] * len(CUTOFFS) + e["level"] - 1))))
    lost = held.filter(~F.col("orders")).join(path.select("of", "at"), same).select("stratum", F.coalesce(fatal, F.lit(len(RULES) * len(CUTOFFS) + 1)).alias("step"))
    lost = lost.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    lost = lost.groupBy("stratum").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("by"))
    lost = lost.withColumn("m", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))
    steps = lost.join(path, same).select("stratum", "n", "by", "m", F.explode("path").alias("p")).select("stratum", "n", "m", "p.*", k(lambda e: e["key"] <= F.col("p.step")).alias("k"))
    share = F.lit(alpha)
    safe = (F.col("k") < F.col("n") * share) & (_log_tail(F.col("n"), F.col("k"), share) <= F.log(F.lit(delta) / F.col("m")))
    return steps.groupBy("stratum").agg(*[F.min(F.when(safe & (F.col("rule") == n), F.col("cutoff"))).alias(r) for n, r in enumerate(RULES)])


def rated(counted: DataFrame, col: str, doc_id: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and a column per rule of the rows that pass the base rule."""
    c = _counts(col)
    return counted.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), *[v.alias(k) for k, v in ratios(c).items()], base_failed(c).alias("bad")).filter("not bad").drop("bad")


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and never otherwise."""
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).filter("quality = 1").select("doc_id")


def judged(counted: DataFrame, col: str, limits: DataFrame, stratum: str = "lang") -> tuple[DataFrame, dict[str, Column], Column]:
    """``counted`` (of :func:`with_counts`) with the cutoffs joined, its count columns, and the verdict column.

    The verdict is one expression over both sides of the join, so the counts are made once, below it."""
    c, s = _counts(col), fresh(counted, "_q_stratum")
    limits = limits.select(F.col("stratum").alias(s), F.struct(*RULES).alias(cut := fresh(counted, "_q_limits")))
    joined = counted.join(limits, F.col(s).eqNullSafe(F.col(stratum)), "left").drop(s)
    broken = base_failed(c).cast("int")
    for k, v in ratios(c).items():
        broken = broken + F.coalesce((v > F.col(cut)[k]).cast("int"), F.lit(0))
    return joined, c, broken == 0


def judge(counted: DataFrame, col: str, labels: DataFrame, *, doc_id: str = "doc_id", stratum: str = "lang", **kw) -> tuple[DataFrame, dict[str, Column], Column]:
    """:func:`judged` with the cutoffs that ``labels`` certify."""
    limits = staged(thresholds(rated(counted, col, doc_id, stratum), labels, **kw).coalesce(1), "quality-limits")
    return judged(counted, col, limits, stratum)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counted, col = with_counts(docs)
    counted = staged(counted.drop("text"), "quality-counts")
    df, c, ok = judge(counted, col, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return df.select("doc_id", *[c[k].alias(k) for k in BASE], base_failed(c).alias("base_failed"), ok.alias("kept"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs of their language; the columns of ``docs``.

    Cutoffs need the texts that are labelled good only: these are counted first, then every text as it is read; no copy of the texts is
    written. A null text is empty and fails the base rule; a null language is a language; repeated rows get the same
    verdict; no rows of none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    good = staged(good_ids(labels), "quality-good")
    some, col = with_counts(rows_among(docs.select("doc_id", "text", "lang"), "doc_id", good))
    some = staged(some.drop("text"), "quality-counts")
    limits = staged(thresholds(rated(some, col), labels).coalesce(1), "quality-limits")
    forgotten(some)
    counted, col = with_counts(docs)
    df, _, ok = judged(counted, col, limits)
    return df.filter(ok).select(*docs.columns)
