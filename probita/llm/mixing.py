"""Mixing sources to target weights by blocks.

Texts are packed into blocks of a fixed number of words, numbered within their source. The mix has as many words as
the corpus; a source's target is its weight's share, at most ``most`` times its own words, the excess shared again by
weight. The shard of each slot is drawn, so an output shard's counts are multinomial over the sources given the sources'
totals, which end within a block of the targets (independent draws per shard would move small sources away from theirs). The
counts choose the blocks: passes over a source that take every block have no choice, but in its last pass each
shard takes the next places of its own lane, so which blocks are taken follows from how many the shards drew
(``slots``). A place becomes a block by a keyed permutation of the source's N indices for that pass (swap-or-not rounds, which
work on any N), and slots and blocks are joined by (source, index). A pass takes a block at most once and there are at most
``most`` passes, so no text is taken more than ``most`` times.

Everything is a function of the rows and a seed, not of the partitioning. Offsets within a source are prefix sums over
small hash groups of a source, then over groups of groups, so a source with most of the rows is spread like any other.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is a source, after the others;
repeated rows are rows of their own; an empty table gives no rows; other columns are carried unread. The sources
themselves (not their rows) are numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE_CLASS, fresh, one_of_each, row_key, staged, table

WEIGHTS, MOST, BLOCK, SEED = (5, 2, 1), 3, 128, 20
ROWS_A_GROUP, FAN, SLOTS_A_CHUNK, SLOTS_A_SHARD, BLOCKS_A_LANE, ROUNDS = 400, 256, 2048, 512, 32, 24


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) rows -> one row per source: s (its number), source, source_size, target, by the closed form of the sharing."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = W.partitionBy(F.lit(0))
    per = per.withColumn("s", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("s") % len(weights) + 1))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("all", F.sum("source_size").over(one)).withColumn("w_all", F.sum("w").over(one))
    before = one.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w0", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("capped", F.col("cap") * (F.col("w_all") - F.col("w0")) <= F.col("w") * (F.col("all") - F.col("c0")))
    rest = (F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(one), F.lit(0))) / (F.col("w_all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(one), F.lit(0.0)))
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * rest))
    return per.select("s", "source", "source_size", "target")


def _before(value: str, keys: list[str], order: list[str]) -> Column:
    return F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def placed(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (uid, key, s, size) with ``at``: the words of the source before the row."""
    groups = max(1, -(-n_rows // ROWS_A_GROUP))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(groups)))
    sums = rows.groupBy("s", "g").agg(F.sum("size").alias("size")).withColumn("gg", F.floor(F.col("g") / FAN))
    far = sums.groupBy("s", "gg").agg(F.sum("size").alias("size")).withColumn("far", _before("size", ["s"], ["gg"])).drop("size")
    near = sums.withColumn("near", _before("size", ["s", "gg"], ["g"])).drop("size")
    starts = near.join(far, ["s", "gg"]).select("s", "g", (F.col("near") + F.col("far")).alias("g_at"))
    return rows.withColumn("own", _before("size", ["s", "g"], ["key", "uid"])).join(starts, ["s", "g"]).withColumn("at", F.col("own") + F.col("g_at")).drop("own", "g_at", "g")


def permuted(j: Column, n: Column, *keys: Column) -> Column:
    """A permutation of 0..n-1, keyed: in each round j and k - j (mod n) change places or don't, by a hash of the pair."""
    def swap(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, y), r, *keys), F.lit(2)) == 1, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), j, swap)


def plan(per: DataFrame, block: int = BLOCK, most: int = MOST, slots_a_shard: int = SLOTS_A_SHARD) -> DataFrame:
    """A row per source with words: s, n (its blocks), want (slots of the mix), full (passes that take every block), shards (of the
    mix), lanes (into which the blocks of its last pass are dealt). Some hundreds of slots a shard, 65,536 shards at most."""
    n = F.ceil(F.col("source_size") / block)
    want = F.least(F.round(F.col("target") * n / F.col("source_size")).cast("long"), most * n)
    per = per.filter("source_size > 0").select("s", n.alias("n"), F.greatest(want, F.when(F.col("target") > 0, F.lit(1)).otherwise(F.lit(0))).alias("want"))
    shards = F.greatest(F.lit(1), F.least(F.lit(65536), F.ceil(F.sum("want").over(W.partitionBy(F.lit(0))) / slots_a_shard)))
    per = per.withColumns({"shards": shards, "full": F.floor(F.col("want") / F.col("n"))})
    return per.withColumn("lanes", F.greatest(F.lit(1), F.least("shards", F.floor(F.col("n") / BLOCKS_A_LANE))))


def _exploded(rows: DataFrame, count: str) -> DataFrame:
    """A row for each of ``count`` slots, spread over partitions by their number."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + int((rows.agg(F.sum(count)).first()[0] or 0) // 500_000))
    chunks = rows.filter(F.col(count) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / SLOTS_A_CHUNK))).alias("c"))
    low = F.col("c") * SLOTS_A_CHUNK
    chunks = chunks.withColumns({"low": low, "high": F.least(low + SLOTS_A_CHUNK, F.col(count)) - 1})
    return chunks.repartition(parts, "s", "low").select(*rows.columns, F.explode(F.sequence("low", "high")).alias("slot"))


def draw(per: DataFrame, seed: int = SEED) -> DataFrame:
    """A row per slot of the mix, from a table of :func:`plan`: (s, n, full, lanes, slot, shard). The shard of each slot is drawn, so a shard's counts are
    multinomial over the sources given their totals."""
    return _exploded(per, "want").withColumn("shard", F.pmod(F.xxhash64("s", "slot", F.lit(seed)), F.col("shards"))).select("s", "n", "full", "lanes", "slot", "shard")


def slots(drawn: DataFrame, per: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: (shard, slot, s, pass, index), from tables of :func:`draw` and :func:`plan`.

    Passes that take every block number their slots as they come. In a source's last pass the draw decides which blocks are taken:
    lane l has the places l, l + lanes, l + 2 lanes, ... of the pass, and a shard's slots take the next ones of its lane, so a lane from which shards
    drew more goes deeper. Slots beyond a lane's end take what other lanes have left, in order. A place becomes an index by the
    permutation of the source and pass."""
    whole = drawn.filter(F.col("slot") < F.col("full") * F.col("n")).select("shard", "slot", "s", "n", F.floor(F.col("slot") / F.col("n")).alias("pass"), (F.col("slot") % F.col("n")).alias("place"))
    last = drawn.filter(F.col("slot") >= F.col("full") * F.col("n")).withColumn("lane", F.col("shard") % F.col("lanes"))
    deep = last.withColumn("j", F.row_number().over(W.partitionBy("s", "lane").orderBy("shard", "slot")) - 1)
    room = F.floor((F.col("n") - F.col("lane") - 1) / F.col("lanes")) + 1
    deep = deep.withColumn("beyond", F.col("j") - room)
    fit = deep.filter("beyond < 0").select("shard", "slot", "s", "n", F.col("full").alias("pass"), (F.col("lane") + F.col("j") * F.col("lanes")).alias("place"))
    lanes = per.filter("want > 0").select("s", "n", "lanes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane")).withColumn("room", room)
    lanes = lanes.join(last.groupBy("s", "lane").agg(F.count(F.lit(1)).alias("k")), ["s", "lane"], "left").fillna(0, ["k"])
    lanes = lanes.withColumns({"over": F.greatest(F.col("k") - F.col("room"), F.lit(0)), "free": F.greatest(F.col("room") - F.col("k"), F.lit(0))})
    lanes = lanes.withColumns({"over_at": _before("over", ["s"], ["lane"]), "free_at": _before("free", ["s"], ["lane"]), "all_over": F.sum("over").over(W.partitionBy("s"))})
    some = lanes.filter((F.col("free") > 0) & (F.col("free_at") < F.col("all_over")))
    left = some.select("s", "lanes", "lane", "k", F.posexplode(F.sequence(F.col("free_at"), F.least(F.col("free_at") + F.col("free"), F.col("all_over")) - 1)).alias("i", "u"))
    left = left.select("s", "u", (F.col("lane") + (F.col("k") + F.col("i")) * F.col("lanes")).alias("place"))
    more = deep.filter("beyond >= 0").join(lanes.select("s", "lane", "over_at"), ["s", "lane"]).withColumn("u", F.col("over_at") + F.col("beyond"))
    more = more.join(left, ["s", "u"]).select("shard", "slot", "s", "n", F.col("full").alias("pass"), "place")
    every = whole.unionByName(fit).unionByName(more)
    return every.select("shard", "slot", "s", "pass", permuted(F.col("place"), F.col("n"), F.col("s"), F.col("pass"), F.lit(seed)).alias("index"))


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with size > 0 -> a row per block that they reach into: the first word of the text in it, and how many."""
    span = rows.filter("size > 0").select("uid", "s", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("index"))
    lo = F.greatest(F.col("index") * block, F.col("at"))
    hi = F.least((F.col("index") + 1) * block, F.col("at") + F.col("size"))
    return span.select("uid", "s", "index", (lo - F.col("at")).alias("word"), (hi - lo).alias("n_words"))


def mixed(sized: DataFrame, *, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, slots_a_shard: int = SLOTS_A_SHARD) -> tuple[DataFrame, DataFrame]:
    """``sized``: a table of (uid, key, source, size). Gives (rows with s, source_size, target), (the taken pieces: uid, shard, slot, pass, word, n_words)."""
    per = staged(targets(sized, weights, most).coalesce(1), "mixing-sources")
    rows = sized.join(per, sized["source"].eqNullSafe(per["source"]), "left").select("uid", "key", "s", "size", "source_size", "target")
    at = placed(rows.select("uid", "key", "s", "size"), sized.count())
    shares = staged(plan(per, block, most, slots_a_shard), "mixing-plan")
    chosen = slots(staged(draw(shares, seed), "mixing-draw"), shares, seed)
    return rows, blocks(at, block).join(chosen.hint("merge"), ["s", "index"]).select("uid", "shard", "slot", "pass", "word", "n_words")


def with_size(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(uid, key, source, size); key: what a row's place in its source depends on."""
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More columns: in how many shards the row's pieces lie, and the first of these."""
    sized = staged(with_size(table(spark, sf_dir, "documents")), "mixing-sizes")
    rows, pieces = mixed(sized)
    taken = pieces.groupBy("uid").agg(F.sum("n_words").alias("taken"), F.min("shard").alias("first_shard"), F.count_distinct("shard").alias("n_shards")).hint("merge")
    out = rows.join(taken, "uid", "left")
    return out.select(F.col("key.id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", F.coalesce("n_shards", F.lit(0)).alias("n_shards"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row per text and pass that takes it, its text cut to the blocks taken, in order and with the white space between words; the columns of ``docs``.

    Rows stand in the order of the shard and place of their first block within each partition. Rows of null, empty or blank text are taken no words and go; a
    null source is a source; repeated rows are rows of their own; no rows of none. Rows are known by their id, source and text, so no
    copy of the texts is written; of rows alike in these the other columns of one stand for all."""
    key = fresh(docs, "_row")
    df = docs.withColumn(key, row_key(docs, "source"))
    place = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    sized = staged(df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("row"), place.alias("key"), F.col("source").alias("source"), size_of(F.col("text")).alias("size")), "mixing-sizes")
    repeated = staged(sized.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row"), "mixing-repeated")
    _, pieces = mixed(sized)
    parts, turn, at = fresh(docs, "_parts"), fresh(docs, "_pass"), fresh(docs, "_at")
    first = F.min(F.struct("shard", F.xxhash64("shard", "slot", "uid", F.lit(SEED)).alias("place"))).alias(at)
    cut = pieces.groupBy("uid", "pass").agg(F.sort_array(F.collect_list(F.struct("word", "n_words"))).alias(parts), F.sum("n_words").alias("n"), first)
    cut = cut.join(sized.select("uid", "row", "size"), "uid").select(F.col("row").alias(key), F.col("pass").alias(turn), F.when(F.col("n") < F.col("size"), F.col(parts)).alias(parts), at)
    tokens = F.split(F.regexp_replace("text", rf"^{SPACE_CLASS}+", ""), rf"(?<={SPACE_CLASS})(?![ \t-\r])")
    pick = lambda t: F.array_join(F.flatten(F.transform(F.col(parts), lambda p: F.slice(t, (p["word"] + 1).cast("int"), p["n_words"].cast("int")))), "")
    some = F.element_at(F.transform(F.array(tokens), pick), 1)  # the text is split once
    out = one_of_each(df, key, repeated).join(cut, key).withColumn("text", F.when(F.col(parts).isNull(), F.col("text")).otherwise(some))
    return out.sortWithinPartitions(at).select(*docs.columns)
