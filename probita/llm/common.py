"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space and \x09-\x0D.
SPACE_CLASS = r"[ \t-\r]"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset in local mode (tests) a folder of our own is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="probita-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forgotten(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are deleted when each ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09-\\x0D; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


MOST_BITS, BITMAP = 1 << 26, 32768


class KeyBits:
    """One-bit-per-hash sketches of sets of keys: a key without its bit is surely not in the set.

    16 bits a key, 2**26 (8 MB a set) at most however many keys there are, so they can always be broadcast; beyond four million keys
    more keys of others have a bit by chance, and what is decided exactly behind the sketch grows, but stays right."""

    def __init__(self, **sets: DataFrame):
        """``sets``: tables of one column, the key."""
        n = max(df.count() for df in sets.values())
        self.bits = BITMAP
        while self.bits < min(16 * n, MOST_BITS):
            self.bits *= 2
        out = None
        for name, df in sets.items():
            h = self._hash(F.col(df.columns[0]))
            one = df.select(F.floor(h / BITMAP).alias("_bits_at"), (h % BITMAP).alias("p")).groupBy("_bits_at").agg(F.bitmap_construct_agg("p").alias(f"_bits_{name}"))
            out = one if out is None else out.join(one, "_bits_at", "full")
        self.table, self.names = staged(out.coalesce(1), "key-bits"), list(sets)  # at most 2048 rows

    def _hash(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.bits))

    def split(self, df: DataFrame, key: str) -> tuple[DataFrame, dict[str, Column], Callable[[DataFrame], DataFrame]]:
        """``df`` with the bitmaps joined; for each set the condition that the row's key has its bit; and what takes the bitmaps off."""
        stem = "_bits"
        while any(c.lower().startswith(stem) for c in df.columns):
            stem = "_" + stem
        h, at, own = self._hash(F.col(key)), f"{stem}_at", {n: f"{stem}_{n}_map" for n in self.names}
        maps = self.table.select(F.col("_bits_at").alias(at), *[F.col(f"_bits_{n}").alias(c) for n, c in own.items()])
        rows = df.withColumn(at, F.floor(h / BITMAP)).join(F.broadcast(maps), at, "left")
        place = (self._hash(F.col(key)) % BITMAP).cast("int")
        byte = lambda b: F.conv(F.hex(F.substring(b, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        on = {n: F.coalesce(F.getbit(byte(F.col(c)), place % 8) == 1, F.lit(False)) for n, c in own.items()}
        return rows, on, lambda x: x.drop(at, *own.values())


def kept_by_key(df: DataFrame, key: str, kept: DataFrame, gone: DataFrame, few: int = 200_000) -> DataFrame:
    """The rows of ``df`` whose key is in ``kept``; ``gone`` has all other keys of ``df`` (both: staged tables of one column).

    Rows are decided by their bits where they can be, so texts are not shuffled. The keys of ``gone`` that have a bit of ``kept`` by
    chance are looked up by broadcast if they are few; if they are many, rows with both bits are shuffled and joined."""
    bits = KeyBits(kept=kept, gone=gone)
    g, on, plain = bits.split(gone, gone.columns[0])
    chance = staged(plain(g.filter(on["kept"])), "key-chance")
    rows, on, plain = bits.split(df, key)
    if chance.count() <= few:
        return plain(rows.filter(on["kept"])).join(F.broadcast(chance.toDF(key)), key, "left_anti")
    sure = plain(rows.filter(on["kept"] & ~on["gone"]))
    return sure.unionByName(plain(rows.filter(on["kept"] & on["gone"])).join(kept.toDF(key), key, "left_semi"))


def rows_among(df: DataFrame, key: str, keys: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``df`` that may have one of ``keys`` (a staged table of one column); with ``inside`` False those that surely have none."""
    rows, on, plain = KeyBits(keys=keys).split(df, key)
    return plain(rows.filter(on["keys"] if inside else ~on["keys"]))


def one_of_each(df: DataFrame, key: str, repeated: DataFrame) -> DataFrame:
    """``df`` with one row of each key in ``repeated`` (a staged table of one column): only rows that may have one of these are shuffled."""
    if repeated.isEmpty():
        return df
    some, keys = rows_among(df, key, repeated), repeated.toDF(key)
    first = some.join(keys, key, "left_semi").dropDuplicates([key])
    return rows_among(df, key, repeated, inside=False).unionByName(some.join(keys, key, "left_anti")).unionByName(first)


def row_key(docs: DataFrame, *others: str) -> Column:
    """The MD5 of a row's id, text (null as empty) and ``others``: what a row is known by where texts are not to be copied."""
    parts = [F.md5(F.coalesce("text", F.lit("")).cast("binary"))]
    for c in ("doc_id", *others):
        x = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))
