"""Interactions of filters, for every order in which they could be applied, from a packed bitmap index.

Each task turns its rows into bitsets, one bit a row: one for each filter (rows that fail it) and each label. Rows of one part
lie together and begin at a new 64-bit word, so a part's bitset is a run of words. What is left after a set of filters is
the AND-NOT of the part with the set's bitsets; the popcount of its AND with another filter is what that filter removes
next. A task sums its counts by part for all 80 pairs of (set before, filter); the sums of all tasks are added up and the
orders only read them. Nothing depends on how rows are dealt, and a part of any size leaves one row per task and pair.

A text equal to one of a smaller id is found by SHA-256: the least id of each text is kept, and (text, id) is looked up among
these, so copies of one text go to many tasks.

Defined results: a null text is empty; a null source is the part ""; a null id is neither smaller nor has smaller ones;
repeated rows count each (equal ids are not smaller); a document is good or toxic if any of its label rows says so; null
labels say nothing; other columns are not read; no rows of none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LETTERS = "ABCDE"
SAME = LETTERS.index("E")
ROWS_AN_INDEX = 1 << 18
_CAPS, _MARKS = bytes(range(65, 91)), b"#$%&*|"
#: (set before as a mask, filter) in a fixed order; the place of a pair is its cell.
CELLS = [(mask, f) for mask in range(32) for f in range(5) if not mask >> f & 1]


def fails(raw: bytes) -> int:
    """Filters A to D on a text's UTF-8 bytes, as bits."""
    words = raw.split()
    n, points = len(words), len(raw) if raw.isascii() else len(raw.decode())
    caps = len(raw) - len(raw.translate(None, _CAPS))
    marked = len(raw.translate(None, _MARKS)) < len(raw)
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * caps > 5 * points) << 2 | marked << 3


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [(t.as_py() or "").encode() for t in b.column(2)]
        bits = pa.array(map(fails, raw), pa.int32())
        digest = pa.array((hashlib.sha256(t).digest() for t in raw), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bits, digest], names=["doc_id", "part", "bits", "digest"])


def tested(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, bits (failed filters A to E) of each row."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), docs[text].alias("text"))
    rows = rows.mapInArrow(_tested, "doc_id long, part string, bits int, digest binary")
    least = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    same = F.when(F.col("doc_id").isNotNull() & F.col("least").isNull(), F.lit(1 << SAME)).otherwise(F.lit(0))
    return rows.join(least, ["digest", "doc_id"], "left").select("doc_id", "part", F.col("bits").bitwiseOR(same).alias("bits"))


class Bitmaps:
    """The bitsets of some rows. ``part``: codes from 0 on, none left out; ``bits`` and ``labels``: a bit for each."""

    def __init__(self, part: np.ndarray, bits: np.ndarray, labels: np.ndarray):
        order = np.argsort(part, kind="stable")
        n = np.bincount(part)
        words = -(-n // 64)
        self.starts = np.r_[0, np.cumsum(words)[:-1]]  # each part's first word
        place = np.arange(len(part)) + np.repeat(64 * self.starts - np.r_[0, np.cumsum(n)[:-1]], n)
        self.size = int(words.sum())
        self.rows = self._packed(place)
        self.filters = [self._packed(place[bits[order] >> f & 1 == 1]) for f in range(5)]
        self.labels = [self._packed(place[labels[order] >> k & 1 == 1]) for k in range(2)]

    def _packed(self, place: np.ndarray) -> np.ndarray:
        held = np.zeros(64 * self.size, np.uint8)
        held[place] = 1
        return np.packbits(held).view(np.uint64)

    def count(self, bitset: np.ndarray) -> np.ndarray:
        """Ones in each part."""
        return np.add.reduceat(np.bitwise_count(bitset), self.starts, dtype=np.int64)

    def cells(self) -> np.ndarray:
        """[part, cell, (removed, good, toxic, alive before)]"""
        out, left = np.empty((len(self.starts), len(CELLS), 4), np.int64), {0: self.rows}
        for mask in range(1, 32):
            low = (mask & -mask).bit_length() - 1
            left[mask] = left[mask & (mask - 1)] & ~self.filters[low]
        alive = {mask: self.count(s) for mask, s in left.items()}
        for c, (mask, f) in enumerate(CELLS):
            gone = left[mask] & self.filters[f]
            out[:, c] = np.stack([self.count(gone), self.count(gone & self.labels[0]), self.count(gone & self.labels[1]), alive[mask]], 1)
        return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["removed", "good", "toxic", "alive"]

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        code = pa.chunked_array(t["part"]).combine_chunks().dictionary_encode()
        got = Bitmaps(code.indices.to_numpy(), t["bits"].to_numpy(), t["labels"].to_numpy()).cells()
        for lo in range(0, len(got), 1000):
            g = got[lo : lo + 1000]
            part = code.dictionary.take(pa.array(np.repeat(np.arange(lo, lo + len(g)), len(CELLS))))
            cell = pa.array(np.tile(np.arange(len(CELLS), dtype=np.int32), len(g)))
            yield pa.RecordBatch.from_arrays([part, cell, *(pa.array(g[:, :, k].ravel()) for k in range(4))], names=["part", "cell", *names])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS_AN_INDEX:
            yield from counted(held)
            held, n = [], 0
    if n:
        yield from counted(held)


def counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of :func:`tested` -> part and cells: for each place of ``CELLS``, (removed, good, toxic, alive)."""
    some = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    bits = F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))
    rows = rows.join(some, "doc_id", "left").select("part", "bits", bits.cast("int").alias("labels"))
    sums = [F.sum(c).alias(c) for c in ("removed", "good", "toxic", "alive")]
    cells = rows.mapInArrow(_indexed, "part string, cell int, removed long, good long, toxic long, alive long").groupBy("part", "cell").agg(*sums)
    whole = cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("cell", "removed", "good", "toxic", "alive"))).alias("cells"))  # 80 each
    return whole


def steps() -> list[dict]:
    """Every step of every order: its letter's filter, its cell, and that filter's cells before and after all others."""
    place = {cell: i for i, cell in enumerate(CELLS)}
    out = []
    for order in permutations(range(5)):
        for i, f in enumerate(order):
            mask = sum(1 << g for g in order[:i])
            out.append({"o": "".join(LETTERS[g] for g in order), "step": i + 1, "f": f, "c": place[mask, f], "none": place[0, f], "all": place[31 - (1 << f), f]})
    return out


def audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """A row per part, order of the filters and step."""
    plan = F.from_json(F.lit(json.dumps(steps())), "array<struct<o string, step int, f int, c int, none int, all int>>")
    at = lambda place: F.element_at("cells", place + 1)

    def shapley(f: int) -> Column:
        mine = [(c, factorial(mask.bit_count()) * factorial(4 - mask.bit_count())) for c, (mask, g) in enumerate(CELLS) if g == f]
        return sum((F.col("cells")[c]["removed"] * w for c, w in mine[1:]), F.col("cells")[mine[0][0]]["removed"] * mine[0][1])

    parts = counts(tested(docs, **names), labels).withColumn("shapley", F.array(*map(shapley, range(5))))
    rows = parts.select("part", "cells", "shapley", F.explode(plan).alias("p")).select("*", at(F.col("p.c")).alias("x"))
    return rows.select(
        "part", F.col("p.o").alias("filter_order"), F.col("p.step").alias("step"), (F.col("x.alive") - F.col("x.removed")).alias("kept"), F.col("x.removed").alias("removed"),
        (at(F.col("p.none"))["removed"] - F.col("x.removed")).alias("redundant"), at(F.col("p.all"))["removed"].alias("unique_fails"), F.col("x.good").alias("good_lost"), F.col("x.toxic").alias("toxic_lost"),
        F.element_at("shapley", F.col("p.f") + 1).alias("shapley"),
    )


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
    [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS bad
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
g AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bad),
s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS k, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) u),
m AS (
  SELECT g.*, s.*, bad[k] AS fails, len(list_filter(before, lambda i: bad[i])) > 0 AS earlier, len(list_filter(bad, lambda b: b)) AS n_bad FROM g, s),
r AS (
  SELECT part, filter_order, step, k, sum(n) FILTER (NOT earlier AND NOT fails) AS kept, sum(n) FILTER (fails AND NOT earlier) AS removed, sum(n) FILTER (fails AND earlier) AS redundant,
    sum(n) FILTER (fails AND n_bad = 1) AS unique_fails, sum(good) FILTER (fails AND NOT earlier) AS good_lost, sum(toxic) FILTER (fails AND NOT earlier) AS toxic_lost
  FROM m GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM r
"""
