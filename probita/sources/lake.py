"""A store of several tables that change by key, one small manifest per commit.

A commit writes each table's new rows as one part, dealt into buckets by a hash of the table's key, and the keys that it
replaces as rows of a table of their own: rows of a replaced key with a smaller commit number are dead. Nothing that is there is
rewritten, so a batch costs what it brings. A reader takes the newest manifest and never sees half of a commit: a
manifest is written aside and then renamed to the next version, which fails if another writer was first. What a commit
that was cut off leaves behind is named by no manifest; ``vacuum`` deletes it.

Parts of like size are merged geometrically (``compact``), so a table has as many parts as the logarithm of its size. The number of
buckets of a part grows with its rows; it is a power of two, and a lookup of some keys reads one bucket a key and part.

Columns ``_batch`` (the commit) and ``_bucket`` are the store's own; a table that has them is refused.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH, BUCKET = "_batch", "_bucket"
ROWS_A_BUCKET, FAN, FEW_KEYS, BROADCAST_ROWS = 100_000, 4, 2_000, 200_000


@dataclass(frozen=True)
class Table:
    """``by``: columns whose hash is the bucket. ``group``: the keys whose replacement makes rows of the table dead, with the
    columns of the key; none: rows stay. ``summed``: a column to add up over rows equal otherwise, where parts are merged."""

    by: tuple[str, ...]
    group: str | None = None
    key: tuple[str, ...] = ()
    summed: str | None = None


def hashed(values: Iterable[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[v.cast("string") for v in values]), F.lit(buckets)).cast("int")


def buckets_for(rows: int) -> int:
    n = 1
    while n * ROWS_A_BUCKET < rows:
        n *= 2
    return n


def _batches(part: dict) -> list[int]:
    """The first and the last commit that a part may have rows of; any, where a manifest of earlier code doesn't say."""
    return part.get("batches", [0, sys.maxsize])


class Lake:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), dict(tables)
        for t in tables.values():
            if t.group:
                self.tables[f"dead_{t.group}"] = Table(t.key)

    # files

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    @property
    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place = self._path("manifests")
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path("manifests", f"v{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self, version: int | None = None) -> Snapshot:
        """The newest state, or that of a version that is still there."""
        known = self.versions()
        if version is None and not known:
            return Snapshot(self, {"version": 0, "done": {}, "tables": {}})
        return Snapshot(self, self._manifest(known[-1] if version is None else version))

    def draft(self) -> Draft:
        return Draft(self, self.current().manifest)

    def _write_aside(self, manifest: dict) -> str:
        name = f"{uuid.uuid4().hex}.part"
        out = self._fs.create(self._path("manifests", name), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return name

    def _rename(self, name: str, version: int) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        to = self._path("manifests", f"v{version:012d}.json")
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(self._path("manifests", name), to, none)  # fails where there is one

    def vacuum(self, keep: int = 2) -> int:
        """Delete what the newest ``keep`` versions don't name, older manifests first; how many folders went."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._path("manifests", f"v{v:012d}.json"), False)
        live = {p["path"] for v in known[-keep:] for t in self._manifest(v)["tables"].values() for p in t["parts"]}
        gone = 0
        for name in self.tables:
            folder = self._path("data", name)
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"data/{name}/{s.getPath().getName()}" not in live:
                    gone += self._fs.delete(s.getPath(), True)
        return gone


class Snapshot:
    """One state of all tables."""

    def __init__(self, lake: Lake, manifest: dict):
        self.lake, self.manifest = lake, manifest

    def parts(self, name: str) -> list[dict]:
        return self.manifest["tables"].get(name, {}).get("parts", [])

    def rows(self, name: str) -> int:
        """Rows of all parts, dead ones too."""
        return sum(p["rows"] for p in self.parts(name))

    def done(self, stream: str) -> int:
        """The number of the last batch of ``stream`` that is in."""
        return self.manifest["done"].get(stream, -1)

    def _stored(self, name: str, parts: list[dict], only: Column | Callable[[int], Column] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(self.manifest["tables"][name]["schema"])
        stored = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        out = None
        for p in parts:
            df = self.lake.spark.read.schema(stored).parquet(f"{self.lake.root}/{p['path']}")
            df = df if only is None else df.filter(only(p["buckets"]))
            out = df if out is None else out.unionByName(df)
        return out.drop(BUCKET)

    def _pruned(self, name: str, keys: DataFrame | None, by: tuple[str, ...]) -> Callable[[int], Column] | None:
        """A filter on buckets for few keys (a number of them that is checked); none for many."""
        if keys is None or not self.parts(name):
            return None
        most = max(p["buckets"] for p in self.parts(name))
        if most == 1:
            return None
        some = keys.select(hashed([F.col(c) for c in by], most).alias("b")).limit(FEW_KEYS + 1).collect()
        if len(some) > FEW_KEYS:
            return None
        found = {r.b for r in some}
        return lambda n: F.col(BUCKET).isin(sorted({b % n for b in found}))

    def _live(self, name: str, parts: list[dict], only: Callable[[int], Column] | None = None, nulls: bool = True, some: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """``some`` rows of the parts without the dead ones. Parts that are no older than the newest dead keys have none and are not joined with them.
        ``nulls``: whether rows may have null keys; without them rows lie where a join by key has left them."""
        t = self.lake.tables[name]
        dead = f"dead_{t.group}"
        newest = max((_batches(p)[1] for p in self.parts(dead)), default=0) if t.group else 0
        old = [p for p in parts if _batches(p)[0] < newest]
        sure = some(self._stored(name, [p for p in parts if p not in old], only)) if len(old) < len(parts) else None
        if not old:
            return sure
        same = only if self.lake.tables[dead].by == t.by else None
        gone = self._stored(dead, self.parts(dead), same).groupBy(*t.key).agg(F.max(BATCH).alias("_dead"))
        gone = gone.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(t.key)], "_dead")
        gone = F.broadcast(gone) if self.rows(dead) <= BROADCAST_ROWS else gone.hint("merge")
        on = F.col(BATCH) < F.col("_dead")
        for i, c in enumerate(t.key):
            on = on & (F.col(c).eqNullSafe(F.col(f"_k{i}")) if nulls else F.col(c) == F.col(f"_k{i}"))
        rows = some(self._stored(name, old, only)).join(gone, on, "left_anti")
        return rows if sure is None else rows.unionByName(sure)

    def read(self, name: str, keys: DataFrame | None = None, where: dict | None = None) -> DataFrame | None:
        """The table's live rows; None before its first commit. ``keys``: only rows whose bucket columns are among these. ``where``: only
        those with these values of the bucket columns. Either way only the buckets in question are read."""
        t = self.lake.tables[name]
        if name not in self.manifest["tables"]:
            return None
        if not self.parts(name):
            return self.lake.spark.createDataFrame([], T.StructType.fromJson(self.manifest["tables"][name]["schema"]))
        if where is not None:
            values = [F.lit(where[c]) for c in t.by]
            only = lambda n: F.col(BUCKET) == hashed(values, n)
            one = [F.col(c) == F.lit(where[c]) for c in t.by]
            return self._live(name, self.parts(name), only, some=lambda rows: rows.filter(reduce(Column.__and__, one))).drop(BATCH)
        if keys is None:
            return self._live(name, self.parts(name)).drop(BATCH)
        only = self._pruned(name, keys, t.by)
        few = only is not None  # else a merge: files of keys are small, the keys in the driver's memory are not
        wanted = keys.select(*t.by).distinct().hint("broadcast" if few else "merge")
        some = lambda rows: rows.join(wanted, list(t.by), "left_semi")
        by_key = set(t.key) <= set(t.by)
        if few or by_key:
            return self._live(name, self.parts(name), only, not by_key, some).drop(BATCH)
        return some(self._live(name, self.parts(name))).drop(BATCH)  # by another key last, and once: rows then lie where their reader needs them


class Draft(Snapshot):
    """The next state, seen by nobody until it is published."""

    def __init__(self, lake: Lake, manifest: dict):
        super().__init__(lake, json.loads(json.dumps(manifest)))
        self.batch = manifest["version"] + 1

    def _write(self, name: str, df: DataFrame, buckets: int) -> dict:
        """A part of rows that have ``_batch``."""
        t, path = self.lake.tables[name], f"data/{name}/{self.batch:012d}-{uuid.uuid4().hex}"
        out = df.withColumn(BUCKET, hashed([F.col(c) for c in t.by], buckets)).hint("rebalance", BUCKET)  # a large bucket becomes several files
        out.sortWithinPartitions(BUCKET, *t.by).write.partitionBy(BUCKET).parquet(f"{self.lake.root}/{path}")
        rows = self.lake.spark.read.schema(f"{BATCH} long, {BUCKET} int").parquet(f"{self.lake.root}/{path}").count()  # from the footers
        return {"path": path, "buckets": buckets, "rows": rows}

    def put(self, name: str, df: DataFrame, expect: int = 0) -> None:
        """Add rows. ``expect``: about how many, from which the number of buckets follows."""
        if clash := {BATCH, BUCKET} & set(df.columns):
            raise ValueError(f"columns of the store's own: {sorted(clash)}")
        known = self.manifest["tables"].setdefault(name, {"schema": json.loads(df.schema.json()), "parts": []})
        names = T.StructType.fromJson(known["schema"]).names
        part = self._write(name, df.select(*names).withColumn(BATCH, F.lit(self.batch).cast("long")), buckets_for(expect))
        if part["rows"]:
            known["parts"].append(part | {"batches": [self.batch, self.batch]})

    def fresh(self, name: str) -> DataFrame:
        """The rows that this commit has put, all of them live: what is made of a batch alone needs no join to find them."""
        schema = T.StructType.fromJson(self.manifest["tables"][name]["schema"])
        own = [p for p in self.parts(name) if _batches(p)[0] == self.batch]
        return self._stored(name, own).drop(BATCH) if own else self.lake.spark.createDataFrame([], schema)

    def kill(self, group: str, keys: DataFrame, expect: int = 0) -> None:
        """Rows of earlier commits with these keys are dead from now on."""
        self.put(f"dead_{group}", keys.select(*self.lake.tables[f"dead_{group}"].by).distinct(), expect)

    def mark(self, stream: str, number: int) -> None:
        self.manifest["done"][stream] = number

    def publish(self) -> Snapshot:
        self.manifest["version"] = self.batch
        self.lake._rename(self.lake._write_aside(self.manifest), self.batch)
        return Snapshot(self.lake, self.manifest)

    def merge(self, full: bool = False) -> bool:
        """Merge parts of like size, ``FAN`` of them at a time (``full``: all parts, after which no dead keys are left); whether anything was."""
        changed, before = False, Snapshot(self.lake, json.loads(json.dumps(self.manifest)))
        for name in [n for n in self.manifest["tables"] if not (full and n.startswith("dead_"))]:
            levels: dict[int, list[dict]] = {}
            for p in before.parts(name):
                levels.setdefault(0 if full else (max(1, p["rows"]).bit_length() - 1) // 2, []).append(p)
            for some in levels.values():
                if len(some) < (1 if full else FAN):
                    continue
                new = self._merged(before, name, some)
                kept = [p for p in self.parts(name) if p not in some]
                self.manifest["tables"][name]["parts"] = kept + ([new] if new["rows"] else [])
                changed = True
        if full:
            for name in [n for n in self.manifest["tables"] if n.startswith("dead_")]:
                changed = changed or bool(self.parts(name))
                self.manifest["tables"][name]["parts"] = []
        return changed

    def _merged(self, before: Snapshot, name: str, some: list[dict]) -> dict:
        t, rows = self.lake.tables[name], before._live(name, some)
        others = [c for c in rows.columns if c not in (t.summed, BATCH)]
        if t.summed:
            rows = rows.groupBy(*others).agg(F.sum(t.summed).alias(t.summed), F.max(BATCH).alias(BATCH)).filter(F.col(t.summed) != 0)
        elif name.startswith("dead_"):
            rows = rows.groupBy(*others).agg(F.max(BATCH).alias(BATCH))
        part = self._write(name, rows, buckets_for(sum(p["rows"] for p in some)))
        return part | {"batches": [min(_batches(p)[0] for p in some), max(_batches(p)[1] for p in some)]}


def compact(lake: Lake, full: bool = False) -> bool:
    """Merge parts and publish the result as a version; False if there was nothing to merge."""
    draft = lake.draft()
    if not draft.merge(full):
        return False
    draft.publish()
    return True
