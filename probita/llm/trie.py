"""A prefix trie of conversations by Patricia construction: sort, keep branch, end and leaf points only, expand at the end.

A turn becomes a 16-byte digest of its role and text, a conversation the digests one after another, so sorting these bytes sorts
conversations by turns with prefixes first. Equal conversations are folded (their number, least id and the hash of their
ids). The distinct ones are sorted over range partitions; each task scans its range once with a stack of the
current path's points and closes a point when the next conversation branches off above it. A closed point stands for its whole
compressed edge: all nodes on it have the same members, and what they save are suffix sums along the edge.

Nodes on the path of a range's first or last conversation may go on in another range. They are never closed: each range gives
what hangs directly at each of them, these are added up by prefix, and the top of the trie, which has twice as many paths as
there are ranges whatever the input, is summed in one task. Then each edge looks its parent's least member up (by
point, so no more of them meet than a range has) and unary nodes are expanded.

The hash of ids that end at a node needs them in order: tasks over ranges of ids join up to 4096 ids of a conversation's
text into one row, and these rows, already in order, are hashed one after another.

Defined results: a null role or text is empty; a null turn stands first; turns with the same number stand in the order of their
digests (SHA-256 of the role's length, a colon, role and text), repeated ones each; rows without conv_id belong to no
conversation; other columns are not read; no conversations have no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

WIDTH, IDS_A_ROW, ROWS_OUT, TOP_ROWS = 16, 4096, 20_000, 200_000
NONE_SHA = hashlib.sha256(b"").hexdigest()
FOLDED = "seq binary, sizes array<long>, least long, n long, ids string"
POINTS = "id long, up long, key binary, up_key binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, ends string, size long, saved array<long>"


def rebuilt(turns: DataFrame, heads: int = 5, most: int = 9) -> DataFrame:
    """conv_id, seq, sizes: the first h turns of conversation c - c % heads, then c's own after its first h; h = crc32(c) % most."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    near = rows.groupBy((F.col("c") - F.col("c") % heads).alias("base")).agg(F.sort_array(F.collect_list(F.struct("c", "turn", "digest", "size"))).alias("t"))
    each = near.select("base", "t", F.explode(F.array_distinct(F.transform("t", lambda x: x["c"]))).alias("c"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("int")
    of = lambda c: F.filter("t", lambda x: x["c"] == c)
    own = of(F.col("c"))
    seq = each.select("c", F.concat(F.slice(of(F.col("base")), F.lit(1), h), F.slice(own, h + 1, F.size(own))).alias("s"))
    return seq.select(F.col("c").alias("conv_id"), F.unhex(F.array_join(F.transform("s", lambda x: x["digest"]), "")).alias("seq"), F.transform("s", lambda x: x["size"]).alias("sizes"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _written(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    held = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield batch()
            held = []
    if held:
        yield batch()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for seq, same in groupby(_rows(batches), key=lambda r: r[0]):
            ids, size = [], None
            for _, size, c in same:
                ids.append(c)
                if len(ids) == IDS_A_ROW:
                    yield seq, size, ids[0], len(ids), ",".join(map(str, ids))
                    ids = []
            if ids:
                yield seq, size, ids[0], len(ids), ",".join(map(str, ids))

    return _written(rows(), FOLDED)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for seq, same in groupby(_rows(batches), key=lambda r: r[0]):
            h, n, least, size = hashlib.sha256(), 0, None, None
            for _, size, first, k, ids in same:
                h.update(b"," * (n > 0) + ids.encode())
                n, least = n + k, first if least is None else least
            yield seq, size, least, n, h.hexdigest()

    return _written(rows(), FOLDED)


def folded(convs: DataFrame) -> DataFrame:
    """A table of :func:`rebuilt` -> a row per distinct sequence: its least id, their number, the hash of their ids."""
    some = convs.repartitionByRange("conv_id").sortWithinPartitions("seq", "conv_id").select("seq", "sizes", "conv_id").mapInArrow(_joined, FOLDED)
    return some.repartition("seq").sortWithinPartitions("seq", "least").mapInArrow(_hashed, FOLDED)


def shared(a: bytes, b: bytes) -> int:
    """How many turns two sequences begin with in common."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


def prefix_keys(seq: bytes) -> list[bytes]:
    """A digest for each prefix, that of no turns first."""
    h, out = hashlib.sha256(), [hashlib.sha256().digest()]
    for k in range(0, len(seq), WIDTH):
        h.update(seq[k : k + WIDTH])
        out.append(h.copy().digest())
    return out


class Point:
    """A branch, end or leaf with what is known of its subtree: members, their least id, children, leaves, saved bytes."""

    __slots__ = ("children", "depth", "ends", "id", "least", "leaves", "n", "saved")

    def __init__(self, depth: int, id_: int):
        self.depth, self.id, self.n, self.least, self.ends, self.children, self.leaves, self.saved = depth, id_, 0, None, None, 0, 0, 0

    def holds(self, n: int, least: int) -> None:
        self.n, self.least = self.n + n, least if self.least is None else min(self.least, least)


class Patricia:
    """Takes a range's distinct sequences in order, gives rows of ``POINTS``: a closed edge with its nodes' savings, top first,
    or (with ``key``) a node of the range's border with what hangs directly at it."""

    def __init__(self, first_id: int = 0):
        self.next, self.stack, self.path, self.sizes, self.border, self.keys = first_id, [], None, [], 0, []

    def _push(self, depth: int) -> Point:
        self.next += 1
        self.stack.append(Point(depth, self.next))
        return self.stack[-1]

    def _closed(self, p: Point, above: int) -> tuple:
        """The edge of ``p`` from below depth ``above`` on, added to the top of the stack."""
        up = self.stack[-1]
        own = (p.n - 1) * np.array(self.sizes[above : p.depth], np.int64)
        own[-1] += p.saved
        saved = np.cumsum(own[::-1])[::-1]
        leaves = p.leaves if p.children else 1
        up.holds(p.n, p.least)
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + int(saved[0])
        return p.id, up.id, None, None, above + 1, p.least, p.n, p.children, leaves, p.ends, None, saved.tolist()

    def _open(self, p: Point, above: int) -> Iterator[tuple]:
        for d in range(p.depth, above, -1):
            size, up = (self.sizes[d - 1], self.keys[d - 1]) if d else (0, None)
            if d == p.depth:
                yield p.id, None, self.keys[d], up, d, p.least, p.n, p.children, p.leaves, p.ends, size, [p.saved]
            else:
                yield None, None, self.keys[d], up, d, None, 0, 0, 0, None, size, [0]

    def _close(self, depth: int) -> Iterator[tuple]:
        while self.stack and self.stack[-1].depth > depth:
            p = self.stack.pop()
            above = max(self.stack[-1].depth if self.stack else -1, depth)
            if above >= 0 and self.stack[-1].depth < above:
                self._push(above)
            if p.depth <= self.border:  # on the path of the first sequence (or, in the end, of the last)
                yield from self._open(p, above)
            else:
                yield self._closed(p, above)

    def add(self, seq: bytes, sizes: list[int], least: int, n: int, ends: str) -> Iterator[tuple]:
        depth = len(seq) // WIDTH
        if self.path is None:
            self._push(0)
            self.border, self.keys = depth, prefix_keys(seq)
        else:
            common = shared(self.path, seq)
            yield from self._close(common)
            self.border = min(self.border, common)
        p = self.stack[-1] if self.stack[-1].depth == depth else self._push(depth)
        p.holds(n, least)
        p.ends, self.path, self.sizes = ends, seq, sizes

    def end(self) -> Iterator[tuple]:
        if self.path is not None:
            self.border, self.keys = len(self.path), prefix_keys(self.path)
            yield from self._close(-1)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    trie = Patricia(TaskContext.get().partitionId() << 40)

    def rows() -> Iterator[tuple]:
        for row in _rows(batches):
            yield from trie.add(*row)
        yield from trie.end()

    return _written(rows(), POINTS)


def _top(t: pa.Table) -> pa.Table:
    """The nodes that ranges share: sums over their subtrees, deepest first."""
    rows = sorted(t.to_pylist(), key=lambda r: -r["depth"])
    by = {r["key"]: r for r in rows}
    for r in rows:
        r["saved"] += (r["n_convs"] - 1) * r["size"]
        r["n_leaves"] += not r["n_children"]
        up = by.get(r["up_key"])
        if up is not None:
            up["n_convs"] += r["n_convs"]
            up["conv_id"] = min(x for x in (up["conv_id"], r["conv_id"]) if x is not None)
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved"] += r["saved"]
    for r in rows:
        r["parent_conv_id"] = by[r["up_key"]]["conv_id"] if r["up_key"] is not None else None
    names = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    kinds = [pa.binary(), *[pa.int64()] * 7, pa.string()]
    return pa.table([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)


def trie(convs: DataFrame) -> DataFrame:
    """A table of :func:`rebuilt` (conv_id, seq, sizes) -> a row per node."""
    points = staged(staged(folded(convs), "trie-folded").repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(_points, POINTS), "trie-points")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")] + [F.sum(F.col("saved")[0]).alias("saved")]
    same = [F.max(c).alias(c) for c in ("up_key", "depth", "ends", "size")]
    border = points.filter("key is not null").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, *same)
    top = border.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_top, "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string")
    top = staged(top, "trie-top")
    small = F.broadcast if top.count() <= TOP_ROWS else lambda df: df
    edges = points.filter("key is null")
    ids = edges.select("id", "conv_id").unionByName(points.filter("key is not null and id is not null").select("id", "key").join(small(top.select("key", "conv_id")), "key").select("id", "conv_id"))
    edges = edges.join(ids.select(F.col("id").alias("up"), F.col("conv_id").alias("above")), "up")
    nodes = edges.select("*", F.posexplode("saved").alias("i", "s"))
    low = F.col("i") == F.size("saved") - 1
    expanded = nodes.select(
        "conv_id", (F.col("depth") + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(low, F.col("n_children")).otherwise(F.lit(1)).alias("n_children"), "n_leaves", F.col("s").alias("saved"), F.when(low, F.col("ends")).alias("ends"),
    )
    out = expanded.unionByName(top.drop("key"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE_SHA)).alias("ends_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(staged(rebuilt(table(spark, sf_dir, "conversations")), "trie-rebuilt"))


def _crc(x: str) -> str:
    """CRC-32 of a string's ASCII characters in SQL: eight shifts for each."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda y: ascii(y)::BIGINT)), lambda a, b: "
        "list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: z::BIGINT)), lambda p, q: xor(p >> 1, CASE WHEN p & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"
    )


OP12_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS d, strlen(text)::BIGINT AS b FROM t),
o AS (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(b ORDER BY turn NULLS FIRST, d) AS bs FROM k GROUP BY conv_id),
h AS (SELECT *, ({_crc('conv_id::VARCHAR')}) % 9 AS h FROM o),
r AS (
  SELECT h.conv_id, list_concat(coalesce(base.ds[1:h.h], []), h.ds[h.h + 1:]) AS ds, list_concat(coalesce(base.bs[1:h.h], []), h.bs[h.h + 1:]) AS bs
  FROM h LEFT JOIN o AS base ON base.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, array_to_string(ds, '') AS whole, bs, len(ds) AS n, unnest(range(0, len(ds) + 1)) AS depth FROM r),
n AS (
  SELECT substr(whole, 1, 32 * depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN depth = 0 THEN 0 ELSE bs[depth] END) AS b,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
c AS (SELECT up.path, count(*) AS n_children FROM n JOIN n AS up ON n.depth > 0 AND up.path = substr(n.path, 1, 32 * (n.depth - 1)) GROUP BY 1),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
s AS (SELECT substr(path, 1, 32 * a) AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * b) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM l) GROUP BY 1)
SELECT l.conv_id, l.depth, up.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, l.ends_sha256
FROM l JOIN s USING (path) LEFT JOIN l AS up ON l.depth > 0 AND up.path = substr(l.path, 1, 32 * (l.depth - 1))
"""
