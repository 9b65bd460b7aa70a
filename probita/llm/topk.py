"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integer vectors floor(scale * x). They are ordered by two levels of centroids, so that neighbours are alike, and
ranges of that order are blocks, each a forward index (a matrix) with the largest and least component per term. The bound
of a query on a block is the sum over terms of the larger of q*max and q*min. Three steps, of which only the last touches
whole blocks in numbers:

1. bounds alone (summaries: two rows per block) give each query the block with the highest bound, which is scored: its k-th
   score is the query's floor;
2. bounds again tell which blocks reach a floor of a group of queries; only those go to the group;
3. there blocks are taken in falling order of their bounds, and a query stops once the bound falls below its k-th score so far
   (not at equality: ties go to smaller ids). The best k of all parts are merged by query.

Groups of queries are ranges of the same order, so alike queries share their blocks. Where vectors have no clusters, no bound
prunes, and each group meets every block: exact search is then queries x rows by nature, and groups are as large as a
task's memory allows (``QUERIES`` x ``GROUPED`` blocks), which keeps what is shuffled to a few hundredths of the scoring. The
centroids are fitted on a sample of at most ``SAMPLE`` rows and only decide the order; every row is indexed and results are
exact. Scores are sums of products of integers below 2**53, so doubles are exact.

Defined results: vectors that are null, hold null or non-finite components, or have a null id take no part; vectors of a
length other than the query's have no score with it; a row is no candidate of its own, but another row of the same id is, and
each row that asks gets its own answer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import staged, table

K, EVERY, SCALE = 5, 50, 256
#: Rows of a block, blocks and queries of a task; rows that centroids are fitted on, and centroids of each level.
BLOCK, GROUPED, QUERIES, SAMPLE, CENTROIDS = 256, 64, 8192, 4096, 64
FLOORED = "q long, dim int, uids binary, ids binary, matrix binary, floor binary"
ENTRY = "n long, dim int, uids binary, ids binary, matrix binary, high binary, low binary"


def whole(vectors: DataFrame, vec_id: str, vector: str, scale: int, asks: Column) -> DataFrame:
    """(uid, vec_id, v array<double> of integers, dim, asks), of the vectors that take part."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), F.coalesce(asks, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(fine)
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("double")).alias("v"), F.size("x").alias("dim"), "asks")


def _centred(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` centroids of the rows, by a few rounds of k-means from spread rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(6):
        near = _nearest(x, c)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)


def fitted(rows: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dim -> two levels of centroids, the second of what the first leaves over, from at most ``sample`` rows by hash of their id."""
    some = rows.select("dim", "v", F.xxhash64("vec_id", "uid").alias("h")).orderBy("h").limit(sample).collect()
    out = {}
    for dim in {r["dim"] for r in some} - {0}:
        x = np.array([r["v"] for r in some if r["dim"] == dim])
        first = _centred(x, CENTROIDS)
        out[dim] = first, _centred(x - first[_nearest(x, first)], CENTROIDS)
    return out


def _dealt(cells: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, v, cell = b.column("dim").to_numpy(), b.column("v"), np.zeros(b.num_rows, np.int64)
            for dim in set(dims.tolist()) & set(cells):
                on = np.flatnonzero(dims == dim)
                x = v.take(pa.array(on)).flatten().to_numpy().reshape(len(on), dim)
                near = _nearest(x, cells[dim][0])
                cell[on] = near * CENTROIDS + _nearest(x - cells[dim][0][near], cells[dim][1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return run


def _blocks(size: int):
    """(uid, vec_id, v, dim, ...), sorted by dim and cell -> a row of ENTRY per ``size`` rows of one dim."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, dim = TaskContext.get().partitionId() << 36, [], None

        def out() -> pa.RecordBatch:
            nonlocal number
            uids, ids, rows = zip(*held, strict=True)
            m = np.array(rows).reshape(len(rows), dim)
            cols = [number, dim, np.array(uids, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes()]
            held.clear()
            number += 1
            return pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in ENTRY.split(", ")], cols, strict=True))], schema=pa.schema([("n", pa.int64()), ("dim", pa.int32()), *[(x, pa.binary()) for x in ("uids", "ids", "matrix", "high", "low")]]))

        for b in batches:
            for d, u, i, v in zip(b.column("dim").to_pylist(), b.column("uid").to_pylist(), b.column("vec_id").to_pylist(), b.column("v"), strict=True):
                if held and (d != dim or len(held) == size):
                    yield out()
                dim = d
                held.append((u, i, v.values.to_numpy()))
        if held:
            yield out()

    return run


def _array(x: bytes, dim: int = 1) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(-1, dim) if dim else np.zeros((1, 0))


def _long(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def search(q_uids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None, turns: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Best (scores, ids), len(q) x k, padded with -inf, of ``q`` against ``blocks`` of (uids, ids, matrix), scores below ``floor`` not wanted, at most ``turns`` blocks a query; and how many (query, block) pairs were scored."""
    best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    bound = bounds(q, np.array([m.max(0) for *_, m in blocks]), np.array([m.min(0) for *_, m in blocks]))
    order, on, scored = np.argsort(-bound, axis=1), np.arange(len(q)), 0
    floor = np.full(len(q), -np.inf) if floor is None else floor
    for turn in range(min(len(blocks), turns or len(blocks))):
        at = order[on, turn]
        go = bound[on, at] >= np.maximum(best[on, -1], floor[on])  # bounds only fall from here on
        on, at = on[go], at[go]
        for b in np.unique(at).tolist():
            rows, (uids, ids, m) = on[at == b], blocks[b]
            scored += len(rows)
            s = q[rows] @ m.T
            s[q_uids[rows][:, None] == uids[None, :]] = -np.inf
            s, i = np.concatenate([best[rows], s], 1), np.concatenate([who[rows], np.broadcast_to(ids, s.shape)], 1)
            i[np.isneginf(s)] = np.iinfo(np.int64).max
            first = np.lexsort((i, -s), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
    return best, who, scored


def _by_dim(a: pa.Table, b: pa.Table, f: Callable, kinds: list[tuple[str, type]]) -> pa.Table:
    """Columns of ``f(dim, rows of a, rows of b)`` for each dim that both have."""
    dims = sorted(set(a["dim"].to_pylist()) & set(b["dim"].to_pylist()))
    of = lambda t, dim: t.filter(pc.equal(t["dim"], dim)).to_pylist()
    got = [f(dim, of(a, dim), of(b, dim)) for dim in dims]
    cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0)] * len(kinds)
    return pa.table([pa.array(c.astype(t)) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


def _bounded(dim: int, q: list[dict], b: list[dict]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each group of queries, its bounds on all blocks, and the blocks' numbers."""
    high, low = (np.concatenate([_array(x[k], dim) for x in b]) for k in ("high", "low"))
    n = np.array([x["n"] for x in b], np.int64)
    for x in q:
        yield x, bounds(_array(x["matrix"], dim), high, low), n


def _best_block(q: pa.Table, b: pa.Table) -> pa.Table:
    def f(dim: int, q: list[dict], b: list[dict]) -> tuple:
        got = [(_long(x["uids"]), np.full(len(bound), x["q"]), n[bound.argmax(1)], bound.max(1)) for x, bound, n in _bounded(dim, q, b)]
        return tuple(np.concatenate(c) for c in zip(*got, strict=True))

    return _by_dim(q, b, f, [("uid", np.int64), ("q", np.int64), ("n", np.int64), ("bound", np.float64)])


def _live(q: pa.Table, b: pa.Table) -> pa.Table:
    def f(dim: int, q: list[dict], b: list[dict]) -> tuple:
        got = [(np.full(int(on.sum()), x["q"]), n[on]) for x, bound, n in _bounded(dim, q, b) for on in [(bound >= np.frombuffer(x["floor"], np.float64)[:, None]).any(0)]]
        return tuple(np.concatenate(c) for c in zip(*got, strict=True))

    return _by_dim(q, b, f, [("q", np.int64), ("n", np.int64)])


def _scores(k: int, turns: int | None):
    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        def f(dim: int, q: list[dict], b: list[dict]) -> tuple:
            held = [(_long(x["uids"]), _long(x["ids"]), _array(x["matrix"], dim).reshape(len(x["ids"]) // 8, dim)) for x in b]
            got = []
            for x in q:
                uids, ids = _long(x["uids"]), _long(x["ids"])
                best, who, _ = search(uids, _array(x["matrix"], dim).reshape(len(ids), dim), held, k, np.frombuffer(x["floor"], np.float64), turns)
                r, c = np.nonzero(~np.isneginf(best))
                got.append((uids[r], ids[r], np.full(len(r), x["q"]), who[r, c], best[r, c]))
            return tuple(np.concatenate(c) for c in zip(*got, strict=True))

        return _by_dim(q, b, f, [("uid", np.int64), ("query_id", np.int64), ("q", np.int64), ("vec_id", np.int64), ("score", np.int64)])

    return run


def _with_floor(k: int):
    """A group of queries with the k-th score that each has so far (fewer than k: none)."""
    def run(q: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for x in q.to_pylist():
            uids, floor = _long(x["uids"]), np.full(len(x["uids"]) // 8, -np.inf)
            at = {u: i for i, u in enumerate(uids.tolist())}
            by: dict[int, list[int]] = {}
            for u, s in zip(found["uid"].to_pylist(), found["score"].to_pylist(), strict=True):
                by.setdefault(u, []).append(s)
            for u, s in by.items():
                if len(s) >= k and u in at:
                    floor[at[u]] = sorted(s)[-k]
            out.append(x | {"floor": floor.tobytes()})
        return pa.Table.from_pylist(out, schema=q.schema.append(pa.field("floor", pa.binary())))

    return run


def top_k(vectors: DataFrame, asks: Column, *, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the best k of each row of ``vectors`` for which ``asks`` holds."""
    rows = staged(whole(vectors, vec_id, vector, scale, asks), "topk-rows")
    order, columns = ["dim", "cell", "vec_id", "uid"], "uid long, vec_id long, v array<double>, dim int, asks boolean, cell long"
    placed = rows.mapInArrow(_dealt(fitted(rows)), columns).repartitionByRange(*order)
    ranged = staged(placed, "topk-order").sortWithinPartitions(*order)
    blocks = staged(ranged.mapInArrow(_blocks(BLOCK), ENTRY), "topk-blocks")
    asked = rows.filter("asks").count()
    asked = ranged.filter("asks").coalesce(-(-asked // QUERIES) or 1).mapInArrow(_blocks(QUERIES), ENTRY)
    asked = staged(asked.select(F.col("n").alias("q"), "dim", "uids", "ids", "matrix"), "topk-queries")
    n_blocks = blocks.count()
    parts, chunks = -(-n_blocks // 4096) or 1, -(-n_blocks // GROUPED) or 1
    short = blocks.select("n", "dim", "high", "low", F.pmod(F.xxhash64("n"), F.lit(parts)).alias("g"))
    cells = lambda side: side.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).groupBy("g", "q")
    groups = F.array_sort(F.array(*[F.lit(r["q"]) for r in asked.select("q").collect()]).cast("array<long>"))  # a number per QUERIES queries
    bound = lambda side, f, kinds: cells(side).cogroup(short.withColumn("q", F.explode(groups)).groupBy("g", "q")).applyInArrow(f, kinds)

    def scored(side: DataFrame, pairs: DataFrame, turns: int | None) -> DataFrame:
        """Each group of queries against its blocks, some of them at a time."""
        met = pairs.join(blocks.select("n", "dim", "uids", "ids", "matrix"), "n").withColumn("c", F.pmod(F.xxhash64("n"), F.lit(chunks)))
        near = side.join(pairs.select("q", F.pmod(F.xxhash64("n"), F.lit(chunks)).alias("c")).distinct(), "q")
        return near.groupBy("q", "c").cogroup(met.groupBy("q", "c")).applyInArrow(_scores(k, turns), "uid long, query_id long, q long, vec_id long, score long")

    no_floor = asked.mapInArrow(_unfloored, FLOORED)
    first = bound(asked, _best_block, "uid long, q long, n long, bound double").groupBy("uid", "q").agg(F.max_by("n", F.struct("bound", "n")).alias("n"))
    seeds = scored(no_floor, first.select("q", "n").distinct(), 1)
    floored = staged(asked.groupBy("q").cogroup(seeds.groupBy("q")).applyInArrow(_with_floor(k), FLOORED), "topk-floors")
    found = scored(floored, staged(bound(floored, _live, "q long, n long").distinct(), "topk-live"), None)
    rank = F.row_number().over(W.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unfloored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        floor = pa.array([np.full(len(x) // 8, -np.inf).tobytes() for x in b.column("uids").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:5], floor], names=[*b.schema.names[:5], "floor"])


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


OP5_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.rid AS rid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.rid <> q.rid WHERE q.vec_id % {EVERY} = 0 AND len(c.x) = len(q.x)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
