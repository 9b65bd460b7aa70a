"""SimHash near-duplicates: fingerprints, a binary trie self-join under a Hamming budget, and components.

A fingerprint has a 1 where more than half of a text's shingle hashes (XXH64, seed 42, repeats included) have one.
Two different fingerprints within the budget of 2 bits agree on six of the eight bytes, so the trie is walked once for
each of the 28 ways to put six bytes in front: the first 48 levels are a shuffle key (zero bits differ there), and one
task traverses node pairs of the remaining 16 levels together, adds up differing bits and prunes a pair beyond the
budget. No such group holds more than 65,536 distinct fingerprints, whatever the data. Exact copies share a fingerprint
and are folded before the join; each group's links go on as a spanning star, not as pairs.

Edited copies differ in more bits than that, so :func:`near_groups` works on 256 bits of the distinct five-word shingles: two
texts of similarity 0.8 (angle arccos(8/9)) differ in 15% of them, give or take 2.2%, and are proposed at ``WIDE_BUDGET`` or
fewer. Its tries take the bits in pseudorandom orders, one walk per order; the first levels, equal bits again, are the shuffle
key. Their number follows the logarithm of the number of texts, so groups stay small, and the number of walks follows from it
such that a pair of similarity 0.8 is proposed with probability ``RECALL``, at every size (:func:`walks_for`). Shingle sets
decide: within each component of proposals all texts whose similarity is ``LEAST`` or more on the 64-bit hashes of their
shingles are linked (:func:`true_links`), and no others.

Defined results: null and empty texts and those without words have fingerprint zero and link to each other; fewer words
than a shingle make one shingle; repeated rows get equal rows; a null id never becomes a component id unless all ids
of the component are null; other columns are carried unread.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forgotten, fresh, kept_by_key, one_of_each, row_key, rows_among, shared_dir, shuffles_freed, staged, table

BUDGET, SEED = 2, 42
#: Wide fingerprints: bits, budget over all of them, levels walked below the key and the budget there, chance to be proposed.
WIDE_BITS, WIDE_BUDGET, LEVELS, LEVEL_BUDGET, RECALL = 256, 56, 16, 6, 0.95
WIDE_SHARE = math.acos(8 / 9) / math.pi
#: Rows walked at once, and how many members of each component of a larger group later rows are compared with first.
BLOCK, KEPT = 2048, 64
#: Walks that are shuffled at a time.
WALKS_EACH = 8
#: Similarity in per cent from which texts are near copies; texts of a component that one task compares; texts that each such task also gets.
LEAST, SETS, PIVOTS = 80, 512, 8
#: Edges of a node from which it may be a hub.
HUB = 1000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _hashes(text: str | None, shingle: int) -> Iterator[bytes]:
    """The digests of the text's shingles, some thousands at a time; nothing for a text without words."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return
    flat, size = b" ".join(w), np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(w))
    digest = xxhash.xxh64_digest
    n = len(w) - k + 1
    for at in range(0, n, 8192):
        yield b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[at : min(at + 8192, n)].tolist(), ends[at + k - 1 : at + 8192 + k - 1].tolist(), strict=False)])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64 bits as a signed integer."""
    votes, n = np.zeros(64, np.int64), 0
    for part in _hashes(text, shingle):
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        votes, n = votes + bits.sum(0, dtype=np.int64), n + len(bits)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(np.frombuffer(b"".join(_hashes(text, shingle)), np.uint64))


def wide_fingerprint(text: str | None, shingle: int = 5) -> bytes:
    return _wide(shingle_set(text, shingle))


def _marked(text: str | None) -> bytes:
    """The wide fingerprint and a 128-bit digest of the set, which tells different sets of one fingerprint apart."""
    h = shingle_set(text)
    return _wide(h) + hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _wide(h: np.ndarray) -> bytes:
    """``WIDE_BITS`` bits over the set of shingles; each hash is remixed once per 64 bits."""
    votes = np.zeros(WIDE_BITS, np.int64)
    salts = np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 8192):
        x = h[at : at + 8192, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        votes += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(h)).tobytes()


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3) -> tuple[DataFrame, str]:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    name = fresh(docs, "_fp")
    return docs.withColumn(name, of(F.col(text))), name


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each item's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def node_pairs(key: np.ndarray, rest: np.ndarray, budget: int, bits: int) -> tuple[np.ndarray, ...]:
    """Pairs of leaves, as ranges of rows, with equal ``key`` and at most ``budget`` differing bits in ``rest``; rows sorted by both.

    Node pairs (a range of rows against a range of rows) go down level by level, all groups at once."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    lo, hi = edge[:-1], edge[1:]
    big = hi - lo > 1
    al, ah, bl, bh = lo[big], hi[big], lo[big], hi[big]
    err = np.zeros(len(al), np.int8)
    for depth in range(bits):
        ones = np.r_[0, np.cumsum((rest >> (bits - 1 - depth)) & 1)]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        own = al == bl  # a node against itself: its halves meet once
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        x = ~own
        parts.append((am[x], ah[x], bl[x], bm[x], err[x] + 1))
        al, ah, bl, bh, err = (np.concatenate(c) for c in zip(*parts, strict=True))
        keep = (al < ah) & (bl < bh) & (err <= budget) & ((al != bl) | (ah - al > 1))
        al, ah, bl, bh, err = al[keep], ah[keep], bl[keep], bh[keep], err[keep]
    return al, ah, bl, bh


def trie_links(key: np.ndarray, rest: np.ndarray, budget: int = BUDGET, bits: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different rows within the budget; see :func:`node_pairs`."""
    al, _, bl, _ = node_pairs(key, rest, budget, bits)
    return al, bl


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rest, fp), sorted by key and rest -> spanning edges (a, b) of each key's links."""
    held: tuple = (np.zeros(0, np.int64),) * 3
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key, rest, fp = (np.concatenate(c) for c in zip(held, new, strict=True))
        last = np.searchsorted(key, key[-1]) if len(key) else 0  # the last key's rows may go on in the next batch
        held = (key[last:], rest[last:], fp[last:])
        yield from _star(key[:last], rest[:last], fp[:last])
    yield from _star(*held)


def _star(key: np.ndarray, rest: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(key) < 2:
        return
    a, b = trie_links(key, rest)
    if len(a):
        root = _roots(len(key), a, b)
        on = np.flatnonzero(root != np.arange(len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[on]), pa.array(fp[root[on]])], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (column fp) -> edges (a, b) that span every component of fingerprints within the budget."""
    byte = lambda i: F.shiftrightunsigned("fp", 56 - 8 * i).bitwiseAND(F.lit(255))
    ways = []
    for n, free in enumerate(combinations(range(8), 2)):
        front = F.lit(n).cast("long")
        for i in range(8):
            if i not in free:
                front = F.shiftleft(front, 8) + byte(i)
        ways.append(F.struct(front.alias("key"), (F.shiftleft(byte(free[0]), 8) + byte(free[1])).alias("rest")))
    rows = fps.select("fp", F.explode(F.array(*ways)).alias("w")).select("w.key", "w.rest", "fp")
    return rows.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(_walk, "a long, b long").distinct()


def _looked_up(rows: DataFrame, values: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """``rows`` left-joined with ``values`` (key, ``n``: rows with that key, ...), without ``n``; no null keys in ``values``.

    A hub has over one in 5,000 of ``total``, so there are fewer than 10,000 of them (two rows an edge): they are joined by
    broadcast, and no task gets all rows of a hub."""
    most = max(HUB, total // 5000)
    hubs = F.broadcast(values.filter(F.col(n) > most).drop(n))
    others = rows.join(hubs, key, "left_anti").join(values.filter(F.col(n) <= most).drop(n), key, "left")
    return rows.join(hubs, key).unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root), root the least node reachable: alternating large and small stars, each round a table."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "simhash-edges")
    n, mark = now.count(), None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _looked_up(both.filter("v > u"), low, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        last, now = now, staged(small.distinct(), "simhash-edges")
        forgotten(last)
        got = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())
        if got == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        n, mark = got[0], got


def with_component(rows: DataFrame, fp: str, doc_id: str) -> tuple[DataFrame, str]:
    """``rows`` (with a fingerprint column) with the component's least id; and that column's name. ``rows`` is read more than once.

    Rows of a common fingerprint, and fingerprints of a large component, stay where they are."""
    per = staged(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least"), F.count(F.lit(1)).alias("rows")).filter("fp is not null"), "simhash-fps")
    roots = components(links(per.select("fp")))
    named = per.join(roots, per["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "rows")
    named = staged(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n"))
    size = named.agg(F.count(F.lit(1)).alias("fps"), F.sum("rows").alias("rows")).first()
    out, key, n = fresh(rows, "_component"), fresh(rows, "_component_fp"), fresh(rows, "_component_rows")
    to = _looked_up(named.select("fp", "root", "rows"), least, "root", size["fps"])
    to = staged(to.select(F.col("fp").alias(key), F.col("component").alias(out), F.col("rows").alias(n)), "simhash-components")
    return _looked_up(rows.withColumn(key, F.col(fp)), to, key, size["rows"] or 0, n).drop(key), out


def _wide_links(key: np.ndarray, rest: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows whose leaves meet in the trie and whose ``bits`` (rows of 64-bit words) are within the whole budget."""
    al, ah, bl, bh = node_pairs(key, rest, LEVEL_BUDGET, LEVELS)
    strips = -(-(ah - al) // 256)  # a wide leaf is compared in strips
    at = np.repeat(np.arange(len(al)), strips)
    low = al[at] + 256 * (np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips))
    high, bl, bh = np.minimum(low + 256, ah[at]), bl[at], bh[at]
    size = (high - low) * (bh - bl)
    part = np.cumsum(size) >> 18
    found = [(np.zeros(0, np.int64),) * 2]
    for one in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1) if len(size) else ():
        of = np.repeat(one, size[one])
        off = np.arange(len(of)) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
        i, j = low[of] + off // (bh - bl)[of], bl[of] + off % (bh - bl)[of]
        i, j = i[i < j], j[i < j]
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= WIDE_BUDGET
        found.append((i[near], j[near]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _wide_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rest, node, wide), sorted by key and rest -> spanning edges (a, b) of each key's links.

    Groups of up to ``BLOCK`` rows are compared whole. A larger group goes on block by block, each first together with
    earlier rows: all members of a component of up to ``KEPT`` texts, ``KEPT`` spread members of a larger one. Then rows
    meet the other members of each component that they don't belong to yet, so no link in the group is left out."""
    none = np.zeros(0, np.int64)
    held, done = (none, none, none, np.zeros((0, WIDE_BITS // 64), np.uint64)), 0
    root = none  # of the first ``done`` rows of held, which belong to one group

    def edges(node: np.ndarray, old: np.ndarray, new: np.ndarray) -> list[pa.RecordBatch]:
        on = np.flatnonzero((old == np.arange(len(old))) & (new != old))  # components that have joined another
        return [pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[new[on]])], names=["a", "b"])] if len(on) else []

    def first_met(size: int) -> np.ndarray:
        order = np.argsort(root, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(root[order]) != 0])
        count = np.diff(np.r_[first, len(root)])
        rank, of = np.arange(len(root)) - np.repeat(first, count), np.repeat(count, count)
        met = np.zeros(size, bool)
        met[order[(of <= KEPT) | (rank * KEPT // of != (rank - 1) * KEPT // of)]] = True
        met[len(root) :] = True
        return met

    def joined(size: int) -> np.ndarray:
        """The roots of the first ``size`` rows, of which ``done`` have one."""
        key, rest, _, bits = (c[:size] for c in held)
        met = first_met(size)
        near = np.flatnonzero(met)
        a, b = _wide_links(key[near], rest[near], bits[near])
        now = np.r_[root, np.arange(done, size)]
        now = _roots(size, now[near[a]], now[near[b]])[now]
        rest_of = np.flatnonzero(~met)
        for one in np.unique(root[rest_of]):
            other = rest_of[root[rest_of] == one]
            for at in range(0, len(other), 128):
                part, new = other[at : at + 128], np.flatnonzero(now[done:] != now[one]) + done
                if not len(new):
                    break
                i, j = np.nonzero(np.bitwise_count(bits[part, None] ^ bits[None, new]).sum(2, dtype=np.int64) <= WIDE_BUDGET)
                now = _roots(size, now[part[i]], now[new[j]])[now]
        return now

    def rows_of(batch: pa.RecordBatch) -> tuple:
        wide = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, WIDE_BITS // 64)
        return *(batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)), wide

    def whole(size: int) -> list[pa.RecordBatch]:
        """Edges of the first ``size`` rows: all of their groups, which end there."""
        nonlocal held, root, done
        out = block(int(np.searchsorted(held[0][:size], held[0][0], "right"))) if done else []
        start = done
        if size - start > 1:
            key, rest, node, bits = (c[start:size] for c in held)
            out += edges(node, np.arange(len(key)), _roots(len(key), *_wide_links(key, rest, bits)))
        held, root, done = tuple(c[size:] for c in held), none, 0
        return out

    def block(size: int) -> list[pa.RecordBatch]:
        nonlocal root, done
        now = joined(size)
        out = edges(held[2], np.r_[root, np.arange(done, size)], now)
        root, done = now, size
        return out

    for batch in batches:
        held = tuple(np.concatenate(c) for c in zip(held, rows_of(batch), strict=True))
        while len(held[0]) > done + BLOCK:
            cut = int(np.searchsorted(held[0], held[0][done + BLOCK]))  # the group that goes on beyond the block starts here
            yield from whole(cut) if cut else block(done + BLOCK)
    yield from whole(len(held[0]))


def walks_for(front: int) -> int:
    """How many walks propose a pair of similarity 0.8 with probability ``RECALL``, over all numbers d of differing bits."""
    share = []
    for d in range(WIDE_BUDGET + 1):
        chance = math.comb(WIDE_BITS, d) * WIDE_SHARE**d * (1 - WIDE_SHARE) ** (WIDE_BITS - d)
        ways = sum(math.comb(LEVELS, i) * math.comb(WIDE_BITS - front - LEVELS, d - i) for i in range(min(d, LEVEL_BUDGET) + 1))
        share.append((chance, ways / math.comb(WIDE_BITS, d)))  # the d bits lie beyond the front, at most LEVEL_BUDGET in the levels
    found = lambda n: sum(chance * (1 - (1 - met) ** n) for chance, met in share)
    high = 1
    while found(high) < RECALL:
        high *= 2
    low = high // 2
    while high - low > 1:
        low, high = (low, mid) if found(mid := (low + high) // 2) >= RECALL else (mid, high)
    return high


def wide_links(nodes: DataFrame) -> DataFrame:
    """(node, wide), one row per distinct set of shingles -> a table of edges (a, b) spanning the components found within the wide budget.

    ``WALKS_EACH`` walks are shuffled at a time, and their shuffle files go once their edges are written: the disk in use
    does not grow with the number of walks."""
    front = min(40, max(8, math.ceil(math.log2(max(nodes.count(), 2))) - 7))
    walks = walks_for(front)

    def deal(batches: Iterator[pa.RecordBatch], some: range) -> Iterator[pa.RecordBatch]:
        orders = {m: np.random.default_rng([SEED, m]).permutation(WIDE_BITS)[: front + LEVELS] for m in some}
        weight = 1 << np.arange(64, dtype=np.int64)[::-1]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                wide = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, WIDE_BITS // 8)
                bits = np.unpackbits(wide, axis=1).astype(np.int64)
                for m, order in orders.items():
                    key, rest = bits[:, order[:front]] @ weight[-front:] + (m << front), bits[:, order[front:]] @ weight[-LEVELS:]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rest.astype(np.int32)), part.column(0), part.column(1)], names=["key", "rest", "node", "wide"])

    path = f"{shared_dir(nodes.sparkSession)}/simhash-met-{uuid.uuid4().hex}"
    for m in range(0, walks, WALKS_EACH):
        some = range(m, min(m + WALKS_EACH, walks))
        dealt = nodes.select("node", "wide").mapInArrow(lambda b, some=some: deal(b, some), "key long, rest int, node long, wide binary")
        met = dealt.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(_wide_walk, "a long, b long").distinct()
        with shuffles_freed(met.sparkSession):
            met.write.mode("append").parquet(path)
    out = nodes.sparkSession.read.schema("a long, b long").parquet(path)
    out.staged_at = path
    return out


class _Block:
    """The shingle sets of one block, compared exactly; ``label`` tells what is known to belong together."""

    def __init__(self, node: list[int], label: list[int], sets: list[np.ndarray]):
        self.node, self.label, self.size = node, np.array(label, np.int64), np.array([len(x) for x in sets])
        self.known, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = np.split(at, np.cumsum(self.size)[:-1])
        self.on, self.same = np.zeros(len(self.known), bool), {}

    def _found(self, label: int) -> int:
        while label in self.same:
            label = self.same[label]
        return label

    def _meet(self, node: int, label: int, size: int, ids: np.ndarray, upto: int) -> Iterator[tuple[int, int]]:
        """Links of a text to the first ``upto`` texts of the block that don't belong together with it yet."""
        label = self._found(label)
        like = 100 * np.minimum(size, self.size[:upto]) >= LEAST * np.maximum(size, self.size[:upto])
        rest = np.flatnonzero(like & (self.label[:upto] != label))[::-1]
        self.on[ids] = True
        step = 16
        while len(rest):
            part, rest, step = rest[:step], rest[step:], 4 * step
            shared = np.add.reduceat(self.on[np.concatenate([self.ids[j] for j in part])], np.r_[0, np.cumsum(self.size[part])[:-1]], dtype=np.int64)
            for j in part[(100 + LEAST) * shared >= LEAST * (size + self.size[part])].tolist():
                other = int(self.label[j])
                if other != label:
                    yield node, self.node[j]
                    self.same[other] = label
                    self.label[self.label == other] = label
            rest = rest[self.label[rest] != label]
        self.on[ids] = False

    def own(self) -> Iterator[tuple[int, int]]:
        for i, node in enumerate(self.node):
            yield from self._meet(node, int(self.label[i]), int(self.size[i]), self.ids[i], i)

    def copy(self, node: int, label: int, own: np.ndarray) -> Iterator[tuple[int, int]]:
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        yield from self._meet(node, label, len(own), at[self.known[at] == own], len(self.node))


def _verify(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """(root, block, copy, node, label, hashes), sorted by the first three -> edges (a, b) that span the true links of each block.

    The block's own rows come first and meet each other (if ``first``), then its copies of other blocks' rows meet them."""
    now, own, block, out = None, ([], [], []), None, []

    def closed() -> _Block | None:
        got = _Block(*own) if own[0] else None
        if got and first:
            out.extend(got.own())
        return got

    for batch in batches:
        root, part, copy, node, label, sets = (c.to_pylist() for c in batch.columns)
        for row in range(batch.num_rows):
            hashes = np.frombuffer(sets[row], np.uint64)
            if (root[row], part[row]) != now:
                if block is None:
                    closed()
                now, own, block = (root[row], part[row]), ([], [], []), None
            if not copy[row]:
                for column, x in zip(own, (node[row], label[row], hashes), strict=True):
                    column.append(x)
            elif own[0]:
                block = block or closed()
                out.extend(block.copy(node[row], label[row], hashes))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
            out.clear()
    if block is None:
        closed()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def _compared(sets: DataFrame, roams: Column, first: bool) -> DataFrame:
    """Edges between the texts of each block, and between ``roams`` texts and those of all other blocks of their component."""
    blocks = F.ceil(F.col("n") / SETS).cast("int")
    rows = sets.withColumn("home", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("block", F.explode(F.when(roams, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("home"))))
    rows = rows.select("root", "block", (F.col("block") != F.col("home")).alias("copy"), "node", "label", "hashes")
    return rows.repartition("root", "block").sortWithinPartitions("root", "block", "copy").mapInArrow(lambda b: _verify(b, first), "a long, b long")


def true_links(sets: DataFrame) -> DataFrame:
    """(root, n, node, hashes), all n texts of each component of proposals -> (node, root) of components by true links.

    A component of up to ``SETS`` texts is compared in one task. A larger one is dealt into blocks, each with a few pivots of
    all; where that leaves more than one part, every text outside the largest part meets the texts of all blocks."""
    pivot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) < PIVOTS
    found = components(_compared(sets.withColumn("label", F.col("node")), pivot, True))
    large = sets.filter(F.col("n") > SETS)
    if large.isEmpty():
        return found
    labels = large.select("node", F.col("root").alias("of")).join(found, "node", "left").select("node", "of", F.coalesce("root", "node").alias("label"))
    labels = staged(labels, "simhash-labels")
    main = labels.groupBy("of", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("of").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("n"))
    left = _looked_up(labels, main, "of", labels.count()).filter("parts > 1").select("node", "label", "main")
    more = _compared(large.join(left, "node"), F.col("label") != F.col("main"), False)
    every = components(more.union(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    forgotten(labels)
    return every


def near_groups(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (key, id, mark of :func:`_marked`) and ``texts`` (key, text; a key once) -> (key): of each group of near copies
    the row with the least id (nulls last)."""

    @F.pandas_udf("binary")
    def hashes_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)

    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")
    per = staged(rows.groupBy("mark").agg(best).withColumn("node", F.monotonically_increasing_id()), "simhash-wide")
    edges = wide_links(per.select("node", F.substring("mark", 1, WIDE_BITS // 8).alias("wide")))
    met = components(edges)
    forgotten(edges)
    met = met.union(met.select("root", "root").distinct())
    sizes = met.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", F.col("n"))
    members = staged(_looked_up(met, sizes, "root", met.count(), "rows").join(per.select("node", "best.key"), "node"), "simhash-members")
    sets = staged(rows_among(texts, "key", members.select("key")).join(members, "key").select("root", "n", "node", hashes_of("text").alias("hashes")), "simhash-sets")
    forgotten(members)
    roots = true_links(sets).withColumnRenamed("node", "of")
    forgotten(sets)
    named = per.select("node", "best").join(roots, F.col("node") == F.col("of"), "left")
    kept = staged(named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select("best.key"), "simhash-kept")
    forgotten(per)
    return kept


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, fp = with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = staged(df.select("doc_id", fp), "simhash-rows")
    out, comp = with_component(rows, fp, "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint"), F.col(comp).alias("component_id"))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity from 0.8 on) stays, the least id (one row of it,
    if repeated); the columns of ``docs``.

    A row is known by the MD5 of its id and text, so ``docs`` is read three times, but no copy of the texts is written; rows with
    the same id and text (null as empty) count as repeated."""
    @F.pandas_udf("binary")
    def mark_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_marked(t) for t in texts], dtype=object)

    key = fresh(docs, "_key")
    df = docs.withColumn(key, row_key(docs))
    rows = staged(df.select(F.col(key).alias("key"), F.col("doc_id").alias("id"), mark_of("text").alias("mark")), "simhash-marks")
    repeated = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "simhash-repeated")
    df = one_of_each(df, key, repeated)
    kept = near_groups(rows, df.select(F.col(key).alias("key"), "text"))
    gone = staged(rows.select("key").distinct().join(kept, "key", "left_anti"), "simhash-gone")
    forgotten(rows)
    return kept_by_key(df, key, kept, gone).select(*docs.columns)
