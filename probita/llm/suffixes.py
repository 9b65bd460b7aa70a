"""Substring dedup on bytes: a logarithmic family of suffix arrays.

A byte goes if a 400-byte string that covers it starts anywhere else too. Suffixes are dealt out so that equal 400-byte
starts meet: each run of consecutive starts with the same anchor (see ``repeats``) is one or two regions, the bytes its suffixes
need: starts so far before the anchor that all hold its left half (the 232 bytes up to and with the anchor), and the others,
which all hold its right half. A region goes to the bucket of its anchor's hash, unless its half is frequent (more than
``HOT_BLOCKS`` blocks of texts have it, so that one task might get a region of every document): then it is cut by the
distance to the anchor into regions of at most 21 starts, each going to the bucket of the 380 bytes that all its starts share,
so documents with other neighbours of a frequent passage go elsewhere. In a bucket, distinct regions form batches; a new batch gets a suffix
array (prefix doubling up to 400 bytes), is merge-scanned against the levels there are, marking suffixes with a match of
400 bytes on both sides, and levels of about equal size are merged, so there are logarithmically many. Equal regions are
sent once per block of texts and count as matches of each other at once.

Left out before, without loss: contents that share no anchor, and regions whose half does not occur twice. Copies of a whole text of 400 bytes or
more are removed whole, and one of them takes part. Regions are known by 128-bit digests; matches are compared byte for byte.

Defined results: a null text is empty; texts under 400 bytes lose nothing; each row is a place of its own, so repeated
rows remove each other; null ids are carried; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .repeats import SENT, all_keys, among, anchor_hashes, anchored, covered, known, live_contents, live_texts, mixed, rolling, sent_table, shared_keys, to_buckets, with_results

LENGTH, GRAM, BLOCK_MB, BATCH = 400, 64, 3, 1_500_000
HALF = (LENGTH - GRAM) // 2 + GRAM
_UNITS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_LEFT = np.uint64(0x5A5A5A5A5A5A5A5A)
ALL_BITS = ~np.uint64(1)
#: Blocks of texts from which a half counts as frequent, and starts of a region of a frequent one.
HOT_BLOCKS, NARROW = 16, 21
EMPTY = hashlib.sha256(b"").hexdigest()


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class Level:
    """A text, its sorted suffix starts, and which of them have a match; ``bases`` and ``names``: its regions."""

    def __init__(self, text: np.ndarray, words: np.ndarray, order: np.ndarray, twin: np.ndarray, bases: np.ndarray, names: np.ndarray):
        self.text, self.words, self.order, self.twin, self.bases, self.names = text, words, order, twin, bases, names

    @classmethod
    def of(cls, regions: list[tuple[int, bytes]], names: np.ndarray) -> Level:
        text = np.frombuffer(b"".join(r for _, r in regions), np.uint8)
        sizes = np.array([len(r) for _, r in regions])
        bases, counts = np.cumsum(sizes) - sizes, np.array([n for n, _ in regions])
        starts = np.repeat(bases, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
        words = np.zeros(len(text), np.uint64)
        for k in range(8):
            words |= padded[k : k + len(text)] << np.uint64(56 - 8 * k)
        rank, size = np.unique(words, return_inverse=True)[1].astype(np.int64), 8
        while 2 * size <= LENGTH:  # ranks of the first 16, 32, ... bytes
            rank = np.unique(rank[: len(rank) - size] * (rank.max() + 1) + rank[size:], return_inverse=True)[1].astype(np.int64)
            size *= 2
        key = rank[starts] * (rank.max() + 1) + rank[starts + LENGTH - size]
        by = np.argsort(key, kind="stable")
        same = np.r_[False, key[by][1:] == key[by][:-1]]
        twin = np.zeros(len(text), bool)
        twin[starts[by[same | np.r_[same[1:], False]]]] = True
        return cls(text, words, starts[by], twin, bases, names)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, off: int, key: np.ndarray, right: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        on = np.flatnonzero(a < b)
        while len(on):
            mid = (a[on] + b[on]) >> 1
            v = self.words[self.order[mid] + off]
            up = (v <= key[on]) if right else (v < key[on])
            a[on[up]], b[on[~up]] = mid[up] + 1, mid[~up]
            on = on[a[on] < b[on]]
        return a

    def scan(self, other: Level) -> np.ndarray:
        """Where each suffix of ``other`` would go in this order; suffixes that match for LENGTH bytes are marked in both."""
        first = other.words[other.order]
        own = self.words[self.order]
        lo, hi = np.searchsorted(own, first), np.searchsorted(own, first, "right")
        on = np.flatnonzero(lo < hi)
        for off in range(8, LENGTH, 8):
            if not len(on):
                break
            key = other.words[other.order[on] + off]
            low = self._bound(lo[on], hi[on], off, key, False)
            hi[on] = self._bound(low, hi[on], off, key, True)
            lo[on] = low
            on = on[lo[on] < hi[on]]
        other.twin[other.order[on]] = True
        d = np.zeros(len(self.order) + 1, np.int64)
        np.add.at(d, lo[on], 1)
        np.add.at(d, hi[on], -1)
        self.twin[self.order[np.cumsum(d[:-1]) > 0]] = True
        return lo

    def merged(self, other: Level, at: np.ndarray) -> Level:
        n = len(self.text)
        return Level(np.r_[self.text, other.text], np.r_[self.words, other.words], np.insert(self.order, at, other.order + n), np.r_[self.twin, other.twin], np.r_[self.bases, other.bases + n], np.r_[self.names, other.names])


class Family:
    """Levels of falling size, each over twice as large as the next."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, new: Level) -> None:
        places = [level.scan(new) for level in self.levels]
        while self.levels and len(self.levels[-1].text) <= 2 * len(new.text):
            level, at = self.levels.pop(), places.pop()
            new = level.merged(new, at)
            places = [other.scan(new) for other in self.levels[-1:]] if self.levels and len(self.levels[-1].text) <= 2 * len(new.text) else []
        self.levels.append(new)


def regions(data: bytes, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """(starts, counts, anchor hashes, half keys, anchor places) of the regions of a text. In pieces of ``step`` starts."""
    reach = HALF - GRAM
    for at in range(0, len(data) - LENGTH + 1, step):
        back = min(at, HALF)  # context for the left halves
        u = _UNITS[np.frombuffer(data[at - back : at + step + LENGTH - 1], np.uint8)]
        place, h = anchored(u[back:], LENGTH, GRAM)
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        a, r = place[new], rolling(u, HALF)
        key = mixed(h[a])  # least hashes are small: mixed again to spread
        end = np.r_[new[1:], len(place)]
        cut = np.clip(a - reach, new, end)  # from here on a start holds the right half
        left, right = np.flatnonzero(new < cut), np.flatnonzero(cut < end)
        start, count = np.r_[new[left], cut[right]], np.r_[(cut - new)[left], (end - cut)[right]]
        half = np.r_[r[a[left] + back - reach] ^ _LEFT, r[a[right] + back]]
        both = np.r_[left, right]
        yield at + start, count, key[both], half, at + a[both]


def half_keys(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(half for _, _, _, half, _ in regions(bytes_of(text)))])


def narrowed(data: bytes, start: int, count: int, anchor: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, count, shared bytes) of the regions of at most NARROW starts that a region is cut into."""
    s = start
    while s < start + count:
        far = (anchor - s) // NARROW  # starts of one ``far`` lie at most NARROW - 1 apart
        n = min(anchor - far * NARROW, start + count - 1) - s + 1
        yield s, n, data[anchor - far * NARROW : anchor - far * NARROW + LENGTH - NARROW + 1]
        s += n


def facts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, digest, n_bytes, kept (SHA-256 of all bytes), anchors, twice."""
    @F.pandas_udf("anchors array<long>, twice boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = [anchor_hashes(_UNITS[np.frombuffer(bytes_of(t), np.uint8)], LENGTH, GRAM) for t in texts]
        return pd.DataFrame({"anchors": [a.view(np.int64) for a, _ in out], "twice": [bool(t) for _, t in out]})

    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), known(F.col(text))[0].alias("digest"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("kept"), of(F.col(text)).alias("f"))
    return rows.select("doc_id", "digest", "n_bytes", "kept", "f.*")


def _digest(part: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(part)


def _core_bucket(core: bytes, buckets: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(core) * buckets >> 64


def _emit(buckets: int):
    """The block's distinct live regions, by bucket: digests, counts, whether there are several, bytes."""
    def run(texts: pa.Table, live: pa.Table) -> pa.Table:
        if not len(texts) or not len(live):
            return sent_table([])
        block, keys = texts["block"][0].as_py(), all_keys(live)
        hot = keys[(keys & np.uint64(1)) > 0] & ALL_BITS
        keys = np.unique(keys & ALL_BITS)
        found: dict[bytes, list] = {}

        def take(bucket: int, n: int, part: bytes) -> None:
            got = found.setdefault(_digest(part), [bucket, n, 0, part])
            got[2] = min(2, got[2] + 1)

        for t in texts["text"].to_pylist():
            data = bytes_of(t)
            for start, count, key, half, anchor in regions(data):
                on = among(half & ALL_BITS, keys)
                often = among(half[on] & ALL_BITS, hot)
                for s, n, b, a, narrow in zip(start[on].tolist(), count[on].tolist(), to_buckets(key[on], buckets).tolist(), anchor[on].tolist(), often.tolist(), strict=True):
                    if not narrow:
                        take(b, n, data[s : s + n + LENGTH - 1])
                        continue
                    for at, k, core in narrowed(data, s, n, a):
                        take(_core_bucket(core, buckets), k, data[at : at + k + LENGTH - 1])
        by: dict[int, list] = {}
        for digest, (b, n, several, part) in found.items():
            by.setdefault(b, []).append((digest, n, several, part))
        rows = []
        for b, parts in by.items():
            d, n, m, p = zip(*parts, strict=True)
            rows.append((b, block, len(d).to_bytes(8, "little") + b"".join(d) + np.array(n, np.uint16).tobytes() + np.array(m, np.uint8).tobytes() + b"".join(p)))
        return sent_table(rows)

    return run


def _match(rows: pa.Table) -> pa.Table:
    """Per block: its regions that have a repeated start: digests, counts, bits."""
    names: dict[bytes, int] = {}
    several: list[int] = []
    counts: list[int] = []
    of_block, family, batch, size, first = [], Family(), [], 0, 0

    def flush() -> None:
        nonlocal size, first
        if batch:
            family.add(Level.of(batch, np.arange(first, first + len(batch))))
            first, size = first + len(batch), 0
            batch.clear()

    for p in rows["payload"]:
        raw = p.as_py()
        k = int.from_bytes(raw[:8], "little")
        n, m = np.frombuffer(raw, np.uint16, k, 8 + 16 * k).tolist(), np.frombuffer(raw, np.uint8, k, 8 + 18 * k).tolist()
        at, own = 8 + 19 * k, []
        for i in range(k):
            digest, length = raw[8 + 16 * i : 24 + 16 * i], n[i] + LENGTH - 1
            j = names.setdefault(digest, len(names))
            if j == len(several):
                several.append(0)
                counts.append(n[i])
                batch.append((n[i], raw[at : at + length]))
                size += length
            several[j] += m[i]
            own.append(j)
            at += length
            if size >= BATCH:
                flush()
        of_block.append(own)
    flush()
    bits: dict[int, np.ndarray] = {}
    for level in family.levels:
        for base, j in zip(level.bases.tolist(), level.names.tolist(), strict=True):
            mask = level.twin[base : base + counts[j]]
            if several[j] > 1:
                bits[j] = np.ones(counts[j], bool)
            elif mask.any():
                bits[j] = mask
    key, out = list(names), []
    for block, own in zip(rows["block"].to_pylist(), of_block, strict=True):
        mine = [j for j in own if j in bits]
        if mine:
            out.append((0, block, len(mine).to_bytes(8, "little") + b"".join(key[j] for j in mine) + np.array([counts[j] for j in mine], np.uint16).tobytes() + np.packbits(np.concatenate([bits[j] for j in mine])).tobytes()))
    return sent_table(out).select(["block", "payload"])


def _cut(texts: pa.Table, found: pa.Table) -> pa.Table:
    """digest, n_removed, n_spans, kept_sha256 of texts that lose bytes."""
    bits, out = {}, []
    for p in found["payload"] if len(texts) else []:
        raw = p.as_py()
        k = int.from_bytes(raw[:8], "little")
        n = np.frombuffer(raw, np.uint16, k, 8 + 16 * k).astype(np.int64)
        mask = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8 + 18 * k)).astype(bool)
        ends = np.cumsum(n).tolist()
        for i in range(k):
            bits[raw[8 + 16 * i : 24 + 16 * i]] = mask[ends[i] - int(n[i]) : ends[i]]
    narrow = any(len(b) <= NARROW for b in bits.values())
    for d, t in zip(texts["digest"].to_pylist(), texts["text"].to_pylist(), strict=True) if bits else []:
        data = bytes_of(t)
        starts = np.zeros(max(0, len(data) - LENGTH + 1), bool)
        for start, count, _, _, anchor in regions(data):
            for s, n, a in zip(start.tolist(), count.tolist(), anchor.tolist(), strict=True):
                got = bits.get(_digest(data[s : s + n + LENGTH - 1]))
                if got is not None:
                    starts[s : s + n] = got
                    continue
                for at, k, _ in narrowed(data, s, n, a) if narrow else ():
                    got = bits.get(_digest(data[at : at + k + LENGTH - 1]))
                    if got is not None:
                        starts[at : at + k] = got
        if starts.any():
            gone = covered(starts, LENGTH, len(data))
            kept = np.frombuffer(data, np.uint8)[~gone]
            out.append((d, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept.tobytes()).hexdigest()))
    d, n, s, h = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table([pa.array(d, pa.binary()), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())], names=["digest", "n_removed", "n_spans", "kept_sha256"])


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    base = staged(facts(docs, doc_id, text), "substrings-facts")
    copies = staged(base.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "substrings-copies")
    live = staged(live_contents(base), "substrings-live")
    texts, blocks = live_texts(docs, text, live, "substrings-texts", BLOCK_MB)
    buckets = max(64, 4 * blocks)
    keys = staged(shared_keys(texts, half_keys, buckets, hot=HOT_BLOCKS), "substrings-keys")
    side = texts.select("block", "digest", "text").groupBy("block")
    sent = side.cogroup(keys.groupBy("block")).applyInArrow(_emit(buckets), SENT)
    found = sent.groupBy("bucket").applyInArrow(_match, "block long, payload binary")
    lost = staged(side.cogroup(found.groupBy("block")).applyInArrow(_cut, "digest binary, n_removed long, n_spans long, kept_sha256 string"), "substrings-lost")
    rows = with_results(base.select("doc_id", "digest", "n_bytes", "kept"), copies, lost)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "kept")).alias("kept_sha256"),
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
