"""What finding exact repeats of bytes and of words shares: rolling hashes, anchors, and exchanges of packed keys.

Every run of ``length`` units holds an anchor: the least gram hash among the run's grams, leftmost on ties. Equal runs
have equal anchors, so a text none of whose anchors occurs elsewhere holds no repeat and is left out without loss.
Equal texts are one content; contents are known by an MD5 and a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

_B = 0x9E3779B97F4A7C15
_BI = pow(_B, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
NONE = np.zeros(0, np.uint64)
BROADCAST_ROWS = 200_000
#: Contents of an anchor from which it counts as frequent.
HOT = 500
#: At most so many digests are joined by broadcast as the common ones.
COMMON = 10_000
SENT = "bucket long, block long, payload binary"


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, NONE)) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.cumprod(p)
    return _POWERS[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(units: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` of 64-bit unit codes."""
    n = len(units)
    if n < length:
        return NONE
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(units * _powers(_BI, n), out=c[1:])
    return mixed((c[length:] - c[:-length]) * _powers(_B, n - length + 1))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of ``w``, from running minima of blocks in both directions."""
    n = len(a)
    if n < w:
        return a[:0]
    full = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, a.dtype)
    full[:n] = a
    left = np.minimum.accumulate(full.reshape(-1, w), axis=1).ravel()
    right = np.minimum.accumulate(full.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchored(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor place of every run of ``length``, hashes of all grams)."""
    h = rolling(units, gram)
    if len(units) < length:
        return np.zeros(0, np.int64), h
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    return (sliding_min(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64), h


def anchor_hashes(units: np.ndarray, length: int, gram: int, step: int = 1 << 20) -> tuple[np.ndarray, bool]:
    """A text's distinct anchor hashes, and whether one occurs twice; in pieces of ``step``, so long texts need no more memory."""
    got, last = [], -1
    for at in range(0, max(1, len(units) - length + 1), step):
        place, h = anchored(units[at : at + step + length - 1], length, gram)
        place = np.unique(place)
        new = place + at > last
        got.append(h[place[new]])
        last = max(last, int(place[-1]) + at) if len(place) else last
    every = np.concatenate(got)
    distinct = np.unique(every)
    return distinct, len(distinct) < len(every)


def known(text: Column) -> tuple[Column, Column]:
    """(MD5, 64-bit hash) of a text, null as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(t)), F.xxhash64(t)


def live_contents(facts: DataFrame) -> DataFrame:
    """``facts`` (digest, anchors, twice; any rows) -> the digests of contents that share an anchor with another, or repeat one.

    Frequent anchors have over HOT contents and over one in BROADCAST_ROWS of all (anchor, content) pairs, so there are
    fewer than BROADCAST_ROWS of them. They are looked up by broadcast, so that no task gets all rows of a frequent one."""
    one = facts.select("digest", "anchors", "twice").dropDuplicates(["digest"])
    pairs = one.select(F.explode("anchors").alias("a"), F.xxhash64("digest").alias("c"), "digest")
    shared = pairs.groupBy("a").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = staged(shared.filter("lo <> hi").select("a", "n"), "repeats-anchors")
    every = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(shared.filter(F.col("n") > max(HOT, every // BROADCAST_ROWS)).select("a"))
    found = one.filter("twice").select("digest").union(pairs.join(hot, "a", "left_semi").select("digest"))
    return found.union(pairs.join(hot, "a", "left_anti").join(shared.select("a"), "a", "left_semi").select("digest")).distinct()


def with_results(rows: DataFrame, copies: DataFrame, lost: DataFrame) -> DataFrame:
    """``rows`` (of any number per digest) with what is known of their digest: ``copies`` (digest, copies, ...), ``lost`` (digest, ...).

    A digest of over one in COMMON of all rows is common: there are fewer than COMMON of them, so they are joined by broadcast
    and never meet in one task; no other digest has more rows than that share."""
    known_ = copies.join(lost, "digest", "left")
    common = copies.filter(F.col("copies") > max(HOT, rows.count() // COMMON)).select("digest")
    few = F.broadcast(known_.join(F.broadcast(common), "digest", "left_semi"))
    others = rows.join(F.broadcast(common), "digest", "left_anti").join(known_, "digest")
    return rows.join(few, "digest").unionByName(others)


def live_texts(docs: DataFrame, text: str, live: DataFrame, tag: str, mb_each: float) -> tuple[DataFrame, int]:
    """A row (block, c, digest, text, ...live's other columns) for each live content, dealt into blocks; and how many blocks.

    ``live``: a staged table of a digest and at most a number a row, some 100 bytes in memory. It is broadcast only if it has at
    most BROADCAST_ROWS rows (20 MB); else texts are made distinct, which combines copies before the shuffle, and then joined."""
    digest, c = known(F.col(text))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), digest.alias("digest"), c.alias("c"))
    if live.count() <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(live), "digest").dropDuplicates(["digest"])
    else:
        found = rows.dropDuplicates(["digest"]).join(live, "digest")
    found = staged(found, tag)
    size = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(32, int(size // (mb_each * 1e6)) + 1)
    return found.withColumn("block", F.pmod("c", F.lit(blocks))), blocks


def to_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each (mixed) key; sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def send(block: int, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """``columns`` (the first: sorted keys) cut by bucket; each payload holds its slices one after another."""
    cut = np.searchsorted(to_buckets(columns[0], buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, block, b"".join(c[cut[b] : cut[b + 1]].tobytes() for c in columns)


def sent_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(p, pa.binary())], names=["bucket", "block", "payload"])


def received(payload: bytes, kinds: list[type]) -> list[np.ndarray]:
    n, at, out = len(payload) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(payload, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def shared_keys(texts: DataFrame, keys_of: Callable[[str], np.ndarray], buckets: int, wanted: Callable[[str], np.ndarray] | None = None, hot: int | None = None) -> DataFrame:
    """(block, payload): for each block its keys (uint64, without the low bit) that two contents have, or one has twice if
    ``wanted`` is None. With ``wanted``, only keys that are among some content's wanted keys.
    With ``hot``, the low bit of a key is set if more than ``hot`` blocks have it.

    A block sends each distinct key once, the low bit telling whether it has it more than once."""
    strict = wanted is not None

    def emit(rows: pa.Table) -> pa.Table:
        block, every, want = rows["block"][0].as_py(), [], [NONE]
        for t in rows["text"].to_pylist():
            k = keys_of(t) & ~np.uint64(1)
            every.append(np.unique(k) if strict else k)
            if strict:
                want.append(wanted(t) & ~np.uint64(1))
        keys, n = np.unique(np.concatenate(every), return_counts=True)
        asked = np.isin(keys, np.unique(np.concatenate(want))) if strict else np.ones(len(keys), bool)
        return sent_table(list(send(block, [keys | (n > 1).astype(np.uint64), asked.astype(np.uint8)], buckets)))

    def decide(rows: pa.Table) -> pa.Table:
        blocks = rows["block"].to_pylist()
        got = [received(p.as_py(), [np.uint64, np.uint8]) for p in rows["payload"]]
        every = np.concatenate([g[0] for g in got])
        keys, first, n = np.unique(every & ~np.uint64(1), return_inverse=True, return_counts=True)
        more, asked = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        more[first[(every & np.uint64(1)) > 0]] = True
        asked[first[np.concatenate([g[1] for g in got]) > 0]] = True
        good, at, out = ((n > 1) | more) & asked, 0, []
        keys = keys | ((n > hot) if hot is not None else np.zeros(len(keys), bool)).astype(np.uint64)
        for block, g in zip(blocks, got, strict=True):
            own = first[at : at + len(g[0])]
            at += len(own)
            if good[own].any():
                out.append((0, block, keys[own[good[own]]].tobytes()))
        return sent_table(out).select(["block", "payload"])

    sent = texts.select("block", "text").groupBy("block").applyInArrow(emit, SENT)
    return sent.groupBy("bucket").applyInArrow(decide, "block long, payload binary")


def all_keys(rows: pa.Table) -> np.ndarray:
    """The keys of one block's payloads, sorted."""
    return np.unique(np.concatenate([NONE, *(np.frombuffer(p.as_py(), np.uint64) for p in rows["payload"])]))


def among(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the ``n`` units within ``length`` of a start (``starts``: mask of the runs)."""
    d = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(d, at, 1)
    np.add.at(d, at + length, -1)
    return np.cumsum(d[:-1]) > 0
