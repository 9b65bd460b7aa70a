"""Substring dedup on words: fixed-block anchors.

Every run of 50 words holds one of its document's non-overlapping 25-word blocks whole. Those reference blocks are
indexed by hash; the rolling 25-word windows of all texts probe them. Around each hit between different texts, the 26
runs of 50 words through the hit are extended on either side: a run's digest (96 bits) is compared over all texts and
the least document id that has it is kept, so a hit is extended word by word as far as runs go on being shared, and such
runs together are the maximal repeats (equal digests stand for equal words; words themselves are not compared). A frequent passage costs each block of texts one entry per run, never a pair per partner.

A run is removed from a document if it also starts in one with a smaller id; runs are judged on the input. Texts that
cannot hold a repeat (see ``repeats``) are left out first; documents with the very text of a smaller one are wholly removed.

Defined results: null and empty texts have no words; texts under 50 words lose nothing; of rows with equal id and text,
all are treated as the first; a row with a null id loses nothing and removes nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .repeats import SENT, all_keys, among, anchor_hashes, covered, known, live_contents, live_texts, mixed, received, rolling, send, sent_table, shared_keys, with_results

RUN, BLOCK, GRAM, BLOCK_MB = 50, 25, 8, 4
EMPTY = hashlib.sha256(b"").hexdigest()


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


_CODES = _Codes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))


def run_keys(units: np.ndarray, length: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of a run's digest, from two sets of word codes."""
    return rolling(units, length), (rolling(mixed(units ^ np.uint64(0x5851F42D4C957F2D)), length) >> np.uint64(32)).astype(np.uint32)


def facts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, digest, n_words, kept (SHA-256 of all words), anchors, twice."""
    @F.pandas_udf("n_words long, kept string, anchors array<long>, twice boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            w = words_of(t)
            a, _ = anchor_hashes(codes(w), RUN, GRAM)
            out.append((len(w), hashlib.sha256(b" ".join(w)).hexdigest(), a.view(np.int64), False))
        return pd.DataFrame(out, columns=["n_words", "kept", "anchors", "twice"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), known(F.col(text))[0].alias("digest"), of(F.col(text)).alias("f"))
    return rows.select("doc_id", "digest", "f.*")


def _pad(c: np.ndarray, n: int) -> np.ndarray:
    return np.r_[c, np.zeros(max(0, n - len(c)), c.dtype)]


def _emit_runs(buckets: int):
    """Runs through the block's hits: key, key2, least id, whether several ids have it."""
    def run(texts: pa.Table, hits: pa.Table) -> pa.Table:
        if not len(texts) or not len(hits):
            return sent_table([])
        block, keys = texts["block"][0].as_py(), all_keys(hits)
        k1, k2, ids = [], [], []
        for m, t in zip(texts["least"].to_pylist(), texts["text"].to_pylist(), strict=True):
            u = codes(words_of(t))
            if len(u) < RUN:
                continue
            hit = among(rolling(u, BLOCK) & ~np.uint64(1), keys)
            # a run starts 0 to RUN - BLOCK words before a hit that it holds
            near = np.convolve(hit, np.ones(RUN - BLOCK + 1, np.int32))[RUN - BLOCK :][: len(u) - RUN + 1] > 0
            a, b = run_keys(u)
            k1.append(a[near])
            k2.append(b[near])
            ids.append(np.full(int(near.sum()), m, np.int64))
        if not k1:
            return sent_table([])
        k1, k2, ids = np.concatenate(k1), np.concatenate(k2), np.concatenate(ids)
        o = np.lexsort((ids, k2, k1))
        k1, k2, ids = k1[o], k2[o], ids[o]
        first = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(k1) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(k1)] - 1
        return sent_table(list(send(block, [k1[first], k2[first], ids[first], ids[last]], buckets)))

    return run


KINDS = [np.uint64, np.uint32, np.int64, np.int64]


def _least(rows: pa.Table) -> pa.Table:
    """Per block: the runs that a smaller id has than the largest of the block, with the least id."""
    got = [received(p.as_py(), KINDS) for p in rows["payload"]]
    k1, k2, lo, hi = (np.concatenate(c) for c in zip(*got, strict=True))
    where = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    o = np.lexsort((lo, k2, k1))
    first = np.r_[True, (k1[o][1:] != k1[o][:-1]) | (k2[o][1:] != k2[o][:-1])]
    least = np.empty(len(o), np.int64)
    least[o] = lo[o][np.flatnonzero(first)][np.cumsum(first) - 1]
    out, blocks = [], rows["block"].to_pylist()
    cuts = np.searchsorted(where, np.arange(len(got) + 1))
    for i, block in enumerate(blocks):
        s = slice(cuts[i], cuts[i + 1])
        on = least[s] < hi[s]
        if on.any():
            out.append((0, block, b"".join(c[s][on].tobytes() for c in (k1, k2, least))))
    return sent_table(out).select(["block", "payload"])


def _cut(texts: pa.Table, found: pa.Table) -> pa.Table:
    """digest, n_removed, kept_sha256 of texts that lose words."""
    out: list[tuple] = []
    if len(texts) and len(found):
        k1, k2, least = (np.concatenate(c) for c in zip(*(received(p.as_py(), [np.uint64, np.uint32, np.int64]) for p in found["payload"]), strict=True))
        o = np.lexsort((k2, k1))
        k1, k2, least = k1[o], k2[o], least[o]
        for d, m, t in zip(texts["digest"].to_pylist(), texts["least"].to_pylist(), texts["text"].to_pylist(), strict=True):
            w = words_of(t)
            if len(w) < RUN:
                continue
            a, b = run_keys(codes(w))
            at, end = np.searchsorted(k1, a), np.searchsorted(k1, a, "right")
            starts = np.zeros(len(a), bool)
            while (at < end).any():  # a key has more than one entry only if 64 bits collide
                here = np.minimum(at, len(k1) - 1)
                starts |= (at < end) & (k2[here] == b) & (least[here] < m)
                at = at + 1
            if starts.any():
                gone = covered(starts, RUN, len(w))
                out.append((d, int(gone.sum()), hashlib.sha256(b" ".join(w[i] for i in np.flatnonzero(~gone).tolist())).hexdigest()))
    d, n, s = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(d, pa.binary()), pa.array(n, pa.int64()), pa.array(s, pa.string())], names=["digest", "n_removed", "kept_sha256"])


def dedup_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    base = staged(facts(docs, doc_id, text), "passages-facts")
    least = staged(base.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "passages-copies")
    live = staged(live_contents(base).join(least.filter("least is not null").select("digest", "least"), "digest"), "passages-live")
    texts, blocks = live_texts(docs, text, live, "passages-texts", BLOCK_MB)
    buckets = max(64, 2 * blocks)
    hits = shared_keys(texts, lambda t: rolling(codes(words_of(t)), BLOCK), buckets, lambda t: rolling(codes(words_of(t)), BLOCK)[::BLOCK])
    hits = staged(hits, "passages-hits")
    side = texts.select("block", "least", "text").groupBy("block")
    runs = side.cogroup(hits.groupBy("block")).applyInArrow(_emit_runs(buckets), SENT)
    found = runs.groupBy("bucket").applyInArrow(_least, "block long, payload binary")
    lost = texts.select("block", "least", "digest", "text").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut, "digest binary, n_removed long, kept_sha256 string")
    lost = staged(lost, "passages-lost")
    rows = with_results(base.select("doc_id", "digest", "n_words", "kept"), least, lost)
    later, own = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)), F.coalesce(F.col("doc_id") == F.col("least"), F.lit(False)) & F.col("n_removed").isNotNull()
    whole = later & (F.col("n_words") >= RUN)
    return rows.select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).when(own, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.lit(EMPTY)).when(own, F.col("kept_sha256")).otherwise(F.col("kept")).alias("kept_sha256"),
    )


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
