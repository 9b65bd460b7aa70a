"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to each text's frequencies.

No piece of the model spans a place where something other than a space meets a space, or a line end (``checked`` tests
the vocabulary for it), so a text's count is the sum over its pre-tokens: runs of spaces with what follows them, up to
the next space or line end; a line end is one piece. The model's leading space is put before the text beforehand.

Texts are taken in blocks. A block sends each hash bucket its distinct pre-tokens once, with compressed postings (which
text of the block, how often); a bucket counts the pieces of each distinct pre-token once for all blocks and answers
with the texts' partial sums; a block's sums are added up. A frequent pre-token costs a few bits per text, and rows are
even: one per block and bucket. The number of buckets is fixed, so rows grow with the input; a bucket's rows are taken
as a stream, and what it holds in memory is its share of the distinct pre-tokens.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each get a row; null ids are carried;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

LIMIT, BLOCK_BYTES, BUCKETS = 4096, 8_000_000, 1024
PRE_TOKEN = re.compile(r" +[^ \n]*|[^ \n]+")
ROWS = "bucket long, block long, kind long, payload binary"
_MODELS: dict = {}


class _Ids(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def model(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = checked(sentencepiece.SentencePieceProcessor(model_file=path))
    return _MODELS[path]


def checked(sp):
    odd = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if re.search("[^▁]▁|\n", p)]
    if odd:
        raise ValueError(f"pieces of this model span pre-tokens: {odd[:3]}")
    return sp


def count_pieces(sp, tokens: list[str]) -> np.ndarray:
    """Pieces of each pre-token, without the space that the model puts first."""
    spaced = sp.encode([t[1:] if t[0] == " " else "\n" + t for t in tokens], num_threads=1)
    n = np.fromiter(map(len, spaced), np.int64, len(tokens))
    lone = np.fromiter((t == " " for t in tokens), bool, len(tokens))  # nothing is left of a single space
    return np.where(lone, 1, n - 2 * np.fromiter((t[0] != " " for t in tokens), np.int64, len(tokens)))


def _blob(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.int64(a.nbytes).tobytes() + a.dtype.str.encode().ljust(4) + a.tobytes() for a in arrays), 1)


def _unblob(data: bytes) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(data), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8 : at + 12].decode().strip()
        out.append(np.frombuffer(raw, np.dtype(kind), n // np.dtype(kind).itemsize, at + 12))
        at += 12 + n
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    top = a.max(initial=0)
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


class _Block:
    def __init__(self, buckets: int):
        self.buckets, self.ids, self.doc, self.tok = buckets, _Ids(), [], []
        self.header: list[tuple] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        size = len(text) if text.isascii() else len(text.encode())
        self.bytes += size
        self.header.append((doc_id, size, text.count("\n")))
        if text:
            t = PRE_TOKEN.findall((" " + text).replace("▁", " "))
            self.tok.append(np.fromiter(map(self.ids.__getitem__, t), np.int64, len(t)))
            self.doc.append(np.full(len(t), len(self.header) - 1, np.int64))

    def rows(self, block: int) -> Iterator[tuple]:
        ids, sizes, lines = zip(*self.header, strict=True)
        null = np.array([i is None for i in ids])
        yield zlib.crc32(str(block).encode()) % self.buckets, block, 0, _blob(np.array([i or 0 for i in ids], np.int64), null, np.array(sizes, np.int64), np.array(lines, np.int64))
        if not self.tok:
            return
        n_docs, tokens = len(self.header), list(self.ids)
        raw = [t.encode() for t in tokens]
        bucket = np.fromiter((zlib.crc32(t) % self.buckets for t in raw), np.int64, len(raw))
        order = np.argsort(bucket, kind="stable")  # local ids by bucket
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pair, freq = np.unique(rank[np.concatenate(self.tok)] * n_docs + np.concatenate(self.doc), return_counts=True)
        tok, doc = pair // n_docs, pair % n_docs
        per = np.bincount(tok, minlength=len(order))
        first = np.r_[True, tok[1:] != tok[:-1]]
        step = np.where(first, doc, np.diff(doc, prepend=0))
        cut, at = np.searchsorted(bucket[order], np.arange(self.buckets + 1)), np.r_[0, np.cumsum(per)]
        for b in np.flatnonzero(np.diff(cut)).tolist():
            lo, hi = cut[b], cut[b + 1]
            own = np.frombuffer(b"\n".join(raw[i] for i in order[lo:hi].tolist()), np.uint8)
            s = slice(at[lo], at[hi])
            yield b, block, 1, _blob(np.array([n_docs], np.int64), own, _narrow(per[lo:hi]), _narrow(step[s]), _narrow(freq[s]))


def _emit(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, now = TaskContext.get().partitionId() << 32, _Block(buckets)

        def out(block: int) -> pa.RecordBatch:
            cols = list(zip(*now.rows(block), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.binary())], names=["bucket", "block", "kind", "payload"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                now.add(doc, text.as_py() or "")
                if now.bytes >= BLOCK_BYTES or len(now.header) >= 60_000:
                    yield out(number)
                    number, now = number + 1, _Block(buckets)
        if now.header:
            yield out(number)

    return run


def _answer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known = model(path), {}
        for batch in batches:
            made = []
            for block, kind, payload in zip(batch["block"].to_pylist(), batch["kind"].to_pylist(), batch["payload"], strict=True):
                if not kind:
                    made.append((block, 0, payload.as_py()))
                    continue
                n_docs, own, per, step, freq = _unblob(payload.as_py())
                tokens = own.tobytes().decode().split("\n")
                new = [t for t in tokens if t not in known]
                if new:
                    known.update(zip(new, count_pieces(sp, new).tolist(), strict=True))
                pieces = np.repeat(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)), per) * freq
                start = np.r_[0, np.cumsum(per.astype(np.int64))[:-1]]
                run_ = np.cumsum(step.astype(np.int64))
                doc = run_ - np.repeat(run_[start] - step[start], per)
                sums = np.bincount(doc, weights=pieces, minlength=int(n_docs[0])).astype(np.int64)
                made.append((block, 1, _blob(_narrow(sums))))
            cols = list(zip(*made, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["block", "kind", "payload"])

    return run


def _total(limit: int):
    def run(rows: pa.Table) -> pa.Table:
        total, head = 0, None
        for kind, payload in zip(rows["kind"].to_pylist(), rows["payload"], strict=True):
            got = _unblob(payload.as_py())
            if kind:
                total = total + got[0].astype(np.int64)
            else:
                head = got
        ids, null, sizes, lines = head
        n = lines + total
        return pa.table([pa.array(ids, mask=null), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    rows = docs.select(docs[doc_id].cast("long"), text)
    sent = rows.mapInArrow(_emit(BUCKETS), ROWS)
    sums = sent.groupBy("bucket").applyInArrow(_answer(path), "block long, kind long, payload binary")
    return sums.groupBy("block").applyInArrow(_total(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
