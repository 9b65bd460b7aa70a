"""Packing token sequences into windows of near-equal load by Karmarkar-Karp multiway differencing.

Texts become token ids with one end id. Every full window's worth of a text is a sequence of its own; what is left stays
whole up to a quarter of a window and is cut into such parts beyond. Parts collect until they fill ``group`` windows but for
a slack of eight tokens each, and multiway differencing spreads them: partial partitions, largest spread first, are merged largest load
against smallest, which cancels their imbalances. When a load still exceeds the capacity, the number of windows rises
and the group is dealt again. At the end of a partition the parts that make up no full window are cut into sequences
whose lengths are powers of two. There is no shuffle and no state beyond one group; a lost task is repeated alike.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; null ids are carried; other
columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

CAPACITY, GROUP, SLACK, PARTS = 2048, 256, 8, 4
#: Rows that a task holds before it passes them on, without and with their token ids.
HELD, HELD_IDS = 20_000, 2_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CACHE: dict = {}


def byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 character if that is printable, else as one from 256 on."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: chr(256 + i) for i, b in enumerate(odd)}


BYTE_CHARS = byte_chars()


class Recent(dict):
    """A cache in two generations of up to ``limit`` entries: a full young one becomes the old one, from which entries
    still in use come back."""

    def __init__(self, limit: int, make):
        super().__init__()
        self.old, self.limit, self.make = {}, limit, make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        self[key] = got = self.make(key) if got is None else got
        return got


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer never looks beyond white space, so white-space-delimited chunks are encoded once and remembered. A
    new chunk of Latin-1 characters is lower-cased and cut as the tokenizer's own pattern cuts, which is the same for
    those characters, and its pieces are remembered too; other chunks go to the tokenizer whole."""

    ODD = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer doesn't
    LETTER, DIGIT = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
    PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\\s{LETTER}{DIGIT}]+")

    def __init__(self, path: str, chunks: int = 250_000, pieces: int = 250_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.pieces, self.chunks = Recent(pieces, self._piece), Recent(chunks, self._chunk)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Of one piece: the merges alone, on the characters that stand for its bytes."""
        return np.array([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARS))], "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or max(chunk) > "\xff":
            return self._whole(chunk)
        return b"".join(map(self.pieces.__getitem__, self.PIECE.findall(chunk.lower())))

    def __call__(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self._whole(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


def word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _CACHE:
        _CACHE[path] = WordIds(path)
    return _CACHE[path]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Item indices of ``k`` subsets of near-equal sum: multiway differencing. Loads of zero are left implicit."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = max(0, len(a) + len(b) - k)  # so many of a's smallest meet b's smallest, crosswise
        tail = [(x + y, (m, n)) for (x, m), (y, n) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
        got = a[: len(a) - over] + b[: len(b) - over] + tail
        got.sort(key=lambda e: -e[0])
        heapq.heappush(heap, (-(got[0][0] - (got[-1][0] if len(got) == k else 0)), tick, got))
        tick += 1
    out = []
    for _, node in heap[0][2] if heap else []:
        mine, todo = [], [node]
        while todo:
            x = todo.pop()
            todo.extend(x) if isinstance(x, tuple) else mine.append(x)
        out.append(sorted(mine))
    return out


def fit(sizes: list[int], k: int, capacity: int) -> list[list[int]]:
    while True:
        sets = difference(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return sets
        k += 1


class Packer:
    """Takes documents' ids, gives (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, group: int = GROUP):
        self.capacity, self.part, self.full = capacity, max(1, capacity // PARTS), group * (capacity - SLACK)
        self.group, self.items, self.load, self.sequences = group, [], 0, 0

    def add(self, doc: object, n: int) -> Iterator[tuple]:
        at = 0
        while n - at >= self.capacity:
            yield doc, at, self.capacity, self._next(), 0
            at += self.capacity
        while at < n:
            size = min(self.part, n - at, self.full - self.load)
            self.items.append((doc, at, size))
            self.load, at = self.load + size, at + size
            if self.load == self.full:
                yield from self._deal(self.group)

    def _next(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _deal(self, k: int) -> Iterator[tuple]:
        items, self.items, self.load = self.items, [], 0
        for chosen in fit([s for *_, s in items], k, self.capacity) if k else []:
            sequence, offset = self._next(), 0
            for i in chosen:
                doc, at, size = items[i]
                yield doc, at, size, sequence, offset
                offset += size

    def end(self) -> Iterator[tuple]:
        k = self.load // (self.capacity - SLACK)
        rest, spare = self.load - k * (self.capacity - SLACK), []
        while rest:
            doc, at, size = self.items.pop()
            cut = min(size, rest)
            if cut < size:
                self.items.append((doc, at, size - cut))
            spare.append((doc, at + size - cut, cut))
            rest -= cut
        yield from self._deal(k)
        left = sum(s for *_, s in spare)
        while left:
            room, sequence, offset = 1 << (left.bit_length() - 1), self._next(), 0
            left -= room
            while room:
                doc, at, size = spare.pop()
                if size > room:
                    spare.append((doc, at + room, size - room))
                    size = room
                yield doc, at, size, sequence, offset
                offset, room = offset + size, room - size


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """A row per piece; ``with_ids`` adds the piece's token ids. Sequence ids are unique, not consecutive."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer, rows = word_ids(tokenizer), Packer(capacity, group), []
        base = TaskContext.get().partitionId() << 36

        def take(pieces: Iterator[tuple]) -> None:
            for (doc, ids), at, size, sequence, offset in pieces:
                own = ids[4 * at : 4 * (at + size)]
                rows.append((doc, at, size, zlib.crc32(own), len(ids) // 4, base + sequence, offset, *([np.frombuffer(own, "<u4")] if with_ids else [])))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[7:]]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids)

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(t.as_py() or "") + end
                take(packer.add((doc, ids), len(ids) // 4))
                if len(rows) >= (HELD_IDS if with_ids else HELD):
                    yield batch()
        take(packer.end())
        if rows:
            yield batch()

    return docs.select(docs[doc_id].cast("long"), text).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as packed pieces with their token ids: every row of ``docs``, repeated ones too; a null or empty text is its end id; no rows of none."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
