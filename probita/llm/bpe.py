"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

A text is cut by the pattern of the rank files. A piece's bytes, as Latin-1 characters, run through an Aho-Corasick
automaton of the vocabulary, which gives the longest token from each place; shorter ones are its prefixes, linked by a table.
A sequence of tokens is what the merges give just when each two neighbours are: the two together are merged to these two
again. So the encoder takes the longest token that is compatible with its left neighbour, remembers the answer for the
two ids, and steps back where no token fits. What the merges make of a prefix is unique, so a place that was left so is
never entered again: the time is linear in the piece, whatever it repeats.

The automaton stands on two properties of the ranks, which ``checked`` tests: all 256 bytes are tokens, and each longer
token is what the merges make of its bytes, from two tokens of lower rank.

Chunks (a space and what follows it up to the next white space) and pieces are encoded once and remembered, in two
generations of bounded size. Characters that are newer than this Python's Unicode tables are put to the library itself, as is their class.

Defined results: a null or empty text has no ids; null ids of rows are carried; repeated rows each get a row; null ids of
tokens decode to null; no rows of none. Texts are taken whole, one at a time.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table
from .packing import Recent

#: White space of the pattern: 25 characters.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
KNOWN, PAIRS, LONG, BATCH_BYTES = 350_000, 250_000, 200, 8_000_000
#: The first character that Unicode has left unassigned.
FIRST_FREE = "\u0378"
_CACHE: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(ranks: dict[bytes, int], data: bytes, least: int = 1) -> list[bytes]:
    """The merges by their definition, down to ``least`` parts: the leftmost pair of lowest rank first. For short data."""
    parts, none = [data[i : i + 1] for i in range(len(data))], len(ranks)
    known = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while len(parts) > least:
        rank = min(known)
        if rank == none:
            break
        i = known.index(rank)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del known[i]
        if i:
            known[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(known):
            known[i] = ranks.get(parts[i] + parts[i + 1], none)
    return parts


def checked(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """``ranks``, if backtracking gives the merges' results for them."""
    if set(ranks.values()) != set(range(len(ranks))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must be 0, 1, 2, ... and hold every byte")
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = merged(ranks, token, 2)
            if len(parts) != 2 or max(ranks[p] for p in parts) > rank:
                raise ValueError(f"the merges don't make the token {token!r}")
    return ranks


def _unassigned() -> re.Pattern:
    spans, last = [], -2
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if c == last + 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
            last = c
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Bpe:
    """Ids of a text as little-endian unsigned 32-bit bytes, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: int = KNOWN, pairs: int = PAIRS):
        import ahocorasick
        import regex

        self.ranks, self.tokens = ranks, sorted(ranks, key=ranks.get)
        self.sizes = list(map(len, self.tokens))
        self.shorter = [next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.pattern, self.cut, self.newer = pattern, regex.compile(pattern), _unassigned()
        self.classes = Recent(10_000, self._stand_in)
        self.pairs, self.known = Recent(pairs, self._compatible), Recent(known, self._chunk)

    def _compatible(self, pair: int) -> bool:
        a, b = (self.tokens[i] for i in divmod(pair, len(self.tokens)))
        return merged(self.ranks, a + b) == [a, b]

    def backtracked(self, data: bytes) -> list[int]:
        n, sizes, shorter, pairs, n_tokens = len(data), self.sizes, self.shorter, self.pairs, len(self.tokens)
        longest = [-1] * (n + 1)
        for end, (back, rank) in self.automaton.iter(data.decode("latin-1")):
            longest[end - back] = rank  # matches from a place come by their ends, so the longest comes last
        path, at, token, left = [], 0, longest[0], bytearray(n + 1)
        while at < n:
            while token >= 0 and (left[at + sizes[token]] or path and not pairs[path[-1] * n_tokens + token]):
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += sizes[token]
                token = longest[at]
            else:
                left[at] = 1
                last = path.pop()
                at -= sizes[last]
                token = shorter[last]
        return path

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        return pack(self.backtracked(data) if whole is None else [whole])

    def _stand_in(self, char: str) -> str:
        """An older character of the same class (letter, number, other), as the library cuts it: a token of the whole shows it."""
        import tiktoken

        for lead, old in (("x", "é"), ("1", "²"), ("!", "§")):
            ranks = {bytes([b]): b for b in range(256)} | {(lead + char).encode(): 256}
            if len(tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(lead + char)) == 1:
                return old
        return " "

    def _pieces(self, chunk: str) -> list[str]:
        if max(chunk) < FIRST_FREE or not self.newer.search(chunk):
            return self.cut.findall(chunk)
        known = self.newer.sub(lambda m: self.classes[m[0]], chunk)
        return [chunk[m.start() : m.end()] for m in self.cut.finditer(known)]

    def _chunk(self, chunk: str) -> bytes:
        """Chunks and their pieces are remembered in one place: a chunk of one piece is that piece."""
        pieces = self._pieces(chunk)
        if len(pieces) == 1:
            return self._piece(chunk)
        return b"".join(self.known[p] if len(p) <= LONG else self._piece(p) for p in pieces)

    def encode(self, text: str) -> bytes:
        return b"".join(self.known[c] if len(c) <= LONG else self._chunk(c) for c in CHUNK.findall(text))


def decoded_bytes(tokens: list[bytes], ids: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe(path: str) -> Bpe:
    import public_tokenizers

    if path not in _CACHE:
        _CACHE[path] = Bpe(read_ranks(path), public_tokenizers.PATTERN)
    return _CACHE[path]


def tokens(path: str) -> list[bytes]:
    """Each id's bytes; all that decoding needs."""
    key = path, "tokens"
    if key not in _CACHE:
        ranks = read_ranks(path)
        _CACHE[key] = sorted(ranks, key=ranks.get)
    return _CACHE[key]


def _mapped(df: DataFrame, tool: Callable[[], object], source: str, name: str, change: Callable, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df`` and a binary column ``name``: ``change(tool(), value)`` of the column ``source``."""
    at = df.columns.index(source)
    schema = T.StructType([df.schema[c] for c in keep]).add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tool()
        for b in batches:
            made, start, size = [], 0, 0
            for i, value in enumerate(b.column(at)):
                made.append(change(held, value.as_py()))
                size += len(made[-1] or b"")
                if size >= BATCH_BYTES or i + 1 == b.num_rows:
                    part = b.select(keep).slice(start, len(made))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*keep, name])
                    made, start, size = [], i + 1, 0

    return df.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of each row; the ranks in the file at ``path``."""
    checked(read_ranks(path))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return _mapped(rows, lambda: bpe(path), "text", "ids", lambda coder, t: coder.encode(t or ""), ["doc_id"])


def decoded(df: DataFrame, path: str, *, ids: str = "ids", bytes_as: str = "bytes") -> DataFrame:
    """``df`` with the bytes that its ids stand for; an id that isn't in the vocabulary is an error."""
    return _mapped(df, lambda: tokens(path), ids, fresh(df, bytes_as), lambda known, i: None if i is None else decoded_bytes(known, i), df.columns)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decoded(encoded(table(spark, sf_dir, "documents"), path), path)
    n = (F.length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
