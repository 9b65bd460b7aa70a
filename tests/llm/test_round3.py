"""Byte-level BPE, conversation trie and filter audit against brute force and SQL."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from probita.llm import audit, bpe, trie
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DIR = "/root/testdata/sf0.001"


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def odd_texts():
    random.seed(5)
    some = [None, "", " ", "  \n\t x", "it's we'll 'S don't'", "a" * 5000, "ab" * 3000, " " * 3000 + "\n", "\x1c\x1f a\x85b　c", "é ĳ ǆ 漢字かな 한국어 ไทย", "<|endoftext|> 12345 ³⅕ Ⅷ", "\U00032000x 1\U00011de0 !\U00011de0 \U0001fae9", "x՘ ꟎࢏", "🧑‍🚀🏽🇩🇪"]
    for alphabet in ("ab", "aeiou ", "etaoin shrdlu\n", "ßäöüéèçñ x", "漢字かなе́", "0123456789.,-", " \n\t\r\xa0"):
        some += ["".join(random.choice(alphabet) for _ in range(random.randint(1, 300))) for _ in range(40)]
    return some + ["".join(chr(random.choice([random.randrange(1, 0x250), random.randrange(0x370, 0x2000), random.randrange(0xE000, 0x1F000)])) for _ in range(200)) for _ in range(30)]


def test_backtracking_equals_the_library():
    lib, coder = library(), bpe.Bpe(bpe.read_ranks(PATH), public_tokenizers.PATTERN, 50, 50)  # small caches, which are turned over
    for t in odd_texts():
        ids = np.frombuffer(coder.encode(t or ""), "<u4").tolist()
        assert ids == lib.encode_ordinary(t or ""), repr(t)[:80]
        assert bpe.decoded_bytes(coder.tokens, np.array(ids, "<u4").tobytes()) == (t or "").encode()


def test_merges_of_any_bytes():
    """Backtracking on bytes that are no text equals the merges by their definition."""
    ranks = bpe.read_ranks(PATH)
    coder = bpe.Bpe(ranks, public_tokenizers.PATTERN)
    random.seed(6)
    tokens = list(ranks)
    for _ in range(2000):
        data = b"".join(random.choice(tokens) for _ in range(random.randint(1, 4)))[:60]
        assert [coder.tokens[i] for i in coder.backtracked(data)] == bpe.merged(ranks, data)


def test_long_pieces_take_linear_time():
    import time

    coder = bpe.Bpe(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    took = []
    for n in (20_000, 80_000):
        data, began = b"abcabd" * (n // 6), time.process_time()
        coder.backtracked(data)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_ranks_are_checked():
    base = {bytes([b]): b for b in range(256)}
    assert bpe.checked(base | {b"ab": 256, b"abc": 257})
    for odd in ({b"abc": 256}, {b"abc": 256, b"ab": 257}, {b"ab": 300}):
        with pytest.raises(ValueError):
            bpe.checked(base | odd)
    with pytest.raises(ValueError):
        bpe.checked({b"a": 0})


def test_bpe_rows(spark):
    texts = odd_texts()
    rows = [(i if i % 7 else None, t, 1, b"x", b"y") for i, t in enumerate(texts)] + [(3, "same", 1, b"x", b"y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids binary, bytes binary")
    lib = library()
    both = bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()
    want = collections.Counter((i, np.array(lib.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in both) == want
    assert bpe.encoded(docs.filter("doc_id = -1"), PATH).count() == 0
    again = bpe.decoded(spark.createDataFrame([(None, 1), (b"", 2)], "ids binary, bytes int"), PATH)
    assert again.columns == ["ids", "bytes", "_bytes"] and {r._bytes for r in again.collect()} == {None, b""}


def test_op11(spark):
    lib = library()
    want = set()
    for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect():
        ids = lib.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in bpe.op11_bpe(spark, DIR).collect()} == want


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        seq = tuple(own.get(base, [])[:h] + t[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def conversations():
    random.seed(9)
    rows = []
    for c in [*range(60), 100, 103, 104, 777, -3, -5, -11]:
        hot = c % 3 == 0
        for t in range(0 if c == 104 else random.randint(1, 12)):
            said = "hello" if hot or t < 2 else random.choice(["yes", "no", "é", ""])
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", said))
    rows += [(200, None, None, None), (200, None, "user", "z"), (200, 1, None, "a"), (201, 5, "a", None), (201, 5, "b", None), (201, 5, "b", None), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(300, t, "user", str(t % 7)) for t in range(700)] + [(305, t, "user", str(t % 7) if t < 650 else "x") for t in range(700)]
    return [(*r, 1, b"q") for r in rows]


@pytest.mark.parametrize("n", [1, 3, 40])
def test_trie(spark, n):
    rows = conversations()
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long, seq binary").repartition(3)
        got = trie.trie(trie.staged(trie.rebuilt(turns), "t")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert collections.Counter(map(tuple, got)) == brute_trie(rows)
    assert trie.trie(trie.staged(trie.rebuilt(turns.filter("conv_id = -999")), "t")).count() == 0


def test_ids_of_one_text_are_hashed_in_order(spark, monkeypatch):
    """Ids of a frequent conversation are cut into rows and still hashed in numerical order."""
    rows = [(c, 0, "user", "hi", 1, b"") for c in range(0, 30_000, 5)]  # each its own base
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long, seq binary").repartition(5)
    got = trie.trie(trie.staged(trie.rebuilt(turns), "t")).collect()
    assert collections.Counter(map(tuple, got)) == brute_trie(rows)


def test_edges_are_compressed():
    """A unary run is one row, whose savings are suffix sums."""
    turn = lambda *x: b"".join(bytes([i]) * 16 for i in x)
    p = trie.Patricia()
    rows = []
    for row in [(turn(1), [5], 9, 1, "e"), (turn(2, 3, 4, 5), [1, 10, 100, 1000], 3, 2, "f"), (turn(2, 3, 4, 6), [1, 10, 100, 7], 2, 1, "g"), (turn(3), [5], 4, 1, "h")]:
        rows += p.add(*row)
    rows += p.end()
    closed = [r for r in rows if r[2] is None]
    assert [(r[4], r[5], r[6], r[-1]) for r in closed] == [(4, 3, 2, [1000]), (4, 2, 1, [0]), (1, 2, 3, [1222, 1220, 1200])]
    assert len([r for r in rows if r[2] is not None]) == 3  # the root and the first and last sequence's own node


def sql(query, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return con.execute(query).fetchall()


def test_op12_equals_sql(spark):
    got = trie.op12_trie(spark, DIR)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DIR}/conversations.parquet'")
    rel = con.execute(trie.OP12_SQL)
    names = [d[0] for d in rel.description]
    assert collections.Counter(map(tuple, got.select(*names).collect())) == collections.Counter(rel.fetchall())


def test_trie_sql_equals_brute_force():
    import pandas as pd

    rows = conversations()
    t = pd.DataFrame([r[:4] for r in rows], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", t)
    rel = con.execute(trie.OP12_SQL)
    order = [[d[0] for d in rel.description].index(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    assert collections.Counter(tuple(r[i] for i in order) for r in rel.fetchall()) == brute_trie(rows)


def audit_rows():
    random.seed(3)
    long = " ".join(random.choice("abcdefghijkl") + str(random.randrange(60)) for _ in range(80))
    kinds = [None, "", long, long, "A B C " * 30, long + " #", long + " tail", "few words", "É" * 99 + "A", long.upper(), "x " * 400 + "|", "a\x0bb\x1cc　d " * 60]
    rows = [(i, kinds[i % 12] if i % 5 else f"{long} {i % 9}", f"s{i % 4}" if i % 6 else None) for i in range(150)]
    return rows + [(7, long, "s1"), (7, long, "s1"), (None, long, "s2"), (None, "only here", "s2"), (-4, "few words", "")]


def brute_audit(rows, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = word.findall(t)
        bad = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i)
        docs.append((part or "", bad, any(d == i and q == 1 for d, q, _ in labels if d is not None), any(d == i and x == 1 for d, _, x in labels if d is not None)))
    out, shapley = [], collections.Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations(range(5)):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if d[1][f]]
                alive = [d for d in alive if not d[1][f]]
                shapley[part, f] += len(gone)
                out.append((part, f, "".join("ABCDE"[g] for g in order), step, len(alive), len(gone), sum(d[1][f] for d in mine) - len(gone), sum(d[1][f] and sum(d[1]) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
    return collections.Counter((p, *rest, shapley[p, f]) for p, f, *rest in out)


LABELS = [(i, i % 3 == 0, i % 7 == 0) for i in range(0, 150, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (9999, 1, 1)]


@pytest.mark.parametrize("index", [1 << 18, 20])
def test_audit(spark, index, monkeypatch):
    monkeypatch.setattr(audit, "ROWS_AN_INDEX", index)
    rows, labels = audit_rows(), [(d, None if q is None else int(q), None if x is None else int(x)) for d, q, x in LABELS]
    docs = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, source string, bits int, digest binary").repartition(3)
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert collections.Counter(map(tuple, got.collect())) == brute_audit(rows, labels)
    assert audit.audit(docs.filter("doc_id = -99"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_many_parts(spark):
    """A part for every document still leaves 600 rows each."""
    docs = spark.createDataFrame([(i, "a b # C", f"p{i}") for i in range(90)], "doc_id long, text string, source string")
    got = audit.audit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert got.count() == 90 * 600 and got.agg(F.sum("good_lost")).first()[0] == 120


def test_op13_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    rel = con.execute(audit.OP13_SQL)
    names = [d[0] for d in rel.description]
    assert collections.Counter(map(tuple, audit.op13_audit(spark, DIR).select(*names).collect())) == collections.Counter(rel.fetchall())


def test_audit_sql_equals_brute_force():
    import pandas as pd

    rows, labels = audit_rows(), [(d, None if q is None else int(q), None if x is None else int(x)) for d, q, x in LABELS]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    rel = con.execute(audit.OP13_SQL)
    order = [[d[0] for d in rel.description].index(c) for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    assert collections.Counter(tuple(r[i] for i in order) for r in rel.fetchall()) == brute_audit(rows, labels)


@pytest.mark.parametrize("few", [200_000, 0])
def test_keys_decide_rows(spark, few, monkeypatch):
    """Rows are kept by their keys exactly, with so few bits that most keys meet others by chance; columns named like the bitmaps' pass through."""
    from probita.llm import common

    monkeypatch.setattr(common, "MOST_BITS", 64)
    monkeypatch.setattr(common, "BITMAP", 64)
    monkeypatch.setattr(common.F, "bitmap_construct_agg", lambda p: F.max(F.lit(bytes([255] * 8))))  # all bits on: nothing is decided by them
    df = spark.range(300).select(F.md5(F.col("id").cast("string").cast("binary")).alias("k"), "id", F.lit(1).alias("_bits_at"))
    keys = lambda cond: common.staged(df.filter(cond).select("k"), "test-keys")
    kept = common.kept_by_key(df, "k", keys("id % 3 = 0"), keys("id % 3 <> 0"), few)
    assert kept.columns == df.columns and sorted(r.id for r in kept.collect()) == list(range(0, 300, 3))


def test_one_of_each_and_sketches(spark):
    from probita.llm import common

    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3), ("c", 4)], "k string, n int")
    some = common.staged(spark.createDataFrame([("a",)], "k string"), "test-keys")
    assert sorted(r.n for r in common.one_of_each(df, "k", some).collect()) == [1, 2, 3, 3, 4]
    assert sorted(r.n for r in common.one_of_each(df, "k", some.filter("k = 'z'")).collect()) == [1, 1, 2, 3, 3, 4]
    many = common.staged(spark.range(5000).select(F.col("id").cast("string").alias("k")), "test-keys")
    rows = spark.range(10_000).select(F.col("id").cast("string").alias("k"), "id")
    got = {r.id for r in common.rows_among(rows, "k", many).collect()}
    assert set(range(5000)) <= got and len(got) < 5600
    out = {r.id for r in common.rows_among(rows, "k", many, inside=False).collect()}
    assert out == set(range(10_000)) - got
