"""Each operator against brute force on odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import types
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from probita.llm import licenses, mixing, packing, passages, pii, quality, repeats, simhash, suffixes, tokencount, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    random.seed(11)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    shared = prose(90)
    near = prose(120).split()
    edited = [*near]
    edited[60] = "other"
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Éa b́ c"), (5, prose(30) + "\n" + shared + "\n" + prose(30)), (6, prose(10) + " " + shared), (7, " ".join(near)), (8, " ".join(edited)),
        (9, " ".join(near)), (9, " ".join(near)), (None, " ".join(near)), (10, "ab " * 900), (11, "x" * 3000), (12, prose(6000)), (13, "same line here\n" * 12 + "# $ | end"), (14, shared.upper()),
        (15, "Licensed under the Apache License, Version 2.0. mail a.b@c.example.org, 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111, call +1 (212) 555-0100, IBAN DE89370400440532013000"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if n % 3 else None, f"s{n % 3}" if n % 4 else None, n, "clash", -1) for n, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, digest string, uid int")


def empty(docs):
    return docs.filter("doc_id = -5")


def words(t):
    return WORD.findall(t or "")


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = packing.word_ids(path).tok
    got = packing.pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), path, with_ids=True).collect()
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in {i: t for i, t in texts() if i is not None}.items():
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by[i], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert (r.start, r.ids, r.doc_tokens, r.ids_crc32) == (at, part, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        ends = np.cumsum([r.length for r in sorted(s, key=lambda r: r.offset)])
        assert [r.offset for r in sorted(s, key=lambda r: r.offset)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert packing.pack(empty(docs), path).count() == 0 and packing.pack(docs, path).count() > len(got)


def test_differencing_balances_and_raises_the_count():
    random.seed(2)
    sizes = [random.randint(1, 256) for _ in range(800)]
    sets = packing.difference(sizes, 40)
    loads = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(800)) and max(loads) - min(loads) <= 2
    assert len(packing.fit([6, 6, 6], 2, 10)) == 3 and packing.difference([], 3) == []


def test_word_ids_equal_the_tokenizer():
    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), 20, 20)
    random.seed(4)
    odd = [chr(c) for c in range(1, 0x180)] + ["'s", "'LL", "<|endoftext|>", "<|x", " ", "日本", "😀", "Σς", "the", "The"]
    for _ in range(2000):
        t = "".join(random.choice(odd) for _ in range(random.randint(0, 10)))
        assert w(t) == np.array(w.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_substrings(docs, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)  # frequent anchors take their own way
    rows = texts()
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[j : j + 400] for b in data for j in range(len(b) - 399))
    want = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for j in range(len(b) - 399):
            if seen[b[j : j + 400]] > 1:
                gone[j : j + 400] = [True] * 400
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in suffixes.dedup_substrings(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert suffixes.dedup_substrings(empty(docs)).count() == 0


def _substrings_brute(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[j : j + 400] for b in data for j in range(len(b) - 399))
    want = []
    for (i, _), b in zip(rows, data, strict=True):
        d = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 399):
            if seen[b[j : j + 400]] > 1:
                d[j] += 1
                d[j + 400] -= 1
        gone = np.cumsum(d[:-1]) > 0
        spans = int(np.sum(gone & ~np.r_[False, gone[:-1]])) if len(b) else 0
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(map(repr, want))


@pytest.mark.parametrize("size", [240, 390, 402, 1500])
def test_substrings_with_a_frequent_passage(spark, monkeypatch, size):
    """One passage with other neighbours in each of many texts, some of which share a neighbour too."""
    monkeypatch.setattr(suffixes, "HOT_BLOCKS", 1)
    random.seed(size)
    noise = lambda n: "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, before, after = noise(size), noise(90), noise(120)
    rows = [(i, noise(random.randrange(300)) + (before if i % 3 == 0 else "") + passage + (after if i % 4 == 0 else "") + noise(random.randrange(300))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in suffixes.dedup_substrings(df).collect()) == _substrings_brute(rows)


def test_regions_cover_all_starts_in_pieces():
    random.seed(3)
    data = bytes(random.choice(b"abcd") for _ in range(5000))
    whole = [tuple(c.tolist()) for c in map(np.concatenate, zip(*suffixes.regions(data), strict=True))]
    keys = {s + j: (k, h) for s, n, k, h, _ in zip(*whole, strict=True) for j in range(n)}
    parts = [tuple(c.tolist()) for c in map(np.concatenate, zip(*suffixes.regions(data, 700), strict=True))]
    assert sorted(keys) == list(range(len(data) - 399))
    assert keys == {s + j: (k, h) for s, n, k, h, _ in zip(*parts, strict=True) for j in range(n)}
    for s, n, _, _, a in zip(*whole, strict=True):
        cut = list(suffixes.narrowed(data, s, n, a))
        assert [x + j for x, k, _ in cut for j in range(k)] == list(range(s, s + n)) and all(k <= 21 for _, k, _ in cut)
        assert all(core in data[x + j : x + j + 400] and len(core) == 380 for x, k, core in cut for j in range(k))


def test_suffix_levels():
    random.seed(6)
    base = bytes(random.choice(b"abcdefgh") for _ in range(3000))
    parts = []
    for _ in range(40):
        at = random.randint(0, len(base) - 620)
        parts.append((random.randint(1, 200), bytes([random.randint(0, 255) for _ in range(5)]) + base[at : at + 610]))
    parts = [(n, p[: n + 399]) for n, p in parts]
    seen = collections.Counter(p[j : j + 400] for n, p in parts for j in range(n))
    family = suffixes.Family()
    for i in range(0, 40, 3):
        family.add(suffixes.Level.of(parts[i : i + 3], np.arange(i, min(40, i + 3))))
    got = {j: level.twin[b : b + parts[j][0]].tolist() for level in family.levels for b, j in zip(level.bases.tolist(), level.names.tolist(), strict=True)}
    assert got == {j: [seen[p[k : k + 400]] > 1 for k in range(n)] for j, (n, p) in enumerate(parts)}
    assert len(family.levels) <= 6


def test_token_counts(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = tokencount.model(path)
    got = sorted(map(repr, map(tuple, tokencount.token_counts(docs, path).collect())))
    assert got == sorted(repr((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096)) for i, t in texts())
    assert tokencount.token_counts(empty(docs), path).count() == 0
    with pytest.raises(ValueError):
        tokencount.checked(types.SimpleNamespace(id_to_piece=["a", "a▁b"].__getitem__, get_piece_size=lambda: 2))


def test_token_counts_send_rows_in_proportion(spark, monkeypatch):
    """Twice the blocks send twice the rows, whatever the input; and a bucket takes its rows in several batches."""
    monkeypatch.setattr(tokencount, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(tokencount, "BUCKETS", 16)
    random.seed(31)
    texts_ = [(i, " ".join(f"w{random.randrange(3000)}" for _ in range(200))) for i in range(80)]
    sent = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(tokencount._emit(tokencount.BUCKETS), tokencount.ROWS).count()
    assert sent(texts_) == 2 * sent(texts_[:40])
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = tokencount.model(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(spark.createDataFrame(texts_, "doc_id long, text string"), path).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: len(sp.encode(t)) for i, t in texts_}


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def test_pii(docs):
    df, col = pii.with_spans(docs)
    got = {r[0]: r[1] for r in df.filter("doc_id is not null").select("doc_id", pii._joined(F.col(col))).collect()}
    t = dict(texts())[15]
    kinds = [x.split(":") for x in got[15].split(",")]
    assert [k for k, _, _ in kinds] == ["email", "ip", "card", "phone", "iban"]
    assert [t[int(a) : int(b)] for _, a, b in kinds] == ["a.b@c.example.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (212) 555-0100", "DE89370400440532013000"]
    assert luhn("4111111111111111") and all(v == "" for k, v in got.items() if k != 15)
    out = df.filter("doc_id = 15").select(pii.redacted(F.col("text"), F.col(col))).first()[0]
    assert out.endswith("mail <EMAIL>, <IP> and 999.1.1.1, card <CARD>, call <PHONE>, IBAN <IBAN>")
    assert df.filter("text is null").select(pii.redacted(F.col("text"), F.col(col))).first()[0] is None
    long = docs.sparkSession.createDataFrame([("9" * 200_000,), ("a" * 200_000,), ("a@b" + ".c" * 50_000,)], "text string")
    assert [len(r[0]) for r in (lambda d, c: d.select(c).collect())(*pii.with_spans(long))] == [0, 0, 1]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base_spans(t):
    """The contract's own patterns and tests."""
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_against_brute_force(spark):
    """Random texts of pieces that nearly match, and long texts full of hits: counts, base_sha256 and all base spans."""
    random.seed(21)
    pieces = ["a.b@c.example.org", "x@y", "@", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "+1 (212) 555-0100", "+49 30 1", "+", "ip ", "é", "😀", "-", ".", " ", "\n", "card ", "DE89370400440532013000", "078-05-1120", "ssn ", "0123456789"]
    rows = [(i, "".join(random.choice(pieces) for _ in range(random.randint(0, 30)))) for i in range(400)]
    rows += [(900, "\n".join(f"u{i}@m{i}.example.org 10.0.0.{i % 300}" for i in range(3000))), (901, "4111 1111 1111 1111, " * 700), (902, None), (903, ""), (None, pieces[0]), (900, "a@b.c " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    df, col = pii.with_spans(df)
    for r in df.select("text", F.col(col).alias("spans"), pii._joined(F.filter(col, lambda s: s["k"] < 4)).alias("base"), pii.redacted(F.col("text"), F.col(col)).alias("red")).collect():
        want, t = _base_spans(r.text), r.text or ""
        assert [(s.start, s.k, s.end) for s in r.spans if s.k < 4] == want
        assert r.base == ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in want)
        at, out = 0, ""
        for s in r.spans:
            if s.start >= at:
                out, at = out + t[at : s.start] + f"<{pii.KINDS[s.k].upper()}>", s.end
        assert (r.red or "") == out + t[at:]
        for s in r.spans:
            kind, before = pii.KINDS[s.k], t[max(0, s.start - 60) : s.start].lower()
            near, against = (bool(re.search(rf"\b(?:{w[kind]})", before)) for w in (pii.CONTEXT, pii.AGAINST))
            assert s.score == round(pii.SCORE[kind] + 0.3 * near - 0.3 * against, 2) and (s.k < 4 or s.score >= 0.6)


def test_topk(spark):
    random.seed(9)
    rows = [(i, [random.uniform(-1, 1) for _ in range(6)], 0) for i in range(300)] + [(7, [0.5] * 6, 0), (50, [0.5] * 6, 0), (301, [0.5] * 6, 0), (302, None, 0), (303, [float("nan")] + [0.1] * 5, 0), (None, [0.1] * 6, 0), (304, [None] + [0.1] * 5, 0), (305, [0.1] * 3, 0), (306, [], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = topk.top_k(v, F.col("vec_id") % 50 == 0).collect()
    whole = {(n, i): [int(np.floor(256 * x)) for x in e] for n, (i, e, _) in enumerate(rows) if i is not None and e is not None and None not in e and not np.isnan(e).any()}
    want = []
    for (n, q), a in whole.items():
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for (m, c), b in whole.items() if m != n and len(a) == len(b))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(v.filter("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_over_many_blocks(spark, monkeypatch):
    """Small blocks, groups and parts give the same answers."""
    for name, n in (("BLOCK", 16), ("GROUPED", 4), ("QUERIES", 8), ("CENTROIDS", 4)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).round(3)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    whole = np.floor(256 * x)
    want = []
    for q in range(0, 600, 20):
        s = whole @ whole[q]
        want += [(q, k + 1, int(c), int(s[c])) for k, c in enumerate(sorted(set(range(600)) - {q}, key=lambda c: (-s[c], c))[:5])]
    assert sorted(map(tuple, topk.top_k(v, F.col("vec_id") % 20 == 0).collect())) == sorted(want)


def test_pruning_leaves_blocks_out():
    blocks = [(np.arange(b * 10, b * 10 + 10), np.arange(b * 10, b * 10 + 10), np.full((10, 4), float(8 - b))) for b in range(8)]
    best, who, scored = topk.search(np.array([999]), np.ones((1, 4)), blocks, 5)
    assert best[0].tolist() == [32.0] * 5 and who[0].tolist() == [0, 1, 2, 3, 4] and scored == 1
    assert topk.search(np.array([999]), np.ones((1, 4)), blocks, 5, np.array([40.0]))[2] == 0


def _license_shingles(t):
    w = [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def _license_brute(rows, templates, least=0.8):
    """Containment of each template in each window of its class; the best by license."""
    out = {}
    for i, t in rows:
        s = _license_shingles(t)
        for kind, license_, body in templates:
            name = license_, kind
            own = set(_license_shingles(body))
            if not own or not s:
                continue
            c = next(c for c in licenses.CLASSES if c >= len(own))
            for k in range(max(0, -(-(len(s) - 4 * c) // (3 * c))) + 1):
                share = len(own & set(s[3 * c * k : 3 * c * k + 4 * c])) / len(own)
                if share >= least:
                    out.setdefault((i, name), {}).setdefault((c, 3 * c * k), []).append(share)
    return {k: (max(max(x) for x in v.values()), len(v), min(f for _, f in v)) for k, v in out.items()}


def test_licenses(spark, docs):
    """Whole, edited, cut and embedded notices against brute force, in short and long texts."""
    random.seed(12)
    prose = lambda n: " ".join(f"w{random.randrange(500)}" for _ in range(n))
    templates = licenses.built_in()
    rows = [(0, None), (1, ""), (2, "the MIT"), (3, prose(40))]
    for n, (_, _, body) in enumerate([x for x in templates if x[0] != "citation"] + random.sample([x for x in templates if x[0] == "citation"], 12)):
        w = body.split()
        edited = [*w]
        for _ in range(len(w) // 40):
            edited[random.randrange(len(w))] = "changed"
        rows += [(100 + n, f"{prose(random.randrange(300))} {body.upper()}\n{prose(random.randrange(900))}"), (200 + n, prose(37) + " " + " ".join(edited) + " " + prose(5)), (300 + n, " ".join(w[: int(len(w) * 0.85)]))]
    rows.append((400, prose(9000) + " " + licenses.NOTICES["MPL-2.0"] + " " + prose(4000) + " released under the MIT License. " + prose(3000)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("window", F.lit("clash"))
    got = {(r.doc_id, (r.license, r.kind)): (r.containment, r.n_windows, r.first_word) for r in licenses.scan(df).collect()}
    want = _license_brute(rows, templates)
    assert len(want) > 60 and got == want
    assert licenses.scan(empty(docs)).count() == 0
    twice = licenses.scan(docs.filter("doc_id = 15").union(docs.filter("doc_id = 15"))).collect()
    assert {(r.license, r.kind, r.n_windows) for r in twice} == {("Apache-2.0", "citation", 2)}
    assert licenses.scan(df, licenses.templates_of(spark, [("text", "short", "too few words here")])).count() == 0


def test_license_bands_keep_their_bound(spark):
    """The least similar template of each class is retrieved: a fifth of the class's shingles in a window of unlike ones."""
    rng = np.random.default_rng(5)
    missed = 0
    for c in (8, 32, 128, 512):
        for _ in range(300):
            n = c // 4 + 1
            own, other = rng.integers(-(2**63), 2**63, n), rng.integers(-(2**63), 2**63, 4 * c)
            other[: -(-4 * n // 5)] = own[: -(-4 * n // 5)]
            missed += not set(np.sort(own)[: licenses.BANDS].tolist()) & set(np.sort(other)[: licenses.BANDS].tolist())
    assert missed <= 0.005 * 1200


def test_quality_counts(spark, docs):
    df, col = quality.with_counts(docs)
    for r in df.select("text", col).collect():
        w, t, q = words(r.text), r.text or "", r[1]
        c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (q.n_words, q.word_chars, q.n_symbols, q.lines.d, q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def test_quality_bound_is_exact(spark):
    from math import comb, log

    got = spark.sql("select 300L n, 4L k").select(quality._log_tail(F.col("n"), F.col("k"), F.lit(0.03)).alias("x")).first().x
    assert abs(got - log(sum(comb(300, i) * 0.03**i * 0.97 ** (300 - i) for i in range(5)))) < 1e-9


def test_quality_cutoffs(spark):
    rated = spark.createDataFrame([(i, "en", *([0.0] * 5), 0.1 if i % 2 else 0.0) for i in range(6000)] + [(9000 + i, "xx", *([0.0] * 6)) for i in range(20)], "doc_id long, stratum string, " + ", ".join(f"{r} double" for r in quality.RULES))
    labels = spark.createDataFrame([(i, 1) for i in range(10_000)] + [(3, 0)], "doc_id long, quality int")
    got = {r.stratum: r for r in quality.thresholds(rated, labels).collect()}
    assert got["en"].symbols == quality.CUTOFFS[0] and got["en"].long_words >= 0.1  # half of the good texts lie at 0.1
    assert got["xx"].symbols is None  # too few labels to certify anything


def test_quality_certifies_small_strata(spark):
    """300 good labels are enough, also where one rule's ratios vary; all rules together reject at most 3% of them."""
    rows = [(i, "en" if i < 300 else None, *([0.0] * 5), 0.05 + 0.1 * (i % 300) / 300) for i in range(600)]
    rated = spark.createDataFrame(rows, "doc_id long, stratum string, " + ", ".join(f"{r} double" for r in quality.RULES))
    labels = spark.createDataFrame([(i, 1) for i in range(600)], "doc_id long, quality int")
    got = {r.stratum: r for r in quality.thresholds(rated, labels).collect()}
    for stratum in ("en", None):
        assert got[stratum].symbols == quality.CUTOFFS[0]
        assert sum(x[1] == stratum and x[-1] > got[stratum].long_words for x in rows) <= 9
    assert all(r.symbols is None for r in quality.thresholds(rated.filter("doc_id < 60"), labels).collect())


def _tail(n, k, p):
    from math import comb

    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_quality_verdicts_against_brute_force(spark):
    """Joint cutoffs by exact tails on three strata, one too small, and the verdict of every row."""
    rng = np.random.default_rng(2)
    words_ = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(1500):
        w = [words_[j] for j in rng.integers(0, 3000, rng.integers(5, 60))]
        junk = rng.random()
        w += ["#$"] * (int(rng.integers(1, 30)) if junk < 0.15 else 0) + ["wow!!"] * (int(rng.integers(1, 9)) if junk > 0.9 else 0)
        rows.append((i, " ".join(w), "en" if i < 700 else "de" if i < 1450 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("quality", F.lit("clash"))
    labels_ = {i: int("#" not in t) for i, t, _ in rows}
    labels = spark.createDataFrame([*labels_.items(), (0, 0), (None, 1)], "doc_id long, quality int")
    labels_[0] = 0
    counted, col = quality.with_counts(docs)
    df, c, ok = quality.judge(mixing.staged(counted, "test-counted"), col, labels)
    quarter = {r[0] for r in spark.range(1500).filter(F.pmod(F.xxhash64("id"), F.lit(4)) == 0).collect()}
    got = df.select("doc_id", "lang", ok.alias("ok"), quality.base_failed(c).alias("bad"), *[v.alias(k) for k, v in quality.ratios(c).items()]).collect()
    cut, strata = {}, {r.lang for r in got}
    for lang in strata:
        good = [r for r in got if r.lang == lang and labels_[r.doc_id] and not r.bad]
        order, test = [r for r in good if r.doc_id in quarter], [r for r in good if r.doc_id not in quarter]
        steps = sorted((sum(r[rule] > x for r in order), max(r[rule] for r in order) / x, -i, n, rule, x) for n, rule in enumerate(quality.RULES) for i, x in enumerate(quality.CUTOFFS))
        limits, lost = {}, set()
        for *_, rule, x in steps:
            lost |= {r.doc_id for r in test if r[rule] > x}
            if len(lost) < 0.03 * len(test) and _tail(len(test), len(lost), 0.03) <= 0.05 / len(strata):
                limits[rule] = min(x, limits.get(rule, x))
        cut[lang] = limits
    assert cut[None] == {} and cut["en"].get("symbols") and cut["de"].get("symbols")
    assert all(r.ok == (not r.bad and all(r[rule] <= x for rule, x in cut[r.lang].items())) for r in got)
    assert any(not r.ok and not r.bad for r in got)  # rejected by a certified cutoff alone


def test_passages(docs):
    rows = texts()
    first = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, passages.dedup_passages(docs).collect()))) == sorted(map(repr, want))
    assert passages.dedup_passages(empty(docs)).count() == 0


def test_simhash(spark, docs):
    import xxhash

    df, fp = simhash.with_fingerprint(docs)
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    for r in df.select("text", fp).collect():
        w = words((r.text or "").translate(low))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]).encode(), seed=42) for j in range(max(1, len(w) - 2))] if w else []
        assert r[1] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hub", [1000, 2])
def test_simhash_components(spark, monkeypatch, hub):
    """Links, equal fingerprints and, by broadcast from ``hub`` on, a common fingerprint that stays spread and a large component."""
    monkeypatch.setattr(simhash, "HUB", hub)
    random.seed(8)
    fps = [random.getrandbits(64) for _ in range(30)]
    for f in fps[:15]:
        for _ in range(6):
            f ^= (1 << random.randrange(64)) | (1 << random.randrange(64))
            fps.append(f)
    fps += fps[:5] + fps[20:21] * 60
    rows = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "doc_id long, fp long").repartition(4)
    out, comp = simhash.with_component(rows, "fp", "doc_id")
    root = list(range(len(fps)))
    for _ in fps:
        for a, x in enumerate(fps):
            for b in range(a):
                if (x ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    got = out.select("doc_id", comp, F.spark_partition_id().alias("at")).collect()
    assert len(got) == len(fps) and {r.doc_id: r[comp] for r in got} == dict(enumerate(root))
    assert hub > 2 or len({r.at for r in got if fps[r.doc_id] == fps[20]}) > 1


def test_components_with_hubs(spark, monkeypatch):
    """Stars, a chain and a clique; hubs take the broadcast way."""
    monkeypatch.setattr(simhash, "HUB", 3)
    random.seed(3)
    edges = [(500 + i, 400) for i in range(60)] + [(400, 3)] + [(i, i + 1) for i in range(700, 740)] + [(a, b) for a in range(800, 806) for b in range(800, a)] + [(9, 9), (520, 720)]
    random.shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {x: got.get(x, x) for x in root} == root
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _linked(bits):
    """Brute force: each row's least linked row."""
    root = list(range(len(bits)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(bits)):
        d = np.bitwise_count(bits[a] ^ bits[:a]).sum(1)
        for b in np.flatnonzero(d <= simhash.WIDE_BUDGET):
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(bits))]


def test_wide_fingerprint():
    random.seed(5)
    base = [f"w{random.randrange(900)}" for _ in range(400)]
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(simhash.wide_fingerprint(a), simhash.wide_fingerprint(b), strict=True))
    edited = [*base]
    edited[50] = edited[200] = edited[300] = "new"
    assert far(" ".join(base), " \n".join(edited).upper()) <= simhash.WIDE_BUDGET
    assert far(" ".join(base), " ".join(base[:200] + [f"v{i}" for i in range(200)])) > simhash.WIDE_BUDGET
    assert far(" ".join(base), " ".join(base + base[:300])) <= simhash.WIDE_BUDGET  # repeats count once
    assert simhash.wide_fingerprint(None) == simhash.wide_fingerprint(" \n") == bytes(32)


def test_wide_walk_over_blocks(monkeypatch):
    """A group many times the block: one large cluster, small ones and single texts, all under one key."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BLOCK", 128)
    monkeypatch.setattr(simhash, "KEPT", 16)
    rng = np.random.default_rng(3)
    seed = rng.integers(0, 2, (8, 256), np.uint8)
    rows = np.concatenate([seed[np.r_[np.zeros(600, int), np.repeat(np.arange(1, 8), 12)]] ^ (rng.random((684, 256)) < 0.05), rng.integers(0, 2, (150, 256), np.uint8)]).astype(np.uint8)
    rows[:, :16] = rows[0, :16] ^ (rng.random((len(rows), 16)) < 0.05)  # all meet in the levels walked
    rest = rows[:, :16].astype(np.int64) @ (1 << np.arange(16)[::-1])
    order = np.argsort(rest, kind="stable")
    rows, rest = rows[order], rest[order]
    wide = [x.tobytes() for x in np.packbits(rows, axis=1)]
    cut = [0, 300, 310, len(rows)]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(b - a, 7)), pa.array(rest[a:b].astype(np.int32)), pa.array(np.arange(a, b)), pa.array(wide[a:b])], names=["key", "rest", "node", "wide"]) for a, b in itertools.pairwise(cut)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = 0
    for out in simhash._wide_walk(iter(batches)):
        for a, b in zip(*[c.to_pylist() for c in out.columns], strict=True):
            edges += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert [find(x) for x in range(len(rows))] == _linked(np.frombuffer(b"".join(wide), np.uint64).reshape(-1, 4))
    assert edges < 3 * len(rows)  # spanning stars, no pairs


def test_wide_walk_keeps_links_to_every_member():
    """A group beyond the block: a hub, edited copies of it, and copies of those, which link to one member only."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    flip = lambda x: x ^ (rng.random(x.shape) < 0.1)
    hub = rng.integers(0, 2, (1, 256), np.uint8)
    copies = flip(np.repeat(hub, 2000, axis=0))
    rows = np.concatenate([hub, copies, flip(copies)]).astype(np.uint8)
    wide = [x.tobytes() for x in np.packbits(rows, axis=1)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), 7)), pa.array(np.zeros(len(rows), np.int32)), pa.array(np.arange(len(rows))), pa.array(wide)], names=["key", "rest", "node", "wide"])
    edges = [np.column_stack([c.to_numpy() for c in out.columns]) for out in simhash._wide_walk(iter([batch]))]
    a, b = np.concatenate(edges).T
    want = _linked(np.frombuffer(b"".join(wide), np.uint64).reshape(-1, 4))
    assert simhash._roots(len(rows), a, b).tolist() == want
    assert len(a) == len(rows) - len(set(want))


def test_near_groups(spark, docs):
    kept = simhash.stage_simhash(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 10, 11, 12, 13, 15]
    assert simhash.stage_simhash(spark, docs.limit(0), "").count() == 0


def _edited(pairs, run):
    """Pairs of unlike texts of 200 words, the second with a run of other words: similarity (192 - run) / (200 + run)."""
    rows = []
    for i in range(pairs):
        w = [f"p{run}x{i}w{j}" for j in range(200)]
        rows += [(2 * i + 1000 * run, " ".join(w)), (2 * i + 1 + 1000 * run, " ".join(w[:90] + [f"o{x}" for x in w[90 : 90 + run]] + w[90 + run :]))]
    return rows


def test_near_groups_decide_by_shingles(spark):
    """Pairs just above similarity 0.8 go together, 0.95 of them on average; pairs just below never."""
    kept = {r.doc_id for r in simhash.stage_simhash(spark, spark.createDataFrame(_edited(300, 17) + _edited(300, 18), "doc_id long, text string"), "").collect()}
    assert sum(17000 <= i < 18000 for i in kept) <= 300 + 24
    assert sum(18000 <= i < 19000 for i in kept) == 600


def test_true_links_over_blocks(spark, monkeypatch):
    """Components over many blocks: a star of near copies, a chain of it, and texts that link to one member only or to none."""
    monkeypatch.setattr(simhash, "SETS", 8)
    monkeypatch.setattr(simhash, "PIVOTS", 1)
    rng = np.random.default_rng(6)
    sets = [rng.choice(10**6, 100, replace=False) for _ in range(6)]
    for _ in range(90):
        x = sets[rng.integers(len(sets))].copy()
        k = rng.integers(1, 15)
        x[rng.integers(0, 100 - k) :][:k] = rng.integers(10**6, 10**7, k)
        sets.append(x)
    sets = [np.unique(x).astype(np.uint64) for x in sets]
    rows = spark.createDataFrame([(0, len(sets), i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "root long, n long, node long, hashes binary")
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(both := np.intersect1d(sets[i], sets[j])) >= 8 * (len(sets[i]) + len(sets[j]) - len(both))]
    want = simhash._roots(len(sets), *np.array(links).T)
    got = {r.node: r.root for r in simhash.true_links(rows).collect()}
    assert 1 < len(set(want.tolist())) < 60
    assert [got.get(i, i) for i in range(len(sets))] == want.tolist()


def test_near_groups_recall(spark):
    """Against brute force on the small table: links of similarity 0.8 and more are found, unlike texts stay."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    every = {r.doc_id: r.text for r in rows.collect()}
    kept = {r.doc_id for r in simhash.stage_simhash(spark, rows, "").collect()}
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, t in every.items():
        w = words((t or "").translate(low))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    holds = collections.defaultdict(set)
    for i in sorted(sets):
        for g in sets[i]:
            holds[g].add(i)
    near, some = set(), set()
    for i in sorted(sets):
        common = collections.Counter(j for g in sets[i] for j in holds[g] if j < i)
        like = max((n / (len(sets[i]) + len(sets[j]) - n) for j, n in common.items()), default=0)
        near |= {i} if like >= 0.8 else set()
        some |= {i} if like >= 0.5 else set()
    groups: dict = {i: i for i in sets}

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    pairs = [(i, j) for i in sorted(sets) for j, n in collections.Counter(j for g in sets[i] for j in holds[g] if j < i).items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
    for i, j in pairs:
        a, b = find(i), find(j)
        groups[max(a, b)] = min(a, b)
    left = collections.Counter(find(i) for i in kept)  # a group that lost no link keeps one document
    split = sum(left[r] > 1 for r in left)
    assert len(pairs) > 50 and split <= 0.1 * sum(n > 1 for n in collections.Counter(find(i) for i in sets).values())
    gone = set(every) - kept
    assert len(near) > 20 and len(near & gone) >= 0.9 * len(near)
    assert gone <= some


def _shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing step by step: sources over their limit are set to it, the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        want = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if want[s] > most * sizes[s]]
        if not over:
            return capped | want
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("parts", [1, 7])
def test_mixing(spark, docs, parts):
    sized = mixing.staged(mixing.with_size(docs.repartition(parts)), "test-sizes")
    rows, pieces = mixing.mixed(sized, block=16)
    taken = {r.uid: r.n for r in pieces.groupBy("uid").agg(F.sum("n_words").alias("n")).collect()}
    rows = rows.join(sized.select("uid", "source"), "uid").collect()
    sizes, took = collections.defaultdict(int), collections.defaultdict(int)
    for r in rows:
        assert taken.get(r.uid, 0) <= 3 * r["size"]
        sizes[r.source] += r["size"]
        took[r.source] += taken.get(r.uid, 0)
    want = _shared(sizes)
    assert len(rows) == docs.count() and all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in rows)
    assert all(abs(took[s] - want[s]) <= 64 for s in sizes)
    assert mixing.mixed(mixing.staged(mixing.with_size(empty(docs)), "test-none"))[1].count() == 0
    blank = docs.withColumn("text", F.lit(" "))
    assert mixing.mixed(mixing.staged(mixing.with_size(blank), "test-blank"))[1].count() == 0


def test_mixing_reruns_agree(spark, docs):
    """What each text is taken does not depend on how rows are dealt."""
    def run(parts):
        sized = mixing.staged(mixing.with_size(docs.repartition(parts)), "test-sizes")
        rows, pieces = mixing.mixed(sized, block=16)
        return sorted(map(repr, rows.join(pieces.groupBy("uid").agg(F.sum("n_words").alias("n")), "uid", "left").select("key.id", "size", "n").collect()))

    assert run(1) == run(5)


def test_the_draw_decides(spark):
    """Shards' counts scatter as a multinomial draw does and choose the blocks: another draw, or none, takes others; sources' totals and the passes hold."""
    per = spark.createDataFrame([(0, 6400, 12800.0), (1, 640, 1920.0), (2, 0, 0.0), (3, 6400, 3300.0), (4, 32000, 31000.0)], "s int, source_size long, target double")
    per = mixing.staged(mixing.plan(per, 16, 3, 50), "test-plan")
    want = {0: 800, 1: 120, 3: 206, 4: 1938}

    def mix(drawn):
        got = mixing.slots(mixing.staged(drawn, "test-draw"), per).collect()
        assert collections.Counter(r.s for r in got) == want
        taken = collections.Counter((r.s, r["pass"], r["index"]) for r in got)
        assert set(taken.values()) == {1} and all(i < {0: 400, 1: 40, 3: 400, 4: 2000}[s] and turn < 3 for s, turn, i in taken)
        return got, set(taken)

    got, one = mix(mixing.draw(per))
    shards = -(-sum(want.values()) // 50)
    for s in want:
        by = collections.Counter(r.shard for r in got if r.s == s)
        mean = want[s] / shards
        assert shards / 3 < sum((by.get(i, 0) - mean) ** 2 / mean for i in range(shards)) < 2 * shards
    assert collections.Counter((r.s, r.shard) for r in got) == collections.Counter((r.s, r.shard) for r in mixing.draw(per).collect())
    for other in (mixing.draw(per, 21), mixing.draw(per).withColumn("shard", F.lit(0).cast("long"))):  # the permutations stay as they are
        _, two = mix(other)
        assert {x for x in one if x[0] in (0, 1)} == {x for x in two if x[0] in (0, 1)}  # passes that take every block
        assert len({x for x in one if x[0] == 3} & {x for x in two if x[0] == 3}) < 190 and {x for x in one if x[0] == 4} != {x for x in two if x[0] == 4}


def test_another_seed_takes_other_words(spark, docs):
    """What documents are taken changes with the draw; sources' words stay near their targets."""
    sized = mixing.staged(mixing.with_size(docs), "test-sizes")
    runs = []
    for seed in (20, 21):
        rows, pieces = mixing.mixed(sized, block=4, seed=seed, slots_a_shard=16)
        runs.append({r.uid: r.n for r in pieces.groupBy("uid").agg(F.sum("n_words").alias("n")).collect()})
        by = collections.defaultdict(lambda: [0, 0.0])
        for r in rows.collect():
            by[r.s][0] += runs[-1].get(r.uid, 0)
            by[r.s][1] = r.target
        assert all(abs(n - t) <= 64 for n, t in by.values())
    assert runs[0] != runs[1]


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    """Rows of equal id and text, null and empty texts and ids, and a column named like the key."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "a")] * 30 + [(2, long, "b"), (3, None, "c"), (3, "", "d"), (3, None, "c"), (None, long, "e"), (None, "one", "f"), (None, "one", "f"), (5, "two", "g")]
    got = simhash.stage_simhash(spark, spark.createDataFrame(rows, "doc_id long, text string, _KEY string"), "")
    assert got.columns == ["doc_id", "text", "_KEY"]
    kept = sorted(got.collect(), key=str)
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", long), ("3", ""), ("None", "one"), ("5", "two")])
