r"""Personal data in texts, in DataFrame expressions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for bank accounts, value ranges),
and words in the 60 code points before a span raise or lower its score by 0.3. The four base kinds (email, ip, card, phone)
stay whatever their score, which is given beside them; the added kinds (iban, ssn, secret) count from a score of 0.6: a
valid IBAN has 0.8 without context and goes after a word such as "serial"; the bare shapes of the others need a context word.

Spark has no function for all match positions, so they come from two aligned results of one pattern: the pieces
between the matches (``split``) and the matches (``regexp_extract_all``). Patterns are written with possessive
repeats, and starts inside a run that failed are skipped by a lookbehind (``\G`` keeps the start right after the last
match), so the time is linear in the text; they match what the plain patterns match, as no repeat can give back
characters usefully. Positions, contexts and replacements come from the pieces in two-level folds (``folded``), never from
the start of the text, so a text of many spans takes time in proportion too.

Defined results: a null or empty text has no spans, and redaction leaves it as it is; repeated rows each get a row; an empty
table gives no rows; other columns are carried unread. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])(?:[0-9a-f]{32,64}|[A-Za-z0-9_-]{40,64})(?![A-Za-z0-9_-])",
}
#: A cheap test that any match of the kind passes; most texts stop here.
GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9_-]{32}"),
}
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|host|server|login", "card": "card|visa|credit|payment|karte",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|konto|cuenta|compte", "ssn": "ssn|social|security|tax",
    "secret": "token|secret|key|password|passwd|credential|auth",
}
#: Words that speak against a kind.
AGAINST = {
    "email": "example|noreply", "ip": "version|release|section", "card": "order|serial|isbn|tracking", "phone": "order|serial|isbn", "iban": "serial|model|part",
    "ssn": "part|model|order|serial", "secret": "md5|sha1|sha256|checksum|commit|uuid",
}
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
NEAR, BOOST, LEAST = 60, 0.3, 0.6
#: Items folded at a time, and code points of a slice of a text.
FOLD, SLICE = 64, 4096


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Of a digit string of 12 to 19."""
    def part(total: Column, i: Column) -> Column:
        d = F.substring(x, F.length(x) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(x) - 1), F.lit(0), part) % 10 == 0


def _mod97(x: Column) -> Column:
    flat = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))

    def part(rest: Column, ch: Column) -> Column:
        letter = F.ascii(ch) >= 65
        return F.when(letter, (rest * 100 + F.ascii(ch) - 55) % 97).otherwise((rest * 10 + F.ascii(ch) - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda ch: ch != ""), F.lit(0), part) == 1


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return x.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return _mod97(x)
    if kind == "ssn":
        return ~x.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    return F.lit(True)


def folded(items: Column, state: Column, step, kind: str) -> Column:
    """struct<at, out>: a left fold's last state, and what its steps give, in order. ``step(at, item)``: (next at, out of type ``kind``).

    An array that grows by one item costs its length each time, so it grows within chunks, and chunks are put together."""
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def inner(a: Column, x: Column) -> Column:
        at, out = step(a["at"], x)
        return F.struct(at.alias("at"), F.array_append(a["out"], out).alias("out"))

    def outer(a: Column, chunk: Column) -> Column:
        got = F.aggregate(chunk, F.struct(a["at"].alias("at"), none.alias("out")), inner)
        return _let(got, lambda g: F.struct(g["at"].alias("at"), F.array_append(a["out"], g["out"]).alias("out")))

    def every(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(FOLD)), lambda i: F.slice(xs, i, F.lit(FOLD)))
        return F.aggregate(chunks, F.struct(state.alias("at"), nones.alias("out")), outer)

    return _let(_let(items, every), lambda e: F.struct(e["at"].alias("at"), F.flatten(e["out"]).alias("out")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, bound as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<start, k, end, score>> of one kind; k: the kind's place in KINDS."""
    hits = lambda x: F.transform(x["hits"], lambda h, i: F.struct(F.length(F.get(x["gaps"], i)).alias("gap"), F.length(h).alias("size"), h.alias("hit"), i.alias("i")))

    def located(x: Column) -> Column:
        step = lambda at, h: (at + h["gap"] + h["size"], F.struct((at + h["gap"]).alias("start"), (at + h["gap"] + h["size"]).alias("end"), h["hit"].alias("hit"), h["i"].alias("i")))
        return folded(hits(x), F.lit(0), step, "struct<start:int,end:int,hit:string,i:int>")["out"]

    def tails(x: Column) -> Column:
        """The last code points of each hit with the gap behind it: twelve of them hold all that is near a span."""
        return F.transform(x["gaps"], lambda g, i: F.substring(F.concat(F.coalesce(F.get(x["hits"], i - 1), F.lit("")), g), -NEAR, NEAR))

    def scored(tail: Column, s: Column) -> Column:
        before = F.lower(F.substring(F.array_join(F.slice(tail, F.greatest(s["i"] - 10, F.lit(1)), F.least(s["i"] + 1, F.lit(12))), ""), -NEAR, NEAR))
        says = lambda words, by: F.when(before.rlike(rf"\b(?:{words})"), by).otherwise(0.0)
        score = F.lit(SCORE[kind]) + says(CONTEXT[kind], BOOST) - says(AGAINST[kind], BOOST)
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end"), F.round(score, 2).alias("score"))

    def kept(x: Column) -> Column:
        valid = F.filter(located(x), lambda s: _valid(kind, s["hit"]))
        good = _let(tails(x), lambda tail: F.transform(valid, lambda s: scored(tail, s)))
        return good if kind in BASE_KINDS else F.filter(good, lambda s: s["score"] >= LEAST)

    # both arrays are bound once
    found = F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hits"))
    none = F.array().cast("array<struct<start:int,k:int,end:int,score:double>>")
    bound = _let(found, lambda x: F.when(F.size(x["hits"]) > 0, kept(x)).otherwise(none))
    return F.when(GUARDS[kind](text), bound).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the array of all spans, sorted by start, then kind; and that column's name."""
    col = fresh(docs, "_pii_spans")
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(col, F.sort_array(F.concat(*[spans_of(t, k) for k in KINDS]))), col


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by <KIND>; of overlapping spans the first start wins."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def done(x: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            """Code points a to b, from the slices that hold them."""
            low, high = F.floor(a / SLICE).cast("int"), F.floor(b / SLICE).cast("int")
            part = lambda i, at, n: F.substring(F.coalesce(F.get(x["slices"], i), F.lit("")), at, n)
            whole = F.array_join(F.slice(x["slices"], low + 2, F.greatest(high - low - 1, F.lit(0))), "")
            return F.when(low == high, part(low, a % SLICE + 1, b - a)).otherwise(F.concat(part(low, a % SLICE + 1, F.lit(SLICE)), whole, part(high, F.lit(1), b % SLICE)))

        def step(at: Column, s: Column) -> tuple[Column, Column]:
            on = s["start"] >= at
            return F.when(on, s["end"]).otherwise(at), F.when(on, F.concat(cut(at, s["start"]), F.element_at(names, s["k"] + 1))).otherwise(F.lit(""))

        return _let(folded(x["spans"], F.lit(0), step, "string"), lambda f: F.concat(F.array_join(f["out"], ""), cut(f["at"], F.length(text))))

    bound = F.struct(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{SLICE}}}"), F.lit(0)).alias("slices"), spans.alias("spans"))
    return F.when(F.size(spans) > 0, _let(bound, done)).otherwise(text)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, col = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(col, lambda s: s["k"] < len(BASE_KINDS))
    count = lambda i: F.size(F.filter(col, lambda s: s["k"] == i)).cast("long")
    return df.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col(col)).alias("spans"), F.array_join(F.transform(col, lambda s: s["score"].cast("string")), ",").alias("scores"))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; the columns of ``docs``. Null and empty texts stay as they are, repeated rows each stay."""
    df, col = with_spans(docs)
    return df.withColumn("text", redacted(F.col("text"), F.col(col))).select(*docs.columns)
