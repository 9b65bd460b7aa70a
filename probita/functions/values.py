"""Column functions: placeholders, numbers, currencies, years, points and labels. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

MONEY = "decimal(24,4)"


def stripped(x: Column) -> Column:
    """Without any Unicode white space at the ends (``trim`` keeps no-break spaces)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def placeholder_status(x: Column) -> Column:
    """Status of a placeholder text; any other bracketed text is ``redacted_other``; else null. No trimming."""
    known = reduce(lambda c, kv: c.when(x == kv[0], F.lit(kv[1])), list(fixed.PLACEHOLDERS.items())[1:], F.when(x == next(iter(fixed.PLACEHOLDERS)), F.lit(next(iter(fixed.PLACEHOLDERS.values())))))
    return known.when(x.rlike(r"^\[.+\]$"), F.lit("redacted_other"))


def is_placeholder(x: Column) -> Column:
    return x.isin(*fixed.PLACEHOLDERS)


def extended_status(x: Column) -> Column:
    code = x.try_cast("int")
    return reduce(lambda c, kv: c.when(code == kv[0], F.lit(kv[1])), fixed.EXTENDED.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def number_text(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stripped(x), " ", ""), ",", ".")


def safe_number(x: Column, kind: str = "decimal(38,10)") -> Column:
    """struct<value, raw, status> of a text: null or empty gives nulls, a placeholder its status, an unreadable one ``parse_error``."""
    status = placeholder_status(x)
    value = F.when(status.isNull() & number_text(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), number_text(x).try_cast(kind))
    none = x.isNull() | (x == "")
    return F.struct(
        F.when(~none, value).alias("value"),
        F.when(~none, x).alias("raw"),
        F.when(none, None).when(status.isNotNull(), status).when(value.isNull(), F.lit("parse_error")).alias("status"),
    )


def contains_any(x: Column, stems) -> Column:
    """Whether the lower-cased text holds any of ``stems``; null: no."""
    return holds_any(lowered(x), stems)


def lowered(x: Column) -> Column:
    """In lower case, null as empty: a column to select first where several sets of stems are looked for."""
    return F.lower(F.coalesce(x, F.lit("")))


def holds_any(low: Column, stems) -> Column:
    """:func:`contains_any` of a text that is lower-cased already."""
    return reduce(lambda a, b: a | b, [low.contains(s) for s in stems])


def currency_code(x: Column) -> Column:
    """A leading code of three capitals, else the code of the first known stem, else null."""
    lead = F.nullif(F.regexp_extract(stripped(x), r"^([A-Z]{3})\b", 1), F.lit(""))
    named = reduce(lambda c, kv: c.when(F.lower(x).contains(kv[0]), F.lit(kv[1])), fixed.CURRENCY_STEMS[1:], F.when(F.lower(x).contains(fixed.CURRENCY_STEMS[0][0]), F.lit(fixed.CURRENCY_STEMS[0][1])))
    return F.coalesce(lead, named)


def rate(code: Column) -> Column:
    table = F.create_map(*[F.lit(v) if i % 2 == 0 else F.lit(v).cast("decimal(6,2)") for kv in fixed.RATES.items() for i, v in enumerate(kv)])
    return F.coalesce(F.try_element_at(table, F.upper(F.coalesce(code, F.lit("UAH")))), F.lit("1").cast("decimal(6,2)"))


def to_uah(amount: Column, code: Column) -> Column:
    """At fixed rates; a missing or unknown currency leaves the amount as it is."""
    return amount.cast(MONEY) * rate(code)


def year_in(x: Column) -> Column:
    """The first 19xx or 20xx anywhere in the text, else null."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"(19[0-9]{2}|20[0-9]{2})", 1).try_cast("int")


def rounded(x: Column, n: int) -> Column:
    """Half up on doubles, the same in any engine."""
    return F.floor(x * 10**n + 0.5).cast("double") / F.lit(float(10**n))


def dbl(x: Column) -> Column:
    return x.cast("double")


def growth(now: Column, before: Column) -> Column:
    return F.when(before > 0, (dbl(now) - dbl(before)) / dbl(before))


def ratio(now: Column, before: Column) -> Column:
    return F.when(before != 0, dbl(now) / dbl(before))


def asset_income_ratio(assets: Column, income: Column) -> Column:
    a, i = dbl(assets), dbl(income)
    return F.when(a.isNull() | i.isNull(), None).when(i <= 0, F.when(a > 0, F.lit(1000.0))).otherwise(F.least(rounded(a / i, 2), F.lit(1000.0)))


def points(base: float, severity: str, confidence: float) -> float:
    return int(base * fixed.SEVERITY.get(severity, 1.0) * confidence * 1000 + 0.5) / 1000


def bounded(raw: Column) -> Column:
    """A raw total on the scale of 0 to 100."""
    return F.when(raw > 0, rounded(100 * (1 - F.exp(-raw / 12)), 2)).otherwise(F.lit(0.0))


def owner_bucket(owner: Column) -> Column:
    return F.when(owner.isNull() | owner.startswith("unknown:"), "unknown").when(owner == "declarant", "declarant").when(owner == "third_party", "third_party").otherwise("family")


def resolved_owner(raw: Column, label: Column) -> Column:
    return F.coalesce(label, F.when(raw == "j", F.lit("third_party")), F.concat(F.lit("unknown:"), F.coalesce(raw, F.lit(""))))


def one_decimal(area: Column) -> Column:
    return F.bround(area, 1).cast("decimal(30,1)").cast("string")


def _low(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(""))))


def estate_fingerprint(kind: Column, city: Column, district: Column, area: Column) -> Column:
    return F.concat_ws("|", F.lit("re"), _low(kind), _low(city), _low(district), F.coalesce(one_decimal(area), F.lit("")))


def vehicle_fingerprint(brand: Column, model: Column, year: Column, owner: Column) -> Column:
    return F.concat_ws("|", F.lit("vh"), _low(brand), _low(model), F.coalesce(year.cast("string"), F.lit("")), _low(owner))


def display_name(last: Column, first: Column, middle: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (last, first, middle)]), F.lit("")), F.lit("Unknown Official"))


def score_band(score: Column) -> Column:
    s = F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))
    return F.when(s <= 0, "None").when(s < 20, "Low").when(s < 40, "Moderate").when(s < 70, "High").otherwise("Critical")


def type_label(x: Column) -> Column:
    return reduce(lambda c, kv: c.when(x == kv[0], F.lit(kv[1])), list(fixed.TYPE_LABELS.items())[1:], F.when(x == 1, F.lit("Annual"))).otherwise("Other")


def percent_label(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def magnitude_label(x: Column) -> Column:
    return F.when(x >= 1e6, F.format_string("%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("%.0fK", x / 1e3)).otherwise(F.format_string("%.0f", x))


def display_field(value: Column, status: Column) -> Column:
    return F.coalesce(value, F.concat(F.lit("["), status, F.lit("]")))


def location(city: Column, district: Column, region: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(x, F.lit("")) for x in (city, district, region)])


def number_label(x: Column) -> Column:
    """Thousands separators, no decimals, half to even; null stays null."""
    return F.format_number(dbl(x), 0)


def times_label(x: Column) -> Column:
    """One decimal and an x; null stays null."""
    return F.when(x.isNotNull(), F.format_string("%.1fx", dbl(x)))


def loose_number(x: Column) -> Column:
    return F.coalesce(F.format_number(number_text(x).try_cast("decimal(38,10)"), 0), x)


def rules_text(x: Column) -> Column:
    """Comma-joined rule names -> array without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda e: F.trim(e)), lambda e: e != "")
