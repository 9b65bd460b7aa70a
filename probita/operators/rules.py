"""Anomaly rules over the wide feature row: each rule is a row expression, so scoring needs no further shuffle.

Rules give hits (struct of seq, rule, category, severity, confidence, score); a declaration's hits are one array, which
can be exploded to a relation. Scores are statistical signals for human review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.values import bounded, dbl, number_label, points, rounded, times_label
from .features import ID

HIT = "struct<seq:int,rule:string,category:string,severity:string,confidence:double,score:double>"


def c(name: str) -> Column:
    return F.col(name)


# The six rules of the legacy composite: each gives a score in [0, 1] or null where it doesn't trigger.


def unexplained_wealth(assets: Column, income: Column, limit: float = 3.0) -> Column:
    r = dbl(assets) / dbl(income)
    return F.when(assets.isNull() | income.isNull(), None).when(income <= 0, F.when(assets > 0, F.lit(1.0))).when(r > limit, rounded(F.least(F.lit(1.0), (r - limit) / limit), 3))


def cash_to_bank(cash: Column, bank: Column, limit: float = 0.8) -> Column:
    total = F.coalesce(cash, F.lit(0)) + F.coalesce(bank, F.lit(0))
    r = dbl(F.coalesce(cash, F.lit(0))) / dbl(total)
    return F.when(total > 0, F.when(r > limit, rounded(F.least(F.lit(1.0), (r - limit) / (1 - limit)), 3)))


def unknown_frequency(fields: Column, unknown: Column, limit: float = 0.5, least: int = 4) -> Column:
    r = dbl(unknown) / fields
    return F.when(fields >= least, F.when(r > limit, rounded(F.least(F.lit(1.0), (r - limit) / (1 - limit)), 3)))


def acquisition_mismatch(largest: Column, income: Column, limit: float = 1.5) -> Column:
    return unexplained_wealth(largest, income, limit)


def zero_income(income: Column, assets: Column, least: float = 100_000.0) -> Column:
    return F.when((income <= 0) & (assets >= least), rounded(F.least(F.lit(1.0), dbl(assets) / 1e6), 3))


def family_concentration(total: Column, family: Column, limit: float = 0.7, least: int = 3) -> Column:
    r = dbl(family) / total
    return F.when(total >= least, F.when(r > limit, rounded(F.least(F.lit(1.0), (r - limit) / (1 - limit)), 3)))


def legacy(df: DataFrame) -> DataFrame:
    """The composite used when a declaration's rows are not at hand: six scores (0 where untriggered) and the total."""
    six = {
        "unexplained_wealth": unexplained_wealth(c("total_assets"), c("total_income")), "cash_to_bank_ratio": cash_to_bank(c("cash"), c("bank")),
        "unknown_value_frequency": unknown_frequency(c("fields"), c("unknown_fields")), "acquisition_income_mismatch": acquisition_mismatch(c("largest_acquisition"), c("total_income")),
        "zero_income_with_assets": zero_income(c("total_income"), c("total_assets")), "family_asset_concentration": family_concentration(c("own_total"), c("own_family")),
    }
    df = df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in six.items()})
    raw = sum((c(k) for k in six), F.lit(0.0))
    return df.withColumn("raw_total", rounded(raw, 3)).withColumn("legacy_score", bounded(raw))


def _hit(seq: int, rule: str, category: str, severity: str, base: float, confidence: float) -> Column:
    return _scored(seq, rule, category, severity, confidence, F.lit(points(base, severity, confidence)))


def _scored(seq: int, rule: str, category: str, severity: str, confidence: float, score: Column) -> Column:
    return F.struct(F.lit(seq).alias("seq"), F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(float(confidence)).alias("confidence"), score.alias("score")).cast(HIT)


def conditions() -> list[tuple[int, str, str, float, float, list[tuple[str, Column]]]]:
    """(seq, rule, category, base, confidence, [(severity, condition), ...]): the first condition that holds decides."""
    income, cash = c("total_income"), c("cash")
    cash_ratio = F.when((income >= 10_000), dbl(cash) / dbl(income))
    fx_share = F.when(c("stem_cash") > 0, dbl(c("fx_cash")) / dbl(c("stem_cash"))).otherwise(0.0)
    fx_income = F.when((income > 0) & (c("stem_cash") > 0), dbl(c("fx_cash")) / dbl(income))
    per_adult = dbl(c("n_vehicles")) / (1 + c("n_adult_family"))
    agri = (c("land_area") >= 100_000) | (c("n_machines") > 0)
    rentable = c("n_trade") + c("n_city_flats")
    corruption, quality, opacity = "corruption", "data_quality", "opacity"
    return [
        (1, "TQ1", quality, 1, 1.0, [("LOW", c("re_bad_dates") + c("vh_bad_dates") > 0)]),
        (2, "TQ2", quality, 1, 1.0, [("LOW", c("re_orphans") + c("inc_orphans") + c("mon_orphans") > 0)]),
        (3, "TQ3", quality, 1, 0.8, [("LOW", c("n_share_issues") > 0)]),
        (4, "TQ4", quality, 1, 1.0, [("LOW", c("inc_bad") + c("mon_bad") + c("re_bad") > 0)]),
        (5, "TQ5", quality, 1, 0.6, [("LOW", c("estate_na") & F.lower(F.trim("country")).isin(*fixed.HOME_COUNTRIES) & (c("n_positive_incomes") > 0))]),
        (7, "CR1", corruption, 5, 1.0, [("EXTREME", cash_ratio >= 10), ("HIGH", cash_ratio >= 5), ("MEDIUM", cash_ratio >= 3)]),
        (8, "CR2", corruption, 4, 1.0, [("HIGH", (fx_share >= 0.7) & (fx_income >= 3)), ("MEDIUM", (fx_share >= 0.5) & (fx_income >= 1.5))]),
        (9, "CR3", corruption, 5, 0.9, _acquisition()),
        (10, "CR4", corruption, 4, 0.9, [("HIGH", (income < 150_000) & (c("re_mid_high") + c("vh_mid_high") >= 2))]),
        (11, "CR6", corruption, 3, 0.8, [("HIGH", c("home_area") > 400), ("MEDIUM", c("home_area") > 250)]),
        (12, "CR6", corruption, 3, 0.8, [("HIGH", c("land_area") > 500_000), ("MEDIUM", c("land_area") > 100_000)]),
        (13, "CR7", corruption, 3, 0.9, [("HIGH", (c("n_luxury") >= 2) & (income < 1_000_000)), ("MEDIUM", (c("n_luxury") >= 1) & (income < 600_000))]),
        (14, "CR7", corruption, 3, 0.8, [("HIGH", per_adult >= 3.5), ("MEDIUM", (income < 500_000) & (per_adult >= 2.5))]),
        (15, "CR8", corruption, 3, 0.8, [("HIGH", agri & (c("agri_income") == 0) & (c("land_area") >= 500_000)), ("MEDIUM", agri & (c("agri_income") == 0))]),
        (16, "CR9", corruption, 3, 0.7, [("HIGH", (rentable >= 3) & (c("rent_income") < 30_000)), ("MEDIUM", (rentable > 0) & (c("rent_income") < 30_000))]),
        (17, "CR10", opacity, 4, 0.9, [("HIGH", (c("n_hidden_major") >= 2) | (c("largest_hidden") & (c("n_hidden_major") >= 1))), ("MEDIUM", c("n_hidden_major") >= 1)]),
        (18, "CR11", corruption, 5, 0.8, [("HIGH", c("proxy"))]),
        (19, "CR12", corruption, 3, 0.7, [("HIGH", c("kin_ratio") >= 5), ("MEDIUM", c("kin_ratio") >= 2)]),
        (20, "CR13", opacity, 5, 1.0, [("HIGH", c("re_no_info") + c("mon_no_info") >= 3)]),
    ]


#: The features that these conditions and the cohorts' compare, and those that they are derived from; by parts.
COMPARED = {
    "incomes": "total_income n_incomes inc_conf inc_orphans inc_bad n_positive_incomes one_off agri_income rent_income",
    "monetary": "cash bank monetary_uah stem_cash fx_cash n_monetary mon_conf mon_orphans mon_bad mon_no_info",
    "real_estate": "estate_cost n_estate re_conf re_bad_dates re_orphans re_bad re_acquired re_mid_high home_area land_area n_trade n_city_flats n_hidden_major largest_hidden re_no_info",
    "vehicles": "n_vehicles vh_acquired vh_mid_high n_luxury n_machines vh_bad_dates", "family": "n_adult_family", "shares": "n_share_issues", "kin": "proxy kin_ratio",
    "": "total_assets cash_ratio confidential_ratio",
}


def _acquisition() -> list[tuple[str, Column]]:
    """CR3: the largest same-year acquisition against income; matching one-off income takes a level off (not below MEDIUM)."""
    cost = F.greatest("re_acquired", "vh_acquired")
    r = F.when(c("total_income") > 0, dbl(cost) / dbl(c("total_income")))
    eased = dbl(c("one_off")) >= dbl(cost) * 0.6
    return [("EXTREME", (r >= 7) & ~eased), ("HIGH", ((r >= 7) & eased) | ((r >= 3) & ~eased)), ("MEDIUM", r >= 2)]


def cohort_conditions() -> list[tuple[int, str, str, float, float, list[tuple[str, Column]]]]:
    """D21 to D24, from the cohort's cut values (see ``cohorts.cuts``), null where a cohort is missing or has under five values."""
    cash_to_income = F.when(c("total_income") > 0, dbl(c("cash")) / dbl(c("total_income"))).when(c("cash").isNotNull(), 0.0)
    fx_share = F.when(c("stem_cash") > 0, dbl(c("fx_cash")) / dbl(c("stem_cash"))).otherwise(0.0)
    dense = (c("conf_median") > 0) & (c("confidential_ratio") > 2 * c("conf_median"))
    return [
        (21, "CR16", "corruption", 3, 0.8, [("MEDIUM", dbl(c("total_income")) >= c("income_p99"))]),
        (22, "CR16", "corruption", 3, 0.8, [("HIGH", dbl(c("total_assets")) >= c("assets_p99")), ("MEDIUM", dbl(c("total_assets")) >= c("assets_p95"))]),
        (23, "CR16", "corruption", 3, 0.8, [("HIGH", (cash_to_income >= c("cash_p99")) & (fx_share >= 0.5))]),
        (24, "BR3", "opacity", 1, 0.7, [("MEDIUM", dense & (c("confidential_ratio") > 3 * c("conf_median"))), ("LOW", dense)]),
    ]


def hits(rules: list, extra: list[tuple[int, Column]] | None = None) -> Column:
    """Array of hits in rule order; ``extra``: (seq, hit or null).

    Arrays of at most one hit put together: generated code throughout, where a filter over one array would evaluate all conditions expression by expression."""
    none = F.array().cast(f"array<{HIT}>")
    every = [(seq, F.when(hit.isNotNull(), F.array(hit)).otherwise(none)) for seq, hit in extra or []]
    for seq, rule, category, base, confidence, ways in rules:
        col = F.when(F.lit(False), none)
        for severity, cond in ways:
            col = col.when(F.coalesce(cond, F.lit(False)), F.array(_hit(seq, rule, category, severity, base, confidence)))
        every.append((seq, col.otherwise(none)))
    return F.concat(*[found for _, found in sorted(every, key=lambda x: x[0])])


def cash_hit() -> Column:
    """The legacy cash rule as a hit; a share so close to the limit that its score rounds to zero is none."""
    cash = cash_to_bank(c("cash"), c("bank"))
    return F.when(cash > 0, _scored(6, "cash_to_bank_ratio", "corruption", "MEDIUM", 1.0, cash))


def declaration_hits(df: DataFrame, with_cohort: bool = False) -> DataFrame:
    return df.withColumn("hits", hits(conditions() + (cohort_conditions() if with_cohort else []), [(6, cash_hit())]))


def with_peers_hits(df: DataFrame) -> DataFrame:
    """``hits`` of the declarations alone (see :func:`declaration_hits`) and, after them, those against the cohorts' cut values."""
    return df.withColumn("hits", F.concat("hits", hits(cohort_conditions())))


def _total(category: str) -> Column:
    return F.aggregate(F.filter("hits", lambda h: h["category"] == category), F.lit(0.0), lambda a, h: a + h["score"])


def scored(df: DataFrame) -> DataFrame:
    """Sub-scores, raw and bounded totals, and the triggered rules, from ``hits``."""
    df = df.withColumn("rules", F.array_distinct(F.transform("hits", lambda h: h["rule"])))
    df = df.withColumns({"corruption": _total("corruption"), "opacity_all": _total("opacity"), "quality": F.least(F.lit(2.0), _total("data_quality"))})
    both = lambda a, b: F.when(F.array_contains("rules", a) & F.array_contains("rules", b), 3.0).otherwise(0.0)
    df = df.withColumn("opacity", F.when((c("corruption") <= 0) & (c("opacity_all") > 0), F.least("opacity_all", 0.25 * c("corruption"))).otherwise(c("opacity_all")))
    raw = c("corruption") + 0.5 * c("opacity") + 0.1 * c("quality") + both("CR1", "CR2") + both("CR10", "CR13")
    return df.withColumn("raw", raw).withColumns({
        "total_score": bounded(c("raw")), "raw_total_score": rounded(c("raw"), 3), "corruption_risk_score": rounded(c("corruption"), 3),
        "opacity_evasion_score": rounded(c("opacity"), 3), "data_quality_score": rounded(c("quality"), 3),
    }).drop("opacity_all", "raw", "corruption", "opacity", "quality")


#: Rule -> the figures that it compares, by label.
FIGURES = {
    "TQ1": {"bad dates": lambda: c("re_bad_dates") + c("vh_bad_dates")}, "TQ2": {"orphans": lambda: c("re_orphans") + c("inc_orphans") + c("mon_orphans")}, "TQ3": {"properties": lambda: c("n_share_issues")},
    "TQ4": {"numbers": lambda: c("inc_bad") + c("mon_bad") + c("re_bad")}, "TQ5": {"positive incomes": lambda: c("n_positive_incomes")}, "cash_to_bank_ratio": {"cash": lambda: c("cash"), "bank": lambda: c("bank")},
    "CR1": {"cash": lambda: c("cash"), "income": lambda: c("total_income")}, "CR2": {"foreign cash": lambda: c("fx_cash"), "income": lambda: c("total_income")},
    "CR3": {"acquired": lambda: F.greatest("re_acquired", "vh_acquired"), "income": lambda: c("total_income")}, "CR4": {"purchases": lambda: c("re_mid_high") + c("vh_mid_high"), "income": lambda: c("total_income")},
    "CR6": {"home area": lambda: c("home_area"), "land area": lambda: c("land_area")}, "CR7": {"vehicles": lambda: c("n_vehicles"), "luxury": lambda: c("n_luxury"), "income": lambda: c("total_income")},
    "CR8": {"land area": lambda: c("land_area"), "machines": lambda: c("n_machines")}, "CR9": {"rentable": lambda: c("n_trade") + c("n_city_flats"), "rent income": lambda: c("rent_income")},
    "CR10": {"hidden": lambda: c("n_hidden_major")}, "CR11": {}, "CR12": {"times the declarant's": lambda: times_label(c("kin_ratio")), "held by": lambda: c("kin_person")}, "CR13": {"fields": lambda: c("re_no_info") + c("mon_no_info")},
    "CR16": {"income": lambda: c("total_income"), "assets": lambda: c("total_assets")}, "BR3": {"confidential fields": lambda: c("inc_conf") + c("mon_conf") + c("re_conf")},
}


#: Labels of figures that are texts already.
TEXTS = ("times the declarant's", "held by")


def titles() -> Column:
    return F.create_map(*[F.lit(x) for kv in fixed.RULE_TITLES.items() for x in kv])


def line(rule: Column) -> Column:
    """``title (label figure, ...)`` of a rule, from the wide row; a figure that is missing shows as n/a."""
    shown = {k: F.concat_ws(", ", *[F.concat(F.lit(f"{label} "), F.coalesce(f() if label in TEXTS else number_label(f()), F.lit("n/a"))) for label, f in v.items()]) for k, v in FIGURES.items()}
    text = F.lit("")
    for k, v in shown.items():  # a chain of cases: only the figures of the rule in question are put together
        text = F.when(rule == k, v).otherwise(text)
    return F.concat(F.coalesce(F.try_element_at(titles(), rule), rule), F.when(text != "", F.concat(F.lit(" ("), text, F.lit(")"))).otherwise(F.lit("")))


NOTHING = "No anomalies detected by the rules."


def explanation(hit_rules: Column) -> Column:
    """A line for each rule that fired, with its figures; rows as :func:`scored` gives them."""
    lines = F.array_join(F.transform(hit_rules, lambda r: F.concat(F.lit("- "), r, F.lit(": "), line(r))), "\n")
    return F.when(F.size(hit_rules) > 0, lines).otherwise(F.lit(NOTHING))


def details_json(hits_: Column) -> Column:
    """The hits as JSON text, as a scores table keeps them."""
    return F.to_json(hits_)


def details(text: Column) -> Column:
    """JSON text of hits -> array; null or unreadable text: none."""
    return F.coalesce(F.from_json(text, f"array<{HIT}>"), F.array().cast(f"array<{HIT}>"))


def label_table(df: DataFrame) -> DataFrame:
    """(rule, title, logic, n): every rule with its texts and how many rows of ``df`` (as :func:`scored` gives them) it fired for."""
    logic = F.create_map(*[F.lit(x) for kv in fixed.RULE_LOGIC.items() for x in kv])
    hit = F.map_from_entries(F.transform("rules", lambda r: F.struct(r, F.lit(1))))
    per = df.agg(*[F.coalesce(F.sum(F.try_element_at(hit, F.lit(rule))), F.lit(0)).alias(rule) for rule in fixed.RULE_TITLES])
    each = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("n")) for rule in fixed.RULE_TITLES]))
    return per.select(each.alias("x")).select("x.rule", F.element_at(titles(), F.col("x.rule")).alias("title"), F.element_at(logic, F.col("x.rule")).alias("logic"), "x.n")
