"""Yearly snapshots, changes between consecutive annual declarations, and the nine timeline rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed
from ..functions.values import MONEY, bounded, dbl, estate_fingerprint, growth, number_label, ratio, rounded, times_label, vehicle_fingerprint
from .features import ID
from .tables import Tables

MAJOR = 1_000_000


def major_assets(t: Tables) -> DataFrame:
    """(declaration_id, fingerprint, value): assets of a million or more, the largest value of each fingerprint."""
    estate = t.real_estate.select(ID, F.col("cost_assessment").cast(MONEY).alias("value"), estate_fingerprint(F.col("object_type"), F.col("city"), F.col("district"), F.col("total_area")).alias("fingerprint"))
    vehicle = t.vehicles.select(ID, F.col("cost_date").cast(MONEY).alias("value"), vehicle_fingerprint(F.col("brand"), F.col("model"), F.col("graduation_year"), F.col("right_belongs_resolved")).alias("fingerprint"))
    return estate.unionByName(vehicle).filter(F.col("value") >= MAJOR).groupBy(ID, "fingerprint").agg(F.max("value").alias("value"))


def filings(df: DataFrame, t: Tables, holdings: bool = True, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row per declaration of a person, with what snapshots are made of, and ``more``. Without ``holdings`` major assets are left out."""
    zero = lambda x: F.nullif(F.col(x), F.lit(0))  # noqa: E731  display values: zero counts as missing
    cash, bank = zero("cash"), zero("bank")
    monetary = F.when(cash.isNotNull() | bank.isNotNull(), F.coalesce(cash, F.lit(0)) + F.coalesce(bank, F.lit(0))).otherwise(F.col("monetary_raw"))
    estate = F.when(F.col("estate_cost") > 0, F.col("estate_cost"))
    owned = major_assets(t).groupBy(ID).agg(F.map_from_entries(F.collect_list(F.struct("fingerprint", "value"))).alias("major_assets"))
    rows = df.filter(F.col("user_declarant_id").isNotNull())
    return (rows.join(owned.hint("merge"), ID, "left") if holdings else rows).select(
        ID, "user_declarant_id", F.coalesce("declaration_year", F.lit(0)).alias("year"), F.coalesce(zero("declaration_type"), F.lit(1)).alias("type"),
        dbl(zero("total_income")).alias("income"), dbl(cash).alias("cash"), dbl(bank).alias("bank"), dbl(monetary).alias("monetary"), dbl(estate).alias("estate"),
        dbl(F.when(estate.isNotNull(), F.coalesce(monetary, F.lit(0)) + estate).otherwise(monetary)).alias("assets"),
        "n_incomes", "n_monetary", "n_estate", "n_vehicles", "unknown_share", F.coalesce("work_post", F.lit("")).alias("role"), F.coalesce("work_place", F.lit("")).alias("institution"),
        *([F.coalesce("major_assets", F.create_map().cast("map<string,decimal(24,4)>")).alias("major_assets")] if holdings else []), dbl(F.col("one_off_timeline")).alias("one_off"), *more,
    )


def chosen(rows: DataFrame) -> DataFrame:
    """Of a person's several declarations of a year the one with the most income rows, the first on ties."""
    first = W.partitionBy("user_declarant_id", "year").orderBy(F.desc("n_incomes"), ID)
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def snapshots(df: DataFrame, t: Tables, holdings: bool = True) -> DataFrame:
    """One row per person and year, see :func:`chosen`."""
    return chosen(filings(df, t, holdings))


def state() -> Column:
    """What a change compares."""
    return F.struct("year", "income", "cash", "monetary", "assets", "unknown_share", "role", "major_assets")


def changes(snaps: DataFrame) -> DataFrame:
    """One row per annual declaration that has an earlier annual one (gaps in the years are allowed)."""
    w = W.partitionBy("user_declarant_id").orderBy("year")
    return compared(snaps.filter("type = 1").withColumn("p", F.lag(state()).over(w)).filter(F.col("p").isNotNull()))


def compared(both: DataFrame, *more: str) -> DataFrame:
    """Snapshots with the state ``p`` before them -> the changes between, and the columns ``more``."""
    gone = lambda a, b: F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"]))
    worth = lambda es: F.coalesce(F.array_max(F.transform(es, lambda e: dbl(e["value"]))), F.lit(0.0))
    low = lambda x: F.lower(F.trim(x))
    appeared, left = gone(F.col("major_assets"), F.col("p.major_assets")), gone(F.col("p.major_assets"), F.col("major_assets"))
    rows = both.withColumns({"appeared": appeared, "left_": left})
    return rows.select(
        "user_declarant_id", F.col("p.year").alias("from_year"), F.col("year").alias("to_year"), F.col("p.income").alias("income_before"), F.col("income").alias("income_now"),
        (F.col("income") - F.col("p.income")).alias("income_delta"), ratio(F.col("income"), F.col("p.income")).alias("income_ratio"), growth(F.col("income"), F.col("p.income")).alias("income_growth"),
        F.col("p.monetary").alias("monetary_before"), F.col("monetary").alias("monetary_now"), (F.col("monetary") - F.col("p.monetary")).alias("monetary_delta"), ratio(F.col("monetary"), F.col("p.monetary")).alias("monetary_ratio"),
        (F.col("cash") - F.col("p.cash")).alias("cash_delta"), growth(F.col("assets"), F.col("p.assets")).alias("asset_growth"),
        (F.col("unknown_share") - F.col("p.unknown_share")).alias("share_delta"), F.col("unknown_share").alias("share_now"),
        ((low(F.col("role")) != low(F.col("p.role"))) & (low(F.col("role")) != "") & (low(F.col("p.role")) != "")).alias("role_changed"),
        F.size("appeared").alias("n_appeared"), F.size("left_").alias("n_left"), worth(F.col("appeared")).alias("max_appeared"), worth(F.col("left_")).alias("max_left"), "one_off", *more,
    )


def _c(x: str) -> Column:
    return F.col(x)


def _over(r: Column, limit: float) -> Column:
    return F.when(r > limit, F.least(F.lit(1.0), (r - limit) / limit))


#: Rule -> (category, score of one change).
CHANGE_RULES = {
    "yoy_income_change": ("corruption", lambda: F.when((_c("income_before") <= 0) & (_c("income_now") > 0), F.lit(0.5)).otherwise(F.coalesce(_over(_c("income_ratio"), 3.0), F.when(_c("income_ratio") < 0.25, F.least(F.lit(1.0), (0.25 - _c("income_ratio")) / 0.25))))),
    "yoy_asset_growth": ("corruption", lambda: F.when(_c("monetary_delta") > 0, F.when(_c("income_before") > 0, _over(_c("monetary_delta") / _c("income_before"), 3.0)).when(_c("monetary_before") > 0, _over(_c("monetary_now") / _c("monetary_before"), 3.0)))),
    "foreign_cash_jump": ("corruption", lambda: F.when(_c("cash_delta") > 200_000, F.least(F.lit(1.0), _c("cash_delta") / 1e6))),
    "CR5": ("corruption", lambda: F.when((_c("asset_growth") >= 0.5) & (_c("income_growth").isNull() | (_c("income_growth") <= 0.1)), F.lit(6.75)).when((_c("asset_growth") >= 0.2) & (_c("income_growth") <= 0), F.lit(4.0))),
    "BR2": ("opacity", lambda: F.when((_c("share_delta") >= 0.3) & (_c("share_now") >= 0.5), F.lit(1.8))),
    "BR4": ("corruption", lambda: F.when(_c("role_changed"), F.when(_c("asset_growth") >= 1, F.lit(2.4)).when(_c("asset_growth") >= 0.5, F.lit(1.4)))),
    "CR14": ("corruption", lambda: F.when((_c("n_appeared") > 0) & (_c("max_appeared") >= MAJOR) & (_c("one_off") < 0.5 * _c("max_appeared")), F.lit(6.0)).when((_c("n_left") > 0) & (_c("max_left") >= MAJOR) & (_c("one_off") < 300_000), F.when(_c("n_left") >= 2, F.lit(5.25)).otherwise(F.lit(3.5)))),
}
ORDER = ("yoy_income_change", "yoy_asset_growth", "foreign_cash_jump", "CR5", "BR2", "BR4", "CR14", "BR1", "CR15")


def change_scores(ch: DataFrame) -> DataFrame:
    """``changes`` with the score of each rule, 0 where it doesn't trigger."""
    return ch.withColumns({k: F.coalesce(rounded(f(), 3), F.lit(0.0)) for k, (_, f) in CHANGE_RULES.items()})


def three_year(snaps: DataFrame) -> DataFrame:
    """(user_declarant_id, estate_ratio): the largest end real estate over the mean of three consecutive positive incomes."""
    w = W.partitionBy("user_declarant_id").orderBy("year").rowsBetween(-2, 0)
    rows = snaps.withColumns({"mean": F.avg("income").over(w), "n": F.count_if(F.col("income") > 0).over(w)})
    return rows.filter("n = 3").groupBy("user_declarant_id").agg(F.max(F.col("estate") / F.col("mean")).alias("estate_ratio"))


def per_year(df: DataFrame) -> DataFrame:
    """(user_declarant_id, max_declarations, worst_year, n_declarations); of years with the most the earliest."""
    rows = df.filter(F.col("user_declarant_id").isNotNull() & F.col("declaration_year").isNotNull()).groupBy("user_declarant_id", "declaration_year").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("user_declarant_id").agg(F.max("n").alias("max_declarations"), F.max_by("declaration_year", F.struct(F.col("n"), (-F.col("declaration_year")).alias("y"))).alias("worst_year"), F.sum("n").alias("n_declarations"))


def full_name() -> Column:
    return F.concat_ws(" ", F.nullif("firstname", F.lit("")), F.nullif("lastname", F.lit("")))


def names(df: DataFrame) -> DataFrame:
    """(user_declarant_id, name): first and last name in the declaration of the latest year, the least id on ties."""
    return df.filter(F.col("user_declarant_id").isNotNull()).groupBy("user_declarant_id").agg(F.min_by(full_name(), F.struct((-F.coalesce("declaration_year", F.lit(0))).alias("y"), ID)).alias("name"))


def timelines(df: DataFrame, t: Tables, once=lambda snaps: snaps) -> DataFrame:
    """A scored row per person: name, the worst score of each rule over the changes, three sums and the bounded total.

    ``once``: how to keep the snapshots, which are read three times, from being made three times. They are all that needs features: counts per
    year and names take columns of the profile only, so ``df`` need not be stored. Joins are merges: persons are never broadcast."""
    snaps = once(snapshots(df, t))
    ch = change_scores(changes(snaps))
    worst = ch.groupBy("user_declarant_id").agg(*worst_of(F.lit(True)))
    years = snaps.groupBy("user_declarant_id").agg(F.count(F.lit(1)).alias("n_snapshots"))
    out = years
    for part in (worst, per_year(df), names(df), three_year(snaps)):
        out = out.join(part.hint("merge"), "user_declarant_id", "left")
    return summed_up(out)


def worst_of(change: Column) -> list[Column]:
    """Aggregates over the rows that are changes."""
    worst = lambda x, name: F.max(F.when(change, x)).alias(name)
    jump = F.when(F.col("cash_delta") > 0, F.col("cash_delta"))
    return [*[worst(F.col(k), k) for k in CHANGE_RULES], worst(F.col("income_ratio"), "max_income_ratio"), worst(F.col("monetary_ratio"), "max_monetary_ratio"), worst(jump, "max_cash_delta"), F.count_if(change).alias("n_changes")]


def in_one_pass(rows: DataFrame) -> DataFrame:
    """The rows of :func:`timelines` from :func:`filings` that have ``declaration_year`` and ``name`` too. Persons are brought together once: what a
    person's years, changes and names give is found by windows over the same order and one aggregate, without a join."""
    year, person = W.partitionBy("user_declarant_id", "year"), W.partitionBy("user_declarant_id").orderBy("year")
    rows = rows.repartition("user_declarant_id").withColumns({"n_year": F.count("declaration_year").over(year), "year_name": F.first("name").over(year.orderBy(ID).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    before, three = person.rowsBetween(W.unboundedPreceding, -1), person.rowsBetween(-2, 0)
    snaps = chosen(rows).withColumns({
        "p": F.last(F.when(F.col("type") == 1, state()), ignorenulls=True).over(before),
        "mean": F.avg("income").over(three), "n3": F.count_if(F.col("income") > 0).over(three),
    })
    change = (F.col("type") == 1) & F.col("p").isNotNull()
    snaps = snaps.select("*", change.alias("is_change"), F.when(F.col("n3") == 3, F.col("estate") / F.col("mean")).alias("estate_to_mean"))
    both = change_scores(compared(snaps, "is_change", "year", "n_year", "year_name", "estate_to_mean"))
    most = F.max_by(F.when(F.col("n_year") > 0, F.col("year")), F.when(F.col("n_year") > 0, F.struct("n_year", (-F.col("year")).alias("y"))))
    out = both.groupBy("user_declarant_id").agg(
        F.count(F.lit(1)).alias("n_snapshots"), *worst_of(F.col("is_change")), F.max(F.when(F.col("n_year") > 0, F.col("n_year"))).alias("max_declarations"), most.alias("worst_year"),
        F.sum(F.when(F.col("n_year") > 0, F.col("n_year"))).alias("n_declarations"), F.max_by("year_name", "year").alias("name"), F.max("estate_to_mean").alias("estate_ratio"),
    )
    return summed_up(out)


def summed_up(out: DataFrame) -> DataFrame:
    """Persons with their worst changes -> the sums over the rules and the bounded total."""
    out = out.withColumns({
        **{k: F.coalesce(k, F.lit(0.0)) for k in CHANGE_RULES}, "n_changes": F.coalesce("n_changes", F.lit(0)),
        "BR1": F.when(F.col("max_declarations") >= 3, 1.6).otherwise(0.0), "CR15": F.when(F.col("estate_ratio") >= 15, 4.8).otherwise(0.0),
    })
    opacity = F.col("BR2") + F.col("BR1")
    corruption = sum((F.col(k) for k in ORDER if k not in ("BR1", "BR2")), F.lit(0.0))
    fired = F.filter(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in ORDER]), lambda x: x.isNotNull())
    return out.withColumns({"corruption_risk_score": rounded(corruption, 3), "opacity_evasion_score": rounded(opacity, 3), "total_score": bounded(corruption + 0.5 * opacity), "triggered": fired})


#: Rule -> what it compared: label, column, whether it is a number of times.
FIGURES = {
    "yoy_income_change": (("largest change of income, times", "max_income_ratio", True),), "yoy_asset_growth": (("largest change of monetary assets, times", "max_monetary_ratio", True),),
    "foreign_cash_jump": (("largest growth of cash", "max_cash_delta", False),), "CR15": (("real estate over mean income, times", "estate_ratio", True),),
    "BR1": (("declarations", "max_declarations", False), ("in", "worst_year", None)),
}
NOTHING = "No anomalies over time detected by the rules."


def line(rule: str) -> Column:
    """``title (label figure, ...)`` of a rule, from a row of :func:`timelines`; a figure that is missing shows as n/a."""
    shape = {True: times_label, False: number_label, None: lambda x: x.cast("string")}
    shown = [F.concat(F.lit(f"{label} "), F.coalesce(shape[kind](F.col(name)), F.lit("n/a"))) for label, name, kind in FIGURES.get(rule, ())]
    text = F.concat(F.lit(f"- {rule}: {fixed.RULE_TITLES[rule]}"), F.lit(" (") if shown else F.lit(""), F.concat_ws(", ", *shown), F.lit(")") if shown else F.lit(""))
    return F.when(F.array_contains("triggered", rule), text)


def explanation() -> Column:
    """A line for each rule over the years that fired, with its figures, in the rules' order."""
    return F.coalesce(F.nullif(F.concat_ws("\n", *[line(rule) for rule in ORDER]), F.lit("")), F.lit(NOTHING))
