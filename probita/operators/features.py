"""One wide row of features per declaration: a conditional aggregate per section table, joined on declaration_id.

Each section is shuffled once by its declaration; members, years and the joins reuse that partitioning. Nothing that grows with the
number of declarations is broadcast, so the driver holds none of it. Texts are lower-cased once, before that shuffle, and searched
for stems there, so that flags travel instead of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.values import MONEY, contains_any, dbl, holds_any, lowered, owner_bucket, rounded, to_uah, year_in
from .tables import Tables

ID = "declaration_id"


def n(cond: Column) -> Column:
    """How many rows have it; null counts as no."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def with_members(rows: DataFrame, t: Tables, ref: str) -> DataFrame:
    """``rows`` with ``known``: whether ``ref`` is a member of the declaration's family. By declaration alone, so that rows stay where their aggregates need them."""
    members = t.family.groupBy(ID).agg(F.collect_set("member_id").alias("_members"))
    return rows.join(members.hint("merge"), ID, "left").withColumn("known", F.coalesce(F.array_contains("_members", F.col(ref)), F.lit(False))).drop("_members")


def income_text() -> Column:
    return F.concat_ws(" ", F.coalesce("income_type", F.lit("")), F.coalesce("source_type", F.lit("")), F.coalesce("income_type_other", F.lit("")))


def _sum_if(cond: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, x)), F.lit(0).cast("decimal(38,4)"))


def income_features(t: Tables) -> DataFrame:
    stems = {"_one_off": fixed.ONE_OFF_STEMS, "_one_off_timeline": fixed.TIMELINE_ONE_OFF_STEMS, "_agri": fixed.AGRI_INCOME_STEMS, "_rent": fixed.RENT_INCOME_STEMS}
    plain = [ID, "person_ref", F.col("amount").cast(MONEY).alias("amount"), "amount_status", "source_name"]
    rows = t.incomes.select(*plain, lowered(income_text()).alias("_text")).select(*plain, *[holds_any(F.col("_text"), v).alias(k) for k, v in stems.items()])
    amount = F.col("amount")
    return with_members(rows, t, "person_ref").groupBy(ID).agg(
        F.sum(amount).alias("total_income"), F.count(F.lit(1)).alias("n_incomes"), F.count_distinct(F.nullif("source_name", F.lit(""))).alias("n_sources"),
        n(F.col("amount_status").isNotNull()).alias("inc_unknown"), n(F.col("amount_status").isin(*fixed.CONFIDENTIAL)).alias("inc_conf"),
        _sum_if(F.col("_one_off"), amount).alias("one_off"), _sum_if(F.col("_one_off_timeline"), amount).alias("one_off_timeline"),
        _sum_if(F.col("_agri"), amount).alias("agri_income"), _sum_if(F.col("_rent"), amount).alias("rent_income"),
        n(amount > 0).alias("n_positive_incomes"),
        (n(F.col("amount_status") == "parse_error") + n(amount > 10_000_000_000)).alias("inc_bad"),
        n((F.col("person_ref") != "1") & ~F.col("known")).alias("inc_orphans"),
    )


def monetary_kind(low: Column) -> Column:
    """From a lower-cased asset type."""
    return F.when(holds_any(low, fixed.CASH_WORDS), "cash").when(holds_any(low, fixed.BANK_WORDS), "bank").otherwise("other")


def monetary_features(t: Tables) -> DataFrame:
    plain = [ID, "person_ref", "amount", "amount_status", "organization_status"]
    made = {"uah": to_uah(F.col("amount"), F.col("currency_code")), "fx": F.upper(F.coalesce("currency_code", F.lit(""))) != "UAH", "_type": lowered(F.col("asset_type"))}
    rows = t.monetary.select(*plain, *[v.alias(k) for k, v in made.items()])
    rows = rows.select(*plain, "uah", "fx", monetary_kind(F.col("_type")).alias("kind"), holds_any(F.col("_type"), fixed.CASH_STEM).alias("stem"))
    rows, uah, fx, stem = with_members(rows, t, "person_ref"), F.col("uah"), F.col("fx"), F.col("stem")
    some = F.col("amount_status").isNotNull() | F.col("amount").isNotNull()
    return rows.groupBy(ID).agg(
        *[F.sum(F.when(F.col("kind") == k, uah)).alias(k) for k in ("cash", "bank", "other")],
        F.sum(uah).alias("monetary_uah"), F.sum(F.col("amount").cast(MONEY)).alias("monetary_raw"), F.count(F.lit(1)).alias("n_monetary"),
        (n(F.col("amount_status").isNotNull()) + n(F.col("organization_status").isNotNull())).alias("mon_unknown"),
        (n(F.col("amount_status").isin(*fixed.CONFIDENTIAL)) + n(F.col("organization_status").isin(*fixed.CONFIDENTIAL))).alias("mon_conf"),
        F.coalesce(F.sum(F.when(stem & fx, uah)), F.lit(0)).cast("decimal(38,6)").alias("fx_cash"), F.coalesce(F.sum(F.when(stem, uah)), F.lit(0)).cast("decimal(38,6)").alias("stem_cash"),
        (n(F.col("amount_status") == "parse_error") + n(uah > 10_000_000_000)).alias("mon_bad"),
        n((F.col("person_ref") != "1") & ~F.col("known")).alias("mon_orphans"),
        n(some).alias("mon_valued"), n(some & F.col("amount_status").isin(*fixed.HIDDEN)).alias("mon_hidden"),
        (n(F.col("known") & (F.col("amount_status") == "family_no_info")) + n(F.col("known") & (F.col("organization_status") == "family_no_info"))).alias("mon_no_info"),
    )


def bad_date(owning: Column, year: Column) -> Column:
    y = year_in(owning)
    return (owning.isNotNull() & (owning != "")) & (y.isNull() | ((year != 0) & (y > year)))


def estate_features(t: Tables) -> DataFrame:
    plain = [ID, "pos", "total_area_status", "cost_assessment_status", "right_belongs_raw", "owning_date", F.col("cost_assessment").cast(MONEY).alias("cost"), F.col("total_area").cast(MONEY).alias("area")]
    made = {"bucket": owner_bucket(F.col("right_belongs_resolved")), "orphan": F.col("right_belongs_resolved").startswith("unknown:"), "_type": lowered(F.col("object_type")), "_city": lowered(F.col("city"))}
    rows = t.real_estate.select(*plain, *[v.alias(k) for k, v in made.items()])
    low = F.col("_type")
    flags = {"home": holds_any(low, fixed.HOME_STEMS), "land": holds_any(low, fixed.LAND_STEM), "trade": holds_any(low, fixed.TRADE_STEMS), "city_flat": holds_any(low, ("кварт",)) & holds_any(F.col("_city"), fixed.CITY_STEMS)}
    rows = rows.select(*[c for c in rows.columns if c not in ("_type", "_city")], *[v.alias(k) for k, v in flags.items()])
    cost, area, home, land = F.col("cost"), F.col("area"), F.col("home"), F.col("land")
    hidden = F.coalesce(F.col("cost_assessment_status").isin(*fixed.HIDDEN), F.lit(False))
    rows = with_members(rows.join(t.profile.select(ID, "declaration_year").hint("merge"), ID, "left"), t, "right_belongs_raw")
    same_year = F.col("declaration_year").isNull() | (year_in(F.col("owning_date")) == F.col("declaration_year"))
    some = F.col("cost_assessment_status").isNotNull() | cost.isNotNull()
    return rows.groupBy(ID).agg(
        F.sum(cost).alias("estate_cost"), F.max(cost).alias("largest_acquisition"), F.count(F.lit(1)).alias("n_estate"),
        (n(F.col("total_area_status").isNotNull()) + n(F.col("cost_assessment_status").isNotNull())).alias("re_hidden_fields"),
        (n(F.col("total_area_status").isin(*fixed.CONFIDENTIAL)) + n(F.col("cost_assessment_status").isin(*fixed.CONFIDENTIAL))).alias("re_conf"),
        n(bad_date(F.col("owning_date"), F.col("declaration_year"))).alias("re_bad_dates"),
        n(F.col("orphan")).alias("re_orphans"),
        (n(area > 10_000_000) + n((F.col("total_area_status") == "parse_error") | (F.col("cost_assessment_status") == "parse_error"))).alias("re_bad"),
        F.max(F.when(same_year, cost)).alias("re_acquired"),
        n((cost >= 500_000) | ((area >= 10_000) & (cost >= 300_000))).alias("re_mid_high"),
        _sum_if(home, area).alias("home_area"), _sum_if(land, area).alias("land_area"),
        n(F.col("trade")).alias("n_trade"),
        n(F.col("city_flat")).alias("n_city_flats"),
        n((home | land) & hidden).alias("n_hidden_major"),
        F.coalesce(F.max_by(F.when(home & (area > 0), hidden), F.when(home & (area > 0), F.struct(area.alias("a"), (-F.col("pos")).alias("p"), (~hidden).alias("h")))), F.lit(False)).alias("largest_hidden"),
        n(some).alias("re_valued"), n(some & hidden).alias("re_hidden"),
        (n(F.col("known") & (F.col("cost_assessment_status") == "family_no_info")) + n(F.col("known") & (F.col("total_area_status") == "family_no_info"))).alias("re_no_info"),
        *[n(F.col("bucket") == b).alias(f"re_{b}") for b in ("declarant", "family", "third_party", "unknown")],
    ).withColumnRenamed("re_unknown", "re_unknown_owner")


def vehicle_features(t: Tables) -> DataFrame:
    plain = [ID, "owning_date", F.col("cost_date").cast(MONEY).alias("cost")]
    named = F.concat_ws(" ", F.coalesce("brand", F.lit("")), F.coalesce("model", F.lit("")))
    made = {
        "bucket": owner_bucket(F.col("right_belongs_resolved")), "some": F.col("cost_date").cast(MONEY).isNotNull() | (F.coalesce("brand", F.lit("")) != ""),
        "_name": lowered(named), "machine": contains_any(F.col("object_type"), fixed.MACHINE_STEMS),
    }
    rows = t.vehicles.select(*plain, *[v.alias(k) for k, v in made.items()])
    rows = rows.select(*[c for c in rows.columns if c != "_name"], holds_any(F.col("_name"), fixed.LUXURY_BRANDS).alias("luxury"))
    rows = rows.join(t.profile.select(ID, "declaration_year").hint("merge"), ID, "left")
    cost, some = F.col("cost"), F.col("some")
    same_year = F.col("declaration_year").isNull() | (year_in(F.col("owning_date")) == F.col("declaration_year"))
    return rows.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n_vehicles"), F.max(F.when(same_year, cost)).alias("vh_acquired"), n(cost >= 300_000).alias("vh_mid_high"),
        n(F.col("luxury")).alias("n_luxury"),
        n(F.col("machine")).alias("n_machines"),
        n(bad_date(F.col("owning_date"), F.col("declaration_year"))).alias("vh_bad_dates"),
        n(some).alias("vh_valued"), n(some & cost.isNull()).alias("vh_hidden"),
        *[n(F.col("bucket") == b).alias(f"vh_{b}") for b in ("declarant", "family", "third_party", "unknown")],
    )


def account_features(t: Tables) -> DataFrame:
    rows = t.accounts.withColumn("bucket", owner_bucket(F.col("account_owner_resolved")))
    return rows.groupBy(ID).agg(F.count(F.lit(1)).alias("n_accounts"), *[n(F.col("bucket") == b).alias(f"ac_{b}") for b in ("declarant", "family", "third_party", "unknown")])


def family_features(t: Tables) -> DataFrame:
    return t.family.groupBy(ID).agg(F.count(F.lit(1)).alias("n_family"), n(~contains_any(F.col("relation"), fixed.MINOR_STEMS_CR7)).alias("n_adult_family"))


def share_issues(t: Tables) -> DataFrame:
    """declaration_id, n_share_issues: properties whose shares add up to over 110 or to between 0 and 10."""
    pct = F.regexp_replace(F.trim(F.coalesce("percent_ownership", F.lit(""))), ",", ".").try_cast("decimal(12,4)")
    per = t.real_estate.filter(pct.isNotNull()).groupBy(ID, "raw_iteration", "object_type", "city", "district").agg(F.sum(pct).alias("pct"))
    return per.groupBy(ID).agg(n((F.col("pct") > 110) | ((F.col("pct") > 0) & (F.col("pct") < 10))).alias("n_share_issues"))


def share_of(pct_text: Column) -> Column:
    """Hundredths: unreadable or missing counts as 100, over 100 as 100, zero and less as null."""
    p = F.coalesce(F.regexp_replace(F.trim(F.coalesce(pct_text, F.lit(""))), ",", ".").try_cast("decimal(12,4)"), F.lit(100).cast("decimal(12,4)"))
    return F.when(p > 0, F.least(p, F.lit(100).cast("decimal(12,4)")))


def kin_features(t: Tables) -> DataFrame:
    """declaration_id, proxy (CR11), kin_ratio and kin_person (CR12): from per-person incomes and assets, joined to relations."""
    kin = t.family.filter(contains_any(F.col("relation"), fixed.KIN_STEMS)).select(ID, F.col("member_id").alias("pid"))
    kin = kin.withColumn("kin", F.lit(True))
    income = t.incomes.select(ID, F.col("person_ref").alias("pid"), F.col("amount").cast(MONEY).alias("amount"))
    cost = F.col("cost_assessment").cast(MONEY)
    pct = F.regexp_replace(F.coalesce("percent_ownership", F.lit("")), ",", ".").try_cast("decimal(12,4)")
    owned = F.coalesce((pct >= 99) & (contains_any(F.col("object_type"), fixed.HOME_STEMS) | F.coalesce(cost >= 500_000, F.lit(False))), F.lit(False))
    estate = t.real_estate.select(ID, F.coalesce("right_belongs_raw", "right_belongs_resolved").alias("pid"), (cost * share_of(F.col("percent_ownership"))).cast("decimal(38,6)").alias("worth"), (owned & F.col("right_belongs_raw").isNotNull()).alias("major"))
    uah = to_uah(F.col("amount"), F.col("currency_code"))
    money = t.monetary.select(ID, F.col("person_ref").alias("pid"), (uah * 100).cast("decimal(38,6)").alias("worth"), F.coalesce(uah >= 500_000, F.lit(False)).alias("major"))
    # all that is known of a person is one aggregate; only persons that hold something count
    every = estate.unionByName(money).withColumn("held", F.lit(True)).unionByName(kin, True).unionByName(income, True).filter(F.col("pid").isNotNull())
    person = every.groupBy(ID, "pid").agg(F.sum("worth").alias("worth"), F.bool_or("major").alias("major"), F.bool_or("kin").alias("kin"), F.sum("amount").alias("own_income"), F.count("held").alias("held"))
    rows = person.filter("held > 0")
    own = F.coalesce("own_income", F.lit(0))
    base = F.max(F.when(F.col("pid") == "1", F.col("worth")))
    poor = F.col("kin") & (own < 50_000) & (F.col("worth") > 0)
    best = F.max(F.when(poor, F.struct("worth", (-F.xxhash64("pid")).alias("h"), "pid")))  # the hash settles ties alike wherever rows lie
    return rows.groupBy(ID).agg(F.coalesce(F.bool_or(F.col("kin") & F.col("major") & (own < 100_000)), F.lit(False)).alias("proxy"), F.when(base > 0, dbl(best["worth"]) / dbl(base)).alias("kin_ratio"), F.when(base > 0, best["pid"]).alias("kin_person"))


ZERO = (
    "n_incomes n_sources inc_unknown inc_conf n_positive_incomes inc_bad inc_orphans n_monetary mon_unknown mon_conf mon_bad mon_orphans mon_valued mon_hidden mon_no_info "
    "n_estate re_hidden_fields re_unknown_owner re_conf re_bad_dates re_orphans re_bad re_mid_high n_trade n_city_flats n_hidden_major re_valued re_hidden re_no_info re_declarant re_family re_third_party "
    "n_vehicles vh_mid_high n_luxury n_machines vh_bad_dates vh_valued vh_hidden vh_declarant vh_family vh_third_party vh_unknown n_accounts ac_declarant ac_family ac_third_party ac_unknown "
    "n_family n_adult_family n_share_issues"
).split()
ZERO_MONEY = "one_off one_off_timeline agri_income rent_income home_area land_area fx_cash stem_cash".split()


PARTS = {
    "incomes": income_features, "monetary": monetary_features, "real_estate": estate_features, "vehicles": vehicle_features,
    "accounts": account_features, "family": family_features, "shares": share_issues, "kin": kin_features,
}


def _derived() -> dict[str, tuple[str, Column]]:
    """Column -> (parts it needs, expression)."""
    c = F.col
    fields = c("n_incomes") + 2 * c("n_monetary") + 2 * c("n_estate")
    liquid = F.coalesce("cash", F.lit(0)) + F.coalesce("bank", F.lit(0))
    own = lambda b: c(f"re_{b}") + c(f"vh_{b}") + c(f"ac_{b}")
    known = c("re_valued") + c("mon_valued") + c("vh_valued")
    assets = F.when(c("estate_cost").isNull() & c("monetary_uah").isNull(), None).otherwise(F.coalesce("estate_cost", F.lit(0)) + F.coalesce("monetary_uah", F.lit(0)))
    rows, owned = "incomes monetary real_estate", "real_estate vehicles accounts"
    return {
        "total_assets": ("monetary real_estate", assets.cast("decimal(38,6)")),
        "fields": (rows, fields), "unknown_fields": (rows, c("inc_unknown") + c("mon_unknown") + c("re_hidden_fields")),
        "confidential_ratio": (rows, F.when(fields > 0, dbl(c("inc_conf") + c("mon_conf") + c("re_conf")) / fields).otherwise(F.lit(0.0))),
        "cash_ratio": ("monetary", F.when(liquid > 0, rounded(dbl(F.coalesce("cash", F.lit(0))) / dbl(liquid), 4))),
        "own_total": (owned, c("n_estate") + c("n_vehicles") + c("n_accounts")), "own_declarant": (owned, own("declarant")), "own_family": (owned, own("family")), "own_third_party": (owned, own("third_party")),
        "own_unknown": (owned, c("re_unknown_owner") + c("vh_unknown") + c("ac_unknown")),
        "unknown_share": ("monetary real_estate vehicles", F.when(known > 0, dbl(c("re_hidden") + c("mon_hidden") + c("vh_hidden")) / known).otherwise(F.lit(0.0))),
    }


def wide(t: Tables, parts: str = " ".join(PARTS), only: str | None = None) -> DataFrame:
    """profile with the features of ``parts``. Counts are 0 and flags false where a section has no rows; sums stay null.

    With ``only`` the profile and these features. A part then goes through the joins as one struct, whose bytes are copied as they are, where
    each join would read and write every amount anew; all of its fields are asked for, so it is not taken apart before."""
    df, wanted = t.profile, None if only is None else only.split()
    for part in parts.split():
        rows = PARTS[part](t)
        if wanted is not None:
            rows = rows.select(ID, F.struct(*[x for x in rows.columns if x in wanted]).alias(f"_{part}"))
        df = df.join(rows.hint("merge"), ID, "left")
    if wanted is not None:
        df = df.select(*t.profile.columns, *[f"_{part}.*" for part in parts.split()])
    there = set(df.columns)
    df = df.fillna(0, [x for x in ZERO if x in there]).fillna(False, [x for x in ("largest_hidden", "proxy") if x in there])
    df = df.withColumns({x: F.coalesce(F.col(x), F.lit(0).cast("decimal(38,4)")) for x in ZERO_MONEY if x in there})
    return df.withColumns({k: e for k, (need, e) in _derived().items() if set(need.split()) <= set(parts.split()) and (wanted is None or k in wanted)})
