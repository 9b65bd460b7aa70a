"""Raw declaration documents to the normalised tables: guards, row expansion and owner resolution.

A document's sections are read as JSON text. Their items become rows by ``posexplode``; numbers and placeholders become
(value, raw, status) columns. A section that does not apply, is missing or holds no list gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.values import currency_code, extended_status, placeholder_status, resolved_owner, safe_number
from .tables import Tables

ID = "declaration_id"
#: Places of rights and owners within an item: more than an item of 2 GB can hold.
WITHIN = 1 << 31
SECTION = "isNotApplicable int, data string"
DOCUMENT = (
    "id string, doc_id string, date string, declaration_year string, declaration_type string, user_declarant_id string, "
    f"data struct<{', '.join(f'step_{n}: struct<isNotApplicable: int, data: string>' for n in (1, 2, 3, 6, 11, 12, 17))}>"
)
RIGHT = "array<struct<ownershipType: string, `percent-ownership`: string, rightBelongs: string>>"
ITEMS = {
    1: "firstname string, lastname string, middlename string, workPost string, workPlace string, postType string, postCategory string, country string",
    2: "id string, subjectRelation string, firstname string, lastname string, middlename string",
    3: f"objectType string, otherObjectType string, totalArea string, cost_date_assessment string, owningDate string, country string, region string, district string, community string, city string, cityType string, iteration string, rights {RIGHT}",
    6: f"objectType string, otherObjectType string, brand string, model string, graduationYear string, owningDate string, costDate string, costDate_extendedstatus string, iteration string, rights {RIGHT}",
    11: "objectType string, otherObjectType string, sizeIncome string, iteration string, person_who_care array<struct<person: string>>, sources array<struct<source_ua_company_name: string, source_ua_company_code: string, incomeSource: string>>",
    12: f"objectType string, sizeAssets string, assetsCurrency string, organization string, organization_extendedstatus string, iteration string, rights {RIGHT}",
    17: "establishment_ua_company_name string, establishment_ua_company_code string, iteration string, persons_has_accounts string, person_who_care array<struct<person: string>>",
}
ACCOUNT = "person_has_account string, iteration string"


def listed(j: Column, objects: bool) -> Column:
    """Elements of a JSON list as texts, only those that are objects; with ``objects`` also an object's values."""
    lead = lambda x: F.substring(F.ltrim(x), 1, 1)
    found = F.when(lead(j) == "[", F.from_json(j, "array<string>"))
    if objects:
        found = found.when(lead(j) == "{", F.map_values(F.from_json(j, "map<string,string>")))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: lead(x) == "{")


def items(docs: DataFrame, step: int, objects: bool = False) -> DataFrame:
    """declaration_id, pos and the item's columns."""
    s = F.col(f"data.step_{step}")
    rows = docs.filter(F.coalesce(s["isNotApplicable"], F.lit(0)) != 1).select(ID, F.posexplode(listed(s["data"], objects)).alias("pos", "item"))
    return rows.select(ID, "pos", F.from_json("item", ITEMS[step]).alias("i")).select(ID, "pos", "i.*")


def parsed(raw: DataFrame, text: str = "value") -> DataFrame:
    """Whole documents in ``text`` -> typed documents with declaration_id and declaration_year; unreadable ones have a null ``data``."""
    docs = raw.select(F.from_json(text, DOCUMENT).alias("d"), *[c for c in raw.columns if c != text]).select("d.*", *[c for c in raw.columns if c != text])
    return docs.withColumns({
        ID: F.coalesce("id", "doc_id", F.lit("unknown")), "declaration_year": F.col("declaration_year").try_cast("int"), "declaration_type": F.col("declaration_type").try_cast("int"), "user_declarant_id": F.col("user_declarant_id").try_cast("int"),
    })


def clean(x: Column) -> Column:
    """A text, null where it is a placeholder."""
    return F.when(placeholder_status(x).isNull(), x)


def profile(docs: DataFrame) -> DataFrame:
    p = F.from_json(F.col("data.step_1.data"), ITEMS[1])
    d = docs.withColumn("p", p)
    text = lambda c: clean(F.col(f"p.{c}"))
    return d.select(
        ID, "user_declarant_id", "declaration_year", "declaration_type", text("firstname").alias("firstname"), text("lastname").alias("lastname"), text("middlename").alias("middlename"), text("workPost").alias("work_post"), text("workPlace").alias("work_place"),
        text("postType").alias("post_type"), text("postCategory").alias("post_category"), F.col("p.country").alias("country"), F.coalesce(F.col("data.step_3.isNotApplicable") == 1, F.lit(False)).alias("estate_na"),
    )


def family(docs: DataFrame) -> DataFrame:
    return items(docs, 2).select(ID, "pos", F.col("id").alias("member_id"), clean(F.col("subjectRelation")).alias("relation"), clean(F.col("firstname")).alias("firstname"), clean(F.col("lastname")).alias("lastname"), clean(F.col("middlename")).alias("middlename"))


def family_index(members: DataFrame) -> DataFrame:
    """(declaration_id, member_id, label) of members; of a repeated id the last counts."""
    person = F.concat_ws(" ", F.nullif("firstname", F.lit("")), F.nullif("lastname", F.lit("")))
    relation = F.coalesce(F.nullif("relation", F.lit("")), F.lit("family"))
    label = F.when(person == "", relation).otherwise(F.concat(relation, F.lit(" ("), person, F.lit(")")))
    pos = F.col("pos") if "pos" in members.columns else F.lit(0)
    return members.filter(F.col("member_id").isNotNull()).groupBy(ID, "member_id").agg(F.max_by(label, pos).alias("label"))


def with_owner(rows: DataFrame, members: DataFrame, raw: str, out: str) -> DataFrame:
    """``out``: the label of the person in ``raw``. "1" is the declarant unless a member has that id."""
    index = family_index(members).select(ID, F.col("member_id").alias(raw), F.col("label").alias("_label"))
    found = rows.join(index, [ID, raw], "left")
    label = F.coalesce("_label", F.when(F.col(raw) == "1", F.lit("declarant")))
    return found.withColumn(out, resolved_owner(F.col(raw), label)).drop("_label")


def real_estate(docs: DataFrame, members: DataFrame, dedupe_property: bool = False) -> DataFrame:
    """A row per property and right, so co-owned property counts once per right; ``dedupe_property`` keeps the first right only."""
    rows = items(docs, 3)
    rights = F.filter(F.coalesce("rights", F.array().cast(RIGHT)), lambda x: x.isNotNull())
    rights = F.slice(rights, 1, 1) if dedupe_property else rights
    rows = rows.withColumn("has_right", F.size(rights) > 0).select("*", F.posexplode_outer(rights).alias("rpos", "right"))
    area, cost = safe_number(F.col("totalArea")), safe_number(F.col("cost_date_assessment"))
    rows = rows.withColumns({"area": area, "cost": cost, "right_belongs_raw": F.col("right.rightBelongs")})
    rows = with_owner(rows, members, "right_belongs_raw", "owner")
    return rows.select(
        ID, (F.col("pos").cast("long") * WITHIN + F.coalesce("rpos", F.lit(0))).alias("pos"), clean(F.col("objectType")).alias("object_type"), clean(F.col("otherObjectType")).alias("other_object_type"),
        F.col("area.value").alias("total_area"), F.col("area.raw").alias("total_area_raw"), F.col("area.status").alias("total_area_status"), F.col("cost.value").alias("cost_assessment"), F.col("cost.raw").alias("cost_assessment_raw"), F.col("cost.status").alias("cost_assessment_status"),
        F.col("owningDate").alias("owning_date"), "right_belongs_raw", F.when(F.col("has_right"), F.col("owner")).alias("right_belongs_resolved"), F.col("right.ownershipType").alias("ownership_type"), F.col("right.percent-ownership").alias("percent_ownership"),
        clean(F.col("country")).alias("country"), clean(F.col("region")).alias("region"), clean(F.col("district")).alias("district"), clean(F.col("community")).alias("community"), clean(F.col("city")).alias("city"), F.col("cityType").alias("city_type"), F.col("iteration").alias("raw_iteration"),
    )


def vehicles(docs: DataFrame, members: DataFrame) -> DataFrame:
    rows = items(docs, 6, objects=True).withColumn("right", F.get("rights", 0)).withColumn("right_belongs_raw", F.col("right.rightBelongs"))
    rows = with_owner(rows, members, "right_belongs_raw", "owner")
    year = F.col("graduationYear").try_cast("int")
    kind = F.when(F.col("objectType") == fixed.OTHER_VEHICLE, F.coalesce("otherObjectType", "objectType")).otherwise(F.col("objectType"))
    return rows.select(
        ID, "pos", clean(kind).alias("object_type"), clean(F.col("brand")).alias("brand"), clean(F.col("model")).alias("model"), year.alias("graduation_year"), F.col("owningDate").alias("owning_date"), safe_number(F.col("costDate"))["value"].alias("cost_date"),
        F.col("right.ownershipType").alias("ownership_type"), F.when(F.col("right").isNotNull(), F.col("owner")).alias("right_belongs_resolved"), F.col("iteration").alias("raw_iteration"),
    )


def _beyond_first(name: str) -> Column:
    """All but the first element; none of a null array."""
    x = F.coalesce(name, F.array())
    return F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))


def incomes(docs: DataFrame) -> DataFrame:
    rows = items(docs, 11).withColumn("n", safe_number(F.col("sizeIncome"))).withColumn("s", F.get("sources", 0))
    extra = F.transform(_beyond_first("sources"), lambda x: F.struct(x["source_ua_company_name"].alias("source_name"), x["source_ua_company_code"].alias("source_code"), x["incomeSource"].alias("source_type")))
    return rows.select(
        ID, "pos", F.get("person_who_care", 0)["person"].alias("person_ref"), clean(F.col("objectType")).alias("income_type"), clean(F.col("otherObjectType")).alias("income_type_other"), F.col("n.value").alias("amount"), F.col("n.raw").alias("amount_raw"), F.col("n.status").alias("amount_status"),
        clean(F.col("s.source_ua_company_name")).alias("source_name"), F.col("s.source_ua_company_code").alias("source_code"), F.col("s.incomeSource").alias("source_type"), F.col("iteration").alias("raw_iteration"), extra.alias("extra_sources"),
    )


def monetary(docs: DataFrame) -> DataFrame:
    rows = items(docs, 12).withColumn("n", safe_number(F.col("sizeAssets"))).withColumn("r", F.get("rights", 0))
    extra = F.transform(_beyond_first("rights"), lambda x: F.struct(x["rightBelongs"].alias("person_ref"), x["ownershipType"].alias("ownership_type")))
    status = F.coalesce(extended_status(F.col("organization_extendedstatus")), placeholder_status(F.col("organization")))
    money = F.when(F.ltrim("assetsCurrency").startswith("{"), F.coalesce(F.get_json_object("assetsCurrency", "$.value"), F.get_json_object("assetsCurrency", "$.original"))).otherwise(F.col("assetsCurrency"))
    return rows.select(
        ID, "pos", F.col("r.rightBelongs").alias("person_ref"), clean(F.col("objectType")).alias("asset_type"), F.col("assetsCurrency").alias("currency_raw"), currency_code(money).alias("currency_code"), F.col("n.value").alias("amount"), F.col("n.raw").alias("amount_raw"), F.col("n.status").alias("amount_status"),
        clean(F.col("organization")).alias("organization"), status.alias("organization_status"), F.col("r.ownershipType").alias("ownership_type"), F.col("iteration").alias("raw_iteration"), extra.alias("extra_rights"),
    )


def accounts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """A row per institution and account owner; without owners, per person who has it in care."""
    rows = items(docs, 17, objects=True)
    held = F.transform(listed(F.col("persons_has_accounts"), True), lambda x: F.from_json(x, ACCOUNT))
    care = F.transform(F.coalesce("person_who_care", F.array().cast("array<struct<person:string>>")), lambda x: F.struct(x["person"].alias("person_has_account"), F.lit(None).cast("string").alias("iteration")))
    rows = rows.select("*", F.posexplode(F.when(F.size(held) > 0, held).otherwise(care)).alias("apos", "a")).withColumn("owner_raw", F.col("a.person_has_account"))
    rows = with_owner(rows, members, "owner_raw", "account_owner_resolved")
    return rows.select(ID, (F.col("pos").cast("long") * WITHIN + F.col("apos")).alias("pos"), clean(F.col("establishment_ua_company_name")).alias("institution_name"), F.col("establishment_ua_company_code").alias("institution_code"), "account_owner_resolved", F.coalesce("a.iteration", "iteration").alias("raw_iteration"))


def normalised(docs: DataFrame, dedupe_property: bool = False) -> Tables:
    """All tables of parsed documents. Unreadable documents (null data) give no rows; the warehouse keeps them."""
    docs = docs.filter("data is not null")
    members = family(docs)
    return Tables(profile(docs), members, real_estate(docs, members, dedupe_property), vehicles(docs, members), incomes(docs), monetary(docs), accounts(docs, members))


def filing_year(docs: DataFrame) -> DataFrame:
    """The year a document is stored under: its own, else the first four characters of its date, else ``unknown``."""
    return docs.withColumn("filed", F.coalesce(F.col("declaration_year").cast("string"), F.nullif(F.substring("date", 1, 4), F.lit("")), F.lit("unknown")))


