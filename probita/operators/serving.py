"""Lists, search, paging, statistics, details and regroupings over scored declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed
from ..functions.values import display_name, rounded
from .features import ID
from .tables import Tables

SORTS = {"score": ["total_score"], "income": ["total_income"], "assets": ["total_assets"], "name": ["lastname", "firstname", "middlename"], "year": ["declaration_year"]}


def name() -> Column:
    return display_name(F.col("lastname"), F.col("firstname"), F.col("middlename"))


def checked(*, limit: int = 50, offset: int = 0, min_score: float = 0.0, query: str = "") -> None:
    if not 1 <= limit <= 200 or not 0 <= offset <= 500_000 or not 0 <= min_score <= 100 or len(query) > 120:
        raise ValueError("limit 1-200, offset 0-500000, min_score 0-100, query of at most 120 characters")


def filtered(scored: DataFrame, *, query: str = "", min_score: float = 0.0, wildcard: bool = True) -> DataFrame:
    """``wildcard``: each name part and the work place by ILIKE (% and _ match); else a substring of the full name or work place."""
    df = scored.filter(F.col("total_score") >= min_score) if min_score else scored
    if not query:
        return df
    if wildcard:
        return df.filter(sum((F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)).cast("int") for c in ("firstname", "middlename", "lastname", "work_place")), F.lit(0)) > 0)
    return df.filter(F.lower(name()).contains(query.lower()) | F.coalesce(F.lower("work_place").contains(query.lower()), F.lit(False)))


def ordered(df: DataFrame, sort_by: str = "score", sort_dir: str = "desc") -> DataFrame:
    """Nulls last in both directions, the id as the last key; unknown names fall back to score and desc."""
    keys = SORTS.get(sort_by, SORTS["score"])
    return df.orderBy(*[F.col(k).asc_nulls_last() if sort_dir == "asc" else F.col(k).desc_nulls_last() for k in keys], ID)


def page(df: DataFrame, *, limit: int = 50, offset: int = 0, sort_by: str = "score", sort_dir: str = "desc") -> DataFrame:
    checked(limit=limit, offset=offset)
    return ordered(df, sort_by, sort_dir).offset(offset).limit(limit)


def list_declarations(scored: DataFrame, *, limit: int = 50, offset: int = 0, min_score: float = 0.0, query: str = "", sort_by: str = "score", sort_dir: str = "desc") -> tuple[DataFrame, int]:
    """(page, total before paging)."""
    checked(limit=limit, offset=offset, min_score=min_score, query=query)
    df = filtered(scored, query=query, min_score=min_score)
    return page(df, limit=limit, offset=offset, sort_by=sort_by, sort_dir=sort_dir), df.count()


def stats(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("total_score") > 0).alias("flagged"), F.coalesce(rounded(F.avg(F.col("total_score").cast("decimal(10,2)")).cast("double"), 3), F.lit(0.0)).alias("average"))


def rule_distribution(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def detail(scored: DataFrame, t: Tables, declaration_id: str) -> DataFrame:
    """One row: the scored profile with each section as an ordered array of structs. The filter reaches every scan."""
    df = scored.filter(F.col(ID) == declaration_id)
    for section in ("family", "real_estate", "vehicles", "incomes", "monetary", "accounts"):
        rows = getattr(t, section).filter(F.col(ID) == declaration_id)
        cols = [c for c in rows.columns if c != ID]
        first = ["pos"] if "pos" in cols else []
        df = df.join(rows.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct(*first, *[c for c in cols if c not in first]))).alias(section)), ID, "left")
    return df


def estate_groups(t: Tables) -> DataFrame:
    """A row per property: by iteration if there is one, else by six columns; the owners in order of appearance."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.coalesce(F.nullif("raw_iteration", F.lit("")), F.concat_ws("|", blank("object_type"), blank("city"), blank("district"), blank("total_area"), blank("cost_assessment"), blank("owning_date")))
    rows = t.real_estate.withColumn("key", key).groupBy(ID, "key").agg(F.count(F.lit(1)).alias("n_rights"), F.sort_array(F.collect_list(F.struct("pos", "right_belongs_resolved"))).alias("o"))
    return rows.select(ID, "key", "n_rights", F.array_join(F.array_distinct(F.filter(F.transform("o", lambda x: x["right_belongs_resolved"]), lambda x: x.isNotNull())), ", ").alias("owners"))


def vehicle_groups(t: Tables) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat_ws("|", blank("object_type"), blank("brand"), blank("model"), blank("graduation_year"), blank("owning_date"))
    rows = t.vehicles.withColumn("key", key).groupBy(ID, "key").agg(F.count(F.lit(1)).alias("n_rights"), F.sort_array(F.collect_list(F.struct("pos", "right_belongs_resolved"))).alias("o"))
    return rows.select(ID, "key", "n_rights", F.array_join(F.array_distinct(F.filter(F.transform("o", lambda x: x["right_belongs_resolved"]), lambda x: x.isNotNull())), ", ").alias("owners"))


def ranked_persons(timelines: DataFrame, *, top: int = 20, min_score: float = 0.0) -> DataFrame:
    """Persons with two snapshots or more and at least ``min_score``, best first; rank from 1."""
    from .timeline import explanation

    some = timelines.withColumn("explanation", explanation()).filter((F.col("n_snapshots") >= 2) & (F.col("total_score") >= min_score)).orderBy(F.desc("total_score"), "user_declarant_id").limit(top)
    return some.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total_score"), "user_declarant_id")))  # of ``top`` rows


def report(ranked: DataFrame, detailed: int = 5) -> str:
    """A bounded ranked list as text: a line per person, then the first ``detailed`` with their figures and rules."""
    rows = ranked.orderBy("rank").collect()
    lines = [f"{r.rank:>4}  {r.total_score:>6.2f}  {r.user_declarant_id}  {r.name}" for r in rows]
    for r in rows[:detailed]:
        lines += ["", f"{r.name} ({r.user_declarant_id}): {r.total_score:.2f} over {r.n_snapshots} years and {r.n_changes} changes"]
        lines += [f"  {x}" for x in r.explanation.split("\n")]
    return "\n".join(lines)


def recipients(t: Tables) -> DataFrame:
    """(declaration_id, pos, recipient): who an income goes to. Null, empty, "1" and "declarant" are the declarant; a member shows as
    relation and full name, as far as known; an id that no member has as ``Person <id>``. Of a repeated member the first counts."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    full, relation = F.concat_ws(" ", blank("lastname"), blank("firstname"), blank("middlename")), blank("relation")
    shown = F.when(relation.isNotNull() & (full != ""), F.concat(relation, F.lit(" ("), full, F.lit(")"))).otherwise(F.coalesce(relation, F.nullif(full, F.lit(""))))
    pos = F.col("pos") if "pos" in t.family.columns else F.lit(0)
    members = t.family.filter(blank("member_id").isNotNull()).groupBy(ID, F.trim("member_id").alias("ref")).agg(F.min_by(F.coalesce(shown, F.lit("")), pos).alias("shown"))
    rows = t.incomes.select(ID, "pos", F.trim(F.coalesce("person_ref", F.lit(""))).alias("ref")).join(members, [ID, "ref"], "left")
    own = (F.col("ref") == "") | (F.col("ref") == "1") | (F.lower("ref") == "declarant")
    return rows.select(ID, "pos", F.when(own, "Declarant").otherwise(F.coalesce(F.nullif("shown", F.lit("")), F.concat(F.lit("Person "), F.col("ref")))).alias("recipient"))


def page_count(total: int, limit: int = 50) -> int:
    return max(1, -(-total // limit))
