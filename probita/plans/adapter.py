"""The driver's star schema as declarations, for Spark and as the SQL prelude of every check.

A declaration is a customer's orders of a year (every 17th customer files up to four a year, so corrections occur); orders are incomes, line items with an even number are real estate, with
an odd one monetary assets, and every third is also a vehicle; purchases are accounts. Rules on keys scatter statuses,
owners, currencies and types, so that every rule fires for some rows and not for others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import Tables
from .stage import materialized

#: One text for both engines: {dec} is the money type.
RELATIONS = {
    "base": """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus, CAST(year(o_orderdate) AS INT) AS y, concat(CAST(o_custkey AS {text}), '-', CAST(year(o_orderdate) AS {text}), CASE WHEN o_custkey % 17 = 0 THEN concat('-', CAST(o_orderkey % 4 AS {text})) ELSE '' END) AS declaration_id FROM orders""",
    "profile": """SELECT b.declaration_id, b.o_custkey AS user_declarant_id, b.y AS declaration_year,
        CASE WHEN b.o_custkey % 11 = 0 AND b.y = 2001 THEN 3 ELSE 1 END AS declaration_type,
        'Customer' AS firstname, c.c_name AS lastname, CAST(NULL AS {text}) AS middlename, b.work_post, n.n_name AS work_place, c.c_mktsegment AS post_type,
        CAST(NULL AS {text}) AS post_category, CASE WHEN b.o_custkey % 5 = 0 THEN ' UA ' ELSE '2' END AS country, (b.o_custkey % 13 = 0 OR b.o_custkey % 10 = 0) AS estate_na
      FROM (SELECT declaration_id, o_custkey, y, min(o_orderpriority) AS work_post FROM base GROUP BY declaration_id, o_custkey, y) b
      JOIN customer c ON c.c_custkey = b.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "family": """SELECT declaration_id, 'f1' AS member_id, CASE user_declarant_id % 3 WHEN 0 THEN 'дружина' WHEN 1 THEN 'син' ELSE 'мати' END AS relation, 'Fam' AS firstname, lastname, CAST(NULL AS {text}) AS middlename
      FROM profile WHERE user_declarant_id % 2 = 0""",
    "incomes": """SELECT declaration_id, o_orderkey AS pos, CASE WHEN o_orderkey % 29 = 0 THEN 'zz' WHEN o_orderkey % 4 = 0 THEN 'f1' ELSE '1' END AS person_ref,
        o_orderpriority AS income_type, CAST(NULL AS {text}) AS income_type_other,
        CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN NULL WHEN o_custkey % 41 = 0 THEN CAST(0 AS {dec}) ELSE CAST(o_totalprice AS {dec}) END AS amount,
        CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' WHEN o_orderkey % 19 = 0 THEN 'parse_error' END AS amount_status,
        o_orderstatus AS source_name, CASE o_orderkey % 23 WHEN 0 THEN 'sale' WHEN 1 THEN 'rent' WHEN 2 THEN 'business' END AS source_type
      FROM base""",
    "items": """SELECT b.declaration_id, b.y, b.o_custkey, l.l_orderkey * 10 + l.l_linenumber AS pos, l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_returnflag,
        CAST(l.l_extendedprice AS {dec}) AS price, CAST(l.l_quantity AS {dec}) AS qty, CAST(l.l_discount AS {dec}) AS disc, {day} AS owning_date
      FROM lineitem l JOIN base b ON b.o_orderkey = l.l_orderkey""",
    "real_estate": """SELECT declaration_id, pos,
        CASE l_partkey % 5 WHEN 0 THEN 'Квартира' WHEN 1 THEN 'Житловий будинок' WHEN 2 THEN 'Земельна ділянка' WHEN 3 THEN 'Нежитлове приміщення' ELSE 'Гараж' END AS object_type,
        CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_partkey % 5 = 2 THEN CAST(qty * 5000 AS {dec}) ELSE CAST(qty * 6 AS {dec}) END AS total_area,
        CASE WHEN l_partkey % 37 = 0 THEN 'parse_error' END AS total_area_status,
        CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(price * 20 AS {dec}) END AS cost_assessment,
        CASE WHEN l_partkey % 13 = 0 THEN CASE l_suppkey % 4 WHEN 0 THEN 'confidential' WHEN 1 THEN 'family_no_info' WHEN 2 THEN 'unknown' ELSE 'redacted_other' END END AS cost_assessment_status,
        CASE WHEN l_partkey % 97 = 0 THEN 'n/a' ELSE owning_date END AS owning_date,
        CASE WHEN l_partkey % 31 = 0 THEN '999' WHEN l_returnflag = 'R' THEN '1' WHEN l_returnflag = 'A' THEN 'f1' ELSE 'j' END AS right_belongs_raw,
        CASE WHEN l_partkey % 31 = 0 THEN 'unknown:999' WHEN l_returnflag = 'R' THEN 'declarant' WHEN l_returnflag = 'A' THEN CASE WHEN o_custkey % 2 = 0 THEN 'family' ELSE 'unknown:f1' END ELSE 'third_party' END AS right_belongs_resolved,
        CASE WHEN l_suppkey % 9 = 0 THEN '100' ELSE CAST(CAST(disc * 1000 AS {dec}) AS {text}) END AS percent_ownership,
        CAST(NULL AS {text}) AS district, CASE l_suppkey % 4 WHEN 0 THEN 'Київ' WHEN 1 THEN 'Lviv' WHEN 2 THEN 'Одеса' ELSE 'Село' END AS city, CAST(l_orderkey AS {text}) AS raw_iteration
      FROM items WHERE l_linenumber % 2 = 0""",
    "monetary": """SELECT declaration_id, pos, CASE WHEN l_orderkey % 3 = 0 THEN 'f1' WHEN l_orderkey % 53 = 0 THEN 'q' ELSE '1' END AS person_ref,
        CASE l_returnflag WHEN 'R' THEN 'Готівкові кошти' WHEN 'A' THEN 'Кошти, розміщені на банківських рахунках' ELSE 'Інше' END AS asset_type,
        CASE l_suppkey % 10 WHEN 0 THEN 'UAH' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' WHEN 4 THEN 'PLN' WHEN 5 THEN 'CHF' WHEN 6 THEN 'CZK' WHEN 7 THEN 'JPY' WHEN 8 THEN 'XYZ' END AS currency_code,
        CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE price END AS amount,
        CASE WHEN l_partkey % 17 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'family_no_info' ELSE 'confidential' END END AS amount_status,
        CASE l_partkey % 11 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'family_no_info' WHEN 2 THEN 'confidential' WHEN 3 THEN 'redacted_other' WHEN 4 THEN 'confidential' END AS organization_status
      FROM items WHERE l_linenumber % 2 = 1""",
    "vehicles": """SELECT declaration_id, pos, CASE WHEN l_partkey % 40 = 0 THEN 'Трактор' ELSE 'Автомобіль' END AS object_type,
        CASE l_partkey % 9 WHEN 0 THEN 'BMW' WHEN 1 THEN 'Toyota' WHEN 2 THEN 'Land Range Rover' ELSE 'Skoda' END AS brand, CAST(l_partkey % 7 AS {text}) AS model, CAST(2000 + l_partkey % 20 AS INT) AS graduation_year,
        owning_date, CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE CAST(price * 15 AS {dec}) END AS cost_date, CASE WHEN l_returnflag = 'N' AND o_custkey % 2 = 0 THEN 'family' ELSE 'declarant' END AS right_belongs_resolved
      FROM items WHERE l_linenumber % 3 = 0""",
    "accounts": """SELECT p.declaration_id, e.event_id AS pos, e.event_type AS institution_name, CASE WHEN e.event_id % 3 = 0 THEN 'declarant' WHEN e.event_id % 3 = 1 THEN 'third_party' ELSE 'unknown:x' END AS account_owner_resolved
      FROM events e JOIN (SELECT user_declarant_id, min(declaration_id) AS declaration_id FROM profile GROUP BY user_declarant_id) p ON p.user_declarant_id = e.user_id WHERE e.event_type = 'purchase'""",
}
SPARK = {"dec": "DECIMAL(18,2)", "text": "STRING", "day": "CAST(CAST(l.l_shipdate AS DATE) AS STRING)"}
DUCK = {"dec": "DECIMAL(18,2)", "text": "VARCHAR", "day": "strftime(l.l_shipdate, '%Y-%m-%d')"}


def prelude() -> str:
    """The relations as common table expressions."""
    return ",\n".join(f"{k} AS ({v.format(**DUCK)})" for k, v in RELATIONS.items())


#: Relations that several tables are made of: with ``once`` they, or the ones it names, are written once per run and read from there.
SHARED = ("base", "profile", "items")
ORDERS_A_TASK = 200_000


def tables(spark: SparkSession, sf_dir: str, once: bool | tuple[str, ...] = False) -> Tables:
    shared = (SHARED if once else ()) if isinstance(once, bool) else once
    made: dict[str, DataFrame] = {}
    for source in ("orders", "customer", "nation", "lineitem", "events"):
        made[source] = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    tasks = -(-made["orders"].count() // ORDERS_A_TASK)
    for name, text in RELATIONS.items():
        # the least text of a declaration is found by sorting: after the shuffle in tasks of a bounded number of rows, not in whole splits of the scan
        dealt = {"base": made["base"].repartition(max(1, tasks), "declaration_id", "o_custkey", "y")} if name == "profile" else {}
        made[name] = spark.sql(_named(text.format(**SPARK), made), **{**made, **dealt})
        if name in shared:
            made[name] = materialized(made[name], name)
    return Tables(**{k: made[k] for k in ("profile", "family", "real_estate", "vehicles", "incomes", "monetary", "accounts")})


def _named(text: str, made: dict[str, DataFrame]) -> str:
    """``FROM x`` and ``JOIN x`` with x as a parameter of spark.sql, so no views are left behind."""
    import re

    return re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in made else m[0], text)
