"""The normalised relations that all operators take; every one has declaration_id, exploded ones a position ``pos``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Tables:
    """
    profile: user_declarant_id, declaration_year, declaration_type, firstname, lastname, middlename, work_post, work_place, post_type, post_category, country, estate_na (boolean)
    family: member_id, relation, firstname, lastname, middlename
    real_estate: object_type, total_area, total_area_status, cost_assessment, cost_assessment_status, owning_date, right_belongs_raw, right_belongs_resolved, percent_ownership, district, city, raw_iteration
    vehicles: object_type, brand, model, graduation_year, owning_date, cost_date, right_belongs_resolved
    incomes: person_ref, income_type, income_type_other, amount, amount_status, source_name, source_type
    monetary: person_ref, asset_type, currency_code, amount, amount_status, organization_status
    accounts: institution_name, account_owner_resolved
    """

    profile: DataFrame
    family: DataFrame
    real_estate: DataFrame
    vehicles: DataFrame
    incomes: DataFrame
    monetary: DataFrame
    accounts: DataFrame
