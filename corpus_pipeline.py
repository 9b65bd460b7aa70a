"""The corpus pipeline: quality rules, SimHash near-dedup, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probita.llm.common import staged, table
from probita.llm.mixing import stage_mixing
from probita.llm.packing import stage_packing
from probita.llm.pii import stage_pii
from probita.llm.quality import stage_quality
from probita.llm.simhash import stage_simhash

STAGES = [
    ("quality_rules", stage_quality),
    ("near_dedup", stage_simhash),
    ("personal_data", stage_pii),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: SQL expresses neither the fingerprints nor the packing. tests/llm compare near-dedup's groups, redaction and the operators behind the other
#: stages with brute force, and hold the stages' rows and words against each other.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage over all rows of ``documents`` that the one before kept, through a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
