"""The corpus pipeline: five stages over ``documents``, each written before the next reads it.

SQL cannot express the learned rules, the balanced draw and the packing, so there is no
``ORACLE_SQL``; ``tests/llm/`` holds the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainlens.llm import balanced_mix, exact_dup, near_dup, packing, quality_rules
from chainlens.llm.scratch import keep, table

STAGES = [
    ("quality rules", quality_rules.stage),
    ("exact dedup", exact_dup.stage),
    ("near dedup", near_dup.stage),
    ("source mix", balanced_mix.stage),
    ("packing", packing.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
