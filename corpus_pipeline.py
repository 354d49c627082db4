"""Documents to training sequences: quality rules, exact and near dedup, mixing and
packing. Each stage is written as Parquet to the shared folder and read again as the
next one's input, so a lost executor costs one stage's tasks at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from gridloom.llm.common import materialise, table

STAGES = [
    ("quality_rules", quality_rules.filter_stage),
    ("exact_dedup", exact_dedup.filter_stage),
    ("near_dedup", near_dedup.filter_stage),
    ("mixing", mixing.mix_stage),
    ("packing", packing.pack_stage),
]

#: Covariance estimates, signatures and Newton steps have no SQL form; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
