"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, hmm, language_id, mixing, near_dedup, packing, periodic_runs, quality_rules, secrets, site_style_tree, substring_dedup, vector_codes, warc_derivatives


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_min_slack_packing": packing.op2_min_slack_packing,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_hmm_score": hmm.op4_hmm_score,
        "op5_bayes_minhash": near_dedup.op5_bayes_minhash,
        "op6_hierarchical_language_id": language_id.op6_hierarchical_language_id,
        "op7_site_style_tree": site_style_tree.op7_site_style_tree,
        "op8_multipart_secrets": secrets.op8_multipart_secrets,
        "op9_entropy_mix": mixing.op9_entropy_mix,
        "op10_warc_derivatives": warc_derivatives.op10_warc_derivatives,
        "op11_suffix_tree_dedup": substring_dedup.op11_suffix_tree_dedup,
        "op12_delta_lloyd": vector_codes.op12_delta_lloyd,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return exact_dedup.ORACLE_SQL | warc_derivatives.ORACLE_SQL | substring_dedup.ORACLE_SQL | vector_codes.ORACLE_SQL
