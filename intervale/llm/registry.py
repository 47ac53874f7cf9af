"""The subpackage's queries and SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from intervale.llm import ann, exact_dedup, fill_middle, fingerprints, hard_negatives, language_id, lm_scoring, mixing, near_dedup, packing, sharding, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        sharding.op1_lookup_sharding, toxicity.op2_kneser_ney_toxicity, mixing.op3_curriculum_mixing, token_counts.op4_edit_aware_counts, lm_scoring.op5_cross_entropy_difference,
        packing.op6_kk_packing, ann.op7_anisotropic_ann, exact_dedup.op8_exact_dedup, near_dedup.op9_minhash_near_dedup, language_id.op10_ecoc_language_id,
        fingerprints.op11_scaled_fingerprints, hard_negatives.op12_vantage_hard_negatives, fill_middle.op13_fill_in_middle,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_curriculum_mixing": mixing.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op11_scaled_fingerprints": fingerprints.ORACLE, "op12_vantage_hard_negatives": hard_negatives.ORACLE, "op13_fill_in_middle": fill_middle.ORACLE}
