"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontaminate, hard_negatives, jaccard_join, language_id, licenses, mixing, periodic_runs, quadratic, quality_rules, simhash, suffix_dedup, token_counts, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": suffix_dedup.op1_suffix_dedup, "op2_quality_rules": quality_rules.op2_quality_rules, "op3_licenses": licenses.op3_licenses, "op4_mix": mixing.op4_mix, "op5_jaccard_join": jaccard_join.op5_jaccard_join, "op6_token_store": token_store.op6_token_store, "op7_token_counts": token_counts.op7_token_counts, "op8_decontaminate": decontaminate.op8_decontaminate, "op9_quadratic": quadratic.op9_quadratic, "op10_language_id": language_id.op10_language_id, "op11_simhash": simhash.op11_simhash, "op12_periodic_runs": periodic_runs.op12_periodic_runs, "op13_hard_negatives": hard_negatives.op13_hard_negatives}


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licenses.sql(), "op4_mix": mixing.SQL, "op8_decontaminate": decontaminate.sql(), "op13_hard_negatives": hard_negatives.SQL}
