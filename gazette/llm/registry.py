"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from gazette.llm import op1_warc, op2_suffix_dedup, op3_bpe, op4_url_filter, op5_substring_dedup, op6_host_rules, op7_simhash, op8_token_files, op9_quality_classifier, op10_decontamination, op11_embedding_near_dedup, op12_hard_negatives, op13_spelling_variants

_MODULES = (op1_warc, op2_suffix_dedup, op3_bpe, op4_url_filter, op5_substring_dedup, op6_host_rules, op7_simhash, op8_token_files, op9_quality_classifier, op10_decontamination, op11_embedding_near_dedup, op12_hard_negatives, op13_spelling_variants)


def _name(module) -> str:
    return module.__name__.rsplit(".", 1)[-1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {_name(m): getattr(m, _name(m)) for m in _MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {_name(m): m.ORACLE_SQL for m in _MODULES if getattr(m, "ORACLE_SQL", None)} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
