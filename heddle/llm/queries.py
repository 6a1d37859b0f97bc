"""The queries of this subpackage: name -> function of (spark, sf_dir), and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff_lm, chat_windows, decontamination, exact_dedup, fill_in_middle, language_id, mixing, near_dup, quality_cnn, source_divergence, substring_dedup, url_filter, vector_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dup": near_dup.query,
    "op2_backoff_lm": backoff_lm.query,
    "op3_chat_windows": chat_windows.query,
    "op4_quality_cnn": quality_cnn.query,
    "op5_url_filter": url_filter.query,
    "op6_mixing": mixing.query,
    "op7_vector_topk": vector_topk.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_language_id": language_id.query,
    "op10_decontamination": decontamination.query,
    "op11_source_divergence": source_divergence.query,
    "op12_exact_dedup": exact_dedup.query,
    "op13_fill_in_middle": fill_in_middle.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dup": near_dup.SQL,
    "op3_chat_windows": chat_windows.SQL,
    "op5_url_filter": url_filter.SQL,
    "op7_vector_topk": vector_topk.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op11_source_divergence": source_divergence.SQL,
    "op12_exact_dedup": exact_dedup.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
