"""The queries of this folder, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kithgraph.llm import exact_dedup, jaccard_join, language_id, lm_scoring, orchard, packing, personal_data, piece_coding, quality_rules, substring_dedup, suffix_dedup, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_personal_data": personal_data.op11_personal_data,
    "op12_centroid_clustering": orchard.op12_centroid_clustering,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_sentencepiece": piece_coding.op3_sentencepiece,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
}

ORACLES: dict[str, str] = {
    "op12_centroid_clustering": orchard.ORACLE,
    "op4_ngram_jaccard_join": jaccard_join.ORACLE,
    "op5_url_filters": url_filter.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_language_id": language_id.ORACLE,
    "op9_suffix_array_dedup": suffix_dedup.ORACLE,
}
