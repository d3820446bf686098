"""Queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from quire.llm import (
    embedding_dedup, importance_resampling, jaccard_join, language_id, line_dedup, mixing, packing, quality, secrets, substring_dedup, suffix_dedup, url_filter, vector_codes,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_language_id": language_id.op7_language_id,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_importance_resampling": importance_resampling.op12_importance_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = {"op2_mix_sources": mixing.SQL, "op3_url_filter": url_filter.SQL, "op11_line_dedup": line_dedup.SQL, "op12_importance_resampling": importance_resampling.SQL}
