"""Queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from . import (
    op1_quality_rules,
    op2_language_id,
    op3_line_dedup,
    op4_mixing,
    op5_substring_dedup,
    op6_ngram_jaccard,
    op7_chat_format,
    op8_quality_crf,
    op9_license_scan,
    op10_decontamination,
    op11_source_divergence,
    op12_periodic_runs,
    op13_packing,
)

QUERIES = {
    "op1_mcd_quality_rules": op1_quality_rules.query,
    "op2_rank_order_language": op2_language_id.query,
    "op3_line_dedup": op3_line_dedup.query,
    "op4_budget_mixing": op4_mixing.query,
    "op5_substring_dedup": op5_substring_dedup.query,
    "op6_ngram_jaccard": op6_ngram_jaccard.query,
    "op7_chat_role_repair": op7_chat_format.query,
    "op8_quality_crf": op8_quality_crf.query,
    "op9_license_scan": op9_license_scan.query,
    "op10_spaced_seed_decontamination": op10_decontamination.query,
    "op11_source_divergence": op11_source_divergence.query,
    "op12_periodic_runs": op12_periodic_runs.query,
    "op13_retrieval_packing": op13_packing.query,
}
ORACLE_SQL = {"op3_line_dedup": op3_line_dedup.ORACLE_SQL, "op5_substring_dedup": op5_substring_dedup.ORACLE_SQL, "op11_source_divergence": op11_source_divergence.ORACLE_SQL}
