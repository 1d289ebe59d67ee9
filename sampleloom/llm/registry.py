"""The queries of this subpackage and, where SQL can express them, the same results in SQL."""

from __future__ import annotations

from sampleloom.llm import bpe, decontaminate, hard_negatives, html_extract, language_id, lexical_search, license_scan, personal_data, quality_rules, simhash_dedup, token_counts, training_order, url_filters

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_language_id": language_id.op3_language_id,
    "op4_simhash_dedup": simhash_dedup.op4_simhash_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_training_order": training_order.op7_training_order,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_personal_data": personal_data.op12_personal_data,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op9_url_filters": url_filters.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
