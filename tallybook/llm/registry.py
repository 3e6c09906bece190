"""The numbered queries of this subpackage and their oracles."""

from __future__ import annotations

from tallybook.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

QUERIES = {
    "op1_media_columns": op1.op1_media_columns,
    "op2_ngram_jaccard": op2.op2_ngram_jaccard,
    "op3_line_dedup": op3.op3_line_dedup,
    "op4_best_fit_packing": op4.op4_best_fit_packing,
    "op5_html_extraction": op5.op5_html_extraction,
    "op6_license_scan": op6.op6_license_scan,
    "op7_decontamination": op7.op7_decontamination,
    "op8_sharding": op8.op8_sharding,
    "op9_url_filters": op9.op9_url_filters,
    "op10_language_id": op10.op10_language_id,
    "op11_importance_resampling": op11.op11_importance_resampling,
    "op12_conversation_trie": op12.op12_conversation_trie,
    "op13_substring_dedup": op13.op13_substring_dedup,
}
ORACLES = {
    "op2_ngram_jaccard": op2.ORACLE,
    "op6_license_scan": op6.ORACLE,
    "op7_decontamination": op7.ORACLE,
    "op9_url_filters": op9.ORACLE,
    "op11_importance_resampling": op11.ORACLE,
    "op12_conversation_trie": op12.ORACLE,
    "op13_substring_dedup": op13.ORACLE,
}
