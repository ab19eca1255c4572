"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_extract, jaccard_join, line_dedup, lm_scoring, packing, prefix_trie, quality, substring_dedup, suffix_dedup, token_store, vector_codes

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_wavelet_tokens": token_store.op5_wavelet_tokens,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality_qda": quality.op10_quality_qda,
    "op11_html_extraction": html_extract.op11_html_extraction,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op2_ngram_jaccard_join": jaccard_join.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
