"""The corpus operators' queries, and SQL for those that SQL can state."""

from __future__ import annotations

from . import exact_dedup, hard_negatives, lexical_search, line_dedup, mixing, packing, perplexity, personal_data, quality_rules, simhash, substring_dedup, token_counts, token_output

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_perplexity_classifier": perplexity.op7_perplexity_classifier,
    "op8_token_output": token_output.op8_token_output,
    "op9_personal_data": personal_data.op9_personal_data,
    "op10_suffix_array_dedup": substring_dedup.op10_suffix_array_dedup,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
SQL = {"op6_exact_dedup": exact_dedup.SQL, "op11_line_dedup": line_dedup.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_lexical_search": lexical_search.SQL}
