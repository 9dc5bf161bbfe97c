"""The operators' queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from spindle.llm import embedding_dedup, html_text, jaccard_join, mixing, packing, perplexity, quality_rules, substring_dedup, suffix_dedup, tokens

QUERIES = {
    "op1_token_counts": tokens.query,
    "op2_mixing": mixing.query,
    "op3_quality_rules": quality_rules.query,
    "op4_suffix_array_dedup": suffix_dedup.query,
    "op5_packing": packing.query,
    "op6_quality_classifier": perplexity.query,
    "op7_html_extraction": html_text.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_embedding_near_dedup": embedding_dedup.query,
    "op10_jaccard_join": jaccard_join.query,
}

ORACLES = {"op2_mixing": mixing.SQL}
