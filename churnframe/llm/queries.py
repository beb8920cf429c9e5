"""Queries of this subpackage and their DuckDB SQL where it can express them."""

from __future__ import annotations

from churnframe.llm import (
    byte_bpe,
    decontaminate,
    fingerprints,
    hard_negatives,
    packing,
    quality,
    secret_scan,
    simhash,
    substring_dedup,
    token_output,
    toxicity,
    url_filter,
    vector_codes,
)

QUERIES = {
    "op1_token_output": token_output.query,
    "op2_best_fit_packing": packing.query,
    "op3_secret_scan": secret_scan.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_quality_resampling": quality.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_toxicity": toxicity.query,
    "op8_url_filter": url_filter.query,
    "op9_decontamination": decontaminate.query,
    "op10_fingerprints": fingerprints.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_vector_codes": vector_codes.query,
    "op13_byte_bpe": byte_bpe.query,
}

ORACLE = {
    "op4_substring_dedup": substring_dedup.SQL,
    "op8_url_filter": url_filter.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
