"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from lodestone.llm import chat, exact_dedup, fingerprints, language, line_dedup, mixing, near_dedup, packing, token_counts, toxicity

QUERIES = {
    "op1_packing": packing.query,
    "op2_line_dedup": line_dedup.query,
    "op3_chat_formatting": chat.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_near_dedup": near_dedup.query,
    "op6_fingerprints": fingerprints.query,
    "op7_mixing": mixing.query,
    "op8_language": language.query,
    "op9_token_counts": token_counts.query,
    "op10_toxicity": toxicity.query,
}
ORACLES = {"op4_exact_dedup": exact_dedup.SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
