"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from parallex.llm import (
    byte_bpe,
    chunk_bpe,
    embedding_dedup,
    hard_negatives,
    importance,
    jaccard_join,
    language_model,
    line_dedup,
    packing,
    quality_mil,
    quality_rules,
    token_counts,
    toxicity,
)


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_packing": packing.op6_packing,
        "op7_quality_classifier": quality_mil.op7_quality_classifier,
        "op8_language_model": language_model.op8_language_model,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_importance_resampling": importance.op11_importance_resampling,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_chunk_bpe": chunk_bpe.op13_chunk_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.oracle(),
        "op11_importance_resampling": importance.oracle(),
        "op12_hard_negatives": hard_negatives.oracle(),
    }
