"""The queries of this subpackage, by name, and their oracle SQL."""

from __future__ import annotations

from skein.llm import additive_ann, chat_format, embed_dedup, hard_negatives, language_id, licenses, mixing, ngram_join, packing, pii, quality_model, quality_rules, spelling


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1,
        "op2_language_id": language_id.op2,
        "op3_quality_classifier": quality_model.op3,
        "op4_license_scan": licenses.op4,
        "op5_embedding_dedup": embed_dedup.op5,
        "op6_source_mix": mixing.op6,
        "op7_retrieval_packing": packing.op7,
        "op8_quality_rules": quality_rules.op8,
        "op9_pii": pii.op9,
        "op10_chat_format": chat_format.op10,
        "op11_additive_ann": additive_ann.op11,
        "op12_spelling_variants": spelling.op12,
        "op13_hard_negatives": hard_negatives.op13,
    }


def oracle_sql() -> dict:
    return {
        "op1_ngram_join": ngram_join.ORACLE_SQL,
        "op5_embedding_dedup": embed_dedup.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op10_chat_format": chat_format.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
