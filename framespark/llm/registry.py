"""The opN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framespark.llm import conversations, decontaminate, mixing, near_dups, pii, quality, resampling, rule_ensemble, sentence_spans, suffix_dedup, token_counts, token_ids, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_near_duplicates": near_dups.op3_near_duplicates,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_mixing": mixing.op5_mixing,
        "op6_sentence_spans": sentence_spans.op6_sentence_spans,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_token_ids": token_ids.op9_token_ids,
        "op10_pseudonyms": pii.op10_pseudonyms,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_quality_classifier": rule_ensemble.op12_quality_classifier,
        "op13_conversation_repair": conversations.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_importance_resampling": resampling.SQL, "op13_conversation_repair": conversations.SQL}
