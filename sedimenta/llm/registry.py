"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from sedimenta.llm import byte_bpe, decontaminate, line_dedup, lm_score, ngram_join, quality_rules, secret_scan, substring_dedup, token_counts, token_store


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_token_store": token_store.op6_token_store,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_lm_score": lm_score.op9_lm_score,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE,
        "op3_line_dedup": line_dedup.ORACLE,
        "op4_decontaminate": decontaminate.ORACLE,
        "op5_quality_rules": quality_rules.ORACLE,
        "op7_ngram_join": ngram_join.ORACLE,
    }
