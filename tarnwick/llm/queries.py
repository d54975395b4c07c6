"""Queries and SQL of this package, for ``__spark_entry__``."""

from __future__ import annotations

from . import histogram, jaccard, language, mixing, negatives, packing, pii, quality, substrings, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_language_id": language.query,
        "op2_mix_sources": mixing.query,
        "op3_warc_captures": warc.query,
        "op4_exact_top_k": topk.query,
        "op5_substring_dedup": substrings.query,
        "op6_best_fit_packing": packing.query,
        "op7_personal_data": pii.query,
        "op8_jaccard_components": jaccard.query,
        "op9_toxicity": toxicity.query,
        "op10_quality_rules": quality.query,
        "op11_packing": histogram.query,
        "op12_hard_negatives": negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_captures": warc.SQL,
        "op4_exact_top_k": topk.SQL,
        "op5_substring_dedup": substrings.SQL,
        "op8_jaccard_components": jaccard.SQL,
        "op10_quality_rules": quality.SQL,
        "op12_hard_negatives": negatives.SQL,
    }
