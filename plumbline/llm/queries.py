"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import jaccard, leaks, lines, mixing, passages, perplexity, quality, rules, sharding, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_line_rules": rules.op2_line_rules,
    "op3_sharding": sharding.op3_sharding,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_suffix_dedup": passages.op7_suffix_dedup,
    "op8_lm_scoring": perplexity.op8_lm_scoring,
    "op9_decontamination": leaks.op9_decontamination,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op2_line_rules": rules.ORACLE,
    "op4_source_mix": mixing.ORACLE,
    "op5_line_dedup": lines.ORACLE,
}
