"""Queries of this subpackage and their DuckDB SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trawldex.llm import q_chat, q_decontam, q_licenses, q_lines, q_mixing, q_ngram, q_quality, q_repair, q_sharding, q_spelling, q_suffix, q_tokens, q_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": q_chat.op1_chat_format,
        "op2_decontaminate": q_decontam.op2_decontaminate,
        "op3_warc_revisits": q_warc.op3_warc_revisits,
        "op4_jump_shards": q_sharding.op4_jump_shards,
        "op5_license_scan": q_licenses.op5_license_scan,
        "op6_mix_weights": q_mixing.op6_mix_weights,
        "op7_token_rollup": q_tokens.op7_token_rollup,
        "op8_suffix_dedup": q_suffix.op8_suffix_dedup,
        "op9_ngram_jaccard": q_ngram.op9_ngram_jaccard,
        "op10_quality_rules": q_quality.op10_quality_rules,
        "op10_policy_ablation": q_quality.op10_policy_ablation,
        "op11_spelling_variants": q_spelling.op11_spelling_variants,
        "op12_line_dedup": q_lines.op12_line_dedup,
        "op13_conversation_repair": q_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": q_chat.OP1_SQL,
        "op2_decontaminate": q_decontam.OP2_SQL,
        "op3_warc_revisits": q_warc.OP3_SQL,
        "op8_suffix_dedup": q_suffix.OP8_SQL,
        "op9_ngram_jaccard": q_ngram.OP9_SQL,
        "op10_quality_rules": q_quality.OP10_SQL,
        "op10_policy_ablation": q_quality.OP10_ABLATION_SQL,
        "op11_spelling_variants": q_spelling.OP11_SQL,
        "op12_line_dedup": q_lines.OP12_SQL,
        "op13_conversation_repair": q_repair.OP13_SQL,
    }
