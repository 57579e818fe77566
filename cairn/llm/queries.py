"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, html, jaccard, langid, mixing, neighbours, oracles, quality, sharding, suffixes, tokencount


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array": suffixes.op1,
        "op2_hypergeometric_shards": sharding.op2,
        "op3_string_kernel_languages": langid.op3,
        "op4_tag_path_ratios": html.op4,
        "op5_entropy_balancing": mixing.op5,
        "op6_byte_bpe": bpe.op6,
        "op7_quality_rules": quality.op7,
        "op8_token_counts": tokencount.op8,
        "op9_chosen_path_join": jaccard.op9,
        "op10_graph_neighbours": neighbours.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array": oracles.SUFFIXES, "op7_quality_rules": oracles.QUALITY, "op9_chosen_path_join": oracles.JACCARD}
