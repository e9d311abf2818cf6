"""Registered queries of the operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, html_extract, mixing, ngram_join, nn_descent, orc_tokens, quality, sharding, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_html": html_extract.op3_html,
        "op4_quality": quality.op4_quality,
        "op5_nn_descent": nn_descent.op5_nn_descent,
        "op6_sharding": sharding.op6_sharding,
        "op7_bpe": bpe.op7_bpe,
        "op8_topk": topk.op8_topk,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_orc": orc_tokens.op10_orc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.ORACLE_SQL,
        "op2_ngram_join": ngram_join.ORACLE_SQL,
        "op5_nn_descent": nn_descent.ORACLE_SQL,
        "op6_sharding": sharding.ORACLE_SQL,
        "op8_topk": topk.ORACLE_SQL,
    }
