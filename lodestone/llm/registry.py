"""The operators' queries, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, decontaminate, jaccard, pieces, pii, quality, secrets, simhash, toxicity, urls
from lodestone.llm.common import load


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": lambda s, d: quality.op1(load(s, d, "documents"), load(s, d, "labels")),
        "op2_chat": lambda s, d: chat.op2(load(s, d, "conversations")),
        "op3_urls": lambda s, d: urls.op3(load(s, d, "pages")),
        "op4_secrets": lambda s, d: secrets.op4(load(s, d, "documents")),
        "op5_pieces": lambda s, d: pieces.op5(load(s, d, "documents")),
        "op6_jaccard": lambda s, d: jaccard.op6(load(s, d, "documents")),
        "op7_pii": lambda s, d: pii.op7(load(s, d, "documents")),
        "op8_simhash": lambda s, d: simhash.op8(load(s, d, "documents")),
        "op8_simhash_near": lambda s, d: simhash.op8_near(load(s, d, "documents")),
        "op9_decontaminate": lambda s, d: decontaminate.op9(load(s, d, "documents"), load(s, d, "benchmark")),
        "op10_toxicity": lambda s, d: toxicity.op10(load(s, d, "documents"), load(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat": chat.ORACLE_SQL, "op3_urls": urls.ORACLE_SQL, "op6_jaccard": jaccard.ORACLE_SQL, "op8_simhash": simhash.ORACLE_SQL, "op8_simhash_near": simhash.NEAR_SQL,
        "op9_decontaminate": decontaminate.ORACLE_SQL,
    }
