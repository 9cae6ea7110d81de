"""The registered query of each operator, over its whole tables, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, collocations, decontamination, jaccard_join, lexical_search, perplexity, quality_ratio, secret_scan, sharding, simhash, token_records, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1,
    "op1_items": decontamination.op1_items,
    "op2_quality_ratio": quality_ratio.op2,
    "op3_records": token_records.op3,
    "op4_perplexity": perplexity.op4,
    "op5_jaccard": jaccard_join.op5,
    "op6_chat": chat.op6,
    "op7_sharding": sharding.op7,
    "op8_secrets": secret_scan.op8,
    "op9_bpe": bpe.op9,
    "op10_toxicity": toxicity.op10,
    "op11_lexical": lexical_search.op11,
    "op12_collocations": collocations.op12,
    "op13_simhash": simhash.op13,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op1_items": decontamination.ORACLE_ITEMS,
    "op2_quality_ratio": quality_ratio.ORACLE,
    "op5_jaccard": jaccard_join.ORACLE,
    "op6_chat": chat.ORACLE,
    "op8_secrets": secret_scan.ORACLE,
    "op11_lexical": lexical_search.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
