"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fill_middle, jaccard_join, mixing, quality_rules, secret_scan, source_divergence, suffix_dedup, token_count, token_store, topk, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_token_counts": token_count.op6_token_counts,
    "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_token_store": token_store.op10_token_store,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": url_filter.OP1_SQL,
    "op2_secret_scan": secret_scan.OP2_SQL,
    "op5_exact_top_k": topk.OP5_SQL,
    "op8_benchmark_decontamination": decontaminate.OP8_SQL,
    "op9_source_mixing": mixing.OP9_SQL,
    "op11_source_divergence": source_divergence.OP11_SQL,
    "op12_quality_rules": quality_rules.OP12_SQL,
    "op13_fill_in_middle": fill_middle.OP13_SQL,
}
