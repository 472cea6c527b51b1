"""The corpus pipeline: toxicity, near duplicates, decontamination, source mixing and the token store, in this order.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes each stage's rows as
Parquet in the shared folder and reads them back for the next.  All stages but the last return the columns of
``docs``.

Defined cases, stage by stage as in the operators' own texts: rows with a null text, or one without words, are never
toxic, near copies or contaminated and pass on; rows with a null id are kept by the near-duplicate stage, and of repeated rows
(equal id and set of n-grams) it keeps one; of equal ids in a class the least id stays, ties go to the least set key; the
other stages judge repeated rows one by one; very long texts are rows like any other; further columns of any name travel
along (the token store returns its own); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrapanel.llm import decontaminate, jaccard_join, mixing, token_store, toxicity
from terrapanel.llm.tables import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity cut; the index is fitted to labelled documents of ``docs`` that are not held out."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.unheld))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return jaccard_join.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words lie in benchmark windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their weights."""
    return mixing.apply_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a document of the token store, read back from its files."""
    return token_store.store_and_verify(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_store", write_tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
