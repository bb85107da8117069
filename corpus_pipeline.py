"""From raw documents to packed batches: five stages, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import language_id, near_dedup, packing, quality_rules, secret_scan
from marlstone.llm.common import discard, exists, materialize, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known from text, markup, address and host; a corpus without pages has no markup."""
    pages = f"{sf_dir}/pages.parquet"
    evidence = language_id.page_evidence(spark.read.parquet(pages)) if exists(spark, pages) else None
    return language_id.keep_identified(docs, evidence=evidence)


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked."""
    return secret_scan.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document: its bucket, batch and slot."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", rate_quality),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Robust estimates and verified similarity classes have no SQL. The stages are tested on one constructed table, their operators by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written as Parquet and read again.

    What a stage has written on its way is deleted when its result is written.
    Null, empty and very long texts, repeated rows, null ids and extra columns
    pass through every stage by the rules that its operator states; an empty
    table gives an empty table.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            after = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
