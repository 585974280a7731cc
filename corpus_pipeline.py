"""A corpus pipeline of five stages; each reads what the one before wrote.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents kept, with all their columns, and in
the last stage the documents' byte-level BPE ids, digested as in query op2.

Cases, for every stage: null and empty texts have no language and go in the first stage; rows with a null doc_id
are judged by their text and pass the join; rows that repeat a doc_id and its text are reduced to one by the join, rows
that share a doc_id only are documents of their own; an empty table stays empty; further columns pass through all but the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loredeck.llm import op2_bpe, op6_language, op7_jaccard, op9_toxicity, op10_decontaminate
from loredeck.llm.common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough certainty, by a model of the documents table."""
    return op6_language.keep_identified(docs, op6_language.learned(table(spark, sf_dir, "documents")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a machine fitted on the labelled documents."""
    return op9_toxicity.keep_civil(docs, op9_toxicity.learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return op7_jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return op10_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length and digests of the documents' ids."""
    return op2_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Trained models decide the first two stages, so SQL can't express the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
