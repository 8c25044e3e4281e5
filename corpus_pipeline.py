"""A corpus pipeline of five stages over ``documents``, each one of the training-data operators.

Every stage works on all that the one before it kept. All but the last return
the columns of documents, further columns included; the last returns the packed
pieces.

A null or empty text fails the base rule of the first stage and goes. Nulls in
lang and source are a group of their own there, and a null source is a source
of the mix; lang is never read as input of a prediction. Rows that are repeated
are copies of one another: near dedup keeps the one of the lowest doc_id, and
one without an id only where all lack it. Rows with one doc_id but unlike texts are documents of their
own. An empty table, or one of which nothing is left after a stage, gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lernspur.llm import langid, mixing, neardup, packing, quality
from lernspur.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the adaptive fences of their language and source."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows with a score of at least 0.3, which texts in a language never learned do not reach."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.take_mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in windows of 1024."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("pack windows", pack_windows),
]

#: The language model, near-duplicate classes and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn; each result is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
