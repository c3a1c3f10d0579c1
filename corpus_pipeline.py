"""The corpus pipeline: documents in, packed sequences out, in five stages of written tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telespark.llm import mixing, near_dedup, packing, secrets, toxicity
from telespark.llm.common import discard, materialise, ready, table
from telespark.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    Null and empty texts stay unless the prior alone makes a text without words toxic; long texts are read whole; repeated rows share one fate; a
    score of exactly 0.5 goes; without labels, or rows, everything stays; other columns, whatever their names, are kept.
    """
    ready(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id.

    Null and empty texts, and rows without a doc_id, are nobody's copies and stay; long texts are compared whole; of rows that repeat doc_id and
    text one stays; a similarity of exactly 0.8 is a copy; an empty table stays empty; other columns are kept.
    """
    ready(spark)
    return near_dedup.distinct_documents(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays.

    Null and empty texts stay as they are; long texts are scanned whole; repeated rows change alike; overlapping findings get one mask; an empty
    table stays empty; n_chars follows the text and other columns are kept.
    """
    ready(spark)
    return secrets.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their domains' target weights ask.

    Null and empty texts have no tokens and are taken once; long texts count with all their tokens but are drawn like short ones; repeated rows
    are drawn alike; rows without a doc_id share one draw; without labels everything is taken once; an empty table stays empty; other columns
    are kept.
    """
    ready(spark)
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), mixing.TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places in packed sequences.

    A null text is empty and takes one token; only documents of over 4,096 tokens are cut; repeated rows are packed each for itself; pieces of
    one length are interchangeable and are dealt by a fixed order; an empty table gives an empty table; other columns are left out.
    """
    ready(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", one_of_each),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages learn, hash and tokenise; SQL can't express them, and the tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each on what the one before it kept; a stage's table goes once the next one is written."""
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
