"""From raw documents to encoded training text: five stages, each over all that the one before kept.

Toxic documents go; of equal texts one stays, then of near copies; what is left is repeated or left out until
the sources have their target weights; and is encoded. Whatever a document's columns hold, nulls included, it goes
through; the operators say how.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlink.llm import toxicity
from cohortlink.llm.bpe import encode, n_tokens
from cohortlink.llm.common import remainder, stored, table
from cohortlink.llm.exact import drop_copies
from cohortlink.llm.mixture import mixed
from cohortlink.llm.simhash import drop_near_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns as the query of the operator does, with a fifth of the labels held out."""
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``n_tokens`` and ``ids``, unsigned 32-bit numbers in one binary value."""
    with_ids = docs.withColumn("ids", encode(spark, VOCABULARY)(F.col("text")))
    return with_ids.withColumn("n_tokens", n_tokens(F.col("ids")))


STAGES: list[tuple[str, Stage]] = [("without_toxic", without_toxic), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
                                   ("source_mix", source_mix), ("encoded", encoded)]

# A learned classifier, components and byte-pair merges are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
