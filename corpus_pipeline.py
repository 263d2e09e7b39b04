"""The corpus pipeline: quality rules, line dedup, near-dedup, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.llm import isolation, linededup, packing, queries, similar, surrogates
from planewise.llm.common import forget_at_exit, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and no forest finds anomalous."""
    return isolation.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in many of them."""
    return linededup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the least doc_id."""
    return similar.keep_one(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced, by the key in the session's setting."""
    return surrogates.replaced(docs, spark.conf.get(surrogates.KEY_SETTING, queries.SAMPLE_KEY))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii_surrogates", pii_surrogates), ("packing", packed)]

#: Forests, fingerprints by XXH64, keyed surrogates and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; between them tables in the shared folder, removed when the session ends.

    A null text counts as an empty one and fails the base rules; rows of equal texts are
    one group, of which the least doc_id stays; rows without a doc_id stay apart; an
    empty table packs nothing; further columns of ``documents``, whatever their names,
    go through all stages but the last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    forget_at_exit(spark, base)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
    return docs.select(*(F.col(c) for c in docs.columns))
