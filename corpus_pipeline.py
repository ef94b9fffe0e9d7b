"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept and returns a frame; ``run`` writes it as Parquet below the shared folder and
reads it back, so that a lost executor repeats a stage at most. The first four
return the columns of documents, the last the pieces of the packed sequences with their token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.llm import decontamination, packing, quality_classifier, quality_rules, simhash
from tokentide.llm.common import table
from tokentide.session import staged


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_classifier.good_documents(docs, table(spark, sf_dir, "labels"))


def orderly_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences, with their ids."""
    # a smaller cache than alone: the workers of this session also run the other stages
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cached=100_000)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", good_documents),
    ("quality_rules", orderly_documents),
    ("simhash_dedup", one_of_each_group),
    ("decontamination", clean_documents),
    ("packing", packed_sequences),
]

#: SQL cannot express the fitted stages; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
