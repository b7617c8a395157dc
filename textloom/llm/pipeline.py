"""Five stages from raw documents to placed training documents.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next stage's
docs.  All but the last return the columns of documents; the last adds slot and shard.

Rows are what stages keep or drop, so texts that share a doc_id are judged one by one, and rows with a null doc_id too.  A null or
empty text has no language and goes in the first stage.  Null sources are one source.  Columns beyond those of documents are carried
along under any name, but slot and shard, which the last stage replaces.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import byte_cnn, decontaminate, mixing, ngram_jaccard, sharding
from textloom.llm.common import Scratch, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose best language has a mean probability below byte_cnn.MIN_SCORE."""
    return byte_cnn.recognised(docs, byte_cnn.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked documents, that with the smallest doc_id; documents without words stay."""
    return ngram_jaccard.distinct_documents(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources get their target shares, in a globally shuffled order."""
    return mixing.mix(spark, docs).select(*docs.columns)


def shard_placement(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard."""
    return sharding.place(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", shard_placement),
]

#: The first stage is a trained network, which SQL cannot express; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
