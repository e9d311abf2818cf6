"""A corpus pipeline: rejects toxic and poor documents, near copies, mixes sources, and makes tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage
before it kept, and is written as Parquet before the next one reads it. All
but the last return the columns of ``documents``. Models are fitted on the
labels of ``sf_dir``. Each stage's treatment of nulls, empty and very long
texts, ties, repeated rows, empty tables and other columns is that of the
operator it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, mixing, ngram_join, quality, toxicity
from quern.llm.common import new_dir, shared_dir, table

#: Every document that is left is used at least once, and none more than twice.
MIXTURE = mixing.Target(repeats=2.0, cover=True)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of their blocks; a repeated row comes as often as its source is read."""
    return mixing.mix(docs, MIXTURE).select(*[f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [("toxicity", toxic), ("quality", good), ("ngram_join", distinct), ("mixing", mixed), ("bpe", tokens)]

#: No SQL expresses the first two stages; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
