"""The corpus pipeline: language, near-duplicates, benchmark passages, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import decontaminate, langid, mixing, sharding, simhash
from sluice.llm.shared import Scratch
from sluice.sources.scratch import passing


#: Documents are near-duplicates if sets of so many words in a row share at least this part of their union.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows; it learns from the labels of the stage's own input.

    Documents without text or letters go. Repeated rows are judged alike and stay; other columns are as they were.
    """
    return langid.keep_known(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles, that with the smallest id.

    Texts without words are one group. Of rows with the same id and text one stays; a group of null ids keeps one row.
    """
    return simhash.keep_one(docs, n=SHINGLE_WORDS, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth or more of their words in benchmark passages. Null texts have no words and stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources has them, in the order of its blocks; the budget is the stage's input.

    Null sources are one source; sources without words are left out. Rows equal in id and text are taken together.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document (or copy of one) with its shard and slot; null texts are of no bytes, null ids are placed like others."""
    found = sharding.shard(docs)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Hashes, fingerprints and the trained model have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing():  # a stage's own tables go once its result is written
            found = scratch.save(stage(spark, docs, sf_dir), name)
        docs = found.read()
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
