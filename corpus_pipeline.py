"""From raw documents to shards of a clean, mixed corpus.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read again as the next one's docs. All but the last
return the columns of documents.

Defined results: null and empty texts have no known language and go in the first stage; null
ids stay, and rows are told apart by id and text; equal rows are one group; an empty table
gives an empty result; columns beyond those of documents are carried along, but for
shard, shard_depth and shard_bytes, which the last stage sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontam, langid, mixing, ngram_join, sharding, storage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a language is known for all others."""
    return langid.keep_known(spark, docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the smallest id stays."""
    return ngram_join.keep_first(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.apply_mix(spark, docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard."""
    return sharding.shard(spark, docs)


STAGES = [("language_id", known_language), ("ngram_join", one_of_each_group), ("decontaminate", without_benchmark), ("mix", mixed), ("shard", sharded)]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; a stage's table is deleted once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with storage.scope(spark) as own:
            docs = own.keep(storage.save(spark, stage(spark, before, sf_dir), name))
        storage.drop(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
