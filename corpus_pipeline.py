"""A corpus pipeline over `documents`: each stage gets what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillfen.llm import bpe, decontamination, privacy, simhash, toxicity


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by fingerprints of three-word shingles at 3 or fewer differing bits stays."""
    return simhash.keep_one(docs, words=3, distance=3)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced; every document stays."""
    return privacy.sanitise(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token ids, checked by decoding them again."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", toxic_texts),
    ("simhash", near_copies),
    ("decontamination", benchmark_passages),
    ("privacy", personal_data),
    ("bpe", token_ids),
]

#: SQL has no SimHash components, no recurrent network and no BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
