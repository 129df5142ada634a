"""A corpus from raw documents: good ones, once each, without long repeats, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumforge.llm import exact_dedup, minhash, packing, quality, suffix_dedup
from sumforge.llm._shared import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; without labels, all. A null text is judged as an empty one."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents that are equal without white space; null counts as empty, rows without an id come last."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near-duplicates, by five-word shingles and a similarity of 0.8 or more.

    Documents without words and rows without an id stay.
    """
    return minhash.keep_one(docs, shingle=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of any run of 50 words that occurs elsewhere too; null texts stay null."""
    return suffix_dedup.cut_texts(docs, chars_col="n_chars", words=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; an empty or null text is an end mark alone."""
    return packing.pack(docs)


STAGES = [("quality", good), ("exact", exact), ("near", near), ("suffix", repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)


#: The classifier, the near-duplicate groups and the packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
