"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokenization.

Each stage is (name, function) of (spark, docs, sf_dir) and works on all its predecessor
kept; all but the last return the columns of documents. Part of the training-data
subpackage: it goes when that goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe, crf, decontaminate, line_dedup, simhash
from lexweave.llm.queries import vocabulary
from lexweave.llm.shared import Scratch

#: Least mean marginal of a document's language.
SURE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best language is not sure."""
    model = crf.fit(docs)
    return crf.keep_identified(docs, model, SURE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; documents with nothing left go. n_chars follows the text."""
    out = line_dedup.dedup(docs, Scratch(spark))
    kept = out.where("NOT (n_deleted > 0 AND n_deleted = n_lines)").withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_first(docs, Scratch(spark))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document kept, as counts and digests."""
    return bpe.encode_decode(docs, vocabulary())


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontaminate", decontaminated), ("bpe", tokenized)]

#: The language model has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        before, docs = docs, scratch.store(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
