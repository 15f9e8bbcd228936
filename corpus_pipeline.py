"""The training-data pipeline: documents in, a decontaminated, deduplicated and balanced mix out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps.
``run`` writes each stage's result to the shared folder and reads it again as the next stage's input, so a lost
executor costs the tasks of one stage at most.

All stages take null texts as empty ones, rows without doc_id as rows of their own, very long texts whole and repeated rows
one by one (but the near-copy stage, see there); an empty table gives an empty one. Other columns are passed on as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrove.llm import decontamination, mixing, ngram_join, quality_classifier, secret_scan
from notegrove.llm.common import documents, free, small_batches, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; equal texts share their score."""
    small_batches(spark)
    ranker = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free("score", docs.columns)
    return quality_classifier.scored(docs, ranker, docs.columns, name=score).where(F.col(score) >= quality_classifier.CUT).drop(score)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each component of near copies (rows without doc_id come last), one of rows
    that are equal in doc_id and text, and every row without words. Rows are told apart by doc_id and text."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every occurrence of a benchmark window out of the texts."""
    small_batches(spark)
    return decontamination.removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; a document without any stays as it is."""
    small_batches(spark)
    return secret_scan.redacted(docs, secret_scan.trained(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with their size, their source's size and target and the words taken of them (columns
    size, source_size, target and taken, with underscores before a name that the input has already). Each row has what the mix
    takes of it alone, rows without doc_id and repeated rows too, so the words taken of a source come near its target."""
    small_batches(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_join", keep_one_of_near_copies),
    ("decontamination", cut_benchmark_passages),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL expresses neither the classifier nor the draws; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
