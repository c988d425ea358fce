"""Documents to training ids: language, near duplicates, benchmark leaks, personal data, pieces.

Every stage takes (spark, docs, sf_dir), works on all rows it gets and returns
a DataFrame; all but the last return the columns of ``documents``. ``run`` writes
each stage's rows as Parquet under the shared checkpoint folder and reads them
again, so that no stage is computed twice and lost executors cost one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm import decontaminate, langid, neardup, pieces, pii
from txnwatch.llm.tables import DOCUMENT_COLUMNS, prepare, read
from txnwatch.llm.tokens import scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is not clear, go."""
    prepare(spark)
    return langid.with_known_language(docs, DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    prepare(spark)
    return neardup.without_near_duplicates(docs.select(*DOCUMENT_COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    prepare(spark)
    return decontaminate.without_overlaps(docs.select(*DOCUMENT_COLUMNS), read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks; all documents stay."""
    prepare(spark)
    return pii.redact(docs.select(*DOCUMENT_COLUMNS))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids and whether decoding gives the text back."""
    prepare(spark)
    out = pieces.encode(docs, pieces.load(spark))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentence_pieces", sentence_pieces),
]

#: Fitted models and set joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    root = scratch(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
