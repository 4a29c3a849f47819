"""A corpus pipeline: documents without toxic ones, near copies and benchmark passages, personal data masked, then encoded.

Every stage is written as Parquet and read again by the next. All but the last return the columns
of documents; the last returns the tokens' count and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dispatchery.llm.bpe import digests
from dispatchery.llm.decontamination import drop_contaminated
from dispatchery.llm.pii import redact
from dispatchery.llm.runs import Run
from dispatchery.llm.simhash import drop_near_duplicates
from dispatchery.llm.toxicity import drop_toxic, fit

#: No SQL can state the network, the fingerprints or the tokenizer; tests hold every stage against plain Python.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled rows of the given tables."""
    return drop_toxic(docs, fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of what they decode to."""
    return digests(docs)


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, docs = Run(spark, "pipeline"), _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = kept.keep(stage(spark, docs, sf_dir))
    return docs
