"""A training corpus in five stages, each one operator of ``gleanery.llm``.

Every stage gets (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import decontaminate, mixing, near_dedup, pii, quality
from gleanery.llm.common import free, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go.

    Null, empty and blank texts go; repeated rows go or stay together; an empty
    table stays empty; further columns, whatever their names, stay as they are.
    """
    score, keep = names = free(docs.columns, "quality_score"), free(docs.columns, "keep")
    return quality.classify(docs, table(spark, sf_dir, "labels"), names).where(keep).drop(score, keep)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the smallest doc_id.

    Of equal ids the smallest text hash stays, so repeated rows leave one. Rows
    without an id stay only if their class has none with one. Each distinct text
    without words (empty, blank) is kept once for each id, a null text too.
    """
    return near_dedup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are benchmark passages go;
    from the others passages of 13 words or more are cut.

    Null and empty texts have no words and stay; repeated rows are treated alike;
    an empty benchmark changes nothing.
    """
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes.

    Null texts stay null; overlapping spans become one mark; repeated rows are
    treated alike.
    """
    return pii.redacted(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by raked probabilities; ``copies`` says how often.

    Texts without words are not drawn; null sources and languages are groups of
    their own; rows with equal ids and cells are drawn alike.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("private_data", private_data),
    ("mixing_to_targets", mixing_to_targets),
]

#: The classifier, the near-duplicate classes and the span classifier have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
