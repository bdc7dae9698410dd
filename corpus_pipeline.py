"""A training corpus from raw documents: quality, language, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. What a stage returns is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.llm import decontaminate, langid, packing, quality, simhash
from logweave.llm.common import fold, store, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    forest = quality.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return docs.where(quality.score(F.col("text"), forest) >= 0.5)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near enough to a centroid of a known language."""
    model = langid.train(docs, fold(F.col("doc_id"), 5) != 0)
    return docs.where(langid.identify(F.col("text"), model).getField("accepted"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose fingerprints (four-word shingles) link at 4 or fewer bits."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality", keep_quality), ("language", keep_language), ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated), ("packing", packed),
]
#: Models and similarity groups are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
