"""From documents to a mixed training corpus: five stages, each written before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import decontaminate, lines, mixing, quality, simhash
from clauselake.llm.common import held_out, remove, shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; the held-out labels of its query teach it nothing here either."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), skip=held_out(F.col("doc_id"), 4, 2))
    return quality.scored(docs, model, into=("__score", "__good")).where("__good = 1").select(*docs.columns)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines of a recurring template stay in its first document only."""
    return lines.drop_recurring_lines(docs, into=("__cut", "__left")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once; rows without id stay."""
    first = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    # Both steps use the same partitioning by id.
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without id can't be told apart and stay."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the rate at which it is to be read, its domain and its tokens."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_recurring_lines),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", to_target_weights),
]

#: The classifiers and the fingerprints can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read again.

    A stage's table is removed once the next one is written; the last one stays, as the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
    return docs
