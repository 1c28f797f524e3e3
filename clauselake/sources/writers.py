"""Writers: term tables, appended rows, replaced tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.operators.corpus import top_terms


def write_frequencies(words: DataFrame, bigrams: DataFrame, path: str, top_words: int = 1000,
                      top_bigrams: int = 500) -> None:
    """Most frequent words and bigrams as JSON lines."""
    top_terms(words, top_words).coalesce(1).write.mode("overwrite").json(f"{path}/words")
    top_terms(bigrams, top_bigrams).coalesce(1).write.mode("overwrite").json(f"{path}/bigrams")


def write_keywords(keywords: DataFrame, path: str) -> None:
    """Keywords as JSON lines, one folder per category."""
    keywords.write.mode("overwrite").partitionBy("category").json(path)


def append_examples(examples: DataFrame, path: str) -> None:
    """Add training rows."""
    examples.write.mode("append").parquet(path)


def write_versions(versions: DataFrame, path: str) -> None:
    """Version table by policy type; a type with most rows still gets many files, because rows
    are dealt by domain and hash inside it."""
    versions.repartition(F.col("policy_type"), F.pmod(F.xxhash64("domain", "content_hash"),
                                                       F.lit(64))).write.mode(
        "overwrite"
    ).partitionBy("policy_type").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a Parquet table that ``df`` may have been read from.

    The new state is written beside the old one, then the folders change names. One writer at a
    time; a reader sees the old or the new table. The old state stays under ``<path>__before``
    until the next replacement.
    """
    spark = df.sparkSession
    fresh, before = f"{path}__next", f"{path}__before"
    df.write.mode("overwrite").parquet(fresh)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(before)
    if fs.exists(hadoop):
        fs.delete(old, True)
        if not fs.rename(hadoop, old):
            raise OSError(f"could not set {path} aside")
    if not fs.rename(new, hadoop):
        raise OSError(f"could not move the new state to {path}")
    spark.catalog.refreshByPath(path)


def read_state(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    """State table, or ``empty`` before the first write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(empty.schema).parquet(path) if fs.exists(hadoop) else empty
