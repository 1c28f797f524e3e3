"""Helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.session import durable, shared_folder

__all__ = ["durable", "held_out", "keep_small", "remove", "shared_folder", "table", "texts", "whole_text"]

BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_small(spark: SparkSession) -> None:
    """Arrow batches of at most 512 rows, so that a batch of very long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library has written, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(key: Column, parts: int, rest: int) -> Column:
    """True where the CRC-32 of the key's decimal text leaves ``rest``; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == rest, F.lit(False))


def texts(batches: Iterator[pa.RecordBatch], at: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch with the Python strings of its column ``at``; null becomes empty."""
    for batch in batches:
        yield batch, [t or "" for t in batch.column(at).to_pylist()]
