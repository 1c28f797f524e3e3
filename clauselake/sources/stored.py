"""Stored tables whose rows lie in buckets of their key, so that an update rewrites only what it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.operators.keyed import first_per_key, insert_if_absent, upsert
from clauselake.session import durable, remove

BUCKET = "key_bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_stored(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write ``df`` with a folder per bucket of its key. The number of buckets stays for the life of the table:
    choose it so that a bucket holds a task's worth of rows or a few."""
    df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of the table. Null, not an error, stands for columns that older files don't have if ``schema`` names them."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, {BUCKET} int")
    return reader.parquet(path).drop(BUCKET)


def _rewrite(rows: DataFrame, path: str) -> None:
    # Written to the shared folder first: the new state is read from the folders it replaces.
    durable(rows).repartition(F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(BUCKET).parquet(path)
    rows.sparkSession.catalog.refreshByPath(path)


def _touched(spark: SparkSession, path: str, rows: DataFrame, buckets: int) -> tuple[list[int], DataFrame]:
    """Buckets that ``rows`` fall into (at most ``buckets`` numbers), and the stored rows of these alone."""
    found = sorted(r[0] for r in rows.select(BUCKET).distinct().limit(buckets + 1).collect())
    if found and not 0 <= found[0] <= found[-1] < buckets:
        raise ValueError("a bucket lies outside the table")
    return found, spark.read.parquet(path).where(F.col(BUCKET).isin(found))


def upsert_stored(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  buckets: int, keep: Sequence[str] = ()) -> int:
    """Insert or update in the stored table; returns the number of buckets that were rewritten.

    The newest update per key wins, as in ``keyed.upsert``. Only buckets with an update are read and replaced,
    folder by folder; the files of the others stay as they are. A row with a null in its key is inserted. One writer at a
    time; a reader that begins meanwhile sees each bucket before or after the update. Repeating an update that failed
    half-way gives the same table.
    """
    newest = durable(first_per_key(updates, keys, order).withColumn(BUCKET, bucket_of(keys, buckets)))
    found, base = _touched(spark, path, newest, buckets)
    if found:
        plain = upsert(base.drop(BUCKET), newest.drop(BUCKET), keys, [F.lit(0)], keep)
        _rewrite(plain.withColumn(BUCKET, bucket_of(keys, buckets)), path)
    return len(found)


def insert_stored(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], buckets: int,
                  order: Sequence[Column] = ()) -> int:
    """Add rows whose key the stored table does not have, touching only their buckets; returns the number of those."""
    fresh = durable(rows.withColumn(BUCKET, bucket_of(keys, buckets)))
    found, base = _touched(spark, path, fresh, buckets)
    if found:
        _rewrite(insert_if_absent(base.drop(BUCKET), fresh.drop(BUCKET), keys, order).withColumn(BUCKET, bucket_of(keys, buckets)), path)
    return len(found)


def delete_stored(spark: SparkSession, path: str, doomed: DataFrame, keys: Sequence[str], buckets: int) -> int:
    """Delete the keys in ``doomed``; a bucket that becomes empty keeps no file. Returns the buckets that were touched."""
    gone = durable(doomed.select(*keys).distinct().withColumn(BUCKET, bucket_of(keys, buckets)))
    found, base = _touched(spark, path, gone, buckets)
    if found:
        left = durable(base.join(gone.select(*keys), list(keys), "left_anti").select(*base.columns))
        there = {r[0] for r in left.select(BUCKET).distinct().collect()}
        _rewrite(left, path)
        # Overwriting by folder can't empty a folder.
        for b in set(found) - there:
            remove(spark, f"{path}/{BUCKET}={b}")
        spark.catalog.refreshByPath(path)
    return len(found)
