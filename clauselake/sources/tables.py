"""Table scans and partition balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet scan; with a schema no file is opened to infer one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int,
                    partitions: int, **options: str) -> DataFrame:
    """Database table read in ranges of a numeric key; filters and columns are pushed down."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low),
                 upperBound=str(high), numPartitions=str(partitions), **options)
        .load()
    )


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Spread a table of few files over the cores before heavy per-row text work.

    A table that is scanned in as many tasks as there are cores is returned as it is; what is shuffled
    is less than one task's input (``spark.sql.files.maxPartitionBytes``) for each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, F.col(key))
