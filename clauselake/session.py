"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def recommended_conf(shuffle_partitions: int | None = None) -> dict[str, str]:
    """Settings the operators are tuned for; pass them to the session builder.

    Adaptive execution coalesces small shuffles and splits skewed join partitions, so the shuffle
    partition count may be set for the largest stage.
    """
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.parquet.filterPushdown": "true",
        # Sessions of one key are merged on each task before the shuffle.
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        # Lower-casing is in every text path; the JVM's own tables are several times faster.
        "spark.sql.icu.caseMappings.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return conf


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A local session without the setting gets a fresh temporary folder. On a cluster that would be
    lost with the machine, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clauselake-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    Used where later steps must see the very same rows again, also after lost executors.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    They go when the driver's memory is collected, which without need may come only after the job has filled the disk.
    """
    spark._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that this library has written."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
