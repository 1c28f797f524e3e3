"""Large JSON arrays of objects, read by many tasks.

A file is cut at every closing brace, wherever Spark splits it. Whether a brace stands inside a string and how deep
it lies follows from counts of quotes and braces before it: prefix sums inside a block of the file, and over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clauselake.session import durable

BLOCK = ["file", "block"]


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier pieces of the file."""
    inside = Window.partitionBy(*BLOCK).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("_value", value)
    # One row per block of a file.
    totals = counted.groupBy(*BLOCK).agg(F.sum("_value").alias("_total")).select(
        *BLOCK, F.coalesce(F.sum("_total").over(
            Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    own = F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return counted.withColumn("_own", own).join(F.broadcast(totals), BLOCK) \
        .withColumn(name, F.col("_own") + F.col("_offset")).drop("_value", "_own", "_offset")


def read_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Objects of files that each hold one JSON array of objects, in no order.

    A file is read in splits of ``spark.sql.files.maxPartitionBytes``; an object may reach over splits, lie over many lines
    and hold objects and strings with any characters. Fields that an object lacks are null, as are all fields of
    what is no object of this form. An object that the file breaks off is left out; empty arrays and files give nothing.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")
    pieces = durable(text)
    plain = F.regexp_replace("value", r"\\.", "")
    quoted = _before(pieces, F.regexp_count(plain, F.lit('"')).cast("long"), "quotes")
    starts = F.col("quotes") % 2 == 1
    ends = (F.col("quotes") + F.regexp_count(plain, F.lit('"'))) % 2 == 1
    # With the halves of strings at both ends made whole, what is left stands outside of strings.
    outside = F.regexp_replace(F.concat(F.when(starts, '"').otherwise(""), plain, F.when(ends, '"').otherwise("")), '"[^"]*"', "")
    opened = F.regexp_count(outside, F.lit(r"\{")).cast("long")
    braced = quoted.withColumn("moved", opened - F.when(ends, 0).otherwise(1)).withColumn("closes", ~ends)
    deep = _before(braced, F.col("moved"), "depth").withColumn("last", F.col("closes") & (F.col("depth") + F.col("moved") == 0))
    numbered = _before(deep, F.col("last").cast("long"), "object")
    whole = numbered.groupBy("file", "object").agg(
        F.bool_or("last").alias("whole"), F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("parts"))
    joined = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    found = whole.where("whole").select(F.from_json(F.regexp_replace(joined, r"^[\s﻿,\[]+", ""), schema).alias("o"))
    return found.select("o.*")
