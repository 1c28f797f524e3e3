"""Stages inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row, whatever is filtered or built on them later.

    A filter on a plain computed column is moved below it together with a copy of its expression,
    and so is every expression that uses it; for text work that means reading the text several
    times. Columns that come out of a generator are not copied. Filters on other columns still
    move down to the scan.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
