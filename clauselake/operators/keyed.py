"""Keyed building blocks that stay safe when one key holds a large share of the rows.

* ``first_per_key`` and ``top_per_key`` keep a bounded number of rows per key; Spark cuts every
  input partition to that number before the shuffle, so a hot key sends few rows.
* ``with_previous`` looks at the row before within a key without putting a key into one task.
* ``spread_join`` splits or salts the keys that hold a large share of the left side.
* ``small_side`` broadcasts a table only after its rows and bytes were checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.session import durable

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 16


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key in a total order, numbered in ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "_rank").drop("_rank")


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the table has at most ``max_rows`` rows and ``max_bytes`` as text.

    The look stops one row past the limit. Without the hint Spark joins by shuffle, and adaptive
    execution may still broadcast on the measured size.
    """
    size = F.length(F.to_json(F.struct(*df.columns)))
    rows, held = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= max_bytes else df


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.02,
             min_rows: int = 100_000) -> list[tuple]:
    """Keys with more than ``min_rows`` rows and ``share`` of all: at most ``1 / share`` of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total")).scalar()
    rows = counts.where((F.col("_n") > total * F.lit(share)) & (F.col("_n") > min_rows)).limit(
        int(1 / share) + 1
    )
    return [tuple(r[k] for k in keys) for r in rows.collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                salt_hot: bool = False, salts: int = SALTS, share: float = 0.02,
                min_rows: int = 100_000) -> DataFrame:
    """Equi-join of many left rows to few right rows per key (inner, left, semi or anti).

    By default hot keys are left to adaptive execution, which splits a skewed partition of the left
    side over tasks by the sizes it measured. ``salt_hot`` counts the keys first: left rows of a
    hot key are dealt over ``salts`` groups and only the right rows of hot keys are copied that
    many times. It costs one more pass over the left keys, so it is meant for stored tables, and
    for sessions without adaptive execution.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted {how} join would repeat right rows")
    hot = hot_keys(left, keys, share, min_rows) if salt_hot else []
    if not hot:
        return left.join(right, list(keys), how)
    # A null key never matches; eqNullSafe still lets its rows be dealt out.
    is_hot = F.lit(False)
    for values in hot:
        match = F.lit(True)
        for k, v in zip(keys, values):
            match = match & F.col(k).eqNullSafe(F.lit(v))
        is_hot = is_hot | match
    deal = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    salted = left.withColumn("_salt", F.when(is_hot, deal).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.withColumn("_salt", F.explode(copies))
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  carry: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add ``carry`` columns of the row before within the key, by the ``order`` columns.

    ``keys`` and ``order`` together must be unique. The rows are range-partitioned by key and
    order, so a hot key spreads over many partitions. Each partition is compared row by row in
    itself; its first row takes what the partition before ended with, from a table that has one
    row per partition.
    """
    sort = [*keys, *order]
    ranged = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_part", F.spark_partition_id())
    )
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*sort, *carry])])
    # Written after the comparison, so that later uses repeat neither shuffle nor sort.
    inside = durable(ranged.withColumn(
        "_prev", F.lag(row).over(Window.partitionBy("_part").orderBy(*sort))
    ))
    # One row per partition: the last row it holds, handed to the next partition that has rows.
    ends = inside.groupBy("_part").agg(F.max_by(row, F.struct(*sort)).alias("_end"))
    handed = ends.withColumn(
        "_end", F.lag("_end").over(Window.orderBy("_part"))
    )
    joined = inside.join(F.broadcast(handed), "_part", "left").withColumn(
        "_prev", F.coalesce("_prev", "_end")
    )
    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & F.col(f"_prev.{k}").eqNullSafe(F.col(k))
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.when(same_key, F.col(f"_prev.{c}")).alias(prefix + c) for c in carry],
    )


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column],
           keep: Sequence[str] = ()) -> DataFrame:
    """Insert or update on a unique key.

    The newest update per key wins over the base row; ``keep`` columns (an id, a first-seen time)
    stay as the base has them. Both sides are unique on the key when they meet, so no key is hot.
    """
    newest = first_per_key(updates, keys, order).withColumn("_update", F.lit(True))
    b, u = base.alias("b"), newest.alias("u")
    on = [F.col(f"b.{k}") == F.col(f"u.{k}") for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c

    def pick(c: str) -> Column:
        if c not in updates.columns:
            return F.col(f"b.{c}").alias(c)
        old, new = F.col(f"b.{c}"), F.col(f"u.{c}")
        if c in keys or c in keep:
            return F.coalesce(old, new).alias(c)
        return F.when(F.col("u._update"), new).otherwise(old).alias(c)

    return b.join(u, condition, "full_outer").select(*[pick(c) for c in base.columns])


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: Sequence[str],
                     order: Sequence[Column] = ()) -> DataFrame:
    """Add the rows whose key the base does not have; existing rows stay untouched."""
    unique = first_per_key(rows, keys, order) if order else rows.dropDuplicates(list(keys))
    fresh = unique.join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(fresh.select(*[c for c in base.columns if c in fresh.columns]),
                            allowMissingColumns=True)


def queue_domains(raw: DataFrame, column: str = "domain") -> DataFrame:
    """Distinct trimmed lower-cased non-empty domains with status ``pending``."""
    clean = F.lower(F.trim(F.col(column)))
    return (
        raw.select(clean.alias("domain"))
        .where(F.col("domain") != "")
        .distinct()
        .withColumn("status", F.lit("pending"))
    )


def delete_where(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and a one-row frame with the number of rows that go.

    A condition that is null does not delete.
    """
    gone = F.coalesce(condition, F.lit(False))
    return df.where(~gone), df.where(gone).agg(F.count(F.lit(1)).alias("deleted"))


def delete_keys(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``doomed``."""
    return df.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def trim_latest(df: DataFrame, order: Sequence[Column], n: int = 1000,
                per: Sequence[str] = ()) -> DataFrame:
    """Newest ``n`` rows overall, or per group."""
    if not per:
        return df.orderBy(*order).limit(n)
    return top_per_key(df, per, order, n, "_rank").drop("_rank")
