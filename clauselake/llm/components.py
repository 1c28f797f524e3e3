"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import durable


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges (a, b)``, both long.

    In each round a node joins the neighbour (or itself) that comes first in a random order; edges
    are rewritten to the joined nodes and doubles go. Random orders make the number of rounds follow
    the logarithm of the nodes, also on long chains. A round is partial sums by node and equal-key
    joins, so a node with very many edges does not land in one task. Tables stay in the cluster and
    are cut by ``checkpoint``. An empty table gives an empty one. Edges from a node to itself and
    nulls are left out.
    """
    left = durable(
        edges.where("a < b").select("a", "b")
        .union(edges.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    roots = None
    for turn in range(rounds):
        if left.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("o"), c.alias("n"))
        ends = left.select(F.inline(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("near")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("near")),
        )))
        step = ends.groupBy("node").agg(
            F.least(F.min(order(F.col("near"))), order(F.col("node")))["n"].alias("to"))
        step = durable(step)
        to = lambda old: step.select(F.col("node").alias(old), F.col("to").alias(f"{old}_to"))  # noqa: E731,B023
        moved = left.join(to("a"), "a").join(to("b"), "b")
        moved = moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        left = durable(moved.where("a < b").distinct())
        roots = step.select("node", F.col("to").alias("root")) if roots is None else durable(
            roots.join(to("root"), "root", "left")
            .select("node", F.coalesce("root_to", "root").alias("root")))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
