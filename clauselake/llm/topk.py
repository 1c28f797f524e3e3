"""Exact top-k by inner product: postings are scattered term by term into dense score arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.common import durable

#: Candidates that are scored together; a score array has this many integers.
BLOCK = 4096


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(wrong, F.lit(True))


def scaled(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component, as long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def postings(vectors: list[list[int]]) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per component the rows that have it and their values; rows are None where all have it."""
    width = max(map(len, vectors), default=0)
    dense = np.zeros((width, len(vectors)), np.int64)
    for i, v in enumerate(vectors):
        dense[:len(v), i] = v
    out = []
    for column in dense:
        rows = np.flatnonzero(column)
        out.append((None, column) if len(rows) == len(vectors) else (rows, column[rows]))
    return out


def best(query: np.ndarray, index: list, ids: np.ndarray, own: int, k: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best rows of a block for one query, ties to smaller ids."""
    scores[:] = 0
    for term in np.flatnonzero(query[:len(index)]):
        rows, values = index[term]
        if rows is None:
            scores += query[term] * values
        else:
            scores[rows] += query[term] * values
    other = np.flatnonzero(ids != own)
    found = scores[other]
    if len(found) > k:
        # All ties with the k-th score stay until ids decide.
        keep = found >= np.partition(found, len(found) - k)[len(found) - k]
        other, found = other[keep], found[keep]
    order = np.lexsort((ids[other], -found))[:k]
    return ids[other][order], found[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, queries_at_once: int = 4096) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of ``vectors`` for each row of ``queries``.

    Both have ``(vec_id, embedding)`` with integer components. A query never finds rows of its own id.
    Ties go to the smaller id, so the result is one only for distinct ids: rows that repeat an id are
    candidates of their own, and a repeated query id is asked once, with its smallest vector. Missing
    components of shorter vectors count as 0. Rows with a null id take no part; other columns are
    ignored; empty tables give an empty one.

    Queries are asked ``queries_at_once`` at a time (the only thing that is broadcast, so its size is
    bounded), against all rows in blocks of ``block``. A task keeps ``k`` rows per query between its
    blocks, and a window over these few per task merges them.
    """
    spark = vectors.sparkSession
    asked = durable(queries.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id"))
                    .agg(F.min("embedding").alias("embedding")))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sets = -(-asked.count() // queries_at_once)
    schema = "query_id long, vec_id long, score long"
    found = None
    for turn in range(sets):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(sets)) == turn).orderBy("vec_id").collect()
        shared = spark.sparkContext.broadcast(
            [(r.vec_id, np.array(r.embedding, np.int64)) for r in mine])

        def run(batches, shared=shared):
            kept = {q: (np.empty(0, np.int64), np.empty(0, np.int64)) for q, _ in shared.value}
            held_ids, held = [], []

            def flush():
                ids, index, scores = np.array(held_ids, np.int64), postings(held), np.empty(len(held), np.int64)
                for q, vector in shared.value:
                    new_ids, new = best(vector, index, ids, q, k, scores)
                    all_ids, all_scores = np.append(kept[q][0], new_ids), np.append(kept[q][1], new)
                    order = np.lexsort((all_ids, -all_scores))[:k]
                    kept[q] = all_ids[order], all_scores[order]
                held_ids.clear()
                held.clear()

            for batch in batches:
                for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held_ids.append(i)
                    held.append(v)
                    if len(held) == block:
                        flush()
            if held:
                flush()
            for q, (ids, scores) in kept.items():
                if len(ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

        part = rows.mapInArrow(run, schema)
        if sets > 1:
            part = durable(part)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def embedding_neighbours(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """Rows whose id is divisible by ``every``, against all other rows, on components times 1024."""
    vectors = embeddings.where(usable(F.col("embedding"))).select("vec_id", scaled(F.col("embedding")).alias("embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
