"""Quality scores: random Fourier features, ridge by partition sums, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselake.llm.common import held_out, keep_small
from clauselake.llm.statistics import NAMES, bag, bounded_labels, features, sample_statistics

#: Labelled documents a classifier is fitted on, at most.
LABELLED_ROWS = 20_000


@dataclass(frozen=True)
class Kernel:
    """Standardised statistics under a random cosine map that approximates a Gaussian kernel."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray

    @staticmethod
    def drawn(mean: np.ndarray, scale: np.ndarray, width: int, seed: int = 7) -> Kernel:
        rng = np.random.default_rng(seed)
        n = len(mean)
        return Kernel(mean, scale, rng.standard_normal((n, width)) / np.sqrt(2 * n), rng.uniform(0, 2 * np.pi, width))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        near = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.shift)) * np.cos(near @ self.turn + self.shift)
        return np.column_stack([z, np.ones(len(z))])


@dataclass(frozen=True)
class Model:
    kernel: Kernel
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.kernel(x) @ self.weights, self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the pooled blocks of a nondecreasing fit of ``y`` on ``x``."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a2, b2, n2 = blocks.pop()
            a1, b1, n1 = blocks[-1]
            n = n1 + n2
            blocks[-1] = [(a1 * n1 + a2 * n2) / n, (b1 * n1 + b2 * n2) / n, n]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", skip=None, width: int = 160,
        ridge: float = 0.05, rows: int = LABELLED_ROWS) -> Model:
    """A model from the documents with a label, at most ``rows`` of them, chosen by hash.

    Every task gives one normal matrix per fold; the driver adds them up. The calibration is fitted
    to predictions for each half from the other half. ``skip`` marks rows of ``labels`` that are not
    to be seen. Without labelled documents the score is 0.5, with one class it is that class.
    """
    sample = sample_statistics(docs, bounded_labels(labels, label, rows, skip))
    known = sample.select(
        F.count("*").alias("n"), F.avg("y").alias("y"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(NAMES))],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(len(NAMES))]).first()
    if not known.n or known.y in (0.0, 1.0):
        none = np.empty(0)
        return Model(Kernel(none, none, none, none), none, none, np.array([known.y if known.n else 0.5]))
    mean = np.array([known[f"m{i}"] for i in range(len(NAMES))])
    kernel = Kernel.drawn(mean, np.array([known[f"s{i}"] for i in range(len(NAMES))]) + 1e-3, width)

    def sums(batches):
        gram, right = np.zeros((2, width + 1, width + 1)), np.zeros((2, width + 1))
        for batch in batches:
            ids, y = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            z = kernel(np.array(batch.column(2).to_pylist()).reshape(-1, len(NAMES)))
            for k in (0, 1):
                part = ids % 2 == k
                gram[k] += z[part].T @ z[part]
                right[k] += z[part].T @ y[part]
        yield pa.RecordBatch.from_arrays([
            pa.array([0, 1], pa.int32()), pa.array(gram.reshape(2, -1).tolist(), pa.list_(pa.float64())),
            pa.array(right.tolist(), pa.list_(pa.float64()))], ["fold", "gram", "right"])

    few = sample.coalesce(8)
    gram, right = np.zeros((2, width + 1, width + 1)), np.zeros((2, width + 1))
    for r in few.mapInArrow(sums, "fold int, gram array<double>, right array<double>").toLocalIterator():
        gram[r.fold] += np.array(r.gram).reshape(width + 1, width + 1)
        right[r.fold] += np.array(r.right)
    weigh = ridge * np.eye(width + 1)
    weigh[-1, -1] = 1e-6
    solve = lambda k: np.linalg.solve(gram[k].sum(0) + weigh, right[k].sum(0))
    by_fold = [solve([1]), solve([0])]

    def out_of_fold(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False) % 2
            z = kernel(np.array(batch.column(2).to_pylist()).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(ids == 0, z @ by_fold[0], z @ by_fold[1])), batch.column(1)], ["p", "y"])

    seen = sample.mapInArrow(out_of_fold, "p double, y int").toPandas()
    return Model(kernel, solve([0, 1]), *isotonic(seen.p.to_numpy(), seen.y.to_numpy(float)))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs (doc_id, text, ...)`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` up).

    Scores come from the whole text alone; null counts as empty. All rows and columns stay, repeated
    rows score alike, an empty table gives an empty one. ``into`` names the two new columns; others of
    these names are replaced.
    """
    keep_small(docs.sparkSession)
    kept = docs.drop(*into)
    at = kept.columns.index("text")
    out = T.StructType([*kept.schema.fields, T.StructField(into[0], T.DoubleType())])
    names = out.names

    def run(batches):
        for batch in batches:
            found = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            x = np.array([features(t, *bag(t)) for t in found]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names)

    return kept.mapInArrow(run, out).withColumn(into[1], (F.col(into[0]) >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 4, rest: int = 2, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; ids with CRC-32 remainder ``rest`` of ``parts`` teach nothing."""
    model = fit(docs, labels, skip=held_out(F.col("doc_id"), parts, rest))
    return scored(docs.select("doc_id", "text"), model, threshold).select(
        "doc_id", held_out(F.col("doc_id"), parts, rest).alias("held_out"), "score", "predicted")
