"""Document rates that bring expected domain token totals to target weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import durable, keep_small, whole_text
from clauselake.llm.quality import LABELLED_ROWS
from clauselake.llm.statistics import NAMES, bag, bounded_labels, features, labelled_texts, telling_words

DOMAINS = ("plain", "low", "toxic")
#: Share of all expected tokens that each domain is to have.
TARGETS = (0.90, 0.07, 0.03)


def label_domain() -> Column:
    """Place in ``DOMAINS`` of a row of the labelled table; null where both labels are missing."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1) \
        .when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)


def _row(text: bytes, told: dict[bytes, int]) -> np.ndarray:
    words, distinct = bag(text)
    x = np.zeros(len(NAMES) + len(told) + 1)
    x[:len(NAMES)] = features(text, words, distinct)
    for w in distinct & told.keys():
        x[len(NAMES) + told[w]] = 1
    x[-1] = len(words)
    return x


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, classes: int, words: int = 64,
                rows: int = LABELLED_ROWS, steps: int = 300):
    """``posterior(x)`` of a softmax regression on statistics and telling words, and those words.

    It is fitted on at most ``rows`` labelled documents, chosen by hash, by full gradient steps on their
    narrow feature rows. Without labels every domain is equally likely.
    """
    chosen = durable(labels.withColumn("_domain", domain).where("_domain is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("_domain").cast("int").alias("y"))
        .where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    told = {w: i for i, w in enumerate(telling_words(docs, chosen, classes, words, bytes.split))}

    def run(batches):
        for batch in batches:
            x = [_row(t, told).tolist() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float32()))], ["y", "x"])

    sample = labelled_texts(docs, chosen).mapInArrow(run, "y int, x array<float>").toArrow()
    if not len(sample):
        return (lambda x: np.full((len(x), classes), 1 / classes)), told
    y = sample.column(0).to_numpy()
    x = sample.column(1).combine_chunks().values.to_numpy().reshape(len(y), -1)[:, :-1].astype(float)
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    mean, scale = x.mean(0), x.std(0) + 0.05
    design = lambda v: np.column_stack([np.clip((v - mean) / scale, -6, 6), np.ones(len(v))])
    z, goal = design(x), np.eye(classes)[y]
    w, speed = np.zeros((z.shape[1], classes)), np.zeros((z.shape[1], classes))
    rate = 2.0 / (np.linalg.norm(z.T @ z / len(z), 2) + 0.01)

    def posterior_of(v: np.ndarray, weights: np.ndarray) -> np.ndarray:
        s = v @ weights
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(steps):
        speed = 0.9 * speed - rate * (z.T @ (posterior_of(z, w) - goal) / len(z) + 1e-3 * w)
        w = w + speed
    return (lambda v: posterior_of(design(v), w)), told


def mixed(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, domain: Column | None = None,
          total: float | None = None, rounds: int = 60, close: float = 1e-6) -> DataFrame:
    """``docs`` with ``tokens`` (words), ``posteriors`` (one per domain), ``domain`` (likeliest) and ``rate``.

    Rates are the nonnegative least-squares solution nearest to 1 of
    ``sum_d rate_d * tokens_d * posterior_d = targets * total`` (``total``: tokens of all documents unless
    given). Gradient steps, in the inverse Gram matrix of the documents with a positive rate, add up in
    one number per domain; a rate is 1 less the document's part of them, projected to zero or more. A
    step is one sum of a few numbers over a narrow table, so no state per document is rewritten. No
    document is dropped: a rate may be 0. It stops at ``close`` of the total or after ``rounds`` steps.

    Null and empty texts have no tokens and keep rate 1. Repeated rows are documents of their own. A
    target for a domain without mass can't be met; the least-squares answer stands. All columns stay,
    except that ones named like the four added are replaced; an empty table gives an empty one.
    """
    keep_small(docs.sparkSession)
    k = len(targets)
    posterior, told = fit_domains(docs, labels, label_domain() if domain is None else domain, k)
    kept = docs.drop("tokens", "posteriors", "domain", "rate")

    def run(batches):
        for batch in batches:
            x = np.array([_row(t or b"", told) for t in batch.column(0).cast(pa.binary()).to_pylist()]) \
                .reshape(-1, len(NAMES) + len(told) + 1)
            p = posterior(x[:, :-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(x[:, -1].astype(np.int64)), pa.array(p.tolist(), pa.list_(pa.float64()))],
                [*batch.schema.names[1:], "tokens", "posteriors"])

    # The hash passes over nulls, so where they stand is hashed too.
    cells = [F.col(f"`{c}`").cast("string") for c in kept.columns]
    key = F.xxhash64(*cells, F.array(*[c.isNull() for c in cells]))
    narrow = durable(kept.select(whole_text().alias("text"), key.alias("row"))
                     .mapInArrow(run, "row long, tokens long, posteriors array<double>"))
    mass = [F.col("tokens") * F.col("posteriors")[i] for i in range(k)]
    every = float(narrow.agg(F.sum("tokens")).first()[0] or 0)
    goal = np.array(targets) * (total if total is not None else every)
    pull, rate = np.zeros(k), F.lit(1.0)
    for _ in range(rounds if every else 0):
        moved = F.when(rate > 0, F.lit(1.0)).otherwise(0.0)
        sums = np.array(narrow.agg(*[F.sum(m * rate) for m in mass],
                                   *[F.sum(a * b * moved) for a in mass for b in mass]).first(), float)
        off, gram = sums[:k] - goal, sums[k:].reshape(k, k)
        if np.abs(off).max() <= close * goal.sum():
            break
        pull += np.linalg.solve(gram + 1e-9 * max(1e-300, np.trace(gram)) * np.eye(k), off)
        rate = F.greatest(F.lit(0.0), F.lit(1.0) - sum(
            (m * float(p) for m, p in zip(mass, pull, strict=True)), F.lit(0.0)))
    likeliest = F.array_position("posteriors", F.array_max("posteriors")).cast("int") - 1
    rated = narrow.withColumn("rate", rate).withColumn("domain", likeliest).dropDuplicates(["row"])
    return kept.withColumn("__mix_row", key).join(rated.withColumnRenamed("row", "__mix_row"), "__mix_row").drop("__mix_row")
