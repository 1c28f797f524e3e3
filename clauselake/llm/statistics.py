"""Statistics of whole texts for the classifiers."""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import durable, keep_small, whole_text

NAMES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "stop", "symbol", "bar", "high",
    "word_bytes", "distinct", "distinct_root", "twin_symbol", "twin_word", "lines", "line_repeats", "end_symbol",
)
_CLASS = np.full(256, 10, np.uint8)
_CLASS[:128] = 8
for _n, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789",
                             b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-")):
    _CLASS[list(_chars)] = _n + 2
_CLASS[ord("|")] = 9
_CLASS[list(b".,;:?'\"()-")] = 7
STEP = 1 << 20


def features(text: bytes, words: list[bytes], distinct: set[bytes]) -> np.ndarray:
    """The values of ``NAMES`` for one text; ratios of an empty text are 0."""
    counts, twins = np.zeros(11), 0
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data), STEP):
        kinds = _CLASS[data[start:start + STEP]]
        counts += np.bincount(kinds, minlength=11)
        same = data[start:start + STEP]
        twins += int(((same[1:] == same[:-1]) & (kinds[1:] >= 7) & (kinds[1:] <= 9)).sum())
    n, w = max(len(data), 1), max(len(words), 1)
    repeats = sum(map(operator.eq, words, words[1:]))
    rows = text.split(b"\n")
    ends = sum(map(bytes.isalnum, map(operator.itemgetter(slice(-1, None)), distinct)))
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), *(counts[2:] / n), (n - counts[5] - counts[6]) / w / 10,
        len(distinct) / w, len(distinct) / np.sqrt(w) / 10, twins / n, repeats / w, min(1, len(rows) / w),
        1 - len(set(rows)) / len(rows), 1 - ends / max(len(distinct), 1),
    ])


def bag(text: bytes) -> tuple[list[bytes], set[bytes]]:
    words = text.split()
    return words, set(words)


def bounded_labels(labels: DataFrame, label: str, rows: int, skip=None) -> DataFrame:
    """``(doc_id, y)``: at most ``rows`` labelled ids, chosen by hash; repeated labels are averaged."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if skip is not None:
        known = known.where(~skip)
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(doc_id, y, text)`` of the chosen ids; ``chosen`` has a bounded number of narrow rows."""
    keep_small(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")) \
        .join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")


def sample_statistics(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(doc_id, y, x)`` with the statistics of the chosen documents, written once."""
    def run(batches):
        for batch in batches:
            x = [features(t, *bag(t)).tolist() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    return durable(labelled_texts(docs, chosen).mapInArrow(run, "doc_id long, y int, x array<double>"))


def telling_words(docs: DataFrame, chosen: DataFrame, classes: int, keep: int, normal) -> list[bytes]:
    """The ``keep`` words whose presence tells most about the class, over the chosen documents.

    ``normal(text)`` gives the words of a text. Counts are sums over tasks; words in fewer than five
    documents are left out.
    """
    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for y, t in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                seen.update((w, y) for w in set(normal(t)))
            yield pa.RecordBatch.from_arrays([
                pa.array([w for w, _ in seen], pa.binary()), pa.array([y for _, y in seen], pa.int32()),
                pa.array(list(seen.values()), pa.int64())], ["word", "y", "n"])

    counts = labelled_texts(docs, chosen).mapInArrow(run, "word binary, y int, n long") \
        .groupBy("word", "y").agg(F.sum("n").alias("n"))
    sizes = dict.fromkeys(range(classes), 0) | {r.y: r.n for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(sizes.values()))
    by_word = counts.groupBy("word").agg(
        F.sum("n").alias("all"), *[F.coalesce(F.sum(F.when(F.col("y") == k, F.col("n"))), F.lit(0)).alias(f"n{k}")
                                   for k in range(classes)]).where("all >= 5")
    chi = sum((F.pow(F.col(f"n{k}") - F.col("all") * (sizes[k] / total), 2) / (F.col("all") * (max(sizes[k], 1) / total))
               for k in range(classes)), F.lit(0.0)) / (1 - F.col("all") / (total + 1))
    return [bytes(r.word) for r in by_word.select("word", chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(keep).collect()]
