"""Importance resampling towards a target: hashed n-gram gains per document, then a draw by exact rank.

Weights come from two arrays of bucket counts, one of the corpus and one of the target. The draw sorts by
regular sampling: every task sorts its own run, regular places of the runs give the splitters, segments
between splitters are exchanged and merged, and counts of the segments before give exact ranks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import durable, keep_small, whole_text

BUCKETS = 10_000
#: Bytes to word characters: A-Z become a-z, digits, a-z and all of a character beyond ASCII stay, the rest parts words.
WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
STRETCH = 1 << 20
#: Splitters come from at most so many sampled rows, or one of each run where there are more runs.
SAMPLES = 200_000


def _zero_byte(c: np.ndarray) -> np.ndarray:
    """CRC-32 registers after one more zero byte."""
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _table(length: int) -> np.ndarray:
    t = (np.arange(256, dtype=np.uint32)[None] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    for _ in range(length):
        t = _zero_byte(t)
    return t


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]


class Shift:
    """CRC-32 of a beginning, moved so that the CRC-32 of what follows can be added by exclusive or."""

    def __init__(self, direct: int = 64):
        tables = [_table(0)]
        for _ in range(1, direct):
            tables.append(_zero_byte(tables[-1]))
        self.direct = np.stack(tables).reshape(-1)
        self.limit = direct
        self.doubled = [_table(1)]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``crc`` after ``length`` more bytes, element by element."""
        row = np.where(length < self.limit, length, 0) * 1024
        out = self.direct[row + (crc & 255)]
        for k in (1, 2, 3):
            out ^= self.direct[row + 256 * k + (crc >> np.uint32(8 * k) & 255)]
        for i in np.flatnonzero(length >= self.limit):
            out[i] = self._long(crc[i:i + 1], int(length[i]))[0]
        return out

    def _long(self, crc: np.ndarray, length: int) -> np.ndarray:
        for k in range(length.bit_length()):
            if k == len(self.doubled):
                self.doubled.append(_apply(self.doubled[-1], self.doubled[-1]))
            if length >> k & 1:
                crc = _apply(self.doubled[k], crc)
        return crc


def _stretches(texts: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Words of the texts in order, at most about ``size`` bytes of one text at a time."""
    for i, text in enumerate(texts):
        clean, at = text.translate(WORD), 0
        while at < len(clean):
            end = clean.find(b" ", at + size)
            end = len(clean) if end < 0 else end
            yield i, clean[at:end].split()
            at = end


def buckets(texts: list[bytes], shift: Shift, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(document, bucket, words)`` of all runs of one to three words, in bounded pieces.

    ``document`` and ``bucket`` have one entry per run; ``words`` counts the words of each text in the piece.
    """
    held: list[tuple[int, list[bytes]]] = []
    size = 0
    crc, length, doc = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    space = np.uint32(zlib.crc32(b" "))

    def piece():
        nonlocal crc, length, doc
        before = min(2, len(doc))
        words = [w for _, ws in held for w in ws]
        n = len(words)
        crc = np.concatenate([crc[-2:], np.fromiter(map(zlib.crc32, words), np.uint32, n)])
        length = np.concatenate([length[-2:], np.fromiter(map(len, words), np.int64, n)])
        new = np.repeat(np.array([i for i, _ in held], np.int64), [len(ws) for _, ws in held])
        doc = np.concatenate([doc[-2:], new])
        after = shift(np.full(len(crc), space), length) ^ crc
        two = shift(crc[:-1], length[1:] + 1) ^ after[1:]
        three = shift(two[:-1], length[2:] + 1) ^ after[2:]
        ok = [np.ones(len(doc), bool), doc[1:] == doc[:-1], doc[2:] == doc[:-2]]
        # Runs that end in the two words carried over have been counted.
        for k, o in enumerate(ok):
            o[:max(0, before - k)] = False
        found = np.concatenate([c[o] for c, o in zip((crc, two, three), ok, strict=True)])
        owner = np.concatenate([doc[k:][o] for k, o in enumerate(ok)])
        return owner, (found % BUCKETS).astype(np.int64), np.bincount(new, minlength=len(texts))

    for i, words in _stretches(texts, stretch):
        held.append((i, words))
        size += sum(map(len, words))
        if size >= stretch:
            yield piece()
            held, size = [], 0
    if held:
        yield piece()


def bucket_counts(rows: DataFrame, text: str = "text") -> np.ndarray:
    """Runs of one to three words per bucket over all ``rows``; tasks send sums only."""
    keep_small(rows.sparkSession)

    def run(batches):
        total, shift = np.zeros(BUCKETS, np.int64), Shift()
        for batch in batches:
            for _, bucket, _ in buckets(batch.column(0).cast(pa.binary()).to_pylist(), shift):
                total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in rows.select(whole_text(text).alias("text")).mapInArrow(run, "bucket long, n long") \
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of target to corpus per bucket, one added to every count."""
    s, t, all_s, all_t = corpus.astype(float), target.astype(float), float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, words, n_features, weight)`` per row of ``docs (doc_id, text)``."""
    keep_small(docs.sparkSession)

    def run(batches):
        shift, value = Shift(), gain.astype(float)
        for batch in batches:
            n = batch.num_rows
            words, many, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for owner, bucket, count in buckets(batch.column(1).cast(pa.binary()).to_pylist(), shift):
                words += count
                many += np.bincount(owner, minlength=n)
                # Sums of whole numbers below 2^53 are exact.
                weight += np.bincount(owner, value[bucket], n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(many), pa.array(weight.astype(np.int64))],
                ["doc_id", "words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, words long, n_features long, weight long")


def noise(key: Column, seed: int = 42) -> Column:
    """Whole thousandths of a Gumbel variable from the SHA-256 of ``seed:key``; a null key is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


KEYS = ("down", "doc_id", "n_features", "run", "place")


def place_in_task() -> Column:
    """Place of a row in its task, from 0."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Every task's rows in order, best score first, with ``run`` and ``place``; written once.

    Rows that are equal in all else still differ in run and place, so that no value is hot.
    """
    ordered = rows.withColumn("down", -F.col("score")).sortWithinPartitions(F.col("down"), F.asc_nulls_last("doc_id"), "n_features")
    return durable(ordered.withColumn("run", F.spark_partition_id().cast("long")).withColumn("place", place_in_task()))


def _key(r) -> tuple:
    return (r.down, r.doc_id is None, r.doc_id or 0, r.n_features, r.run, r.place)


def splitters(runs: DataFrame, segments: int, samples: int = SAMPLES) -> list[tuple]:
    """Keys that part all rows into at most ``segments`` nearly equal parts, from regular places of the runs."""
    size = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    tasks = size.count()
    each = max(1, min(segments, samples // max(tasks, 1)))
    step = F.ceil(F.col("n") / each)
    # One row per task is broadcast.
    regular = runs.join(F.broadcast(size), "run").where((F.col("place") % step) == F.floor(step / 2)).select(*KEYS)
    found = sorted(map(_key, regular.collect()))
    at = sorted({len(found) * k // segments for k in range(1, segments)})
    return [found[i] for i in at if i]


def with_segment(runs: DataFrame, parts: list[tuple]) -> DataFrame:
    """Add ``segment``, the number of splitters at or before the row."""
    first = np.array([p[0] for p in parts], np.int64)

    def run(batches):
        for batch in batches:
            down = batch.column("down").to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(first, down, "left"), np.searchsorted(first, down, "right")
            tied = np.flatnonzero(low != high)
            if len(tied):
                cols = [batch.column(c).take(pa.array(tied)).to_pylist() for c in KEYS]
                for i, (d, doc, n, r, p) in zip(tied, zip(*cols, strict=True), strict=True):
                    low[i] = bisect.bisect_right(parts, (d, doc is None, doc or 0, n, r, p))
            yield batch.append_column("segment", pa.array(low.astype(np.int64)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return runs.mapInArrow(run, f"{kinds}, segment long")


def ranked(rows: DataFrame, wanted: int, segments: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """``rows (doc_id, n_features, score, ...)`` with ``rank`` from 1 by falling score; null beyond ``wanted``.

    Ties go to the smaller id (null last), then to fewer runs. Only the segments that reach the ``wanted``
    first rows are exchanged; the others keep a null rank where they are.
    """
    spark = rows.sparkSession
    segments = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = sorted_runs(rows)
    parts = splitters(runs, segments, samples)
    cut = durable(with_segment(runs, parts))
    # At most one row per segment.
    sizes = sorted((r.segment, r.n) for r in cut.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for segment, n in sizes:
        if total < wanted:
            before.append((segment, len(before), total))
        total += n
    rank = F.lit(None).cast("long").alias("rank")
    if not before:
        return cut.select(*rows.columns, rank)
    offsets = F.broadcast(spark.createDataFrame(before, "segment long, owner int, before long"))
    last = before[-1][0]
    exchanged = cut.where(F.col("segment") <= last).join(offsets, "segment").repartitionById(len(before), F.col("owner"))
    merged = exchanged.sortWithinPartitions("down", F.asc_nulls_last("doc_id"), "n_features", "run", "place") \
        .withColumn("rank", F.col("before") + place_in_task() + 1)
    drawn = merged.select(*rows.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.unionByName(cut.where(F.col("segment") > last).select(*rows.columns, rank))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
              segments: int | None = None) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` per row of ``docs (doc_id, text)``.

    ``rank`` numbers the drawn rows: the ``percent`` of a hundred (rounded down) with the highest scores
    among texts of ``least_words`` words or more; it is null for the others. Null and empty texts have no
    features and weight 0, and are never drawn unless ``least_words`` is 0. Repeated rows are rows of their
    own; rows with equal id and score rank by their number of features, and rows equal in all of that take
    their ranks in any order. A null id is hashed as an empty one and ranks last among equal scores.
    Other columns are ignored. An empty table gives an empty one; without target texts only the corpus counts
    speak. Long texts are read a stretch at a time.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = durable(weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    out = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(F.col("words") >= least_words).select(*out)
    found = ranked(able, percent * able.count() // 100, segments)
    return found.unionByName(scored.where(F.col("words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
