"""Importance resampling: CRC arithmetic, stretches, ranks by regular sampling, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import resampling

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_buckets(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10_000
                        for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, percent, least):
    corpus, wanted = Counter(), Counter()
    for _, t in docs:
        corpus.update(plain_buckets(t)[1])
    for t in target:
        wanted.update(plain_buckets(t)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s + 10_000.0) / ((corpus[b] + 1.0) * (t + 10_000.0))))
    rows = []
    for i, text in docs:
        n, found = plain_buckets(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[:percent * len(able) // 100]
    out = [(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn):]]
    return Counter(out + [(*r[:4], None) for r in rows if r[4] < least])


def test_crc_of_a_beginning_is_moved():
    shift, rng = resampling.Shift(), random.Random(1)
    for length in (0, 1, 2, 62, 63, 64, 65, 1000, 70_000):
        a, b = rng.randbytes(rng.randrange(9)), rng.randbytes(length)
        moved = shift(np.array([zlib.crc32(a)], np.uint32), np.array([length]))[0]
        assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_stretches_lose_and_repeat_no_run_of_words():
    rng, shift = random.Random(2), resampling.Shift()
    for size in (1, 4, 9, 30, 1000):
        texts = [" ".join(rng.choice(["a", "Bé", "-", "x" * 90, "É9", "the\nend"]) for _ in range(rng.randrange(40)))
                 for _ in range(6)]
        got, words = [[] for _ in texts], 0
        for owner, bucket, n in resampling.buckets([t.encode() for t in texts], shift, size):
            words = words + n
            for i, b in zip(owner, bucket, strict=True):
                got[i].append(b)
        assert [sorted(g) for g in got] == [sorted(plain_buckets(t)[1]) for t in texts]
        assert list(words) == [plain_buckets(t)[0] for t in texts]


def odd_documents():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "eps-ilon", "42", "ΔΕ", "zeta"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(5, None), (6, ""), (7, " \n- "), (None, docs[0][1]), (None, None), (8, docs[8][1]), (8, docs[8][1]),
             (9, "one two three " * 9), (10, "x" * 5000), (11, "long " * 30_000)]
    return docs + [(12, "same words in all of these rows " * 4)] * 150


@pytest.mark.parametrize("percent", [0, 5, 60, 100])
def test_equals_brute_force(spark, percent):
    docs, target = odd_documents(), ["Alpha délta alpha", None, "", "zeta 42 zeta"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("place", F.lit(1)).repartition(7)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(df, wanted, percent, segments=9)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(docs, target, percent, 20)


def test_no_value_is_hot(spark):
    """Rows that are equal in all but their place are dealt over segments and still get each rank once."""
    rows = spark.range(4000, numPartitions=8).select(F.lit(3).cast("long").alias("doc_id"), F.lit(4).cast("long").alias("n_features"),
                                                     F.lit(5).cast("long").alias("score"))
    runs = resampling.sorted_runs(rows)
    cut = resampling.with_segment(runs, resampling.splitters(runs, 10))
    sizes = [r["count"] for r in cut.groupBy("segment").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * 4000 / 10
    assert sorted(r.rank for r in resampling.ranked(rows, 4000, 10).collect()) == list(range(1, 4001))


def test_only_segments_that_reach_the_draw_are_exchanged(spark):
    rows = spark.range(20_000, numPartitions=8).select(
        F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("score"))
    got = resampling.ranked(rows, 500, 20)
    want = rows.orderBy(F.desc("score"), "doc_id").limit(500).collect()
    assert [r.doc_id for r in got.where("rank is not null").orderBy("rank").collect()] == [r.doc_id for r in want]
    assert got.count() == 20_000
    first = got.where("rank is not null").select(F.spark_partition_id().alias("p")).distinct().count()
    assert first <= 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resampled(docs, one).count() == 0
    assert [(r.doc_id, r.n_features, r.rank) for r in resampling.resampled(one, docs, 100).collect()] == [(1, 117, 1)]
