"""Ranked lexical search against brute force, over blocks, bundles, owners and sets of items."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import ranking

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    some = [c for _, c in found if c]
    n, total = len(some), sum(c.total() for c in some)
    df = Counter(t for c in some for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in found:
            if doc is None or not c:
                continue
            m = 100 - 50 + (50 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in wanted if c[t])
            if score > 0:
                scores.append((-score, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def odd_documents():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "naïve", "DATA", "x-y", "7"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 50)))) for i in range(400)]
    docs += [(3, None), (4, ""), (5, " -\n"), (None, "w1 w39 data"), (9, docs[9][1]), (9, docs[9][1]), (401, "data " * 40_000)]
    return docs + [(500 + i, "w3 w20 été the same text") for i in range(300)]


ITEMS = [(1, "w1 w2 w30 w30"), (2, "W3, w20! Été"), (3, None), (4, ""), (None, "w1"), (5, "unknown words only"),
         (6, " ".join(f"w{i}" for i in range(40))), (6, "data"), (7, "data"), (8, "naïve x-y 7")]


@pytest.mark.parametrize("owners, bundle, at_once, rows", [(4, 128, 4096, 16_384), (1, 2, 4096, 50), (5, 3, 4096, 64), (3, 4, 4, 100)])
def test_equals_brute_force(spark, owners, bundle, at_once, rows):
    docs = odd_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("item_id", F.lit("x")).repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit(0))
    got = ranking.ranked_documents(df, items, 7, owners, bundle, at_once, block_rows=rows)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == plain(docs, ITEMS, 7)


def test_blocks_end_at_words_too(spark):
    df = spark.createDataFrame([(i, "a b " * 10) for i in range(20)], "doc_id long, text string").coalesce(1)
    blocks = ranking.posting_blocks(df, {b"a": 0, b"zz": 1}, 1000, 50)
    assert [len(r.doc_ids) for r in blocks.orderBy("block").collect()] == [3] * 6 + [2]
    assert {tuple(r.sizes) for r in blocks.collect()} == {(20, 20, 20), (20, 20)}


def test_words_of_a_long_text_are_counted_in_parts():
    known = {b"a": 0, b"b": 1, b"c": 2}
    words = [random.Random(1).choice([b"a", b"b", b"c", b"d"]) for _ in range(1000)]
    for most in (1, 7, 1000):
        term, n = ranking._counted(words, known, most)
        assert dict(zip(term.tolist(), n.tolist(), strict=True)) == {known[w]: c for w, c in Counter(words).items() if w in known}


def test_a_stage_leaves_only_what_is_out_for_good():
    """With the rest of the weight known, sums that can't reach the k-th of today go, and the result is the same."""
    weights = np.array([9000, 5, 5, 5])
    assert ranking.owners_of(np.array([1, 3, 2, 2]), 2).tolist() == [1, 0, 1, 1]
    stage = ranking.Stage({0: [np.arange(4)]}, weights, np.array([0, 1, 1, 1]), 100, 1000, 2)
    state = {"bundle": 0, "doc_ids": np.arange(100), "sizes": np.full(100, 10), "items": np.zeros(0, int), "places": np.zeros(0, int),
             "scores": np.zeros(0, int)}
    first = np.zeros(50, int), np.arange(50), np.where(np.arange(50) < 5, 9, 1)
    _, places, _ = stage.add(0, False, state, first)
    assert places.tolist() == [0, 1, 2, 3, 4]


def test_large_sizes_do_not_overflow():
    assert ranking.length_norm(np.array([10**7, 1]), 4 * 10**10, 10**14).tolist() == [50 + 50 * 10**7 * 4 * 10**10 // 10**14, 50]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.ranked_documents(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a"), (2, "c")], "doc_id long, text string")
    assert ranking.ranked_documents(docs, items.limit(0)).count() == 0
    assert [(r.item_id, r["rank"], r.doc_id) for r in ranking.ranked_documents(docs, items).collect()] == [(1, 1, 1)]
