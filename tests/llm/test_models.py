"""Learned operators, exact search, token files and the pipeline over small tables."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import mixing, quality, queries, tokencounts, topk, toxicity
from clauselake.llm.common import table

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_quality_held_out(spark):
    out = queries.QUERIES["op10_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").toPandas()
    assert all(out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id])
    held = out[out.held_out & out.quality.notna()]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert ((out.score >= 0.7) == out.predicted).all() and out.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    out = queries.QUERIES["op7_toxicity"](spark, SF).join(table(spark, SF, "labels"), "doc_id").toPandas()
    held = out[out.held_out & out.toxic.notna()]
    assert len(held) > 40 and (held.predicted == held.toxic).mean() > 0.93


def labelled(spark, n=80):
    rows = [(i, ("the calm river runs on and on " if i % 2 else "### !!! you awful idiot $$$ ") * (1 + i % 5), "x") for i in range(n)]
    docs = spark.createDataFrame(rows + [(900, None, "y"), (901, "", "y"), (902, "you aw ful 1d10t", "y"), (902, "you aw ful 1d10t", "y"),
                                         (None, "the calm", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, 1.0) for i in range(n)] + [(0, None, None, 1.0), (None, 1, 1, 1.0)],
                                   "doc_id long, quality int, toxic int, text double")
    return docs, labels


def test_scores_of_odd_rows(spark):
    docs, labels = labelled(spark)
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        out = run(docs, labels).toPandas()
        assert len(out) == 85 and out.score.between(0, 1).all()
        assert run(docs.limit(0), labels).count() == 0
        assert set(run(docs, labels.limit(0)).toPandas().score) == {0.5}
    tox = toxicity.toxicity_scores(docs, labels).where("doc_id = 902").toPandas()
    assert list(tox.predicted) == [1, 1]
    scored = quality.scored(docs, quality.fit(docs, labels))
    assert scored.columns == ["doc_id", "text", "score", "predicted"]


def test_one_class_gives_that_class(spark):
    docs, labels = labelled(spark)
    assert set(quality.quality_scores(docs, labels.where("quality = 1")).toPandas().score) == {1.0}


def test_isotonic_pools():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(x) == [1, 2.5, 4] and list(y) == [0, 0.5, 1]


@pytest.mark.parametrize("noisy, plain", [
    ("1d10t", "idiot"), ("id!ot", "idiot"), ("stuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("$tupid", "stupid"), ("m0r0n###", "moron"),
    ("st*pid", "stupid"), ("good", "good"), ("moon,", "moon"), ("12.5", "12.5"), ("", "")])
def test_decoding(noisy, plain):
    text = "the idiot is stupid and the moron is a good man in the moon " * 20
    codes = toxicity._CODE[np.frombuffer(text.encode(), np.uint8)]
    counts = np.zeros((28, 28, 28))
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    restorer = toxicity.Restorer(toxicity.language_model(counts), frozenset({"stupid", "idiot", "moron"}))
    assert restorer.token(noisy) == plain
    assert restorer.words("a s t u p i d. man")[1] == ["astupid"]


@pytest.mark.parametrize("noisy, plain", [
    ("stuupid", "stupid"), ("idioot", "idiot"), ("morron", "moron"), ("455", "ass"), ("@$$", "ass"), ("a$$", "ass"), ("1d10t", "idiot"),
    ("good", "good"), ("moon", "moon"), ("455.5", "455.5"), ("1234", "1234"), ("$$$", ""), ("2021", "2021")])
def test_doubled_letters_and_letterless_tokens(noisy, plain):
    text = "the idiot is stupid and the moron is an ass and a good man in the moon " * 20
    codes = toxicity._CODE[np.frombuffer(text.encode(), np.uint8)]
    counts = np.zeros((28, 28, 28))
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    told = {"stupid": 0, "idiot": 1, "moron": 2, "ass": 3}
    restorer = toxicity.Restorer(toxicity.language_model(counts), frozenset(told))
    assert restorer.token(noisy) == plain
    assert restorer.hits(f"well {noisy} then", told)[0] == ({told[plain]} if plain in told else set())
    assert restorer.hits("you stu pid mo ron, and 1d 10t", told)[:2] == ({0, 1, 2}, 3)
    assert restorer.hits("more on the id of it", told)[0] == set()


def test_trigrams_cross_no_blocks_twice(spark):
    docs = spark.createDataFrame([(1, "abcab"), (2, None), (3, "ab")], "doc_id long, text string")
    counts = toxicity.trigrams(docs)
    assert counts.sum() == 3 and counts[1, 2, 3] == 1


def plain_top(rows, asked, k):
    out = {}
    for q, v in asked:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) * (rng.random(6) < 0.5) / 1000]) for i in range(700)]
    rows += [(700 + i, [0.001] * 6) for i in range(60)] + [(800, [0.5]), (900, [])]
    bad = [(1000, None), (1100, [None, 1.0]), (1200, [float("nan")]), (1300, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows + bad], "vec_id long, embedding array<float>, score double")
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    vectors = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.scaled(F.col("embedding")).alias("embedding"))
    want = plain_top(whole, [r for r in whole if r[0] % 100 == 0], 10)
    for block, at_once in ((64, 3), (4096, 4096)):
        got = {}
        for r in topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10, block, at_once).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert got == want
    assert topk.embedding_neighbours(df).count() == sum(map(len, want.values()))
    assert topk.embedding_neighbours(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.embedding_neighbours(few).collect()] == [(0, 1, 1, 1024 * 1024)]


def test_token_counts_equal_the_encoder(spark):
    docs = table(spark, SMALL, "documents")
    encode = tokencounts._encoder(tokencounts.VOCABULARY).encode_ordinary
    want = {r.doc_id: len(encode(r.text or "")) for r in docs.collect()}
    for block in (7, 1 << 20):
        out = tokencounts.token_counts(docs, block=block)
        assert {r.doc_id: r.tokens for r in out.collect()} == want
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (None, "one two", 9)], "doc_id long, text string, tokens long")
    assert sorted((r.doc_id or 0, r.tokens) for r in tokencounts.token_counts(odd).collect()) == [
        (0, len(encode("one two"))), (1, 0), (2, 0), (2, 0)]
    assert tokencounts.token_counts(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_stitching_of_any_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for n in range(4):
        ids = rng.choice([1, 2, tokencounts.END], 60 if n else 0, p=[0.5, 0.3, 0.2]).astype(tokencounts.KIND)
        (tmp_path / f"part-{n:05d}").write_bytes(ids.tobytes())
        pieces = np.split(ids, np.flatnonzero(ids == tokencounts.END) + 1)
        want += [(n, k, len(p) - (k < len(pieces) - 1), k < len(pieces) - 1) for k, p in enumerate(pieces) if k < len(pieces) - 1 or len(p)]
    got = tokencounts.stitched(tokencounts.scanned(spark, str(tmp_path), block)).collect()
    assert sorted((int(r.file[-5:]), r.ordinal, r.tokens, r.ended) for r in got) == want


def test_mixing_meets_its_targets(spark):
    docs = table(spark, SF, "documents")
    out = mixing.mixed(docs, table(spark, SF, "labels"), targets=(0.7, 0.2, 0.1)).toPandas()
    assert len(out) == docs.count() and (out.rate >= 0).all()
    p, t = np.array(out.posteriors.tolist()), out.tokens.to_numpy()
    assert np.abs((p * (t * out.rate.to_numpy())[:, None]).sum(0) / t.sum() - [0.7, 0.2, 0.1]).max() < 1e-5
    # The rates are the projection that the conditions of a least-squares optimum ask for.
    mass = p * t[:, None]
    kept = out.rate.to_numpy() > 0
    pull = np.linalg.lstsq(mass[kept], 1 - out.rate.to_numpy()[kept], rcond=None)[0]
    assert np.abs(np.maximum(0, 1 - mass @ pull) - out.rate).max() < 1e-6


def test_mixing_of_odd_rows(spark):
    docs, labels = labelled(spark)
    docs = docs.withColumnRenamed("score", "rate")
    out = mixing.mixed(docs, labels)
    assert sorted(out.columns) == ["doc_id", "domain", "posteriors", "rate", "text", "tokens"] and out.count() == 85
    assert {r.rate for r in out.where("text is null or text = ''").collect()} == {1.0}
    shifted = spark.createDataFrame([(1, None, "a b c"), (1, "a b c", None)], "doc_id int, note string, text string")
    assert {r.note: r.tokens for r in mixing.mixed(shifted, labels).collect()} == {None: 3, "a b c": 0}
    assert mixing.mixed(docs.limit(0), labels).count() == 0
    assert mixing.mixed(docs, labels.limit(0)).select("posteriors").first()[0] == [1 / 3] * 3


def test_pipeline_runs_and_its_decisions_take_effect(spark):
    import corpus_pipeline as p

    assert p.ORACLE_SQL is None and len(p.STAGES) == 5
    docs = table(spark, SF, "documents")
    before = {r.doc_id for r in docs.collect()}
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        now = {r.doc_id for r in docs.collect()}
        assert now <= before and now
        before = now
    made = lambda: set(Path(p.shared_folder(spark).removeprefix("file:")).glob("pipeline-*/*"))
    old = made()
    assert p.run(spark, SF).count() == len(before)
    assert {f.name for f in made() - old} == {"4"}


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5)],
                                 table(spark, SMALL, "documents").schema)
    for rows in (docs, docs.limit(0)):
        for _, stage in p.STAGES:
            stage(spark, rows, SMALL).collect()
    assert p.one_of_each_group(spark, docs, SMALL).count() == 3
    clash = docs.select("*", *[F.lit(7).alias(c) for c in ("score", "predicted", "lines_cut", "fp", "component_id", "item_id", "key", "_row")])
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, clash, SMALL)
        assert out.columns == clash.columns and {(r.score, r.predicted, r.lines_cut, r.fp) for r in out.collect()} <= {(7, 7, 7, 7)}
    assert p.to_target_weights(spark, clash, SMALL).count() == 4
