"""Link features, model and policy score."""

import math

import numpy as np
from pyspark.sql import functions as F

from clauselake.operators import features as fe


def feats(spark, text, href, context="footer", base="https://a.com/", content=None):
    df = spark.createDataFrame([(text, href, context, base, content)], "t string, h string, c string, b string, p string")
    page = fe.page_features(F.col("p")) if content is not None else None
    got = df.select(fe.link_features(F.col("t"), F.col("h"), F.col("c"), F.col("b"), page).alias("f")).first().f
    return dict(zip(fe.FEATURE_NAMES, got))


def test_footer_policy_link(spark):
    f = feats(spark, "Privacy Policy 2024", "/legal/privacy-policy")
    assert f["has_privacy_keyword"] == 1 and f["has_terms_keyword"] == 0 and f["is_in_footer"] == 1
    assert f["text_match_strength"] == 2 / 5  # privacy, privacy policy
    assert f["url_has_privacy_path"] == 1 and f["url_has_legal_path"] == 1 and f["url_depth"] == 2 / 5
    assert f["url_length"] == len("/legal/privacy-policy") / 200 and f["url_is_https"] == 1
    assert f["link_has_year"] == 1 and f["link_text_length"] == 19 / 50 and f["link_is_external"] == 0
    assert sum(f[n] for n in fe.PAGE_FEATURES) == 0


def test_icon_external_and_content(spark):
    f = feats(spark, "🔒 Trust", "https://b.com/x", "unknown", content="call 555-123-4567 " + "consent processing " * 5)
    assert f["link_has_icon"] == 1 and f["link_is_external"] == 1 and f["is_in_body"] == 1
    assert f["page_has_contact_info"] == 1 and f["page_has_legal_jargon"] == 1 and f["page_word_count"] == 12 / 5000
    assert f["page_has_privacy_content"] == 0


def test_url_features(spark):
    df = spark.createDataFrame([("https://a.com/privacy",), ("#x",)], "u string")
    got = [r.f for r in df.select(fe.url_features(F.col("u"), F.lit("https://a.com/")).alias("f")).collect()]
    assert got[0][0] == 1 and got[0][14] == 1 and got[1] == [0.0] * 24


def sig(x):
    return 1 / (1 + math.exp(-x))


def test_forward_pass_by_hand(spark):
    layers = [([[0.1] * 24] * 32, [0.0] * 32), ([[0.05] * 32] * 16, [0.1] * 16), ([[0.2] * 16], [-1.0])]
    df = spark.createDataFrame([([1.0] * 24,), ([0.0] * 24,)], "features array<double>")
    got = [r.model_score for r in fe.score_links(df, layers).collect()]

    def net(total):
        h1 = sig(0.1 * total)
        h2 = sig(0.05 * 32 * h1 + 0.1)
        return sig(0.2 * 16 * h2 - 1.0)

    assert all(abs(a - b) < 1e-12 for a, b in zip(got, (net(24), net(0))))


def test_confidence_bands(spark):
    for score, want in ((0.86, "high"), (0.84, "medium"), (0.66, "medium"), (0.64, "low"), (0.14, "high")):
        bias = math.log(score / (1 - score))
        df = spark.createDataFrame([([0.0],)], "features array<double>")
        r = fe.score_links(df, [([[1.0]], [bias])]).first()
        assert (r.model_confidence, r.is_policy) == (want, score > 0.5)


def test_load_weights():
    assert fe.load_weights('[{"weights": [[1, 2]], "bias": [3]}]') == [([[1, 2]], [3])]


XOR = [([0.0, 0.0], 0), ([0.0, 1.0], 1), ([1.0, 0.0], 1), ([1.0, 1.0], 0)]


def test_xor_is_learned(spark):
    df = spark.createDataFrame(XOR * 5, "features array<double>, target int").coalesce(2)
    layers, accuracy = fe.train_link_model(df, layers=(2, 6, 1), seed=11, epochs=60, rate=8.0)
    assert accuracy == 1.0
    scored = fe.score_links(df, layers).select("target", "is_policy").collect()
    assert all(r.is_policy == bool(r.target) for r in scored)


def test_training_equals_a_run_on_the_driver(spark):
    """One batch: the steps are those of plain descent with momentum, however the rows lie."""
    rng = np.random.default_rng(1)
    x = rng.random((300, 24))
    y = (x[:, 3] + x[:, 11] > 1).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y)], "features array<double>, target int").repartition(5)
    got, accuracy = fe.train_link_model(df, epochs=20, rate=0.5)
    stack = [[w.copy(), b.copy()] for w, b in fe.first_weights((24, 32, 16, 1), 7)]
    speed = [[np.zeros_like(w), np.zeros_like(b)] for w, b in stack]
    for _ in range(20):
        out = [x]
        for w, b in stack:
            out.append(1 / (1 + np.exp(-(out[-1] @ w.T + b))))
        delta = (y[:, None] - out[-1]) * out[-1] * (1 - out[-1])
        for k in (2, 1, 0):
            back = delta @ stack[k][0]
            for i, g in enumerate((delta.T @ out[k], delta.sum(0))):
                speed[k][i] = 0.9 * speed[k][i] + 0.5 * g / 300
            delta = back * out[k] * (1 - out[k])
        for k in range(3):
            for i in (0, 1):
                stack[k][i] = stack[k][i] + speed[k][i]
    for (w, b), (v, c) in zip(got, stack):
        assert np.allclose(w, v, atol=1e-9) and np.allclose(b, c, atol=1e-9)
    assert 0 < accuracy <= 1


def test_training_is_the_same_twice_and_for_odd_rows(spark):
    rows = [([0.1, 0.2], 1), ([0.9, 0.1], 0), (None, 1), ([0.1], 1), ([0.1, None], 0), ([0.3, 0.3], None)] * 6
    df = spark.createDataFrame(rows, "features array<double>, target int").coalesce(1)
    a = fe.train_link_model(df, layers=(2, 3, 1), epochs=2, batch_rows=3)
    assert a == fe.train_link_model(df, layers=(2, 3, 1), epochs=2, batch_rows=3)
    layers, accuracy = fe.train_link_model(df.limit(0), layers=(2, 3, 1))
    assert accuracy == 0.0 and len(layers) == 2


def test_feedback(spark):
    fb = spark.createDataFrame([("a.com", "https://a.com/p", "https://a.com/q"), ("b.com", "https://b.com/none", None)],
                               "domain string, correct_url string, incorrect_url string")
    pages = spark.createDataFrame([(1, "https://a.com/p", "Privacy policy, contact us")], "page_id int, url string, html string")
    got = {r.url: (r.target, r.features[0], r.features[19]) for r in fe.feedback_examples(fb, pages).collect()}
    assert got == {"https://a.com/p": (1, 1.0, 1.0), "https://a.com/q": (0, 0.0, 0.0), "https://b.com/none": (1, 0.0, 0.0)}


def test_adjust(spark):
    policy = "privacy policy personal information " + "x" * 100
    rows = [("https://a.com/p", None), ("https://a.com/p", "short"), ("https://a.com/", "x" * 200), ("https://a.com/", policy),
            ("https://a.com/p", policy), ("https://a.com/privacy-policy", "x" * 6000), ("https://a.com/privacy-policy", "x" * 200), ("https://a.com/p", "x" * 200)]
    df = spark.createDataFrame([(i, u, h, 0.9, "high") for i, (u, h) in enumerate(rows)], "i int, url string, html string, model_score double, model_confidence string")
    got = [(round(r.adjusted_score, 3), r.adjusted_confidence, r.adjusted_policy) for r in fe.adjust_prediction(df).orderBy("i").collect()]
    assert got == [(0.09, "low", False), (0.2, "low", False), (0.2, "low", False), (0.9, "high", True), (0.9, "high", True), (0.765, "medium", True),
                   (0.63, "medium", True), (0.35, "low", False)]


def test_combine(spark):
    df = spark.createDataFrame([(0.7, 10, False, 0), (0.5, 10, False, 3), (0.5, 10, False, 2), (None, 33, True, 0)], "m double, c int, v boolean, k int")
    got = [tuple(r.x) for r in df.select(fe.combine_confidence(F.col("m"), F.col("c"), F.col("v"), F.col("k")).alias("x")).collect()]
    assert got == [(46, True), (34, True), (34, False), (33, True)]


SCORE = ("clauses_found array<string>, contact_info string, third_party_sharing array<string>, reading_level string, "
         "key_findings array<struct<category:string,text:string>>")


def score(spark, *row):
    r = fe.policy_score(spark.createDataFrame([row], SCORE)).first()
    return r.policy_score, len(r.deductions)


def test_policy_score(spark):
    all_clauses = ["deletion_clause", "contact_clause", "opt_out_clause"]
    assert score(spark, all_clauses, None, [], "Simple", []) == (100, 2)
    worst = [("THREAT", "vague and kept forever"), ("THREAT", "they TRACK you with third parties")]
    assert score(spark, [], None, ["We SELL it", "marketing"], "Complex", worst) == (100 - 15 - 10 - 18 - 7 - 8 - 6 - 5, 7)
    assert score(spark, None, "x@y", None, None, None) == (85, 1)
    assert score(spark, all_clauses[:2], None, ["a", "b", "c"], None, []) == (96, 1)
    assert score(spark, all_clauses[:2], None, list("abcdef"), "Moderate", []) == (89, 2)
    assert score(spark, all_clauses[:2], None, ["marketing"] + list("abcdef"), None, []) == (88, 1)


def test_findings_order(spark):
    df = spark.createDataFrame([([("GOOD", "1"), ("THREAT", "2"), (None, "3"), ("THREAT", "4"), ("CONCERNING", "5")],)],
                               "f array<struct<category:string,text:string>>")
    assert [x.text for x in df.select(fe.sort_findings(F.col("f")).alias("s")).first().s] == ["5", "2", "4", "3", "1"]
    agg = spark.createDataFrame([("a", "privacy", 80, "complete"), ("a", "terms", 50, "complete"), ("a", "ai", 10, "failed"), ("a", "ai", None, "complete")],
                                "domain string, policy_type string, score int, status string")
    assert fe.aggregate_policy_score(agg, status="status").first().aggregate_score == 68


def test_batches_are_dealt_to_several_tasks_and_steps_stay_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(v.tolist(), int(v[0] > 0.5)) for v in rng.random((400, 2))]
    df = spark.createDataFrame(rows, "features array<double>, target int").coalesce(2)
    whole, _ = fe.train_link_model(df, layers=(2, 3, 1), epochs=3, batch_rows=100)
    monkeypatch.setattr(fe, "PIECE_ROWS", 10)
    folded, seen, steps = fe._descend, [], []
    monkeypatch.setattr(fe, "_descend", lambda blocks, *a: (seen.append(blocks.getNumPartitions()), folded(blocks, *a))[1])
    run = type(spark.sparkContext).runJob
    monkeypatch.setattr(type(spark.sparkContext), "runJob", lambda self, rdd, f, parts=None, *a: (steps.append(list(parts)), run(self, rdd, f, parts, *a))[1])
    pieces, _ = fe.train_link_model(df, layers=(2, 3, 1), epochs=3, batch_rows=100)
    assert seen == [4 * fe.PIECES] and len(steps) == 12 and all(len(p) == fe.PIECES for p in steps)
    for (w, b), (v, c) in zip(whole, pieces):
        assert np.allclose(w, v, atol=1e-12) and np.allclose(b, c, atol=1e-12)
