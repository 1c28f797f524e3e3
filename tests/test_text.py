"""Golden rows for text functions, detector and content checks."""

from pyspark.sql import functions as F

from clauselake.functions import terms as tm
from clauselake.functions import text as tx
from clauselake.operators import corpus as co
from clauselake.operators import detection as de


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_round_half_up(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (2.4,)], "x double").select(
        tm.round_half_up(F.col("x"))
    )
    assert [r[0] for r in got.collect()] == [-2, 3, 2]


def test_required_literal():
    assert tm.required_literal(r"(?i)followers?\s*:\s*\d+") == "follower"
    assert tm.required_literal(r"(?i)dpo|data\s+protection") is None
    assert tm.required_literal(r"(?i)children('s)?\s+privacy") == "children"
    assert tm.required_literal(r"(?i)ab?") is None


def test_guarded_patterns_agree_with_plain_ones(spark):
    from clauselake.values import text_terms as V

    texts = ["Last updated: today. FOLLOWERS : 12", "Article 6 gdpr, Data  Subject", "company size : 9",
             "min  read", "nothing at all", "1. Introduction\nBuy Now", "Don't have an account"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (V.POSITIVE_PATTERNS, V.NEGATIVE_PATTERNS, V.EVIDENCE_PATTERNS):
        got = df.select(
            tm.patterns_matched(F.col("t"), patterns, F.lower("t")).alias("a"),
            tm.patterns_matched(F.col("t"), patterns).alias("b"),
        ).collect()
        assert all(r.a == r.b for r in got)


def test_space_and_hash(spark):
    assert one(spark, "  a b　\n", tx.word_count) == 2
    assert one(spark, " \n\tx ", tx.trimmed) == "x"
    a = one(spark, "  A  b ", lambda c: tx.content_hash(c, "normalized"))
    assert a == one(spark, "a\nB", lambda c: tx.content_hash(c, "normalized"))
    assert one(spark, "x", tx.content_hash) == one(spark, " x\n", tx.content_hash)


def test_tokens(spark):
    text = "Visit https://a.b/c now, mail me@x.org! 123 12a it's <b>bold</b> ab"
    assert one(spark, text, tx.tokens) == ["visit", "now", "mail", "12a", "it's", "bold"]
    assert one(spark, text, tx.clean_for_tokens) == "visit now mail 123 12a it's bold ab"
    assert one(spark, "one two three", lambda c: tx.bigrams(tx.tokens(c))) == ["one two", "two three"]
    assert one(spark, "one", lambda c: tx.bigrams(tx.tokens(c))) == []
    assert one(spark, "12", lambda c: tx.bigrams(tx.tokens(c))) == []


def test_term_frequencies_count_documents_once(spark):
    df = spark.createDataFrame([("cat cat dog",), ("cat",), ("",)], "text string")
    got = {r.term: (r["count"], r.documents) for r in co.word_frequencies(df, (), min_count=1).collect()}
    assert got == {"cat": (3, 2), "dog": (1, 1)}


def test_labelled_scores(spark):
    words = spark.createDataFrame([("data", 50, 2)], "term string, count long, documents long")
    pairs = spark.createDataFrame([("my data", 200, 1)], "term string, count long, documents long")
    labels = spark.createDataFrame(
        [("Data", True, "high"), ("my data", True, "low"), ("x", True, "high"), ("data", False, "high")],
        "term string, is_policy_related boolean, confidence string",
    )
    total = spark.createDataFrame([(4,)], "n long")
    got = {r.term: (round(r.score, 4), r.category) for r in
           co.labelled_keyword_scores(words, pairs, labels, total).collect()}
    assert got == {"Data": (0.65, "high_confidence"), "my data": (0.52, "low_confidence")}


def test_html_text(spark):
    filler = "word " * 60
    html = (f"<html><head><title>A &amp; B</title><script>var t='</p>';</script></head><body><nav>menu</nav>"
            f"<main><p>Hello <b>wor</b>ld</p><p>{filler}</p></main><footer>foot</footer></body></html>")
    text = one(spark, html, tx.html_text)
    assert text.startswith("Hello world word") and "menu" not in text and "foot" not in text
    assert one(spark, html, tx.html_title) == "A & B"
    short = "<html><body><main>tiny</main><p>rest</p><div class='sidebar'>side</div></body></html>"
    assert one(spark, short, tx.html_text) == "tiny rest"
    assert "menu" in one(spark, html, lambda c: tx.html_text(c, "direct"))
    meta = "<meta property='og:title' content='Og'><p>x</p>"
    assert one(spark, meta, tx.html_title) == "Og"
    assert one(spark, "<p>x</p>", tx.html_title) == "Privacy Policy"


def test_chunks(spark):
    text = "intro text that is long\n\nHEADER ONE\nbody one\n\nmore of one\n\nHeader Two\nbody two"
    got = [(c.title, c.content) for c in one(spark, text, tx.chunks_by_header)]
    assert got == [("intro text that is long", ""), ("HEADER ONE", "body one\n\nmore of one"),
                   ("Header Two", "body two")]
    # A section whose first line is no title keeps the title of the one before.
    kept = [(c.title, len(c.content)) for c in one(spark, "Title here\nx\n\nA" + "b" * 120, tx.chunks_by_header)]
    assert kept[0][0] == "Title here"
    long = "T1 title\n" + "a" * 25
    parts = [(c.title, c.content) for c in one(spark, long, lambda c: tx.chunks_by_header(c, 10))]
    assert [p[0] for p in parts] == ["T1 title (Part 1)", "T1 title (Part 2)", "T1 title (Part 3)"]
    assert "".join(p[1] for p in parts) == "a" * 25


def test_sections(spark):
    text = "# Top\nINTRO PART\n1. Scope of it\nTitle Case\nHow we do it\nplain text.\n"
    got = [(s.title, s.level) for s in one(spark, text, tx.sections)]
    assert got == [("Top", 1), ("INTRO PART", 1), ("1. Scope of it", 1), ("Title Case", 2), ("How", 2)]
    few = one(spark, "some text without any heading.\n\nsecond", tx.sections)
    assert [s.title for s in few] == ["some text without any heading."]
    many = "\n".join(f"Title {'x' * i}".title() for i in range(2, 40))
    assert len(one(spark, many, tx.sections)) == 38
    assert len(one(spark, many, lambda c: tx.sections(c, 20))) == 20


def test_find_all_overlaps(spark):
    assert one(spark, "aAaa b", lambda c: tx.find_all(c, "aa")) == [0, 1, 2]
    assert one(spark, "a" * 300, lambda c: tx.find_all(c, "a", 100)) == list(range(100))
    assert one(spark, "xyz", lambda c: tx.find_all(c, "q")) == []
    assert one(spark, "a" * 3000, lambda c: tx.find_all(c, "a")) == list(range(3000))
    assert one(spark, "b.a.a", lambda c: tx.find_all(c, ".A")) == [1, 3] and one(spark, "", lambda c: tx.find_all(c, "a")) == []


def test_pdf_text(spark):
    assert one(spark, "a\r\n \r\nb\t\t c  ", tx.pdf_text_normalise) == "a\n\nb c"


def detect(spark, text, **kw):
    return de.detect_policy(spark.createDataFrame([(text,)], "text string"), **kw).first()


def test_detector_counts(spark):
    pad = " zzz" * 200
    short = detect(spark, "privacy policy")
    assert (short.confidence, short.is_policy, short.document_type) == (0.0, False, None)
    cats, types = {"core": ("gdpr", "q1")}, {"t": ("nothing", "here")}
    for n, hits in ((1, 1.0), (5, 1.8), (9, 1.8)):
        got = detect(spark, "gdpr " * n + pad, categories=cats, types=types)
        assert round(got.confidence, 6) == round(hits / 2, 6)
    flagged = detect(spark, 'Section 3. Definitions: x. Effective: 1. Contact us. Table of contents. '
                     "We may update this. To the fullest extent permitted by law." + pad,
                     categories=cats, types=types)
    assert len(flagged.structure) == 7 and round(flagged.confidence, 6) == 0.35


def test_document_type_threshold(spark):
    words = spark.createDataFrame([("aa bb",)], "w string")
    at = words.select(de.document_type(F.col("w"), {"x": ("aa",) + tuple(f"n{i}" for i in range(9))}).alias("d")).first().d
    assert at.type is None  # 0.1 is not above 0.15
    above = words.select(de.document_type(F.col("w"), {"x": ("aa", "n1", "n2"), "y": ("bb", "n1", "n2")}).alias("d")).first().d
    assert above.type == "x" and round(above.confidence, 6) == round(1 / 3, 6)


def test_filter_on_verdict_reads_text_once(spark):
    df = spark.createDataFrame([("x" * 600,)], "text string")
    plan = de.detect_policy(df).where("is_policy")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") >= 3 and plan.count("regexp_replace(lower") <= 1


def signals(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "text string")
    return de.validate_content(de.content_signals(df), **kw).first()


def test_language_and_topics(spark):
    def lang(t):
        return de.detect_language(spark.createDataFrame([(t,)], "text string")).first().language

    assert lang("privacy policy and legal terms") == "en"
    assert lang("datenschutz hinweis impressum") == "de"
    assert lang("confidentialité et vie privée, mentions légales") == "fr"
    assert lang("privacidad aviso términos") == "es"
    assert lang("zzz") is None
    got = signals(spark, "Datenschutz: personenbezogene Daten, Einwilligung, your rights")
    assert got.language == "de"
    assert set(got.topics) == {"personenbezogene daten", "einwilligung", "your rights"}


def test_validate_content_limits(spark):
    base = "we collect personal data and personal information, your rights, cookies, privacy policy. "
    good = signals(spark, base * 10)
    assert good.content_valid and not good.content_issues
    # 40 + 15 for 30 keywords + 7 strong words * 2 + 3 pairs * 5 + 1 positive pattern * 3
    assert good.content_confidence == 87
    short = signals(spark, (base * 10)[:499])
    assert not short.content_valid and short.content_issues[0].startswith("Content too short (499")
    poor = signals(spark, "buy now add to cart min read " * 30)
    assert not poor.content_valid and poor.negative == 3 and poor.positive == 0
    # The bonus of strong terms may be limited to 30.
    assert signals(spark, base[:60], cap_bonus=True).content_confidence <= signals(spark, base[:60]).content_confidence


def test_quick_reject_order(spark):
    pad = " x" * 150

    def reason(t):
        return one(spark, t, de.quick_reject)

    assert reason("linkedin followers") == "Content too short"
    assert reason("LinkedIn followers" + pad) == "Appears to be a LinkedIn profile"
    assert reason("facebook likes" + pad) == "Appears to be a Facebook page"
    assert reason("5 min read" + pad) == "Appears to be a news article"
    assert reason("published 3 days ago" + pad) == "Appears to be a news article"
    assert reason("company size industry headquarters" + pad) == "Appears to be a company directory listing"
    assert reason("nothing" + pad) == "No privacy-related terms found"
    assert reason("privacy" + pad) is None


def test_page_checks(spark):
    assert one(spark, "404 not found", de.is_garbage)
    assert not one(spark, "404 not found" + " x" * 600, de.is_garbage)
    assert one(spark, "Please log in", de.is_login_page)
    late = " " * 6000 + "please log in"
    assert one(spark, late, de.is_login_page) and not one(spark, late, lambda c: de.is_login_page(c, scan_chars=5000))
    e = one(spark, "Privacy policy. Third-party cookies policy", de.page_evidence)
    assert (e.strong, e.structural, e.is_policy) == (1, 2, True)
    assert one(spark, "overview of topics", de.is_hub_page)
    assert one(spark, "gdpr, your rights, we collect, we process, personal data", de.is_actual_policy)
    assert not one(spark, "gdpr, your rights, we collect, we process", de.is_actual_policy)


def test_gate(spark):
    df = spark.createDataFrame(
        [("https://a.com/x", "privacy " * 20), ("https://a.com/privacy", "privacy " * 20),
         ("https://a.com/x", "nothing " * 40), ("https://a.com/x", "privacy " * 28), ("https://a.com/x", "privacy " * 60)],
        "url string, text string",
    )
    assert [r.reject_reason for r in de.extraction_gate(df).collect()] == [
        "insufficient text extracted", None, "no privacy-related text found", "content is too short", None]


def test_verified_claims(spark):
    items = spark.createDataFrame([(1, "THREAT", "a"), (1, "THREAT", "b"), (1, "GOOD", "c"), (2, "THREAT", "a")],
                                  "id int, category string, claim string")
    ok = spark.createDataFrame([(1, "a"), (2, "z")], "id int, claim string")
    got = de.keep_verified(items, ok, ["id"], "claim", F.col("category") == "THREAT")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "GOOD", "c"), (1, "THREAT", "a")]
    cut = de.keep_verified(items, items.select("id", "claim"), ["id"], "claim", F.col("category") == "THREAT",
                           checked=1, order=[F.col("claim")])
    assert sorted(tuple(r) for r in cut.collect()) == [(1, "GOOD", "c"), (1, "THREAT", "a"), (2, "THREAT", "a")]
