"""Long word lists by the index of letters against one search per term."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauselake.functions import matching
from clauselake.functions import terms as tm
from clauselake.functions.matching import TermMatcher

TERMS = ["privacy", "data protection", "隐私", "数", "プライバシー", "vie privée", "конфиденциальность", "a", "of", " the ", "x y", "p.q", " ", "zzz",
         "privacy", "ﬁ", "e-privacy", "protection des données", "　", "12"]
TEXTS = ["privacyholder and data  protection", "data protection of the 隐私政策 数据", "", None, "プライバシーポリシー", "la vie privée, x y p.q", "A OF", "\n\t",
         "конфиденциальностью", "e-privacy protection des données　", "of\tthe"]


def test_index_equals_search(spark, monkeypatch):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices([*TERMS, " ", ",", "x", "The"], k=12)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")

    def run(at):
        monkeypatch.setattr(tm, "INDEX_FROM", at)
        return df.select("id", tm.terms_found(F.col("text"), TERMS).alias("f"), tm.terms_found_count(F.col("text"), TERMS).alias("n"),
                         F.to_json(tm.occurrence_map(F.lower("text"), TERMS)).alias("m"), tm.term_occurrences(F.col("text"), TERMS).alias("o")) \
            .orderBy("id").collect()

    assert run(1) == run(10**9)


@pytest.mark.parametrize("terms", [["abc"], ["ab", "abcd", "bcde"], ["long word list", "list"], ["\t"], ["x"]])
def test_every_term_stands_under_a_run_of_its_own(terms):
    index = tm.gram_index(terms)
    assert sorted(p for places in index.values() for p in places) == list(range(len(terms)))
    assert all(run in terms[p] for run, places in index.items() for p in places)


def test_terms_take_runs_that_few_terms_share():
    index = tm.gram_index(["station one", "station two", "station six"])
    assert set(index) == {"one", "two", "six"}


def test_index_is_one_expression_in_one_stage(spark, monkeypatch):
    monkeypatch.setattr(tm, "INDEX_FROM", 1)
    plan = spark.range(1).select(tm.terms_found(F.lit("x").cast("string"), TERMS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def _text(rnd, letters, most):
    return "".join(rnd.choice(letters) for _ in range(rnd.randrange(most)))


@pytest.mark.parametrize("letters", ["ab", "ab '-", "a\u00e9 b\u20ac", "a", "abcdefgh"])
@pytest.mark.parametrize("whole", [False, True])
def test_batch_matcher_equals_patterns(letters, whole):
    if whole and not letters.isascii():
        pytest.skip("whole words are those of ASCII texts")
    rnd = random.Random(5)
    edge = r"\b" if whole else ""
    for _ in range(40):
        terms = sorted({t for _ in range(30) if (t := _text(rnd, letters, 13))})
        texts = [None, "", *[_text(rnd, letters, 120) + rnd.choice(terms) for _ in range(9)]]
        row, term, count = TermMatcher(terms).matches(pa.array(["cut", *texts])[1:], whole)
        want = {(i, j): n for i, x in enumerate(texts) for j, t in enumerate(terms)
                if (n := len(re.findall(edge + re.escape(t) + edge, x or "", re.ASCII)))}
        assert list(zip(row.tolist(), term.tolist())) == sorted(want) and count.tolist() == [want[k] for k in sorted(want)]


def test_matcher_over_the_borders_of_its_chunks(monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 5)
    terms = ["a", "needle", "long needle in hay", "le i"]
    texts = ["xx needle long needle in hay", "needle", "nee", "dle"]
    row, term, count = TermMatcher(terms).matches(pa.array(texts))
    assert {(r, terms[t]): c for r, t, c in zip(row, term, count)} == {
        (i, t): x.count(t) for i, x in enumerate(texts) for t in terms if t in x}


def test_long_lists_are_counted_in_one_pass_over_a_batch(spark):
    terms = [a + b + c for a in TERMS[:12] for b in TERMS[:12] for c in TERMS[:12]][: tm.INDEX_FROM + 50]
    texts = [None, "", terms[3] * 4 + " " + terms[801], "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, x string").select("id", F.map_entries(tm.occurrence_map(F.col("x"), terms)).alias("m"))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    distinct = list(dict.fromkeys(terms))
    assert [list(map(tuple, r.m)) for r in df.orderBy("id").collect()] == [
        [(t, x.count(t)) for t in distinct if t in x] if x else [] for x in texts]


def test_word_counts_equal_word_hits(spark):
    lists = [("the", "of", "and that", "the"), ("it's", "co-op", "a a", "o"), ("-x",), ("",)]
    texts = [None, "", "the of the and that the", "a a a a it's it's-co-op o'the", "o -x y-x the", "x" * 50]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for terms in lists:
        got = df.select(tm.hits_of(tm.word_counts(F.col("x"), terms), 0.2, 4).alias("a"), tm.word_hits(F.col("x"), terms, 0.2, 4).alias("b"),
                        F.size(tm.word_counts(F.col("x"), terms)).alias("n")).collect()
        assert all(r.a == r.b and r.n == len(terms) for r in got)
    assert df.select(F.size(tm.word_counts(F.col("x"), ()))).first()[0] == 0


@pytest.mark.parametrize("pattern, runs", [
    (r"(?i)\b(?:section|article|clause)\s*\d+", ("section", "article", "clause")),
    (r'(?i)\b(?:"[^"]+"\s+(?:means|refers to)|definitions?:)', ("means", "refers to", "definition")),
    (r"(?i)(?:effective|last\s+(?:updated|modified))[:\s]+\d", ("effective", "last")), ("(?:abc|def)?x", ()), ("(?:abc|def){0,2}x", ()),
    ("a|(?:bcd|efg)x", ()), ("(?:ab|cdef)z", ()), ("(?!abcd)x+", ()), (r"[(|\]]x(?:abcd|)", ()), (r"\((?:abc|d\|ef)", ()), ("plain", ("plain",)),
])
def test_runs_that_a_choice_needs(pattern, runs):
    assert tm.required_choices(pattern) == runs


def test_detector_counts_all_its_words_in_one_pass(spark):
    from clauselake.operators import detection as de

    pad = " filler" * 90
    texts = ["privacy policy of the data controller, section 4" + pad, "nothing" + pad, "short", None]
    df = de.detect_policy(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), categories={"core": ("privacy", "data"), "none": ("absent",)},
                          types={"p": ("privacy", "policy"), "t": ("terms",)}, weights={"core": 3.0, "none": 1.0})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
    got = [(round(r.confidence, 6), r.document_type, r.matched_categories, r.structure) for r in df.orderBy("id").collect()]
    assert got == [(0.9, "p", ["core"], ["numbered_sections"]), (0.0, None, [], []), (0.0, None, [], []), (0.0, None, [], [])]
