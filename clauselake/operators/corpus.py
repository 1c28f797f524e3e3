"""Corpus keyword mining: term counts, keyword scores and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import text as tx
from clauselake.functions.terms import literal_array
from clauselake.operators.keyed import small_side, top_per_key
from clauselake.values.text_terms import KEYWORD_INDICATORS

# Smallest counts, list lengths and report lengths.
MIN_WORD_COUNT = 5
MIN_BIGRAM_COUNT = 3
TOP_WORDS = 200
REPORT_ROWS = {"high_confidence": 50, "medium_confidence": 30, "low_confidence": 30}

# Function words for runs without an own list; pass ``stop_words`` for more.
STOP_WORDS = (
    "the", "and", "for", "are", "was", "were", "with", "that", "this", "these", "those", "from",
    "not", "but", "you", "your", "our", "his", "her", "its", "they", "them", "their", "who",
    "which", "what", "when", "where", "will", "would", "can", "could", "may", "might", "shall",
    "should", "has", "have", "had", "been", "being", "any", "all", "some", "such", "than", "then",
    "into", "onto", "out", "over", "under", "also", "only", "other", "about",
)


def _excluded(word: Column, stop_words: Sequence[str]) -> Column:
    return word.isin(*stop_words) if stop_words else F.lit(False)


def _counted(terms: DataFrame) -> DataFrame:
    """Count and document count per term from one sorted term array per document.

    A term opens a new document exactly where it differs from the term before it in its sorted
    array. That makes the document count a plain sum, so one shuffle with map-side partial sums
    does both counts and a frequent term is never gathered.
    """
    listed = terms.select(F.sort_array("terms").alias("terms")).select(
        F.explode(
            F.arrays_zip(
                F.col("terms").alias("term"),
                F.concat(
                    F.array(F.lit(None).cast("string")),
                    F.slice("terms", F.lit(1), F.greatest(F.size("terms") - 1, F.lit(0))),
                ).alias("before"),
            )
        ).alias("t")
    )
    # The zip pads an empty array with one null term.
    return listed.where(F.col("t.term").isNotNull()).groupBy(F.col("t.term").alias("term")).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.when(F.col("t.term").eqNullSafe(F.col("t.before")), 0).otherwise(1))
        .cast("long")
        .alias("documents"),
    )


def _without(counts: DataFrame, words: DataFrame, parts: Sequence[Column]) -> DataFrame:
    """Anti-join the counted terms with a stop-word table, once per word of the term.

    It runs after the count, on distinct terms instead of all occurrences.
    """
    names = words.select(F.lower(F.col(words.columns[0])).alias("_stop")).distinct()
    for part in parts:
        counts = counts.join(small_side(names), part == F.col("_stop"), "left_anti")
    return counts


def word_frequencies(docs: DataFrame, stop_words: Sequence[str] | DataFrame = STOP_WORDS,
                     text: str = "text", min_count: int = MIN_WORD_COUNT) -> DataFrame:
    """``term, count, documents`` of every word with at least ``min_count`` occurrences."""
    words = docs.select(tx.tokens(F.col(text)).alias("terms"))
    if isinstance(stop_words, DataFrame):
        counts = _without(_counted(words), stop_words, [F.col("term")])
    else:
        counts = _counted(
            words.select(
                F.filter("terms", lambda w: ~_excluded(w, stop_words)).alias("terms")
            )
        )
    return counts.where(F.col("count") >= min_count)


def bigram_frequencies(docs: DataFrame, stop_words: Sequence[str] | DataFrame = STOP_WORDS,
                       text: str = "text", min_count: int = MIN_BIGRAM_COUNT) -> DataFrame:
    """As ``word_frequencies`` for neighbouring words; one stop word drops the pair."""
    pairs = docs.select(tx.tokens(F.col(text)).alias("words")).select(
        tx.bigrams(F.col("words")).alias("terms")
    )
    first = F.substring_index("term", " ", 1)
    second = F.substring_index("term", " ", -1)
    if isinstance(stop_words, DataFrame):
        counts = _without(_counted(pairs), stop_words, [first, second])
    else:
        counts = _counted(
            pairs.select(
                F.filter(
                    "terms",
                    lambda p: ~_excluded(F.substring_index(p, " ", 1), stop_words)
                    & ~_excluded(F.substring_index(p, " ", -1), stop_words),
                ).alias("terms")
            )
        )
    return counts.where(F.col("count") >= min_count)


def top_terms(counts: DataFrame, n: int) -> DataFrame:
    """Most frequent ``n`` terms; equal counts in term order."""
    return counts.orderBy(F.col("count").desc(), F.col("term")).limit(n)


def keyword_scores(words: DataFrame, total_docs: DataFrame,
                   indicators: Sequence[str] = KEYWORD_INDICATORS,
                   top: int = TOP_WORDS) -> DataFrame:
    """Heuristic keywords: frequent words that contain an indicator or are part of one.

    ``total_docs`` is a one-row frame with the number of documents; it enters as a scalar
    subquery.
    """
    n = total_docs.scalar()
    share = F.col("documents") / n
    frequency = F.least(F.lit(1.0), F.col("count") / F.lit(100.0))
    hit = F.exists(
        literal_array(indicators),
        lambda i: F.contains(F.col("term"), i) | F.contains(i, F.col("term")),
    )
    return (
        top_terms(words, top)
        .where(hit)
        .select(
            "term",
            F.col("count").alias("frequency"),
            F.col("documents").alias("document_frequency"),
            (share * 0.5 + frequency * 0.5).alias("score"),
            F.when(F.col("documents") > n * F.lit(0.5), "high_confidence")
            .otherwise("medium_confidence")
            .alias("category"),
        )
    )


def labelled_keyword_scores(words: DataFrame, bigrams: DataFrame, labels: DataFrame,
                            total_docs: DataFrame) -> DataFrame:
    """Keywords from a label table ``term, is_policy_related, confidence``.

    A term is looked up among the words first, then among the bigrams.
    """
    n = total_docs.scalar()
    counts = words.unionByName(bigrams)  # words hold no blank, bigrams always do
    share = F.col("documents") / n
    frequency = F.least(F.lit(1.0), F.col("count") / F.lit(100.0))
    # Weight of a label.
    label = F.when(F.col("confidence") == "high", 1.0).when(
        F.col("confidence") == "medium", 0.7
    ).otherwise(0.4)
    wanted = labels.where("is_policy_related").select(
        F.col("term").alias("label_term"), "confidence", F.lower("term").alias("term")
    )
    return counts.join(small_side(wanted), "term").select(
        F.col("label_term").alias("term"),
        F.col("count").alias("frequency"),
        F.col("documents").alias("document_frequency"),
        (share * 0.4 + frequency * 0.3 + label * 0.3).alias("score"),
        F.when(F.col("confidence") == "high", "high_confidence")
        .when(F.col("confidence") == "medium", "medium_confidence")
        .otherwise("low_confidence")
        .alias("category"),
    )


def keyword_report(keywords: DataFrame, rows: dict[str, int] = REPORT_ROWS) -> DataFrame:
    """Best keywords per category with their rank, as many as the report shows of each."""
    ranked = top_per_key(
        keywords, ["category"], [F.col("score").desc(), F.col("term")], max(rows.values())
    )
    keep = F.coalesce(
        *[F.when(F.col("category") == c, F.col("rank") <= n) for c, n in rows.items()],
        F.lit(False),
    )
    return ranked.where(keep)
