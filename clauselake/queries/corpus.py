"""Corpus queries: tokens, frequencies, keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.functions import text as tx
from clauselake.operators import corpus as co
from clauselake.queries.base import query, sql_list, with_views

CLEAN = (
    r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, "
    r"'<[^>]*>', ' ', 'g'), 'https?://[^\s]+', ' ', 'g'), "
    r"'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}', ' ', 'g'), "
    r"'[^a-zA-Z0-9\s''-]', ' ', 'g'), '\s+', ' ', 'g')))"
)


def tokens_view(table: str = "documents", key: str = "doc_id", name: str = "v_tokens") -> str:
    return (
        f"{name} AS (SELECT {key}, list_filter(string_split({CLEAN.format('text')}, ' '), "
        rf"lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^\d+$')) AS words FROM {table})"
    )


STOP = f"{sql_list(co.STOP_WORDS)}"
V_WORDS = f"""v_words AS (SELECT term, count(*) AS count, count(DISTINCT doc_id) AS documents FROM (
 SELECT doc_id, unnest(words) AS term FROM v_tokens) t
 WHERE NOT list_contains({STOP}, term) GROUP BY term HAVING count(*) >= 5)"""
V_BIGRAMS = f"""v_bigrams AS (SELECT term, count(*) AS count, count(DISTINCT doc_id) AS documents FROM (
 SELECT doc_id, a || ' ' || b AS term, a, b FROM (
  SELECT doc_id, unnest(words[1:-2]) AS a, unnest(words[2:]) AS b FROM v_tokens WHERE len(words) > 1) p
 WHERE NOT list_contains({STOP}, a) AND NOT list_contains({STOP}, b)) t
 GROUP BY term HAVING count(*) >= 3)"""


@query(with_views(tokens_view()) + f"""SELECT doc_id, CAST(length({CLEAN.format('text')}) AS INT) AS clean_chars,
 CAST(len(words) AS INT) AS tokens, CAST(greatest(len(words) - 1, 0) AS INT) AS bigrams,
 md5(array_to_string(words, ' ')) AS words_hash FROM documents JOIN v_tokens USING (doc_id)""")
def corpus_tokens(t):
    words = tx.tokens(F.col("text"))
    return (
        t.documents.select("doc_id", F.length(tx.clean_for_tokens(F.col("text"))).alias("clean_chars"),
                           words.alias("words"))
        .select(
            "doc_id", "clean_chars", F.size("words").alias("tokens"),
            F.size(tx.bigrams(F.col("words"))).alias("bigrams"),
            F.md5(F.array_join("words", " ")).alias("words_hash"),
        )
    )


@query(with_views(tokens_view(), V_WORDS) + "SELECT term, count, documents FROM v_words")
def term_frequencies(t):
    return co.word_frequencies(t.documents)


@query(with_views(tokens_view(), V_BIGRAMS) + "SELECT term, count, documents FROM v_bigrams")
def bigram_frequencies(t):
    return co.bigram_frequencies(t.documents)


@query(with_views(tokens_view(), V_WORDS)
       + "SELECT term, count, documents FROM v_words ORDER BY count DESC, term LIMIT 1000")
def top_terms(t):
    return co.top_terms(co.word_frequencies(t.documents), 1000)


STOP_TABLE = tokens_view("benchmark", "item_id", "v_stop_tokens")


@query(with_views(tokens_view(), STOP_TABLE) + """, v_stop AS (SELECT DISTINCT unnest(words) AS stop FROM v_stop_tokens),
 c AS (SELECT term, count(*) AS count, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(words) AS term FROM v_tokens) x GROUP BY term)
SELECT term, count, documents FROM c WHERE count >= 5 AND term NOT IN (SELECT stop FROM v_stop)""")
def stop_word_table(t):
    stop = t.read("benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("word"))
    return co.word_frequencies(t.documents, stop)


@query(with_views(tokens_view(), STOP_TABLE) + """, v_stop AS (SELECT DISTINCT unnest(words) AS stop FROM v_stop_tokens),
 c AS (SELECT a || ' ' || b AS term, any_value(a) AS a, any_value(b) AS b, count(*) AS count, count(DISTINCT doc_id) AS documents FROM (
  SELECT doc_id, unnest(words[1:-2]) AS a, unnest(words[2:]) AS b FROM v_tokens WHERE len(words) > 1) p GROUP BY 1)
SELECT term, count, documents FROM c WHERE count >= 3 AND a NOT IN (SELECT stop FROM v_stop) AND b NOT IN (SELECT stop FROM v_stop)""")
def stop_word_table_bigrams(t):
    stop = t.read("benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("word"))
    return co.bigram_frequencies(t.documents, stop)


INDICATORS = ("the", "tion", "ent", "data", "und", "que", "ing", "con", "ver")
V_KEYWORDS = f"""v_keywords AS (SELECT term, count AS frequency, documents AS document_frequency,
 documents / n * 0.5 + least(1.0, count / 100.0) * 0.5 AS score,
 CASE WHEN documents > n * 0.5 THEN 'high_confidence' ELSE 'medium_confidence' END AS category
 FROM (SELECT * FROM v_words ORDER BY count DESC, term LIMIT 200) w, (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents) d
 WHERE len(list_filter({sql_list(INDICATORS)}, lambda i: contains(term, i) OR contains(i, term))) > 0)"""


def _keywords(t):
    total = t.read("documents").agg(F.count(F.lit(1)).alias("n"))
    return co.keyword_scores(co.word_frequencies(t.documents), total, INDICATORS)


@query(with_views(tokens_view(), V_WORDS, V_KEYWORDS)
       + "SELECT term, frequency, document_frequency, round(score, 6) AS score, category FROM v_keywords")
def keyword_scores(t):
    return _keywords(t).withColumn("score", F.round("score", 6))


@query(with_views(tokens_view(), V_WORDS, V_KEYWORDS)
       + """SELECT term, frequency, document_frequency, round(score, 6) AS score, category, CAST(rank AS INT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, term) AS rank FROM v_keywords) k
 WHERE rank <= CASE category WHEN 'high_confidence' THEN 50 ELSE 30 END""")
def keyword_report(t):
    return co.keyword_report(_keywords(t)).withColumn("score", F.round("score", 6))


@query(with_views(tokens_view(), V_WORDS, V_BIGRAMS) + """, v_all AS (SELECT * FROM v_words UNION ALL SELECT * FROM v_bigrams),
 v_labels AS (SELECT DISTINCT upper(w) AS term, length(w) % 2 = 0 AS related,
  CASE length(w) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT unnest(words) AS w FROM v_tokens) x)
SELECT l.term, count AS frequency, documents AS document_frequency,
 round(documents / n * 0.4 + least(1.0, count / 100.0) * 0.3 + CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END * 0.3, 6) AS score,
 confidence || '_confidence' AS category
FROM v_all v JOIN v_labels l ON v.term = lower(l.term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents) d WHERE related""")
def labelled_keyword_scores(t):
    docs = t.documents
    word = F.col("w")
    size = F.length(word)
    labels = docs.select(F.explode(tx.tokens(F.col("text"))).alias("w")).distinct().select(
        F.upper(word).alias("term"), (size % 2 == 0).alias("is_policy_related"),
        F.when(size % 3 == 0, "high").when(size % 3 == 1, "medium").otherwise("low").alias("confidence"),
    )
    total = t.read("documents").agg(F.count(F.lit(1)).alias("n"))
    return co.labelled_keyword_scores(
        co.word_frequencies(docs), co.bigram_frequencies(docs), labels, total
    ).withColumn("score", F.round("score", 6))
