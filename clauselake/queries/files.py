"""Files written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from clauselake.operators import corpus as co
from clauselake.queries.base import query, with_views
from clauselake.queries.corpus import V_BIGRAMS, V_WORDS, tokens_view
from clauselake.session import durable, remove, shared_folder
from clauselake.sources.readers import read_analysis_log, read_pages
from clauselake.sources.writers import append_examples, write_frequencies

TERMS = "term string, count long, documents long"


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query("SELECT page_id, url, CAST(length(html) AS INT) AS chars, md5(html) AS html_hash FROM pages")
def page_table(t):
    return read_pages(t.spark, f"{t.sf_dir}/pages.parquet").select(
        "page_id", "url", F.length("html").alias("chars"), F.md5("html").alias("html_hash")
    )


@query(with_views(tokens_view(), V_WORDS, V_BIGRAMS) + """SELECT 'words' AS kind, * FROM (SELECT term, count, documents FROM v_words ORDER BY count DESC, term LIMIT 1000) w
 UNION ALL SELECT 'bigrams', * FROM (SELECT term, count, documents FROM v_bigrams ORDER BY count DESC, term LIMIT 500) b""")
def written_frequencies(t):
    """The report files: the most frequent words and bigrams."""
    root = _folder(t)
    write_frequencies(co.word_frequencies(t.documents), co.bigram_frequencies(t.documents), root)
    parts = [
        t.spark.read.schema(TERMS).json(f"{root}/{kind}").select(F.lit(kind).alias("kind"), "*")
        for kind in ("words", "bigrams")
    ]
    out = durable(parts[0].unionByName(parts[1]))
    remove(t.spark, root)
    return out


@query("SELECT event_type AS target, count(*) AS examples, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def appended_examples(t):
    """Examples added in two rounds."""
    root = _folder(t)
    rows = t.read("events").select("event_id", F.col("event_type").alias("target"))
    for rest in (0, 1):
        append_examples(rows.where(F.pmod("event_id", F.lit(2)) == rest), root)
    out = durable(t.spark.read.parquet(root).groupBy("target").agg(
        F.count(F.lit(1)).alias("examples"), F.sum("event_id").alias("ids")
    ))
    remove(t.spark, root)
    return out


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, source AS domain, CAST(doc_id % 3 > 0 AS BOOLEAN) AS success, CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 100 AS INT) END AS score,
 length(text) AS error_chars, md5(text) AS error_hash, lang AS policy_type FROM documents""")
def analysis_log_file(t):
    """Whole documents as the error texts of an analysis log: sixteen JSON arrays, cut where the splits fall."""
    root, place = _folder(t), Window.partitionBy("g").orderBy("doc_id")
    row = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("domain"), (F.col("doc_id") % 3 > 0).alias("success"),
        F.col("text").alias("error"), F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 100).cast("int")).alias("score"),
        F.col("lang").alias("policyType")))
    lines = t.documents.withColumn("g", F.pmod("doc_id", F.lit(16))).select(
        "g", F.row_number().over(place).alias("n"), F.lead("doc_id").over(place).isNull().alias("last"), row.alias("row"))
    text = F.concat(F.when(F.col("n") == 1, "[").otherwise(""), "row", F.when(F.col("last"), "]").otherwise(","))
    lines.select("g", text.alias("value")).write.partitionBy("g").text(root)
    out = durable(read_analysis_log(t.spark, root).select(
        "id", "domain", "success", "score", F.length("error").alias("error_chars"), F.md5("error").alias("error_hash"), "policy_type"))
    remove(t.spark, root)
    return out
