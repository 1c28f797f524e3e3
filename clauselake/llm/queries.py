"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.llm import (
    decontaminate, htmltext, lines, mixing, pii, quality, ranking, resampling, simhash, tokencounts, tokentable, topk,
    toxicity)
from clauselake.llm.common import table
from clauselake.llm.sql import SQL

#: Stands for a secret that a user keeps elsewhere.
PSEUDONYM_KEY = "a key for tests and measurements"


def op1_line_dedup(spark, sf_dir):
    return lines.drop_recurring_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "lines_cut", "lines_kept")


def op2_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark, sf_dir):
    return pii.pseudonymised(table(spark, sf_dir, "documents"), PSEUDONYM_KEY).select("doc_id", "text", "values_replaced")


def op4_topk(spark, sf_dir):
    return topk.embedding_neighbours(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")) \
        .select("doc_id", "tokens", "posteriors", F.element_at(F.array(*map(F.lit, mixing.DOMAINS)), F.col("domain") + 1)
                .alias("domain"), "rate")


def op6_token_counts(spark, sf_dir):
    return tokencounts.token_counts(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_text(spark, sf_dir):
    return htmltext.page_texts(table(spark, sf_dir, "pages"))


def op10_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_table(spark, sf_dir):
    return tokentable.token_digests(table(spark, sf_dir, "documents"))


def op12_resampling(spark, sf_dir):
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ranked_search(spark, sf_dir):
    return ranking.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_decontamination, op3_pii, op4_topk, op5_mixing, op6_token_counts, op7_toxicity, op8_simhash,
    op9_html_text, op10_quality, op11_token_table, op12_resampling, op13_ranked_search, pipeline)}

__all__ = ["QUERIES", "SQL"]
