"""From pages to policies, from a corpus to keywords, from services to risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import html_text, html_title
from clauselake.functions.urls import bare_host, resolve_url
from clauselake.operators import candidates as ca
from clauselake.operators import corpus as co
from clauselake.operators import detection as de
from clauselake.operators import features as fe
from clauselake.operators import links as li
from clauselake.operators import risk as ri
from clauselake.operators.staging import computed


def read_policies(pages: DataFrame) -> DataFrame:
    """Pages to checked documents: text, title, gate, content check. One stage, no shuffle."""
    texts = computed(
        pages, text=html_text(F.col("html")), title=html_title(F.col("html"))
    ).select("page_id", "url", "text", "title")
    passed = de.extraction_gate(texts).where(F.col("reject_reason").isNull()).drop("reject_reason")
    return de.validate_content(de.content_signals(passed))


def discover_policies(pages: DataFrame, overrides: DataFrame | None = None,
                      sitemap_urls: DataFrame | None = None,
                      layers: Sequence[tuple] | None = None,
                      paths: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Best address per domain and policy type from all pages of a crawl.

    Domains with a known address take it and are not searched. The rest gather candidates from
    their links (scored by the link model when its weights are given), from standard paths that
    were crawled, and from sitemaps.
    """
    from clauselake.values.link_terms import CRAWL_LINK_PATTERNS, PROBE_PATHS

    named = pages.withColumn("domain", bare_host(F.col("url"))).where(F.col("domain").isNotNull())
    domains = named.select("domain").distinct()
    known = ca.special_domain_override(domains, overrides).select(
        "domain", "type", F.col("special_url").alias("url"), F.lit("special_domain").alias("source"),
        F.col("confidence").cast("double").alias("confidence"),
    )
    links = li.extract_links(named, keep=("domain", "page_id", "url"), only_privacy=False)
    links = computed(links, link_url=resolve_url(F.col("href"), F.col("url"))).where(
        F.col("link_url").isNotNull()
    )
    model = None
    if layers is not None:
        model = "model_score"
        links = fe.score_links(
            links.withColumn(
                "features",
                fe.link_features(F.col("text"), F.col("href"), F.col("context"), F.col("url")),
            ),
            layers,
        )
    found = li.classify_links(links, CRAWL_LINK_PATTERNS, "crawl", model).select(
        "domain", "type", F.col("link_url").alias("url"),
        F.when(F.col("context") == "footer", "footer_link").otherwise("nav_link").alias("source"),
        "confidence",
    )
    probed = ca.path_candidates(domains, pages, paths or PROBE_PATHS, 70, 2000).select(
        "domain", "type", "url", F.lit("direct_probe").alias("source"),
        F.col("confidence").cast("double").alias("confidence"),
    )
    parts = [found, probed]
    if sitemap_urls is not None:
        rows = sitemap_urls.select(
            bare_host(F.col("loc")).alias("domain"), F.col("loc").alias("href"),
            F.col("loc").alias("link_url"), F.lit("").alias("text"), F.lit("unknown").alias("context"),
        )
        parts.append(
            li.classify_links(rows, CRAWL_LINK_PATTERNS, "sitemap").select(
                "domain", "type", F.col("link_url").alias("url"), F.lit("sitemap").alias("source"),
                "confidence",
            )
        )
    gathered = parts[0]
    for p in parts[1:]:
        gathered = gathered.unionByName(p)
    searched = gathered.join(known.select("domain").distinct(), "domain", "left_anti")
    return ca.best_per_type(known.unionByName(searched))


def mine_keywords(docs: DataFrame, stop_words: Sequence[str] | DataFrame = co.STOP_WORDS,
                  text: str = "text") -> DataFrame:
    """Report table of corpus keywords."""
    words = co.word_frequencies(docs, stop_words, text)
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    return co.keyword_report(co.keyword_scores(words, total))


def personal_risk(users: DataFrame, services: DataFrame, breaches: DataFrame) -> DataFrame:
    """Factors, score, level and recommendations per user.

    ``users``: user_id, region, goals; ``services``: user_id, domain, latest_score; ``breaches``:
    user_id, total.
    """
    factors = ri.risk_factors(users, services, breaches)
    return ri.recommendations(ri.risk_score(factors))


def recheck(tracked: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New tracking state and the changes to report."""
    from clauselake.operators.versions import change_records, detect_changes

    state = detect_changes(tracked, snapshot)
    return state, change_records(state)


def stale_keys(status: DataFrame) -> DataFrame:
    """Keys that need a new analysis; join them before any text work."""
    from clauselake.operators.versions import needs_analysis

    return needs_analysis(status).where("to_do").select("domain", "policy_type")


