"""Whether an address belongs to a domain and is worth using.

Each step is a projection over the one before, so the block lists are tested once per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import urls as ur
from clauselake.operators.staging import computed
from clauselake.operators.suffixes import with_roots
from clauselake.values import domains as D


def check_owner(df: DataFrame, url: str | Column, target: str | Column,
                related: Mapping[str, Sequence[str]] = D.RELATED_DOMAINS,
                prefix: str = "owner_", suffixes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Add ``owner_valid``, ``owner_confidence`` and ``owner_reason``.

    Blocked 0, same host 100, same registrable domain 95, related company 90, else 0. The block
    test comes first, so a related domain that is blocked itself stays at 0. Two hosts that are suffixes
    themselves have no domain in common. ``suffixes`` are public suffix rules, as a short list or as the
    table of ``operators.suffixes``; without them the built-in rules hold.
    """
    address = F.col(url) if isinstance(url, str) else url
    domain = F.col(target) if isinstance(target, str) else target
    # A few pairs are known, so a membership test over "owner domain" strings needs no join.
    pairs = [f"{owner} {d}" for owner, ds in related.items() for d in ds]
    hosts = computed(
        df,
        _host=ur.bare_host(address),
        _wanted=F.regexp_replace(F.lower(domain), r"^www\.", ""),
        _blocked=ur.is_blocked_url(address),
    )
    if isinstance(suffixes, DataFrame):
        staged = with_roots(hosts, suffixes, {"_host": "_root", "_wanted": "_wanted_root"})
    else:
        staged = computed(
            hosts,
            _root=ur.registrable_domain(F.col("_host"), suffixes),
            _wanted_root=ur.registrable_domain(F.col("_wanted"), suffixes),
        )
    related_hit = F.concat_ws(" ", "_wanted", "_root").isin(*pairs) if pairs else F.lit(False)
    confidence = (
        F.when(F.col("_blocked"), 0)
        .when(F.col("_host") == F.col("_wanted"), 100)
        .when(F.col("_root") == F.col("_wanted_root"), 95)
        .when(related_hit, 90)
        .otherwise(0)
    )
    reason = (
        F.when(F.col("_host").isNull(), "Invalid URL format")
        .when(
            F.col("_blocked"),
            "URL is from a blocked domain type (social media, directory, etc.)",
        )
        .when(
            F.col(f"{prefix}confidence") == 0,
            F.concat(
                F.lit("URL domain ("), F.col("_host"), F.lit(") doesn't match target domain ("),
                F.col("_wanted"), F.lit(")"),
            ),
        )
    )
    return (
        computed(staged, **{f"{prefix}confidence": confidence})
        .withColumn(f"{prefix}valid", F.col(f"{prefix}confidence") > 0)
        .withColumn(f"{prefix}reason", reason)
        .drop("_host", "_wanted", "_blocked", "_root", "_wanted_root")
    )


def score_domains(df: DataFrame, url: str | Column, target: str | Column,
                  name: str = "quality") -> DataFrame:
    """Add the quality of a domain as a source of policies, 0 to 100."""
    address = F.col(url) if isinstance(url, str) else url
    domain = F.col(target) if isinstance(target, str) else target
    staged = computed(df, _blocked=ur.is_blocked_host(domain) | ur.is_blocked_url(address))
    quality = ur.domain_quality(domain, address, F.col("_blocked"))
    return computed(staged, **{name: quality}).drop("_blocked")


def validate_urls(df: DataFrame, url: str | Column, target: str | Column,
                  suffixes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Owner and quality together: ``url_valid, url_confidence, quality, url_issues``."""
    address = F.col(url) if isinstance(url, str) else url
    owner, quality = F.col("_o_confidence"), F.col("quality")
    confidence = (
        F.when(quality >= 70, F.least(F.lit(100), owner + 10))
        .when(quality < 50, F.greatest(F.lit(0), owner - 20))
        .otherwise(owner)
    )
    issues = F.array_compact(
        F.array(
            F.when(~F.col("_o_valid"), F.coalesce("_o_reason", F.lit("Domain mismatch"))),
            F.when(quality < 30, "Low quality domain score"),
            F.when(F.col("_bad"), "URL matches blocked pattern"),
        )
    )
    staged = score_domains(check_owner(df, url, target, prefix="_o_", suffixes=suffixes), url, target)
    return (
        computed(staged, _bad=ur.is_blocked_url(address))
        .withColumn("url_valid", F.col("_o_valid") & (quality >= 30) & ~F.col("_bad"))
        .withColumn("url_confidence", confidence)
        .withColumn("url_issues", issues)
        .drop("_bad", "_o_valid", "_o_confidence", "_o_reason")
    )
