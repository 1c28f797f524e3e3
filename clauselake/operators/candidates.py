"""Policy candidates: look-ups, ranking, voting and merging.

Best-of-group results are aggregations with map-side partial results, not sorts of whole groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import terms as tm
from clauselake.functions import urls as ur
from clauselake.operators.detection import matching_types
from clauselake.operators.keyed import first_per_key, small_side, top_per_key
from clauselake.operators.staging import computed
from clauselake.values import domains as D
from clauselake.values import link_terms as L

# Order of sources and of policy types, and confidence by source.
SOURCE_ORDER = ("special_domain", "direct_fetch", "footer_link", "standard_path", "sitemap",
                "search_fallback", "manual")
TYPE_ORDER = ("privacy", "terms", "cookies", "security", "gdpr", "ccpa", "ai", "acceptable_use")
EARLY_STOP = 85


def rank_in(value: Column, names: Sequence[str]) -> Column:
    """Position of a name in a list; names that are not listed come last."""
    return F.coalesce(
        F.nullif(F.array_position(tm.literal_array(names), value), F.lit(0)), F.lit(len(names) + 1)
    )


def special_domain_override(domains: DataFrame, overrides: DataFrame | None = None,
                            domain: str = "domain") -> DataFrame:
    """Known policy addresses: one row per domain and type.

    A domain is looked up as given, then with ``www.``, then without; the first key that exists
    gives all its addresses. The three forms are laid out on the side of the small table.
    """
    if overrides is None:
        overrides = domains.sparkSession.createDataFrame(
            list(D.SPECIAL_POLICY_URLS), "domain string, type string, url string"
        )
    key = F.col("domain")
    forms = F.array(
        F.struct(key.alias("asked"), F.lit(0).alias("form")),
        F.when(
            F.startswith(key, F.lit("www.")),
            F.struct(F.substring(key, F.lit(5), F.length(key)).alias("asked"),
                     F.lit(1).alias("form")),
        ),
        F.when(
            ~F.startswith(key, F.lit("www.")),
            F.struct(F.concat(F.lit("www."), key).alias("asked"), F.lit(2).alias("form")),
        ),
    )
    laid = overrides.select(F.inline(F.array_compact(forms)), "type", F.col("url").alias("special_url"))
    best = laid.groupBy("asked").agg(F.min("form").alias("form"))
    table = laid.join(best, ["asked", "form"]).select(
        F.col("asked").alias(domain), "type", "special_url"
    )
    return domains.join(small_side(table), domain).select(
        *domains.columns, "type", "special_url", F.lit("high").alias("confidence_level"),
        F.lit(99).alias("confidence"),
    )


def resolve_company(names: DataFrame, companies: DataFrame, name: str = "name") -> DataFrame:
    """``name, domain`` for every distinct name found in the table ``company, domain``.

    Lower case without blanks first, then without signs, hyphens, underscores.
    """
    bare = F.regexp_replace(F.trim(F.lower(name)), r"\s+", "")
    tried = F.array(
        bare, F.regexp_replace(bare, "[^a-z0-9]", ""), F.replace(bare, F.lit("-"), F.lit("")),
        F.replace(bare, F.lit("_"), F.lit("")),
    )
    asked = names.select(name).distinct().select(
        name, F.posexplode(tried).alias("_order", "company")
    )
    return (
        asked.join(small_side(companies), "company")
        .groupBy(name)
        .agg(F.min_by("domain", F.struct("_order", "domain")).alias("domain"))
    )


def path_candidates(domains: DataFrame, pages: DataFrame,
                    paths: Sequence[str] | Mapping[str, Sequence[str]] = L.STANDARD_PATHS,
                    confidence: int = 80, min_body: int = 0, with_www: bool = False,
                    domain: str = "domain") -> DataFrame:
    """Standard paths of each domain that exist as crawled pages.

    Result: domain, type, path, url, confidence. ``paths`` is a list, or lists by policy type; all
    are tried in one pass over the pages. Addresses are compared without scheme, so a page crawled
    over either scheme counts; each page is used once.
    """
    host = F.col(domain)
    by_type = paths if isinstance(paths, Mapping) else {"privacy": paths}
    tries = F.array(
        *[
            F.struct(F.lit(t).alias("type"), F.lit(p).alias("path"))
            for t, ps in by_type.items()
            for p in dict.fromkeys(ps)
        ]
    )
    hosts = (
        F.array_distinct(F.array(host, F.when(
            ~F.startswith(host, F.lit("www.")), F.concat(F.lit("www."), host)).otherwise(host)))
        if with_www else F.array(host)
    )
    probes = (
        domains.select(domain)
        .distinct()
        .withColumn("_host", F.explode(hosts))
        .select("*", F.inline(tries))
        .withColumn("_place", F.lower(F.concat("_host", F.regexp_replace("path", "/$", ""))))
    )
    place = F.regexp_replace(ur.normalised_url(F.col("url")), r"^[a-z][a-z0-9+.-]*://", "")
    bodies = pages.where(F.length("html") > min_body).select("url")
    crawled = computed(bodies.where(~ur.is_auth_url(F.col("url"))), _place=place)
    one = crawled.groupBy("_place").agg(F.min("url").alias("url"))
    return probes.join(one, "_place").select(
        domain, "type", "path", "url", F.lit(confidence).alias("confidence")
    )


def nested_path_candidates(starts: DataFrame, pages: DataFrame,
                           paths: Sequence[str] = L.NESTED_PATHS, least: int = 5) -> DataFrame:
    """Known sub-paths below a start address that exist and read like the policy itself."""
    from clauselake.functions.text import html_text
    from clauselake.operators.detection import is_actual_policy

    tests = (
        starts.select(
            "domain",
            F.col("url").alias("original_url"),
            F.regexp_replace(F.concat(ur.url_origin(F.col("url")), ur.url_path(F.col("url"))),
                             "/$", "").alias("_stem"),
        )
        .withColumn("path", F.explode(tm.literal_array(list(dict.fromkeys(paths)))))
        .withColumn("_place", F.lower(F.concat("_stem", "path")))
    )
    good = (
        pages.where(F.length("html") > 2000)
        .select(ur.normalised_url(F.col("url")).alias("_place"), "url", "html")
        .join(tests.select("_place").distinct(), "_place", "left_semi")
        .where(is_actual_policy(html_text(F.col("html"), "direct"), least=least))
        .groupBy("_place")
        .agg(F.min("url").alias("found_url"))
    )
    strong = tm.any_term(F.lower("found_url"), ("datenschutzerklaerung", "datenschutzerklarung"))
    return tests.join(good, "_place").select(
        "domain", "original_url", "found_url", "path",
        F.when(strong, 95).otherwise(85).alias("confidence"), F.lit(1).alias("depth"),
    )


def sitemap_candidates(urls: DataFrame, url: str = "url",
                       terms: Sequence[str] = ("privacy", "legal", "terms")) -> DataFrame:
    """Sitemap addresses that name a policy, at confidence 90."""
    return urls.where(tm.any_term(F.lower(url), terms)).withColumn("confidence", F.lit(90))


def search_candidates(results: DataFrame, domain: str = "domain", url: str = "url",
                      position: str = "position", start: int = 50, first: int = 3) -> DataFrame:
    """First search results on the asked domain that are not blocked: 50, 40, 30."""
    host = F.coalesce(ur.url_host(F.col(url)), F.lit(""))
    kept = results.where(F.contains(F.col(url), F.col(domain)) & ~ur.is_blocked_host(host))
    return top_per_key(kept, [domain], [F.col(position), F.col(url)], first).withColumn(
        "confidence", F.lit(start + 10) - F.col("rank") * 10
    )


def best_candidate(candidates: DataFrame, stop: int = EARLY_STOP,
                   sources: Sequence[str] = SOURCE_ORDER) -> DataFrame:
    """Best candidate per domain when sources are tried in order and a strong one ends the search.

    Sources after the first with a confidence of ``stop`` or more do not count. Equal confidence
    goes to the earlier source, then to the smaller address.
    """
    per_source = (
        candidates.withColumn("_order", rank_in(F.col("source"), sources))
        .groupBy("domain", "_order", "source")
        .agg(
            F.max("confidence").alias("confidence"),
            F.min_by("url", F.struct(-F.col("confidence"), "url")).alias("url"),
        )
    )
    # At most one row per source is left of a domain, so this window is small.
    last = F.min(F.when(F.col("confidence") >= stop, F.col("_order"))).over(
        Window.partitionBy("domain")
    )
    reached = per_source.withColumn("_last", last).where(
        F.col("_last").isNull() | (F.col("_order") <= F.col("_last"))
    )
    best = F.min_by(
        F.struct("url", "source", "confidence"), F.struct(-F.col("confidence"), "_order", "url")
    )
    return reached.groupBy("domain").agg(best.alias("_best")).select("domain", "_best.*")


def best_validated_candidate(candidates: DataFrame, validations: DataFrame,
                             sources: Sequence[str] = SOURCE_ORDER, looked_at: int = 5
                             ) -> DataFrame:
    """Best candidate per domain after a look at the content of the first five.

    ``validations`` holds ``url, valid, content_confidence, search_on``. A valid top candidate
    gains up to 10 (at most 98). An invalid one gives way to the first valid of the next four;
    without one it loses 20, down to 30.
    """
    ranked = top_per_key(
        candidates, ["domain"],
        [F.col("confidence").desc(), rank_in(F.col("source"), sources), F.col("url")], looked_at,
    )
    checked = ranked.join(validations, "url", "left").withColumn(
        "valid", F.coalesce("valid", F.lit(False))
    )
    row = F.struct("url", "source", "confidence", "valid", "content_confidence", "search_on")
    picked = checked.groupBy("domain").agg(
        F.min_by(row, "rank").alias("top"),
        F.min_by(row, F.when(F.col("valid") & (F.col("rank") > 1), F.col("rank"))).alias("other"),
        F.min(F.when(F.col("valid") & (F.col("rank") > 1), F.col("rank"))).alias("_other_rank"),
    )
    top, other = F.col("top"), F.col("other")
    swap = ~top["valid"] & F.coalesce(top["search_on"], F.lit(False))
    replaced = swap & F.col("_other_rank").isNotNull()
    gain = F.least(F.lit(10), F.floor(top["content_confidence"] / 10).cast("int"))
    confidence = (
        F.when(top["valid"], F.least(F.lit(98), top["confidence"] + gain))
        .when(replaced, F.greatest(other["confidence"], other["content_confidence"]))
        .when(swap, F.greatest(F.lit(30), top["confidence"] - 20))
        .otherwise(top["confidence"])
    )
    return picked.select(
        "domain",
        F.when(replaced, other["url"]).otherwise(top["url"]).alias("url"),
        F.when(replaced, other["source"]).otherwise(top["source"]).alias("source"),
        confidence.cast("int").alias("confidence"),
        F.when(top["valid"], "validated").when(replaced, "alternative")
        .when(swap, "inconclusive").otherwise("unchecked").alias("outcome"),
    )


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 80, "high").when(confidence >= 50, "medium").otherwise("low")


def best_per_type(candidates: DataFrame, keys: Sequence[str] = ("domain", "type"),
                  sources: Sequence[str] = SOURCE_ORDER) -> DataFrame:
    """Best candidate per domain and type, with its level and the type's place in the report."""
    order = F.struct(-F.col("confidence"), rank_in(F.col("source"), sources), F.col("url"))
    best = candidates.groupBy(*keys).agg(
        F.min_by(F.struct("url", "source", "confidence"), order).alias("_best")
    )
    return best.select(
        *keys, "_best.*",
        confidence_level(F.col("_best.confidence")).alias("level"),
        rank_in(F.col("type"), TYPE_ORDER).cast("int").alias("type_order"),
    )


def merge_by_priority(layers: Sequence[DataFrame], keys: Sequence[str] = ("domain", "type"),
                      order: Sequence[str] = ("url",)) -> DataFrame:
    """One row per key from the first layer that has it."""
    stacked = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("layer", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return first_per_key(stacked, keys, [F.col("layer"), *[F.col(c) for c in order]])


def validate_by_type(policies: DataFrame, bodies: DataFrame) -> DataFrame:
    """Keep policies that are certain or whose page body reads like their type.

    ``policies``: url, type, source, level, model_score; ``bodies``: url, body, one row per url. The
    types a body reads like are found in its scan; bodies do not go through the join.
    """
    certain = (
        (F.col("source") == "special_domain")
        | (F.coalesce("model_score", F.lit(0.0)) > 0.7)
        | (F.col("level") == "high")
    )
    checked = (
        policies.where(~certain)
        .join(bodies.select("url", matching_types(F.col("body")).alias("_types")), "url")
        .where(F.array_contains("_types", F.col("type")))
        .select(*policies.columns)
    )
    return policies.where(certain).unionByName(checked)


def rerank_search_results(results: DataFrame, query: str = "query", url: str = "url",
                          title: str = "title", top: int | None = None) -> DataFrame:
    """Score results, drop login and sign-up pages, best first within each query.

    Redirect addresses are decoded first. The order comes from one range-partitioned sort, so a
    query with very many results spreads over tasks; ``top`` keeps the best few per query.
    """
    raw = F.col(url)
    target = F.when(
        F.contains(raw, F.lit("uddg=")),
        F.try_url_decode(F.regexp_extract(raw, "uddg=([^&]+)", 1)),
    ).otherwise(raw)
    both = F.lower(F.concat("target", F.coalesce(F.col(title), F.lit(""))))

    def has(word: str) -> Column:
        return tm.flag(F.contains(both, F.lit(word)))

    score = (
        has("privacy") * 10 + has("policy") * 5 + has("notice") * 5 - has("help") * 5
        - has("support") * 5 - has("community") * 10 - F.length("target") * F.lit(0.05)
    )
    kept = (
        results.withColumn("target", target)
        .where(F.startswith(F.col("target"), F.lit("http")))
        .where(~tm.any_term(F.lower("target"), ("login", "signup")))
        .withColumn("score", score)
    )
    order = [F.col("score").desc(), F.col("target")]
    if top is not None:
        return top_per_key(kept, [query], order, top)
    return kept.orderBy(F.col(query), *order)


def consensus_domain(votes: DataFrame, engines: int = 3) -> DataFrame:
    """Domain most engines agree on per company.

    Score: 30 per vote plus mean confidence. Final confidence: mean times 1.0, 0.85 or 0.6 for
    three, two, one (or more than three) votes, at most 100.
    """
    counted = (
        votes.where(F.col("domain").isNotNull())
        .groupBy("company", F.lower("domain").alias("domain"))
        .agg(
            F.count(F.lit(1)).alias("votes"),
            F.sum("confidence").alias("_sum"),
        )
        .withColumn("_mean", F.col("_sum") / F.col("votes"))
        .withColumn("score", F.col("votes") * 30 + F.col("_mean"))
        .where(F.col("score") > 0)
    )
    row = F.struct("domain", "votes", "score", "_mean")
    best = counted.groupBy("company").agg(
        F.min_by(row, F.struct(-F.col("score"), "domain")).alias("b")
    )
    factor = F.when(F.col("b.votes") == 3, 1.0).when(F.col("b.votes") == 2, 0.85).otherwise(0.6)
    return best.select(
        "company", "b.domain", "b.votes", F.col("b.score").alias("score"),
        F.least(F.lit(100), tm.round_half_up(F.col("b._mean") * factor)).alias("confidence"),
    )
