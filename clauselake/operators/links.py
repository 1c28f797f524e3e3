"""Links of crawled pages: extraction, scores and confidence.

A page is one row. Its regions, its links and the rule that looks into the body only when the
other regions gave too little all work inside that row, so extraction needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import terms as tm
from clauselake.functions import text as tx
from clauselake.functions import urls as ur
from clauselake.operators.addresses import check_owner
from clauselake.operators.keyed import first_per_key, spread_join, top_per_key
from clauselake.operators.staging import computed
from clauselake.session import durable
from clauselake.values import link_terms as L

# Contexts from the most to the least telling, and how regions are marked.
CONTEXT_RANK = {"footer": 0, "legal_hub": 1, "nav": 2, "body": 3}
FOOTER_REGION = (
    r"(?is)<footer\b[^>]*>.*?</footer\s*>"
    r"|<(div|section|ul|p)\b[^>]*(?:role\s*=\s*[\"']contentinfo[\"']"
    r"|\b(?:class|id)\s*=\s*[\"'][^\"']*footer[^\"']*[\"'])[^>]*>.*?</\1\s*>"
)
LEGAL_REGION = (
    r"(?is)<(div|section|ul|p|span)\b[^>]*\b(?:class|id)\s*=\s*[\"'][^\"']*"
    r"(?:legal|policy|terms|bottom-links|footer-links)[^\"']*[\"'][^>]*>.*?</\1\s*>"
)
NAV_REGION = (
    r"(?is)<nav\b[^>]*>.*?</nav\s*>"
    r"|<(div|section|ul)\b[^>]*role\s*=\s*[\"']navigation[\"'][^>]*>.*?</\1\s*>"
)
ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a\s*>"
LINK_TYPE = "array<struct<context:string,pos:int,href:string,text:string,label:string>>"


def _anchors(region: Column, context: str) -> Column:
    def link(anchor: Column, i: Column) -> Column:
        def attribute(name: str) -> Column:
            return F.regexp_extract(anchor, rf"(?is)^<a\b[^>]*\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)

        inner = F.regexp_extract(anchor, r"(?is)^<a\b[^>]*>(.*)</a\s*>$", 1)
        return F.struct(
            F.lit(context).alias("context"),
            i.alias("pos"),
            attribute("href").alias("href"),
            tx.strip_tags(inner).alias("text"),
            tx.trimmed(F.concat_ws(" ", attribute("title"), attribute("aria-label"))).alias(
                "label"
            ),
        )

    return F.transform(F.regexp_extract_all(region, F.lit(ANCHOR), F.lit(0)), link)


def _visible(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")


def link_words(link: Column) -> Column:
    """Lower-cased text, title and aria label of a link."""
    return tx.trimmed(F.lower(F.concat_ws(" ", link["text"], link["label"])))


def extract_links(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url"),
                  terms: Sequence[str] = L.HOMEPAGE_TERMS, texts: Sequence[str] = L.LINK_TEXTS,
                  patterns: Sequence[str] = L.PRIVACY_URL_PATTERNS, least: int | None = None,
                  only_privacy: bool = True) -> DataFrame:
    """One row per link with its context (footer, legal_hub, nav, body).

    With ``least`` body links count only on pages where fewer privacy links than that were found in
    the other regions. ``only_privacy=False`` returns all links of all regions.
    """
    visible = F.col("_visible")

    def region(pattern: str) -> Column:
        return F.array_join(F.regexp_extract_all(visible, F.lit(pattern), F.lit(0)), "\n")

    body = F.regexp_replace(
        visible, r"(?is)<(footer|nav)\b[^>]*>.*?</\1\s*>", " "
    )
    seen = computed(pages, _visible=_visible(F.col(html))).select(*keep, "_visible")
    staged = computed(
        seen,
        _marked=F.concat(
            _anchors(region(FOOTER_REGION), "footer"),
            _anchors(region(LEGAL_REGION), "legal_hub"),
            _anchors(region(NAV_REGION), "nav"),
        ),
    )
    if not only_privacy:
        chosen = F.concat(F.col("_marked"), _anchors(body, "body"))
        return staged.select(*keep, F.inline(chosen))
    words = list(dict.fromkeys(t.lower() for t in (*terms, *texts)))

    def speaks(link: Column) -> Column:
        href = F.lower(link["href"])
        return (
            tm.any_term(link_words(link), words)
            | tm.any_term(href, list(dict.fromkeys(t.lower() for t in terms)))
            | tm.any_pattern(href, patterns)
        )

    chosen = F.concat(F.col("_hits"), F.filter(_anchors(body, "body"), speaks))
    if least is not None:
        chosen = F.when(F.size("_hits") < least, chosen).otherwise(F.col("_hits"))
    return computed(staged, _hits=F.filter("_marked", speaks)).select(*keep, F.inline(chosen))


def extract_footer_links(pages: DataFrame, html: str = "html",
                         keep: Sequence[str] = ("page_id", "url"),
                         tail_chars: int | None = None) -> DataFrame:
    """Links of the first ``<footer>``, or of the page when it has none.

    ``tail_chars`` looks at the end of footerless pages only (50 000 was usual).
    """
    page = F.col(html)
    tail = page if tail_chars is None else F.substring(page, -tail_chars, tail_chars)
    footer = F.regexp_extract(page, r"(?is)<footer\b[^>]*>(.*?)</footer\s*>", 1)
    area = F.when(F.rlike(page, F.lit(r"(?is)<footer\b[^>]*>.*?</footer\s*>")), footer).otherwise(
        tail
    )
    return pages.select(*keep, F.inline(_anchors(area, "footer")))


def footer_privacy_links(links: DataFrame, domain: str = "domain",
                         texts: Sequence[str] = L.FOOTER_LINK_TEXTS,
                         patterns: Sequence[str] = L.FOOTER_URL_PATTERNS,
                         words: Sequence[str] | None = None) -> DataFrame:
    """Footer links that speak of privacy, as absolute addresses, each once per page."""
    low = F.lower("text")
    vocabulary = list(dict.fromkeys([t.lower() for t in texts] + list(words or ur.all_terms())))
    href = F.col("href")
    full = (
        F.when(F.startswith(href, F.lit("/")), F.concat(F.lit("https://"), F.col(domain), href))
        .when(~F.startswith(href, F.lit("http")),
              F.concat(F.lit("https://"), F.col(domain), F.lit("/"), href))
        .otherwise(href)
    )
    speaking = links.where(tm.any_term(low, vocabulary) | tm.any_pattern(href, patterns))
    kept = (
        computed(speaking, link_url=full)
        .where(~ur.is_blocked_host(F.coalesce(ur.url_host(F.col("link_url")), F.lit(""))))
        .where(F.rlike("href", F.lit("^(?!mailto:|javascript:|#)")))
    )
    return first_per_key(kept, ["page_id", "link_url"], [F.col("pos")])


def score_homepage_links(links: DataFrame, url: str = "url",
                         texts: Sequence[str] = L.LINK_TEXTS,
                         terms: Sequence[str] | None = None,
                         patterns: Sequence[str] = L.PRIVACY_URL_PATTERNS,
                         paths: Sequence[str] = L.PRIVACY_PATHS,
                         exact: Sequence[str] = L.EXACT_LINK_TEXTS,
                         homepage_terms: Sequence[str] = L.HOMEPAGE_TERMS) -> DataFrame:
    """Add ``link_url`` and ``score``; blocked and login addresses are dropped."""
    words = link_words(F.struct("text", "label"))
    low_href = F.lower("href")
    base = (
        ur.score_link_text(words, texts, terms)
        + ur.score_privacy_url(F.col("href"), patterns, paths)
        + tm.flag(words.isin(*exact)) * 25
        + tm.flag(
            F.rlike(low_href, F.lit("/(privacy|datenschutz|confidentialite|privacidad)($|/)"))
        ) * 20
    )
    speaks = tm.any_term(words, homepage_terms) | tm.any_term(low_href, homepage_terms)
    pdf = F.endswith(low_href, F.lit(".pdf")) & ((F.col("_base") > 10) | speaks)
    usable = (
        computed(links, link_url=ur.resolve_url(F.col("href"), F.col(url)))
        .where(F.col("link_url").isNotNull())
        .where(~ur.is_blocked_url(F.col("link_url")) & ~ur.is_auth_url(F.col("link_url")))
    )
    based = computed(usable, _base=base)
    return computed(based, score=F.col("_base") + tm.flag(pdf) * 15).drop("_base")


def context_rank(context: Column) -> Column:
    return F.coalesce(*[F.when(context == c, F.lit(r)) for c, r in CONTEXT_RANK.items()], F.lit(9))


def dedupe_links_first(links: DataFrame, keys: Sequence[str] = ("page_id", "link_url")
                       ) -> DataFrame:
    """First link per address on a page: by context, then by position."""
    return first_per_key(links, keys, [context_rank(F.col("context")), F.col("pos")])


def dedupe_links_best(links: DataFrame, keys: Sequence[str] = ("page_id",),
                      url: str = "link_url", score: str = "score") -> DataFrame:
    """Best-scored link per normalised address; the first one on equal scores."""
    named = computed(links, _same=ur.normalised_url(F.col(url)))
    return first_per_key(
        named,
        [*keys, "_same"],
        [F.col(score).desc(), context_rank(F.col("context")), F.col("pos"), F.col(url)],
    ).drop("_same")


def homepage_confidence(links: DataFrame, domain: str = "domain",
                        model_score: str | None = None, top: int = 5) -> DataFrame:
    """Top links per domain that belong to the domain, with a confidence up to 98.

    With a model score (0 to 1) it is 70 % model and 30 % link score, and smaller context bonuses.
    """
    ranked = top_per_key(
        links, [domain],
        [F.col("score").desc(), context_rank(F.col("context")), F.col("pos"), F.col("link_url")],
        top,
    )
    context = F.col("context")
    if model_score is None:
        base = (
            50
            + F.col("score")
            + F.when(context == "footer", 15)
            .when(context == "legal_hub", 12)
            .when(context == "nav", 5)
            .otherwise(0)
        )
    else:
        mixed = F.col(model_score) * 100 * 0.7 + (50 + F.col("score")) * 0.3
        base = tm.round_half_up(mixed) + F.when(context == "footer", 10).when(
            context == "legal_hub", 8
        ).otherwise(0)
    return (
        check_owner(ranked, "link_url", domain)
        .where("owner_valid")
        .withColumn(
            "confidence",
            F.least(
                F.lit(98), (base + F.floor(F.col("owner_confidence") / 10)).cast("int")
            ),
        )
        .drop("owner_valid", "owner_confidence", "owner_reason")
    )


def score_deep_links(links: DataFrame, url: str = "url",
                     texts: Sequence[str] = L.LINK_TEXTS, terms: Sequence[str] | None = None,
                     patterns: Sequence[str] = L.PRIVACY_URL_PATTERNS,
                     paths: Sequence[str] = L.PRIVACY_PATHS) -> DataFrame:
    """Add ``link_url`` and the deep-scan ``score``; links that do not speak of privacy go."""
    low = F.lower("href")

    def names(*parts: str) -> Column:
        return tm.any_term(low, parts)

    score = (
        ur.score_privacy_url(low, patterns, paths)
        + ur.score_link_text(F.col("text"), texts, terms)
        + tm.flag(
            names("datenschutzerklaerung", "datenschutzerklarung", "datenschutzhinweise",
                  "datenschutzrichtlinie")
        ) * 40
        + tm.flag(names("privacy-policy", "privacy-statement", "privacy-notice")) * 35
    )
    usable = (
        computed(links, link_url=ur.resolve_url(F.col("href"), F.col(url)))
        .where(F.col("link_url").isNotNull())
        .where(~ur.is_blocked_url(F.col("link_url")))
    )
    return computed(usable, score=score).where(
        (F.col("score") > 5)
        | ur.is_privacy_url(low, patterns)
        | ur.is_privacy_link_text(F.col("text"), texts)
    )


def deep_link_confidence(score: Column, link_url: Column, from_hub: Column, depth: Column
                         ) -> Column:
    """Confidence of a link found on a page ``depth`` steps from the start, not capped."""
    low = F.lower(link_url)
    return (
        50
        + score
        + tm.flag(
            tm.any_term(low, ("datenschutzerklaerung", "datenschutzerklarung",
                              "datenschutzhinweise"))
        ) * 30
        + tm.flag(tm.any_term(low, ("privacy-policy", "privacy-statement"))) * 25
        + tm.flag(from_hub) * 15
        + tm.flag(depth > 0) * 10
    )


def expand_links(starts: DataFrame, edges: DataFrame, max_depth: int = 2, follow: int = 60,
                 accept: int = 70, suffixes: Sequence[str] | None = None) -> DataFrame:
    """Follow scored links from start addresses and return what looks like a policy.

    ``starts``  domain, url
    ``edges``   url (page), link_url, score, from_hub: the best few links of each page
    Result: domain, original_url, found_url, confidence (up to 98), depth. A page is visited once
    per domain, at its smallest depth. Many domains may stand on the same page, so the step from
    page to links splits hot pages.
    """
    # Every step reads the few links per page again, so they are written once.
    placed = computed(
        edges, _page=ur.normalised_url(F.col("url")), _target=ur.normalised_url(F.col("link_url"))
    )
    hops = durable(
        placed.where(F.col("_page") != F.col("_target")).select(
            "_page", F.col("link_url").alias("found_url"), "_target", "score", "from_hub"
        )
    )
    begun = computed(starts, _page=ur.normalised_url(F.col("url")))
    frontier = begun.select(
        "domain", F.col("url").alias("original_url"), "_page"
    ).dropDuplicates(["domain", "_page"])
    visited = frontier.select("domain", F.col("_page").alias("_target"))
    found = []
    for depth in range(max_depth + 1):
        stepped = check_owner(
            spread_join(frontier, hops, ["_page"]), "found_url", "domain", suffixes=suffixes
        )
        # Written once: the step is read for the results and for the next frontier.
        reached = durable(
            stepped.where("owner_valid").select(
                "domain", "original_url", "found_url", "_target",
                deep_link_confidence(F.col("score"), F.col("found_url"), F.col("from_hub"),
                                     F.lit(depth)).alias("confidence"),
            ).where(F.col("confidence") >= min(follow, accept))
        )
        found.append(
            reached.where(F.col("confidence") >= accept).select(
                "domain", "original_url", "found_url",
                F.least(F.lit(98), F.col("confidence")).alias("confidence"),
                F.lit(depth + 1).alias("depth"),
            )
        )
        if depth == max_depth:
            break
        onward = (
            reached.where(F.col("confidence") >= follow)
            .join(visited, ["domain", "_target"], "left_anti")
            .select("domain", F.col("found_url").alias("original_url"),
                    F.col("_target").alias("_page"))
        )
        frontier = first_per_key(onward, ["domain", "_page"], [F.col("original_url")])
        visited = visited.unionByName(
            frontier.select("domain", F.col("_page").alias("_target"))
        )
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _first_match(patterns: Sequence[str], text: Column, href: Column) -> Column:
    """Which of text and address the first matching pattern hits; null when none matches."""
    return F.coalesce(
        *[
            F.when(
                F.rlike(text, F.lit(p)) | F.rlike(href, F.lit(p)),
                F.struct(
                    F.rlike(text, F.lit(p)).alias("text"), F.rlike(href, F.lit(p)).alias("href")
                ),
            )
            for p in patterns
        ]
    )


def classify_links(links: DataFrame, patterns: Mapping[str, Sequence[str]] = L.TYPE_LINK_PATTERNS,
                   variant: str = "footer", model_score: str | None = None,
                   hub_patterns: Sequence[str] = L.HUB_URL_PATTERNS) -> DataFrame:
    """One row per link and policy type it points to, with ``type`` and ``confidence``.

    ``footer``      2 for the text, 1 for the address, 3 in a footer, twice the model score;
                    index pages of legal sections are left out
    ``crawl``       30 / 15 / 0 by footer, nav, body, 20 for the text or 10 for the address,
                    30 times the model score, at most 95
    ``legal_hub``   75, ``search`` 55, ``sitemap`` 60: the first type that fits
    """
    text, href, context = F.lower("text"), F.col("href"), F.col("context")
    neural = F.lit(0.0) if model_score is None else F.col(model_score)
    matches = []
    for t, ps in patterns.items():
        m = _first_match(ps, text, href)
        if variant == "footer":
            value = (
                tm.flag(m["text"]) * 2
                + tm.flag(m["href"])
                + F.when(context == "footer", 3).otherwise(0)
                + neural * 2
            )
        elif variant == "crawl":
            value = F.least(
                F.lit(95.0),
                F.when(context == "footer", 30).when(context == "nav", 15).otherwise(0)
                + F.when(m["text"], 20).otherwise(10)
                + neural * 30,
            )
        else:
            # Confidence by where the link was found.
            value = F.lit({"legal_hub": 75.0, "search": 55.0, "sitemap": 60.0}[variant])
        matches.append(
            F.when(
                m.isNotNull(),
                F.struct(F.lit(t).alias("type"), value.cast("double").alias("confidence")),
            )
        )
    hits = F.array_compact(F.array(*matches))
    if variant not in ("footer", "crawl"):
        hits = F.slice(hits, 1, 1)
    rows = links
    if variant == "footer":
        target = F.col("link_url") if "link_url" in links.columns else href
        rows = links.where(~tm.any_pattern(target, hub_patterns))
    return rows.select("*", F.inline(hits))


def direct_page_confidence(pages: DataFrame, html: str = "html", url: str = "url",
                           special: Column | None = None,
                           terms: Sequence[str] | None = None, least: int = 2,
                           scan_chars: tuple[int, int] | None = None) -> DataFrame:
    """Pages that are policies by their own words, with a confidence up to 98.

    ``scan_chars=(15000, 500000)`` reads only the head of a page, more of it above 100 000
    characters; the default reads the page.
    """
    from clauselake.operators.detection import is_login_page
    from clauselake.values.text_terms import DIRECT_PAGE_TERMS, LOGIN_MARKERS_PAIR

    page = F.col(html)
    if scan_chars is not None:
        page = F.substring(
            page, F.lit(1),
            F.when(F.length(page) > 100_000, scan_chars[1]).otherwise(scan_chars[0]),
        )
    words = DIRECT_PAGE_TERMS if terms is None else terms
    low_url = F.lower(url)
    found = F.col("term_count")
    title = F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]+)</title>", 1))
    base = F.when(F.contains(low_url, F.lit("privacy")), 85).otherwise(75)
    if special is not None:
        base = F.when(special, 95).otherwise(base)
    return (
        computed(pages, term_count=tm.terms_found_count(F.lower(page), words))
        .where(found >= least)
        .where(~is_login_page(page, LOGIN_MARKERS_PAIR, 2))
        .where(~ur.is_auth_url(F.col(url)))
        .withColumn(
            "confidence",
            F.least(
                F.lit(98),
                base
                + tm.flag(found >= 4) * 5
                + tm.flag(F.contains(title, F.lit("privacy"))) * 5,
            ),
        )
    )


# Words and bonuses of the two older crawlers.
OLD_SCORES = {
    "smart": {
        "privacy": ("privacy", "data protection", "gdpr", "ccpa", "security"),
        "terms": ("terms", "conditions", "tos", "user agreement"),
        "legal": ("legal", "compliance", "policies"),
        "negative": ("login", "signup", "register", "signin", "share", "facebook", "twitter",
                     "linkedin", "mailto:", "tel:", "javascript:", "#"),
    },
    "universal": {
        "privacy": ("privacy", "data protection", "gdpr", "ccpa", "security", "datenschutz",
                    "confidentialité", "privacidad", "cookie", "cookies", "personal data"),
        "terms": ("terms", "conditions", "tos", "user agreement", "nutzungsbedingungen", "agb",
                  "service agreement", "legal notice"),
        "legal": ("legal", "compliance", "policies", "rechtliches", "impressum", "imprint"),
        "negative": ("login", "signup", "register", "signin", "share", "mailto:", "tel:",
                     "javascript:", "#", "/help/", "/support/", "/faq/"),
    },
}


def old_link_score(link_url: Column, text: Column, in_footer: Column, variant: str = "smart",
                   visible: Column | None = None,
                   words: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Link score of the two older crawlers; null for links they skip or score at 0 or less."""
    w = words or OLD_SCORES[variant]
    url, low = F.lower(link_url), F.lower(text)
    negative = tm.any_term(url, w["negative"])

    def has(col: Column, group: str) -> Column:
        return tm.any_term(col, w[group])

    if variant == "smart":
        negative = negative | has(low, "negative")
        score = (
            tm.flag(tm.any_term(url, ("/en/", "en-us", "lang=en"))) * 50
            + tm.flag(has(url, "privacy")) * 50
            + tm.flag(has(url, "terms")) * 30
            + tm.flag(has(url, "legal")) * 20
            + tm.flag(has(low, "privacy")) * 40
            + tm.flag(has(low, "terms")) * 20
            + tm.flag(has(low, "legal")) * 10
            + tm.flag(in_footer) * 10
            - tm.flag(tm.any_term(url, ("/de/", "/fr/", "/es/"))) * 10
        )
    else:
        score = (
            tm.flag(tm.any_term(url, ("/en/", "en-us"))) * 50
            - tm.flag(tm.any_term(url, ("/de/", "/fr/"))) * 20
            + tm.flag(has(url, "privacy") | has(low, "privacy")) * 40
            + tm.flag(has(url, "terms") | has(low, "terms")) * 20
            + tm.flag(has(url, "legal") | has(low, "legal")) * 10
            + tm.flag(in_footer) * 30
            + (tm.flag(visible) * 5 if visible is not None else F.lit(0))
        )
    return F.when(~negative & (score > 0), score)
