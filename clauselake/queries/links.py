"""Link and candidate queries over crawled pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.functions import text as tx
from clauselake.functions import urls as ur
from clauselake.operators import candidates as ca
from clauselake.operators import detection as de
from clauselake.operators import links as li
from clauselake.plans import flows
from clauselake.queries.base import (
    LAYOUTS,
    TYPES,
    V_CANDIDATES,
    any_found,
    found_count,
    matches,
    q,
    query,
    sql_list,
    with_views,
)
from clauselake.queries.detection import strip_sql
from clauselake.queries.urls import (
    BARE,
    HOST,
    NORMAL,
    ORIGIN,
    PATH,
    root_sql,
    text_score_sql,
    url_score_sql,
)
from clauselake.sources.readers import read_sitemap_urls, sitemap_lines, sitemap_sources

# Words and patterns that occur in the given pages, in the shapes of the real lists.
LINK_WORDS = ("the", "der", "le", "los", "contact", "imprint")
LINK_TEXTS = ("the", "and", "contact", "about", "imprint", "le", "un")
LINK_PATTERNS = (r"(?i)/th", r"(?i)/about", r"(?i)/e[a-z]", r"(?i)/(der|die)$")
LINK_PATHS = ("/the", "/and", "/le", "/about", "/le")
EXACT = ("the", "and", "le", "contact")
WORDS = ("th", "un", "er")

# The pages hold plain <footer>, <nav> and legal blocks, so the SQL needs no other region form.
MOVED = " ".join(
    f"WHEN {i} THEN replace(replace(html, '<nav>', {q(start)}), '</nav>', {q(end)})" for i, (start, end) in enumerate(LAYOUTS))
V_LINKS = rf"""v_pages AS (SELECT page_id, url, CASE page_id % {len(LAYOUTS)} {MOVED} END AS html FROM pages),
v_visible AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g') AS v FROM v_pages),
v_regions AS (SELECT page_id, url, 'footer' AS context, 0 AS ctx, array_to_string(regexp_extract_all(v, '(?is)<footer\b[^>]*>.*?</footer\s*>'), chr(10)) AS r FROM v_visible
 UNION ALL SELECT page_id, url, 'legal_hub', 1, array_to_string(regexp_extract_all(v, '(?is)<div class="legal-box">.*?</div\s*>'), chr(10)) FROM v_visible
 UNION ALL SELECT page_id, url, 'nav', 2, array_to_string(regexp_extract_all(v, '(?is)<nav\b[^>]*>.*?</nav\s*>'), chr(10)) FROM v_visible
 UNION ALL SELECT page_id, url, 'body', 3, regexp_replace(regexp_replace(v, '(?is)<footer\b[^>]*>.*?</footer\s*>', ' ', 'g'), '(?is)<nav\b[^>]*>.*?</nav\s*>', ' ', 'g') FROM v_visible),
v_anchors AS (SELECT page_id, url, context, ctx, unnest(regexp_extract_all(r, {q(li.ANCHOR)})) AS a, generate_subscripts(regexp_extract_all(r, {q(li.ANCHOR)}), 1) - 1 AS pos FROM v_regions),
v_links AS (SELECT page_id, url, context, ctx, CAST(pos AS INT) AS pos, regexp_extract(a, '(?is)^<a\b[^>]*\bhref\s*=\s*[\"'']([^\"'']*)[\"'']', 1) AS href,
 {strip_sql("regexp_extract(a, '(?is)^<a[^>]*>(.*)</a *>$', 1)")} AS text FROM v_anchors)"""

V_PRIVACY = f"""v_speaks AS (SELECT *, {any_found('lower(text)', LINK_WORDS + LINK_TEXTS)} OR {any_found('lower(href)', LINK_WORDS)} OR {' OR '.join(matches('lower(href)', p) for p in LINK_PATTERNS)} AS speaks FROM v_links),
v_gate AS (SELECT page_id, count_if(speaks AND context <> 'body') AS n FROM v_speaks GROUP BY 1),
v_privacy AS (SELECT s.* FROM v_speaks s JOIN v_gate g USING (page_id) WHERE speaks AND (context <> 'body' OR n < 3))"""


def resolve_sql(href: str, base: str) -> str:
    """Resolution for the link forms the pages hold: absolute, rooted, relative."""
    folder = rf"regexp_replace({PATH.format(base)}, '[^/]*$', '')"
    return (
        f"CASE WHEN {href} = '' OR starts_with({href}, '#') OR regexp_matches({href}, '^(?i)(javascript|mailto|tel|data):') THEN NULL "
        f"WHEN regexp_matches({href}, '^(?i)https?://[^/?#]+$') THEN {href} || '/' "
        f"WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href} "
        f"WHEN starts_with({href}, '/') THEN {ORIGIN.format(base)} || {href} "
        f"ELSE {ORIGIN.format(base)} || {folder} || {href} END"
    )


def _links(t, only_privacy: bool = True):
    return li.extract_links(
        t.laid_pages, terms=LINK_WORDS, texts=LINK_TEXTS, patterns=LINK_PATTERNS,
        only_privacy=only_privacy, least=3,
    )


@query(with_views(V_LINKS) + "SELECT page_id, context, pos, href, text FROM v_links")
def page_links(t):
    return _links(t, False).select("page_id", "context", "pos", "href", "text")


@query(with_views(V_LINKS, V_PRIVACY) + "SELECT page_id, context, pos, href, text FROM v_privacy")
def privacy_links(t):
    return _links(t).select("page_id", "context", "pos", "href", "text")


@query(with_views(V_LINKS) + f"""SELECT page_id, pos, href, {resolve_sql('href', 'url')} AS link_url, context FROM v_links""")
def resolved_links(t):
    return _links(t, False).select(
        "page_id", "pos", "href", ur.resolve_url(F.col("href"), F.col("url")).alias("link_url"),
        "context",
    )


@query(with_views(V_LINKS) + f"""SELECT page_id, link_url FROM (SELECT *, CASE WHEN starts_with(href, '/') THEN 'https://' || domain || href
  WHEN NOT starts_with(href, 'http') THEN 'https://' || domain || '/' || href ELSE href END AS link_url FROM (
  SELECT *, {HOST.format('url')} AS domain FROM v_links WHERE context = 'footer') a) l
 WHERE ({any_found('lower(text)', LINK_TEXTS + WORDS)} OR {' OR '.join(matches('href', p) for p in LINK_PATTERNS)}) AND NOT regexp_matches(href, '^(mailto:|javascript:|#)')
 GROUP BY ALL""")
def footer_links(t):
    rows = li.extract_footer_links(t.laid_pages).withColumn("domain", ur.url_host(F.col("url")))
    return li.footer_privacy_links(rows, texts=LINK_TEXTS, patterns=LINK_PATTERNS, words=WORDS).select(
        "page_id", "link_url"
    )


V_SCORED = f"""v_scored AS (SELECT *, {text_score_sql('text', LINK_TEXTS, WORDS)} + {url_score_sql('href', LINK_PATTERNS, LINK_PATHS)}
 + CASE WHEN trim(lower(text)) IN ({', '.join(q(e) for e in EXACT)}) THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(lower(href), '/(privacy|datenschutz|confidentialite|privacidad)($|/)') THEN 20 ELSE 0 END AS score FROM (
 SELECT *, {resolve_sql('href', 'url')} AS link_url FROM v_privacy) r WHERE link_url IS NOT NULL AND {HOST.format('link_url')} IS NOT NULL)"""


def _scored(t):
    return li.score_homepage_links(
        _links(t), texts=LINK_TEXTS, terms=WORDS, patterns=LINK_PATTERNS, paths=LINK_PATHS,
        exact=EXACT, homepage_terms=LINK_WORDS,
    )


@query(with_views(V_LINKS, V_PRIVACY, V_SCORED) + "SELECT page_id, context, pos, link_url, CAST(score AS INT) AS score FROM v_scored")
def homepage_link_scores(t):
    return _scored(t).select("page_id", "context", "pos", "link_url", "score")


@query(with_views(V_LINKS, V_PRIVACY, V_SCORED) + """SELECT page_id, link_url, context, pos FROM v_scored
 QUALIFY row_number() OVER (PARTITION BY page_id, link_url ORDER BY ctx, pos) = 1""")
def links_first(t):
    return li.dedupe_links_first(_scored(t)).select("page_id", "link_url", "context", "pos")


@query(with_views(V_LINKS, V_PRIVACY, V_SCORED) + f"""SELECT page_id, link_url, CAST(score AS INT) AS score FROM v_scored
 QUALIFY row_number() OVER (PARTITION BY page_id, {NORMAL.format('link_url')} ORDER BY score DESC, ctx, pos, link_url) = 1""")
def links_best(t):
    return li.dedupe_links_best(_scored(t)).select("page_id", "link_url", "score")


V_TOP5 = f"""v_first AS (SELECT *, {BARE.format('url')} AS domain FROM v_scored QUALIFY row_number() OVER (PARTITION BY page_id, link_url ORDER BY ctx, pos) = 1),
v_top AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, ctx, pos, link_url) AS rank FROM v_first QUALIFY rank <= 5),
v_owned AS (SELECT *, CASE WHEN regexp_replace({HOST.format('link_url')}, '^www\\.', '') = domain THEN 100
 WHEN {root_sql(HOST.format('link_url'))} = {root_sql('domain')} THEN 95 ELSE 0 END AS owner FROM v_top)"""


@query(with_views(V_LINKS, V_PRIVACY, V_SCORED, V_TOP5) + """SELECT domain, link_url, CAST(rank AS INT) AS rank,
 CAST(least(98, 50 + score + CASE context WHEN 'footer' THEN 15 WHEN 'legal_hub' THEN 12 WHEN 'nav' THEN 5 ELSE 0 END + owner // 10) AS INT) AS confidence FROM v_owned WHERE owner > 0""")
def homepage_confidence(t):
    rows = li.dedupe_links_first(_scored(t)).withColumn("domain", ur.bare_host(F.col("url")))
    return li.homepage_confidence(rows).select("domain", "link_url", "rank", "confidence")


@query(with_views(V_LINKS, V_PRIVACY, V_SCORED, V_TOP5) + """SELECT domain, link_url,
 CAST(least(98, floor(((pos % 10) / 10.0::DOUBLE) * 100 * 0.7::DOUBLE + (50 + score) * 0.3::DOUBLE + 0.5) + CASE context WHEN 'footer' THEN 10 WHEN 'legal_hub' THEN 8 ELSE 0 END + owner // 10) AS INT) AS confidence FROM v_owned WHERE owner > 0""")
def homepage_confidence_model(t):
    """With a model score; the link's position stands in for it."""
    rows = li.dedupe_links_first(_scored(t)).withColumn("domain", ur.bare_host(F.col("url")))
    rows = rows.withColumn("model_score", (F.col("pos") % 10) / F.lit(10.0))
    return li.homepage_confidence(rows, model_score="model_score").select(
        "domain", "link_url", "confidence"
    )


V_DEEP = f"""v_deep AS (SELECT *, CAST({url_score_sql('href', LINK_PATTERNS, LINK_PATHS)} + {text_score_sql('text', LINK_TEXTS, WORDS)} AS INT) AS score FROM (
 SELECT *, {resolve_sql('href', 'url')} AS link_url FROM v_links) l WHERE link_url IS NOT NULL AND {HOST.format('link_url')} IS NOT NULL),
v_kept AS (SELECT * FROM v_deep WHERE score > 5 OR {' OR '.join(matches('lower(href)', p) for p in LINK_PATTERNS)} OR {any_found('lower(text)', LINK_TEXTS)}),
v_best AS (SELECT * FROM v_kept QUALIFY row_number() OVER (PARTITION BY page_id, {NORMAL.format('link_url')} ORDER BY score DESC, ctx, pos, link_url) = 1),
v_edges AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ctx, pos, link_url) AS rank FROM v_best QUALIFY rank <= 5)"""


def _edges(t):
    deep = li.score_deep_links(
        _links(t, False), texts=LINK_TEXTS, terms=WORDS, patterns=LINK_PATTERNS, paths=LINK_PATHS
    )
    best = li.dedupe_links_best(deep)
    from clauselake.operators.keyed import top_per_key

    return top_per_key(
        best, ["page_id"],
        [F.col("score").desc(), li.context_rank(F.col("context")), F.col("pos"), F.col("link_url")],
        5,
    )


@query(with_views(V_LINKS, V_DEEP) + "SELECT page_id, link_url, score, CAST(rank AS INT) AS rank, CAST(50 + score + 15 + 10 AS INT) AS confidence FROM v_edges")
def deep_links(t):
    return _edges(t).select(
        "page_id", "link_url", "score", "rank",
        li.deep_link_confidence(F.col("score"), F.col("link_url"), F.lit(True), F.lit(1)).alias(
            "confidence"
        ),
    )


@query(with_views(V_LINKS, V_DEEP).replace("WITH ", "WITH RECURSIVE ", 1) + f""", e AS (SELECT {NORMAL.format('url')} AS page, link_url AS found_url, {NORMAL.format('link_url')} AS target, score, page_id % 2 = 0 AS hub FROM v_edges),
 e2 AS (SELECT * FROM e WHERE page <> target),
 s AS (SELECT {BARE.format('url')} AS domain, url AS original_url, {NORMAL.format('url')} AS page FROM pages QUALIFY row_number() OVER (PARTITION BY {BARE.format('url')} ORDER BY page_id) = 1),
 r0 AS (SELECT s.domain, original_url, found_url, target, 50 + score + CASE WHEN hub THEN 15 ELSE 0 END AS c, 1 AS depth FROM s JOIN e2 USING (page)),
 r AS (SELECT * FROM r0 WHERE regexp_replace({HOST.format('found_url')}, '^www\\.', '') = domain OR {root_sql(HOST.format('found_url'))} = {root_sql('domain')})
SELECT domain, original_url, found_url, CAST(least(98, c) AS INT) AS confidence, CAST(depth AS INT) AS depth FROM r WHERE c >= 70""")
def expand_links_once(t):
    """One step from the first page of each domain."""
    pages = t.read("pages").withColumn("domain", ur.bare_host(F.col("url")))
    starts = pages.groupBy("domain").agg(F.min_by("url", "page_id").alias("url"))
    edges = _edges(t).withColumn("from_hub", F.col("page_id") % 2 == 0)
    return li.expand_links(starts, edges, max_depth=0)


LADDER = """WITH e AS (SELECT DISTINCT o_custkey % 50 AS a, o_orderkey % 50 AS b FROM orders WHERE o_custkey % 50 <> o_orderkey % 50),
 x AS (SELECT a, b, 10 + (a * 7 + b * 3) % 30 AS score FROM e),
 f0 AS (SELECT 'd' || (c_custkey % 5) || '.example.com' AS domain, c_custkey % 50 AS a FROM customer GROUP BY ALL),
 r0 AS (SELECT domain, f0.a AS o, b, 50 + score + CASE WHEN x.a % 2 = 0 THEN 15 ELSE 0 END AS c FROM f0 JOIN x USING (a)),
 f1 AS (SELECT domain, b AS a FROM r0 WHERE c >= 60 AND NOT EXISTS (SELECT 1 FROM f0 WHERE f0.domain = r0.domain AND f0.a = r0.b) GROUP BY ALL),
 r1 AS (SELECT domain, min(r0.o) AS o FROM r0 GROUP BY 1),
 s1 AS (SELECT f1.domain, f1.a AS o, x.b, 60 + score + CASE WHEN x.a % 2 = 0 THEN 15 ELSE 0 END AS c FROM f1 JOIN x USING (a)),
 v1 AS (SELECT * FROM f0 UNION SELECT * FROM f1),
 f2 AS (SELECT domain, b AS a FROM s1 WHERE c >= 60 AND NOT EXISTS (SELECT 1 FROM v1 WHERE v1.domain = s1.domain AND v1.a = s1.b) GROUP BY ALL),
 s2 AS (SELECT f2.domain, f2.a AS o, x.b, 60 + score + CASE WHEN x.a % 2 = 0 THEN 15 ELSE 0 END AS c FROM f2 JOIN x USING (a)),
 u AS (SELECT domain, b, c, 1 AS depth FROM r0 UNION ALL SELECT domain, b, c, 2 FROM s1 UNION ALL SELECT domain, b, c, 3 FROM s2)
SELECT domain, CAST(depth AS INT) AS depth, 'https://n' || b || '.example.com/' AS found_url, CAST(max(least(98, c)) AS INT) AS confidence, count(*) AS ways FROM u WHERE c >= 70 GROUP BY 1, 2, 3"""


@query(LADDER)
def expand_links_two_steps(t):
    """Two steps deep over a graph of customers and orders."""
    a, b = (F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50).alias("b")

    def site(c: str):
        return F.concat(F.lit("https://n"), F.col(c).cast("string"), F.lit(".example.com/"))

    edges = t.read("orders").select(a, b).where("a <> b").distinct().select(
        site("a").alias("url"), site("b").alias("link_url"),
        (10 + (F.col("a") * 7 + F.col("b") * 3) % 30).cast("int").alias("score"),
        (F.col("a") % 2 == 0).alias("from_hub"),
    )
    starts = t.read("customer").select(
        F.concat(F.lit("d"), (F.col("c_custkey") % 5).cast("string"), F.lit(".example.com")).alias("domain"),
        (F.col("c_custkey") % 50).alias("a"),
    ).select("domain", site("a").alias("url")).distinct()
    found = li.expand_links(starts, edges)
    return found.groupBy("domain", "depth", "found_url").agg(
        F.max("confidence").cast("int").alias("confidence"), F.count(F.lit(1)).alias("ways")
    )


PAGE_WORDS = ("the ", "der ", "que", "para", "ment", "tion", "ung")


@query(f"""SELECT page_id, term_count, CAST(least(98, CASE WHEN page_id % 10 = 0 THEN 95 WHEN contains(lower(url), 'privacy') THEN 85 ELSE 75 END
 + CASE WHEN term_count >= 4 THEN 5 ELSE 0 END + CASE WHEN contains(lower(regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1)), 'privacy') THEN 5 ELSE 0 END) AS INT) AS confidence
 FROM (SELECT *, {found_count('lower(html)', PAGE_WORDS)} AS term_count FROM pages) p WHERE term_count >= 2""")
def direct_page_confidence(t):
    return li.direct_page_confidence(
        t.pages, special=F.col("page_id") % 10 == 0, terms=PAGE_WORDS
    ).select("page_id", "term_count", "confidence")


TYPE_PATTERNS = {
    "privacy": (r"(?i)^the$", r"(?i)/th"),
    "terms": (r"(?i)and", r"(?i)/e[a-z]+"),
    "cookies": (r"(?i)le$", r"(?i)about"),
}
HUBS = (r"(?i)/the$",)


def _typed_sql(value: str, hub: bool) -> str:
    parts = []
    for name, ps in TYPE_PATTERNS.items():
        text = " ".join(f"WHEN {matches('low', p)} OR {matches('href', p)} THEN {matches('low', p)}" for p in ps)
        href = " ".join(f"WHEN {matches('low', p)} OR {matches('href', p)} THEN {matches('href', p)}" for p in ps)
        parts.append(f"SELECT page_id, context, pos, {q(name)} AS type, CASE {text} END AS tm, CASE {href} END AS hm FROM l")
    skip = f"WHERE NOT {matches('link_url', HUBS[0])}" if hub else ""
    return f""", l AS (SELECT *, lower(text) AS low FROM (SELECT *, {resolve_sql('href', 'url')} AS link_url FROM v_links) x {skip}),
 m AS ({' UNION ALL '.join(parts)})
SELECT page_id, context, pos, type, CAST({value} AS DOUBLE) AS confidence FROM m WHERE tm IS NOT NULL"""


@query(with_views(V_LINKS) + _typed_sql("tm::INT * 2 + hm::INT + CASE context WHEN 'footer' THEN 3 ELSE 0 END", True))
def classify_footer_links(t):
    rows = _links(t, False).withColumn("link_url", ur.resolve_url(F.col("href"), F.col("url")))
    return li.classify_links(rows, TYPE_PATTERNS, "footer", hub_patterns=HUBS).select(
        "page_id", "context", "pos", "type", "confidence"
    )


@query(with_views(V_LINKS) + _typed_sql("least(95, CASE context WHEN 'footer' THEN 30 WHEN 'nav' THEN 15 ELSE 0 END + CASE WHEN tm THEN 20 ELSE 10 END)", False))
def classify_crawled_links(t):
    return li.classify_links(_links(t, False), TYPE_PATTERNS, "crawl").select(
        "page_id", "context", "pos", "type", "confidence"
    )


OLD = {"privacy": ("the", "der"), "terms": ("and", "le"), "legal": ("about", "contact"),
       "negative": ("ou", "#", "mailto:")}


def _old_sql(variant: str) -> str:
    def has(col, group):
        return any_found(col, OLD[group])

    if variant == "smart":
        neg = f"{has('u', 'negative')} OR {has('x', 'negative')}"
        score = f"""{any_found('u', ('/en/', 'en-us', 'lang=en'))}::INT * 50 + {has('u', 'privacy')}::INT * 50 + {has('u', 'terms')}::INT * 30 + {has('u', 'legal')}::INT * 20
 + {has('x', 'privacy')}::INT * 40 + {has('x', 'terms')}::INT * 20 + {has('x', 'legal')}::INT * 10 + (context = 'footer')::INT * 10 - {any_found('u', ('/de/', '/fr/', '/es/'))}::INT * 10"""
    else:
        neg = has("u", "negative")
        score = f"""{any_found('u', ('/en/', 'en-us'))}::INT * 50 - {any_found('u', ('/de/', '/fr/'))}::INT * 20 + ({has('u', 'privacy')} OR {has('x', 'privacy')})::INT * 40
 + ({has('u', 'terms')} OR {has('x', 'terms')})::INT * 20 + ({has('u', 'legal')} OR {has('x', 'legal')})::INT * 10 + (context = 'footer')::INT * 30 + (pos % 2 = 0)::INT * 5"""
    return f"CASE WHEN NOT ({neg}) AND ({score}) > 0 THEN {score} END"


@query(with_views(V_LINKS) + f"""SELECT page_id, context, pos, CAST({_old_sql('smart')} AS INT) AS smart, CAST({_old_sql('universal')} AS INT) AS universal FROM (
 SELECT *, lower(link_url) AS u, lower(text) AS x FROM (SELECT *, {resolve_sql('href', 'url')} AS link_url FROM v_links) a WHERE link_url IS NOT NULL) b""")
def old_link_scores(t):
    rows = _links(t, False).withColumn("link_url", ur.resolve_url(F.col("href"), F.col("url")))
    footer = F.col("context") == "footer"
    return rows.where("link_url IS NOT NULL").select(
        "page_id", "context", "pos",
        li.old_link_score(F.col("link_url"), F.col("text"), footer, "smart", words=OLD).alias("smart"),
        li.old_link_score(F.col("link_url"), F.col("text"), footer, "universal",
                          F.col("pos") % 2 == 0, OLD).alias("universal"),
    )


# --------------------------------------------------------------------------- candidates


@query(with_views(V_CANDIDATES) + """, s AS (SELECT domain, source, source_order, max(confidence) AS confidence, arg_min(url, {'c': -confidence, 'u': url}) AS url FROM v_candidates GROUP BY 1, 2, 3),
 l AS (SELECT domain, min(CASE WHEN confidence >= 85 THEN source_order END) AS last FROM s GROUP BY 1)
SELECT domain, url, source, confidence FROM s JOIN l USING (domain) WHERE last IS NULL OR source_order <= last
 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, source_order, url) = 1""")
def best_candidate(t):
    return ca.best_candidate(t.candidates)


@query(with_views(V_CANDIDATES) + """, v AS (SELECT url, any_value(part) AS part FROM v_candidates GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, source_order, url) AS rank FROM v_candidates QUALIFY rank <= 5),
 c AS (SELECT r.*, v.part % 3 = 0 AS valid, CAST(v.part % 101 AS INT) AS cc, v.part % 2 = 0 AS search_on FROM r JOIN v USING (url)),
 t AS (SELECT * FROM c WHERE rank = 1),
 o AS (SELECT * FROM c WHERE rank > 1 AND valid QUALIFY row_number() OVER (PARTITION BY domain ORDER BY rank) = 1)
SELECT t.domain, CASE WHEN sw AND o.url IS NOT NULL THEN o.url ELSE t.url END AS url, CASE WHEN sw AND o.url IS NOT NULL THEN o.source ELSE t.source END AS source,
 CAST(CASE WHEN t.valid THEN least(98, t.confidence + least(10, t.cc // 10)) WHEN sw AND o.url IS NOT NULL THEN greatest(o.confidence, o.cc) WHEN sw THEN greatest(30, t.confidence - 20) ELSE t.confidence END AS INT) AS confidence,
 CASE WHEN t.valid THEN 'validated' WHEN sw AND o.url IS NOT NULL THEN 'alternative' WHEN sw THEN 'inconclusive' ELSE 'unchecked' END AS outcome
FROM (SELECT *, NOT valid AND search_on AS sw FROM t) t LEFT JOIN o ON t.domain = o.domain""")
def best_validated_candidate(t):
    c = t.candidates
    checks = c.groupBy("url").agg(F.min("part").alias("part")).select(
        "url", (F.col("part") % 3 == 0).alias("valid"),
        (F.col("part") % 101).cast("int").alias("content_confidence"),
        (F.col("part") % 2 == 0).alias("search_on"),
    )
    return ca.best_validated_candidate(c, checks)


@query(with_views(V_CANDIDATES) + f"""SELECT domain, type, url, source, confidence, CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END AS level,
 CAST(list_position({sql_list(ca.TYPE_ORDER)}, type) AS INT) AS type_order FROM v_candidates QUALIFY row_number() OVER (PARTITION BY domain, type ORDER BY confidence DESC, source_order, url) = 1""")
def best_per_type(t):
    return ca.best_per_type(t.candidates)


@query(with_views(V_CANDIDATES) + """, l AS (SELECT *, CASE WHEN source = 'sitemap' THEN 0 WHEN source = 'manual' THEN 1 ELSE 2 END AS layer FROM v_candidates WHERE source IN ('sitemap', 'manual', 'footer_link'))
SELECT domain, type, url, CAST(layer AS INT) AS layer FROM (SELECT DISTINCT domain, type, url, layer FROM l) x QUALIFY row_number() OVER (PARTITION BY domain, type ORDER BY layer, url) = 1""")
def merge_by_priority(t):
    c = t.candidates.select("domain", "type", "url", "source")
    layers = [c.where(F.col("source") == s) for s in ("sitemap", "manual", "footer_link")]
    return ca.merge_by_priority(layers).select("domain", "type", "url", "layer")


@query(with_views(V_CANDIDATES) + f""", b AS (SELECT 'https://d' || (1 + doc_id % 90) || '.example.com/p' || doc_id AS url, text AS body FROM documents),
 p AS (SELECT url, type, CASE doc_id % 9 WHEN 0 THEN 'special_domain' ELSE 'crawl' END AS source, CASE doc_id % 5 WHEN 0 THEN 'high' ELSE 'low' END AS level,
  (doc_id % 10) / 10.0::DOUBLE AS model_score FROM (SELECT 'https://d' || (1 + doc_id % 90) || '.example.com/p' || doc_id AS url, {sql_list(TYPES)}[1 + doc_id % 8] AS type, doc_id FROM documents) d)
SELECT p.url, p.type FROM p JOIN b USING (url) WHERE source = 'special_domain' OR model_score > 0.7 OR level = 'high'
 OR (length(body) >= 1000 AND CASE p.type {' '.join(f"WHEN {q(k)} THEN {any_found('lower(body)', v)}" for k, v in de.V.TYPE_TERMS.items())} ELSE false END)""")
def validate_by_type(t):
    d = t.documents.withColumn(
        "url", F.concat(F.lit("https://d"), (1 + F.col("doc_id") % 90).cast("string"),
                        F.lit(".example.com/p"), F.col("doc_id").cast("string"))
    )
    n = F.col("doc_id")
    policies = d.select(
        "url", F.get(F.array(*[F.lit(x) for x in TYPES]), (n % 8).cast("int")).alias("type"),
        F.when(n % 9 == 0, "special_domain").otherwise("crawl").alias("source"),
        F.when(n % 5 == 0, "high").otherwise("low").alias("level"),
        ((n % 10) / F.lit(10.0)).alias("model_score"),
    )
    return ca.validate_by_type(policies, d.select("url", F.col("text").alias("body"))).select("url", "type")


@query(r"""SELECT query, target, round((contains(b, 'privacy')::INT * 10 + contains(b, 'policy')::INT * 5 + contains(b, 'notice')::INT * 5 - contains(b, 'help')::INT * 5
 - contains(b, 'support')::INT * 5 - contains(b, 'community')::INT * 10 - length(target) * 0.05::DOUBLE), 6) AS score FROM (
 SELECT page_id % 20 AS query, url AS target, lower(url || coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 'Privacy Policy')) AS b FROM pages) r WHERE NOT contains(lower(target), 'login') AND NOT contains(lower(target), 'signup')""")
def rerank_search_results(t):
    rows = t.pages.select(
        (F.col("page_id") % 20).alias("query"),
        F.when(F.col("page_id") % 3 == 0, F.concat(
            F.lit("https://s.example.com/l/?kh=-1&uddg="), F.url_encode("url"), F.lit("&x=1")))
        .otherwise(F.col("url")).alias("url"),
        tx.html_title(F.col("html")).alias("title"),
    )
    return ca.rerank_search_results(rows).select("query", "target", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT 'c' || l_orderkey AS company, CASE WHEN l_linenumber < 6 THEN 'D' || (l_suppkey % 3) || '.com' END AS domain, CAST(l_quantity AS INT) AS confidence FROM lineitem),
 n AS (SELECT company, lower(domain) AS domain, count(*) AS votes, sum(confidence) / count(*)::DOUBLE AS mean FROM v WHERE domain IS NOT NULL GROUP BY 1, 2)
SELECT company, domain, votes, round(votes * 30 + mean, 6) AS score,
 CAST(least(100, floor(mean * CASE votes WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END + 0.5)) AS INT) AS confidence FROM n
 QUALIFY row_number() OVER (PARTITION BY company ORDER BY votes * 30 + mean DESC, domain) = 1""")
def consensus_domain(t):
    votes = t.read("lineitem").select(
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("company"),
        F.when(F.col("l_linenumber") < 6, F.concat(
            F.lit("D"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".com"))).alias("domain"),
        F.col("l_quantity").cast("int").alias("confidence"),
    )
    return ca.consensus_domain(votes).withColumn("score", F.round("score", 6))


@query(f"""WITH d AS (SELECT DISTINCT {HOST.format('url')} AS domain FROM pages), s AS (SELECT * FROM (VALUES ('example.com', 0)) x(a, b)),
 o AS (SELECT DISTINCT regexp_replace(domain, '^www\\.', '') AS k, domain FROM d WHERE length(domain) % 2 = 0),
 f AS (SELECT DISTINCT domain AS k FROM d WHERE length(domain) % 2 = 0)
SELECT domain, coalesce((SELECT f.k FROM f WHERE f.k = d.domain), (SELECT f.k FROM f WHERE f.k = 'www.' || d.domain), (SELECT f.k FROM f WHERE f.k = regexp_replace(d.domain, '^www\\.', ''))) AS matched
FROM d WHERE coalesce((SELECT f.k FROM f WHERE f.k = d.domain), (SELECT f.k FROM f WHERE f.k = 'www.' || d.domain), (SELECT f.k FROM f WHERE f.k = regexp_replace(d.domain, '^www\\.', ''))) IS NOT NULL""")
def special_domain_override(t):
    domains = t.read("pages").select(ur.url_host(F.col("url")).alias("domain")).distinct()
    known = domains.where(F.length("domain") % 2 == 0).select(
        "domain", F.lit("privacy").alias("type"), F.col("domain").alias("url")
    )
    return ca.special_domain_override(domains, known).select(
        "domain", F.col("special_url").alias("matched")
    )


@query("""WITH n AS (SELECT DISTINCT s_name AS name FROM supplier UNION SELECT DISTINCT upper(n_name) || ' ' || n_nationkey FROM nation),
 v AS (SELECT name, regexp_replace(trim(lower(name)), '\\s+', '', 'g') AS b FROM n),
 t AS (SELECT name, unnest([b, regexp_replace(b, '[^a-z0-9]', '', 'g'), replace(b, '-', ''), replace(b, '_', '')]) AS k, unnest([0, 1, 2, 3]) AS o FROM v),
 c AS (SELECT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS company, 's' || s_suppkey || '.com' AS domain FROM supplier UNION ALL SELECT lower(n_name) || n_nationkey, 'n' || n_nationkey || '.org' FROM nation)
SELECT name, domain FROM t JOIN c ON k = company QUALIFY row_number() OVER (PARTITION BY name ORDER BY o, domain) = 1""")
def resolve_company(t):
    s, n = t.read("supplier"), t.read("nation")
    names = s.select(F.col("s_name").alias("name")).unionByName(
        n.select(F.concat(F.upper("n_name"), F.lit(" "), F.col("n_nationkey").cast("string")).alias("name"))
    )
    companies = s.select(
        F.regexp_replace(F.lower("s_name"), "[^a-z0-9]", "").alias("company"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("domain"),
    ).unionByName(n.select(
        F.concat(F.lower("n_name"), F.col("n_nationkey").cast("string")).alias("company"),
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".org")).alias("domain"),
    ))
    return ca.resolve_company(names, companies)


PROBES = tuple(f"/{lang}/{n}" for lang in ("en", "fr") for n in range(100, 200, 3)) + ("/en/853/",)


@query(f"""WITH p AS (SELECT min(url) AS url, regexp_replace({NORMAL.format('url')}, '^[a-z][a-z0-9+.-]*://', '') AS place FROM pages WHERE length(html) > 1000 GROUP BY 2),
 d AS (SELECT DISTINCT {BARE.format('url')} AS domain FROM pages),
 x AS (SELECT domain, unnest({sql_list(PROBES)}) AS path FROM d), h AS (SELECT domain, path, domain AS host FROM x UNION ALL SELECT domain, path, 'www.' || domain FROM x)
SELECT domain, path, url, CAST(80 AS INT) AS confidence FROM h JOIN p ON place = host || regexp_replace(path, '/$', '')""")
def path_candidates(t):
    pages = t.pages
    domains = pages.select(ur.bare_host(F.col("url")).alias("domain"))
    return ca.path_candidates(domains, pages, PROBES, min_body=1000, with_www=True).drop("type")


@query(f"""SELECT 'https://' || {HOST.format('url')} || '/sitemap.xml' AS sitemap_url, url AS loc, CAST(90 AS INT) AS confidence FROM pages WHERE {any_found('lower(url)', ('en/1', 'pills'))}""")
def sitemap_urls(t):
    """Sitemaps laid out from the crawled addresses: one file per page."""
    body = F.concat(F.lit("<?xml version='1.0'?><urlset><url><loc> "), F.col("url"),
                    F.lit(" </loc></url></urlset>"))
    maps = t.pages.select(
        F.concat(F.lit("https://"), ur.url_host(F.col("url")), F.lit("/sitemap.xml")).alias("url"),
        body.alias("body"),
    )
    rows = read_sitemap_urls(maps)
    return ca.sitemap_candidates(rows, "loc", ("en/1", "pills"))


@query(f"""WITH d AS (SELECT DISTINCT {HOST.format('url')} AS domain FROM pages),
 l AS (SELECT {HOST.format('url')} AS domain, page_id, 'https://' || {HOST.format('url')} || '/m' || page_id || '.xml' AS sitemap_url FROM pages WHERE page_id % 2 = 0)
SELECT domain, sitemap_url FROM l UNION ALL SELECT domain, 'https://' || domain || '/sitemap.xml' FROM d WHERE domain NOT IN (SELECT domain FROM l)""")
def sitemap_sources_of_domains(t):
    host = ur.url_host(F.col("url"))
    robots = t.pages.where("page_id % 2 = 0").select(
        "url", F.concat(F.lit("User-agent: *\nSitemap: https://"), host, F.lit("/m"),
                        F.col("page_id").cast("string"), F.lit(".xml\n")).alias("body")
    )
    domains = t.pages.select(host.alias("domain"))
    return sitemap_sources(domains, sitemap_lines(robots))


@query(f"""SELECT domain, url, CAST(rank AS INT) AS rank, CAST(60 - rank * 10 AS INT) AS confidence FROM (
 SELECT 'example.' || split_part({HOST.format('url')}, '.', -1) AS domain, url, row_number() OVER (PARTITION BY split_part({HOST.format('url')}, '.', -1) ORDER BY page_id) AS rank FROM pages) r WHERE rank <= 3""")
def search_candidates(t):
    tld = F.element_at(F.split(ur.url_host(F.col("url")), r"\."), -1)
    rows = t.pages.select(
        F.concat(F.lit("example."), tld).alias("domain"), "url", F.col("page_id").alias("position")
    )
    return ca.search_candidates(rows).select("domain", "url", "rank", "confidence")


@query()
def discover_policies(t):
    """Rows only: the whole discovery flow over the crawl, each part checked on its own."""
    return flows.discover_policies(t.pages)


@query()
def read_policies(t):
    """Rows only: pages to checked documents in one stage."""
    return flows.read_policies(t.pages).select("page_id", "content_confidence", "content_valid")




# Sitemaps over the given pages: a file per page, an index per ten pages, indexes of ten indexes that also name the
# index before them, and two that name each other.
_LEAF, _INNER, _OUTER = "'https://m.example/l' || page_id", "'https://m.example/i' || (page_id // 10)", "'https://m.example/o' || (page_id // 100)"


@query(f"""WITH RECURSIVE p AS (SELECT page_id, url FROM pages),
 e(a, b) AS (SELECT DISTINCT {_INNER}, {_LEAF} FROM p UNION SELECT {_OUTER}, {_INNER} FROM p
  UNION SELECT {_OUTER}, 'https://m.example/o' || (page_id // 100 - 1) FROM p UNION SELECT 'https://m.example/o0', 'https://m.example/o1'),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s AS sitemap_url, count(*) AS addresses, count(DISTINCT loc) AS distinct_addresses FROM (
 SELECT {_LEAF} AS s, url AS loc FROM p UNION ALL SELECT r.a, url FROM r JOIN p ON r.b = {_LEAF}) x GROUP BY s""")
def nested_sitemaps(t):
    """Indexes of indexes, with loops."""
    p = t.read("pages").select("page_id", "url")
    at = lambda letter, n: F.concat(F.lit("https://m.example/" + letter), n.cast("string"))
    page = F.col("page_id")
    inner, outer = F.floor(page / 10), F.floor(page / 100)
    leaf = p.select(at("l", page).alias("url"), F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url></urlset>")).alias("body"))
    edges = p.select(at("i", inner).alias("a"), at("l", page).alias("b")).unionByName(
        p.select(at("o", outer).alias("a"), at("i", inner).alias("b"))).unionByName(
        p.select(at("o", outer).alias("a"), at("o", outer - 1).alias("b"))).unionByName(
        p.select(F.lit("https://m.example/o0").alias("a"), F.lit("https://m.example/o1").alias("b"))).distinct()
    index = edges.groupBy(F.col("a").alias("url")).agg(F.concat(
        F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "b", F.lit("</loc></sitemap>"))), ""),
        F.lit("</sitemapindex>")).alias("body"))
    return read_sitemap_urls(leaf.unionByName(index), first="first").groupBy("sitemap_url").agg(
        F.count("loc").alias("addresses"), F.count_if("first").alias("distinct_addresses"))
