"""Link feature, model and policy score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.operators import features as fe
from clauselake.operators import links as li
from clauselake.queries.base import (
    V_ANALYSES,
    V_VERSIONS,
    any_found,
    found_count,
    match_sum,
    q,
    query,
    sql_list,
    with_views,
)
from clauselake.queries.detection import EVIDENCE
from clauselake.queries.links import V_LINKS, resolve_sql
from clauselake.queries.urls import HOST, PATH
from clauselake.values import feature_terms as V
from clauselake.values import text_terms as TT


def _n(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _scaled(value: str, top: int) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({value}) / {top}.0::DOUBLE))"


PAGE_SQL = {
    "page_has_privacy_content": _n(any_found("low", V.PRIVACY_WORDS)),
    "page_has_policy_structure": _n(f"{found_count('low', V.STRUCTURE_WORDS)} >= 3"),
    "page_has_legal_jargon": _n(f"{found_count('low', V.JARGON_WORDS)} >= 2"),
    "page_word_count": _scaled(r"len(regexp_extract_all(low, '\S+'))", 5000),
    "page_has_contact_info": _n(
        r"contains(low, '@') OR contains(low, 'contact us') OR regexp_matches(low, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b')"
    ),
}


def link_sql(text: str, href: str, context: str, base: str, page: dict[str, str] | None = None) -> dict:
    """SQL of the 24 features over columns ``words`` (trimmed lower text), ``u`` and ``full``."""
    every = V.PRIVACY_WORDS + V.TERMS_WORDS + V.COOKIE_WORDS
    path = PATH.format("full_url")
    values = {
        "has_privacy_keyword": _n(any_found("words", V.PRIVACY_WORDS)),
        "has_terms_keyword": _n(any_found("words", V.TERMS_WORDS)),
        "has_cookie_keyword": _n(any_found("words", V.COOKIE_WORDS)),
        "has_legal_keyword": _n(any_found("words", V.LEGAL_WORDS)),
        "text_match_strength": _scaled(found_count("words", every), 5),
        "url_has_privacy_path": _n(any_found("u", V.URL_WORDS[:8])),
        "url_has_terms_path": _n(any_found("u", V.URL_WORDS[8:14])),
        "url_has_legal_path": _n(any_found("u", ("legal", "policies"))),
        "url_depth": f"CASE WHEN {HOST.format('full_url')} IS NULL THEN 0.0::DOUBLE ELSE {_scaled(f'''len(list_filter(string_split({path}, '/'), lambda s: length(s) > 0))''', 5)} END",
        "url_length": _scaled("length(u)", 200),
        "url_is_https": _n(f"starts_with(u, 'https') OR starts_with(lower({base}), 'https')"),
        "is_in_footer": _n(f"{context} = 'footer'"),
        "is_in_nav": _n(f"{context} = 'nav'"),
        "is_in_legal_hub": _n(f"{context} = 'legal_hub'"),
        "is_in_body": _n(f"{context} IN ('body', 'unknown')"),
    }
    for name in PAGE_SQL:
        values[name] = page[name] if page else "0.0::DOUBLE"
    values |= {
        "link_text_length": _scaled("length(words)", 50),
        "link_has_icon": _n(
            f"{any_found('words', ('🔒', '🛡', '⚖'))} OR {any_found(href, ('shield', 'lock', 'secure'))}"
        ),
        "link_is_external": _n(f"{HOST.format('full_url')} <> {HOST.format(base)}"),
        "link_has_year": _n(r"regexp_matches(words, '\b20[2-3]\d\b')"),
    }
    return values


def _columns(values: dict) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in values.items())


def _spread(df, keys):
    return df.select(
        *keys, *[F.round(F.col("f")[i], 6).alias(n) for i, n in enumerate(fe.FEATURE_NAMES)]
    )


@query(with_views(V_LINKS) + f""", p AS (SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in PAGE_SQL.items())} FROM (SELECT page_id, lower(html) AS low FROM pages) x),
 x AS (SELECT v_links.*, trim(lower(text)) AS words, lower(href) AS u, {resolve_sql('href', 'url')} AS full_url FROM v_links)
SELECT page_id, context, pos, {_columns(link_sql('text', 'href', 'context', 'url', {k: k for k in PAGE_SQL}))} FROM x JOIN p USING (page_id)""")
def link_features(t):
    """The content features of the page stand on the page row and are joined to its links."""
    pages = t.pages
    content = pages.select("page_id", fe.page_features(F.col("html")).alias("page"))
    rows = li.extract_links(t.laid_pages, only_privacy=False).join(content, "page_id")
    out = rows.select(
        "page_id", "context", "pos",
        fe.link_features(F.col("text"), F.col("href"), F.col("context"), F.col("url"), F.col("page")).alias("f"),
    )
    return _spread(out, ("page_id", "context", "pos"))


@query(f"""WITH x AS (SELECT page_id, url, 'https://example.com/' AS base, lower({PATH.format('url')}) AS words, lower(url) AS u, url AS full_url FROM pages)
SELECT page_id, {_columns(link_sql('words', 'url', "'unknown'", 'base'))} FROM x""")
def url_features(t):
    f = fe.url_features(F.col("url"), F.lit("https://example.com/"))
    return _spread(t.pages.select("page_id", f.alias("f")), ("page_id",))


NINE = {
    "in_footer": _n("context = 'footer'"), "in_nav": _n("context = 'nav'"),
    "privacy_text": _n(any_found("x", ("privacy", "data protection"))),
    "terms_text": _n(any_found("x", ("terms", "conditions"))),
    "legal_text": _n("contains(x, 'legal') OR contains(u, 'legal')"),
    "depth": "least(length(u) - length(replace(u, '/', '')), 5) / 5.0::DOUBLE",
    "text_length": "least(length(x), 50) / 50.0::DOUBLE",
    "https": _n("starts_with(u, 'https')"),
    "year": _n(r"regexp_matches(x, '\b20[2-3][0-9]\b')"),
}
V_NINE = f"""v_nine AS (SELECT page_id, context, pos, {', '.join(f'{v} AS {k}' for k, v in NINE.items())} FROM (
 SELECT *, lower(text) AS x, lower(href) AS u FROM v_links) l)"""


def _nine(t):
    return li.extract_links(t.laid_pages, only_privacy=False).select(
        "page_id", "context", "pos",
        fe.link_features9(F.col("text"), F.col("href"), F.col("context")).alias("features"),
    )


@query(with_views(V_LINKS, V_NINE) + f"SELECT page_id, context, pos, {', '.join(f'round({k}, 6) AS {k}' for k in NINE)} FROM v_nine")
def link_features_nine(t):
    return _nine(t).select(
        "page_id", "context", "pos",
        *[F.round(F.col("features")[i], 6).alias(n) for i, n in enumerate(NINE)],
    )


# A tiny network over the nine features: 9-2-1.
NET = (
    ([[0.5, -0.25, 1.0, 0.5, 0.25, -1.0, 2.0, 0.75, 0.1], [-1.0, 0.5, 0.25, 1.5, -0.5, 2.0, -1.0, 0.2, 0.3]], [0.1, -0.2]),
    ([[1.5, -2.0]], [0.25]),
)


def _neuron(weights, bias, inputs) -> str:
    total = " + ".join(f"{n} * {w}::DOUBLE" for w, n in zip(weights, inputs))
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({total} + {bias}::DOUBLE)))"


HIDDEN = ", ".join(
    f"{_neuron(w, b, NINE)} AS h{i}" for i, (w, b) in enumerate(zip(*NET[0]))
)


@query(with_views(V_LINKS, V_NINE) + f""", h AS (SELECT page_id, context, pos, {HIDDEN} FROM v_nine),
 o AS (SELECT page_id, context, pos, {_neuron(NET[1][0][0], NET[1][1][0], ('h0', 'h1'))} AS s FROM h)
SELECT page_id, context, pos, round(s, 6) AS model_score, s > 0.5 AS is_policy, CASE WHEN abs(s - 0.5) > 0.35 THEN 'high' WHEN abs(s - 0.5) > 0.15 THEN 'medium' ELSE 'low' END AS model_confidence FROM o""")
def score_links(t):
    out = fe.score_links(_nine(t), NET)
    return out.select("page_id", "context", "pos", F.round("model_score", 6).alias("model_score"),
                      "is_policy", "model_confidence")


@query()
def train_link_model(t):
    """Rows only: a network trained on all links, to tell links of footers and legal boxes from others."""
    links = li.extract_links(t.laid_pages, only_privacy=False)
    rows = links.select(
        fe.link_features(F.col("text"), F.col("href"), F.col("context"), F.col("url")).alias("features"),
        F.col("context").isin("footer", "legal_hub").cast("int").alias("target"),
    )
    layers, accuracy = fe.train_link_model(rows, epochs=40, rate=4.0)
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("examples")).withColumn(
        "accuracy", F.lit(accuracy)
    ).withColumn("layers", F.lit(len(layers)))


FEEDBACK = """f AS (SELECT user_id AS domain, event_id, (SELECT count(*) FROM pages) AS n, event_type FROM events WHERE event_type IN ('signup', 'error')),
 p AS (SELECT page_id, url, html FROM pages),
 e AS (SELECT 's' || f.domain || '.com' AS domain, p.url, 1 AS target, html FROM f JOIN p ON page_id = f.event_id % n
  UNION ALL SELECT 's' || f.domain || '.com', p.url, 0, html FROM f JOIN p ON page_id = (f.event_id + 1) % n WHERE event_type = 'error')"""


@query(f"""WITH {FEEDBACK}, x AS (SELECT domain, url, target, trim(lower(html)) AS words, lower(url) AS u, url AS full_url, lower(html) AS low FROM e),
 y AS (SELECT domain, url, target, {', '.join(f'{v} AS {k}' for k, v in (link_sql('words', 'url', "'footer'", 'domain', PAGE_SQL)).items())} FROM x)
SELECT url, target, count(*) AS examples, {', '.join(f'round(sum({k}), 4) AS {k}' for k in fe.FEATURE_NAMES)} FROM y GROUP BY 1, 2""")
def feedback_examples(t):
    pages = t.pages
    n = t.read("pages").agg(F.count(F.lit(1)).alias("n")).scalar()
    said = t.read("events").where(F.col("event_type").isin("signup", "error")).select(
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit(".com")).alias("domain"),
        (F.col("event_id") % n).alias("a"),
        F.when(F.col("event_type") == "error", (F.col("event_id") + 1) % n).alias("b"),
    )
    names = pages.select("page_id", "url")
    feedback = (
        said.join(names.withColumnsRenamed({"page_id": "a", "url": "correct_url"}), "a")
        .join(names.withColumnsRenamed({"page_id": "b", "url": "incorrect_url"}), "b", "left")
        .select("domain", "correct_url", "incorrect_url")
    )
    rows = fe.feedback_examples(feedback, pages)
    return rows.groupBy("url", "target").agg(
        F.count(F.lit(1)).alias("examples"),
        *[F.round(F.sum(F.col("features")[i]), 4).alias(n) for i, n in enumerate(fe.FEATURE_NAMES)],
    )


STRONG_URLS = ("/privacy-policy", "/privacy_policy", "/privacypolicy", "/datenschutz",
               "/policies/privacy", "/legal/privacy")


@query(f"""WITH x AS (SELECT page_id, url, CASE WHEN page_id % 7 <> 0 THEN html END AS html, (page_id % 10) / 10.0::DOUBLE AS s FROM pages),
 e AS (SELECT *, {found_count('lower(html)', TT.EVIDENCE_TERMS)} AS st, CAST({match_sum('lower(html)', TT.EVIDENCE_PATTERNS)} AS INT) AS su, regexp_matches({PATH.format('url')}, '(?i)^/(index\\.(html?|php|asp))?$') AS home,
  {any_found('lower(url)', STRONG_URLS)} AS strong FROM x),
 p AS (SELECT *, st >= 2 OR su >= 3 OR (st >= 1 AND su >= 1) AS proof FROM e),
 a AS (SELECT page_id, CASE WHEN html IS NULL THEN least(s * 0.1::DOUBLE, 0.15::DOUBLE) WHEN length(html) < 100 THEN least(s, 0.2::DOUBLE) WHEN home AND NOT proof THEN least(s, 0.2::DOUBLE)
  WHEN home OR proof THEN s WHEN strong AND length(html) > 5000 THEN greatest(s * 0.85::DOUBLE, 0.6::DOUBLE) WHEN strong THEN greatest(s * 0.7::DOUBLE, 0.5::DOUBLE) ELSE least(s, 0.35::DOUBLE) END AS v,
  CASE WHEN html IS NULL OR length(html) < 100 OR (home AND NOT proof) THEN 'low' WHEN home OR proof THEN 'high' WHEN strong THEN 'medium' ELSE 'low' END AS c FROM p)
SELECT page_id, round(v, 6) AS adjusted_score, c AS adjusted_confidence, v > 0.5 AS adjusted_policy FROM a""")
def adjust_prediction(t):
    rows = t.pages.select(
        "page_id", "url", F.when(F.col("page_id") % 7 != 0, F.col("html")).alias("html"),
        ((F.col("page_id") % 10) / F.lit(10.0)).alias("model_score"),
        F.lit("high").alias("model_confidence"),
    )
    return fe.adjust_prediction(rows).select(
        "page_id", F.round("adjusted_score", 6).alias("adjusted_score"), "adjusted_confidence",
        "adjusted_policy",
    )


@query(f"""SELECT doc_id, CAST(CASE WHEN m > 0 THEN floor(m * 0.6::DOUBLE + c * 0.4::DOUBLE + 0.5) ELSE c END AS INT) AS confidence, m >= 70 OR v OR (m >= 50 AND k >= 3) AS valid FROM (
 SELECT doc_id, (doc_id % 11) / 11.0::DOUBLE * 100 AS m, CAST(length(text) % 101 AS INT) AS c, doc_id % 6 = 0 AS v, {found_count('lower(text)', EVIDENCE)} AS k FROM documents) d""")
def combine_confidence(t):
    from clauselake.functions.terms import terms_found_count

    c = fe.combine_confidence(
        (F.col("doc_id") % 11) / F.lit(11.0), (F.length("text") % 101).cast("int"),
        F.col("doc_id") % 6 == 0, terms_found_count(F.lower("text"), EVIDENCE),
    )
    return t.documents.select("doc_id", c.alias("c")).select("doc_id", "c.confidence", "c.valid")


@query(with_views(V_ANALYSES) + """, x AS (SELECT *, list_transform(third_party_sharing, lambda s: lower(s)) AS sh, lower(array_to_string(list_transform(key_findings, lambda f: f.text), ' ')) AS said FROM v_analyses),
 y AS (SELECT *, len(list_filter(sh, lambda s: contains(s, 'sell'))) > 0 AS sells, len(list_filter(sh, lambda s: contains(s, 'marketing'))) > 0 AS mk FROM x),
 r AS (SELECT id, [CASE WHEN NOT list_contains(clauses_found, 'deletion_clause') THEN -15 END, CASE WHEN NOT list_contains(clauses_found, 'contact_clause') AND coalesce(contact_info, '') = '' THEN -10 END,
  CASE WHEN sells THEN -18 WHEN mk THEN -12 WHEN len(sh) > 5 THEN -8 WHEN len(sh) > 2 THEN -4 END, CASE reading_level WHEN 'Complex' THEN -7 WHEN 'Moderate' THEN -3 WHEN 'Simple' THEN 2 END,
  CASE WHEN contains(said, 'vague') OR contains(said, 'unclear') THEN -8 END, CASE WHEN contains(said, 'indefinite') OR contains(said, 'forever') THEN -6 END,
  CASE WHEN contains(said, 'track') AND contains(said, 'third') THEN -5 END, CASE WHEN list_contains(clauses_found, 'opt_out_clause') THEN 3 END] AS rules FROM y)
SELECT id, CAST(greatest(1, least(100, 100 + coalesce(list_sum(rules), 0))) AS INT) AS policy_score, CAST(len(list_filter(rules, lambda x: x IS NOT NULL)) AS INT) AS deductions FROM r""")
def policy_score(t):
    return fe.policy_score(t.analyses).select("id", "policy_score", F.size("deductions").alias("deductions"))


@query(with_views(V_VERSIONS) + """SELECT domain, CAST(floor(sum(score * w) / sum(w)::DOUBLE + 0.5) AS INT) AS aggregate_score, count(*) AS policies FROM (
 SELECT *, CASE policy_type WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END AS w FROM v_versions) v GROUP BY 1""")
def aggregate_policy_score(t):
    return fe.aggregate_policy_score(t.versions, weights={"en": 3, "de": 2})


ORDER = f"(list_position({sql_list(fe.CATEGORY_ORDER)}, category) - 1)"


@query(with_views(V_ANALYSES) + f""", f AS (SELECT id, unnest(key_findings) AS x, generate_subscripts(key_findings, 1) AS i FROM v_analyses),
 g AS (SELECT id, i, x.category AS category, x.text AS text FROM f)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY {ORDER}, i) - 1 AS INT) AS place, category, text,
 CASE category {' '.join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fe.LEGACY_CATEGORIES.items())} ELSE category END AS current_category FROM g""")
def sorted_findings(t):
    rows = t.analyses.select("id", F.posexplode(fe.sort_findings(F.col("key_findings"))).alias("place", "x"))
    return rows.select("id", "place", "x.category", "x.text",
                       fe.map_legacy_category(F.col("x.category")).alias("current_category"))


