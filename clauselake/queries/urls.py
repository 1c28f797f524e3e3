"""Address queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.functions import urls as ur
from clauselake.operators.addresses import check_owner, score_domains, validate_urls
from clauselake.operators.keyed import spread_join
from clauselake.operators.suffixes import host_parts, suffix_rules
from clauselake.queries.base import any_found, found_count, match_sum, matches, q, query, sql_list
from clauselake.values import domains as D
from clauselake.values.suffix_rules import PRIVATE_RULES, REGISTRY_RULES

HOST = r"nullif(lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '')"
BARE = r"regexp_replace(" + HOST + r", '^www\.', '')"
PATH = r"coalesce(nullif(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
ORIGIN = r"lower(regexp_extract({0}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1))"
NORMAL = "lower(" + ORIGIN + r" || regexp_replace(" + PATH + r", '/$', ''))"

BLOCKED = ("example.net", "spam-farm.example.org", "cheap-pills.example.com")
PATTERNS = (r"(?i)/en/", r"(?i)/fr/\d+", r"(?i)utm_source=", r"(?i)/es[/\?#]", r"(?i)[?&]page=\d")
PATHS = ("/en", "/de", "/fr", "/en", "/es/5", ".html")
TEXTS = ("the", "and", "of", "le", "der", "und", "tion")
TERMS = ("th", "en", "er", "ou", "ción")


def suffixes(host: str) -> str:
    return (
        f"list_transform(range(1, len(string_split({host}, '.')) + 1), lambda i: "
        f"array_to_string(list_slice(string_split({host}, '.'), i, len(string_split({host}, '.'))), '.'))"
    )


def blocked_host(host: str, names) -> str:
    return f"(len(list_intersect({suffixes(host)}, {sql_list(names)})) > 0)"


# The four patterns that look ahead, as a test with and a test without.
AHEAD = (
    ("facebook.com/.*/", "facebook.com/.*/(privacy|policy|legal)"),
    ("twitter.com/", "twitter.com/.*(privacy|policy|tos)"),
    ("instagram.com/", "instagram.com/.*(privacy|policy)"),
    ("wikipedia.org/wiki/", "wikipedia.org/wiki/(Privacy|Terms|Legal)"),
)


def blocked_url(url: str, names=D.BLOCKED_DOMAINS) -> str:
    plain = [p for p in D.BLOCKED_URL_PATTERNS if "(?!" not in p]
    tests = [matches(url, p) for p in plain]
    tests += [f"({matches(url, '(?i)' + a)} AND NOT {matches(url, '(?i)' + b)})" for a, b in AHEAD]
    return f"({HOST.format(url)} IS NULL OR {blocked_host(BARE.format(url), names)} OR {' OR '.join(tests)})"


@query(f"""SELECT page_id, {HOST.format('url')} AS host, {PATH.format('url')} AS path, {NORMAL.format('url')} AS place,
 coalesce(nullif(regexp_extract(x, '^([a-z0-9_-]+(?:\\.[a-z0-9_-]+)+)(?:[:/?#]|$)', 1), ''), x) AS clean FROM (
 SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/$', '') AS x FROM pages) p""")
def url_parts(t):
    u = F.col("url")
    return t.pages.select(
        "page_id", ur.url_host(u).alias("host"), ur.url_path(u).alias("path"),
        ur.normalised_url(u).alias("place"), ur.clean_domain(u).alias("clean"),
    )


SUFFIXES = ("example.net", "co.uk")


@query(f"""SELECT page_id, CASE WHEN length(host) > length(root) THEN substr(host, 1, length(host) - length(root) - 1) END AS subdomain, root AS root_domain, tld FROM (
 SELECT *, CASE WHEN nl > len(string_split(tld, '.')) THEN ls[nl - len(string_split(tld, '.'))] END AS root FROM (
 SELECT page_id, host, {suffixes('host')} AS ls, len(string_split(host, '.')) AS nl,
  CASE WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'example.net' ELSE string_split(host, '.')[-1] END AS tld
 FROM (SELECT page_id, {BARE.format('url')} AS host FROM pages) a) b) c""")
def domain_parts(t):
    return t.pages.select(
        "page_id", ur.domain_parts(ur.bare_host(F.col("url")), SUFFIXES).alias("d")
    ).select("page_id", "d.subdomain", "d.root_domain", "d.tld")


@query(f"SELECT page_id, {blocked_host(BARE.format('url'), BLOCKED)} AS blocked_host, {blocked_url('url')} AS blocked_url FROM pages")
def blocked_addresses(t):
    u = F.col("url")
    return t.pages.select(
        "page_id", ur.is_blocked_host(ur.url_host(u), BLOCKED).alias("blocked_host"),
        ur.is_blocked_url(u).alias("blocked_url"),
    )


MARKERS = ("/en/1", "utm_source=", "#top", "?next=")


@query(f"SELECT page_id, {any_found('lower(url)', MARKERS)} AS auth, regexp_matches(coalesce({PATH.format('url')}, ''), '(?i)^/(index\\.(html?|php|asp))?$') AS homepage FROM pages")
def auth_and_home(t):
    u = F.col("url")
    return t.pages.select(
        "page_id", ur.is_auth_url(u, MARKERS).alias("auth"), ur.is_homepage(u).alias("homepage")
    )


FOLDER = ur.LOCALE_FOLDER


@query(f"""SELECT page_id, {matches('url', '(?i)/(' + '|'.join(ur.FOREIGN_LOCALES) + ')/')} AS foreign_locale,
 CASE WHEN {matches('url', FOLDER)} THEN array_to_string([{', '.join(f"regexp_replace(url, {q(FOLDER)}, {q(e)})" for e in ur.ENGLISH_FOLDERS)}], ' ') ELSE '' END AS variants FROM pages""")
def english_variants(t):
    u = F.col("url")
    return t.pages.select(
        "page_id", ur.has_foreign_locale(u).alias("foreign_locale"),
        F.array_join(ur.english_variants(u), " ").alias("variants"),
    )


def url_score_sql(url: str, patterns=PATTERNS, paths=PATHS) -> str:
    low = f"lower({url})"
    return (
        f"CAST(least(100, {match_sum(low, patterns)} * 20 + {found_count(low, paths)} * 30 + "
        f"CASE WHEN regexp_matches({low}, '/(legal|policies|rechtlich|juridisch|legale)/') THEN 10 ELSE 0 END) AS INT)"
    )


def text_score_sql(text: str, texts=TEXTS, terms=TERMS) -> str:
    low = f"trim(lower({text}))"
    return (
        f"CAST(least(100, CASE WHEN {low} IN ({', '.join(q(x) for x in texts)}) THEN 50 ELSE 0 END + "
        f"{found_count(low, texts)} * 20 + {found_count(low, terms)} * 10) AS INT)"
    )


ROLES = "role || ' ' || substr(text, 1, 12)"


@query(f"SELECT page_id, ({' OR '.join(matches('lower(url)', p) for p in PATTERNS)}) AS privacy_url, {url_score_sql('url')} AS url_score FROM pages")
def privacy_url_scores(t):
    u = F.col("url")
    return t.pages.select(
        "page_id", ur.is_privacy_url(u, PATTERNS).alias("privacy_url"),
        ur.score_privacy_url(u, PATTERNS, PATHS).alias("url_score"),
    )


@query(f"SELECT conv_id, turn, {any_found('lower(text)', TEXTS)} AS speaks, {text_score_sql('text')} AS text_score FROM conversations")
def link_text_scores(t):
    """Texts of turns stand in for link texts."""
    x = F.col("text")
    return t.read("conversations").select(
        "conv_id", "turn", ur.is_privacy_link_text(x, TEXTS).alias("speaks"),
        ur.score_link_text(x, TEXTS, TERMS).alias("text_score"),
    )


TLDS = {".org": ("de",), ".net": ("fr", "it"), ".com": ("es",)}


def _words(*langs: str) -> str:
    from clauselake.values.text_terms import PRIVACY_TERMS

    return sql_list(w for lang in langs for w in PRIVACY_TERMS[lang].values())


@query(f"""SELECT page_id, CAST(len(words) AS INT) AS words, array_to_string(list_sort(words), ',') AS word_list FROM (SELECT page_id,
 list_distinct(list_concat({_words('en')}, CASE WHEN ends_with(host, '.org') THEN {_words('de')} WHEN ends_with(host, '.net') THEN {_words('fr', 'it')} ELSE {_words('es')} END)) AS words
 FROM (SELECT page_id, {HOST.format('url')} AS host FROM pages) h) w""")
def lexicon_for_host(t):
    return t.pages.select(
        "page_id", ur.lexicon_for_host(ur.url_host(F.col("url")), tlds=TLDS).alias("w")
    ).select("page_id", F.size("w").alias("words"),
             F.array_join(F.array_sort("w"), ",").alias("word_list"))


TARGET = "CASE page_id % 4 WHEN 0 THEN 'example.com' WHEN 1 THEN 'www.example.net' WHEN 2 THEN " + HOST.format("url") + " ELSE 'other.org' END"


def _target():
    p = F.col("page_id") % 4
    return (
        F.when(p == 0, "example.com").when(p == 1, "www.example.net")
        .when(p == 2, ur.url_host(F.col("url"))).otherwise("other.org")
    )


def root_sql(host: str) -> str:
    """Registrable domain of hosts whose suffix is one label."""
    return f"array_to_string(list_slice(string_split({host}, '.'), len(string_split({host}, '.')) - 1, len(string_split({host}, '.'))), '.')"


OWNER = f"""o AS (SELECT page_id, url, {TARGET} AS target, {BARE.format('url')} AS host, regexp_replace({TARGET}, '^www\\.', '') AS wanted, {blocked_url('url')} AS blocked FROM pages),
 c AS (SELECT *, CASE WHEN blocked THEN 0 WHEN host = wanted THEN 100 WHEN {root_sql('host')} = {root_sql('wanted')} THEN 95 ELSE 0 END AS owner FROM o),
 k AS (SELECT *, CASE WHEN blocked THEN 0 ELSE greatest(0, least(100, 50 + CASE WHEN ends_with(wanted, '.com') THEN 10 WHEN ends_with(wanted, '.org') THEN 8 WHEN ends_with(wanted, '.net') THEN 5 ELSE 0 END
  + CASE WHEN regexp_matches(low, '/(privacy|legal|datenschutz|confidentialite|privacidad)') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(low, '/(about|corporate|company|unternehmen)') THEN 5 ELSE 0 END
  - CASE WHEN regexp_matches(low, '/profile/') THEN 30 ELSE 0 END - CASE WHEN regexp_matches(low, '/(company|business|org)/[a-z0-9-]+$') THEN 40 ELSE 0 END
  - CASE WHEN regexp_matches(low, '\\?.*(?:id|ref|source|utm)=') THEN 5 ELSE 0 END)) END AS quality FROM (SELECT *, lower(url) AS low FROM c) l)"""


@query(f"WITH {OWNER} SELECT page_id, owner > 0 AS valid, CAST(owner AS INT) AS confidence, CAST(quality AS INT) AS quality FROM k")
def url_for_domain(t):
    rows = score_domains(check_owner(t.pages, "url", _target()), "url", _target())
    return rows.select("page_id", F.col("owner_valid").alias("valid"),
                       F.col("owner_confidence").alias("confidence"), "quality")


@query(f"""WITH {OWNER} SELECT page_id, owner > 0 AND quality >= 30 AND NOT blocked AS valid, CAST(quality AS INT) AS quality,
 CAST(CASE WHEN quality >= 70 THEN least(100, owner + 10) WHEN quality < 50 THEN greatest(0, owner - 20) ELSE owner END AS INT) AS confidence,
 CAST((owner = 0)::INT + (quality < 30)::INT + blocked::INT AS INT) AS issues FROM k""")
def validated_urls(t):
    return validate_urls(t.pages, "url", _target()).select(
        "page_id", F.col("url_valid").alias("valid"), "quality",
        F.col("url_confidence").alias("confidence"), F.size("url_issues").alias("issues"),
    )




# Hosts over the given orders: names of customers below suffixes of every kind of rule, or such a suffix alone.
BELOW = ("github.io", "k12.ca.us", "high.sch.uk", "tokyo.jp", "x.kawasaki.jp", "city.kawasaki.jp", "co.th", "herokuapp.com",
         "www.ck", "b.ck", "example.com", "unknown", "ca.us", "eu-1.elb.amazonaws.com")
ALL_RULES = [(r, False) for r in REGISTRY_RULES] + [(r, True) for r in PRIVATE_RULES]


def _hosts_sql(key: str, step: int) -> str:
    return (f"CASE WHEN ({key} + {step}) % 7 = 0 THEN '' WHEN {key} % 3 = 0 THEN 'w.n' || (o_custkey % {step + 2}) || '.' "
            f"ELSE 'n' || (o_custkey % {step + 2}) || '.' END || [{', '.join(q(b) for b in BELOW)}][CAST({key} % {len(BELOW)} AS INT) + 1]")


def _hosts(key, step: int):
    name = F.concat(F.lit("n"), (F.col("o_custkey") % (step + 2)).cast("string"), F.lit("."))
    return F.concat(
        F.when((key + step) % 7 == 0, "").when(key % 3 == 0, F.concat(F.lit("w."), name)).otherwise(name),
        F.element_at(F.array(*map(F.lit, BELOW)), (key % len(BELOW)).cast("int") + 1),
    )


def rule_table(t):
    return suffix_rules(t.spark.createDataFrame(ALL_RULES, "rule string, private boolean"))


def _parts_sql(rules) -> str:
    """CTEs from ``h(host)`` to ``p(host, root, tld)``, by a join of suffixes and rules written another way."""
    values = ", ".join(f"({q(r)})" for r, _ in rules)
    return f"""r(rule) AS (VALUES {values}),
 d AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM h),
 s AS (SELECT host, i, array_to_string(l[i:], '.') AS s, array_to_string(l[i + 1:], '.') AS up FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM d) x),
 m AS (SELECT host, i + 1 AS place, 0 AS k FROM s JOIN r ON rule = '!' || s UNION ALL SELECT host, i, 1 FROM s JOIN r ON rule = s
  UNION ALL SELECT host, i, 1 FROM s JOIN r ON rule = '*.' || up WHERE up <> ''),
 b AS (SELECT host, arg_min(place, k * 1000 + place) AS place FROM m GROUP BY host),
 p AS (SELECT d.host, l, coalesce(place, len(l)) AS place, array_to_string(l[coalesce(place, len(l)):], '.') AS tld,
  CASE WHEN coalesce(place, len(l)) > 1 THEN array_to_string(l[coalesce(place, len(l)) - 1:], '.') END AS root FROM d LEFT JOIN b ON d.host = b.host)"""


@query(f"""WITH h AS (SELECT o_orderkey, {_hosts_sql('o_orderkey', 1)} AS host FROM orders), {_parts_sql(ALL_RULES)}
SELECT o_orderkey, h.host, CASE WHEN place > 2 THEN array_to_string(l[:place - 2], '.') END AS subdomain, root AS root_domain, tld FROM h JOIN p ON h.host = p.host""")
def domain_parts_by_rules(t):
    rows = t.read("orders").select("o_orderkey", _hosts(F.col("o_orderkey"), 1).alias("host"))
    return spread_join(rows, host_parts(rows, rule_table(t)), ["host"]).select(
        "o_orderkey", "host", "subdomain", "root_domain", "tld")


@query(f"""WITH h AS (SELECT o_orderkey, {_hosts_sql('o_orderkey', 1)} AS host FROM orders), {_parts_sql(ALL_RULES[:len(REGISTRY_RULES)])}
SELECT tld, count(*) AS orders, count(DISTINCT root) AS roots FROM h JOIN p ON h.host = p.host GROUP BY tld""")
def registry_suffixes(t):
    """Suffixes without the rules of private owners."""
    rows = t.read("orders").select(_hosts(F.col("o_orderkey"), 1).alias("host"))
    parts = host_parts(rows, rule_table(t), private=False)
    return spread_join(rows, parts, ["host"]).groupBy("tld").agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("root_domain").alias("roots"))


_PAIRS = f"""o AS (SELECT o_orderkey, {_hosts_sql('o_orderkey', 1)} AS host, {_hosts_sql('(o_orderkey + o_orderkey % 2 * 14 + (o_orderkey % 5 = 0)::INT)', 2)} AS wanted FROM orders)"""


@query(f"""WITH {_PAIRS}, h AS (SELECT host FROM o UNION SELECT wanted FROM o), {_parts_sql(ALL_RULES)}
SELECT o_orderkey, x.host, x.wanted, CAST(CASE WHEN {blocked_url("'https://' || x.host || '/privacy'")} THEN 0 WHEN x.host = x.wanted THEN 100 WHEN a.root = b.root THEN 95 ELSE 0 END AS INT) AS confidence
FROM (SELECT o_orderkey, regexp_replace(host, '^www\\.', '') AS host, regexp_replace(wanted, '^www\\.', '') AS wanted, host AS full_host, wanted AS full_wanted FROM o) x
JOIN p a ON a.host = x.full_host JOIN p b ON b.host = x.full_wanted""")
def owners_by_rules(t):
    """Whether an address belongs to a domain, where most names lie under the same suffix."""
    key = F.col("o_orderkey")
    other = key + key % 2 * 14 + (key % 5 == 0).cast("int")
    rows = t.read("orders").select("o_orderkey", _hosts(key, 1).alias("host"), _hosts(other, 2).alias("wanted"))
    checked = check_owner(rows, F.concat(F.lit("https://"), F.col("host"), F.lit("/privacy")), "wanted", suffixes=rule_table(t))
    bare = lambda c: F.regexp_replace(c, r"^www\.", "")
    return checked.select("o_orderkey", bare("host").alias("host"), bare("wanted").alias("wanted"),
                          F.col("owner_confidence").alias("confidence"))


@query(f"""WITH {OWNER} SELECT page_id, array_to_string(list_filter([
 CASE WHEN owner = 0 THEN CASE WHEN host IS NULL THEN 'Invalid URL format' WHEN blocked THEN 'URL is from a blocked domain type (social media, directory, etc.)'
  ELSE 'URL domain (' || host || ') doesn''t match target domain (' || wanted || ')' END END,
 CASE WHEN quality < 30 THEN 'Low quality domain score' END, CASE WHEN blocked THEN 'URL matches blocked pattern' END], lambda s: s IS NOT NULL), ' | ') AS issues FROM k""")
def url_issue_texts(t):
    """What the address check says, word by word."""
    return validate_urls(t.pages, "url", _target()).select("page_id", F.array_join("url_issues", " | ").alias("issues"))
