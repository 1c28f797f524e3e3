"""Addresses: parts, clean forms, resolution, block lists and privacy scores.

Parts are taken with plain patterns instead of a strict URI parser, because crawled addresses hold
characters a strict parser refuses. An address without a scheme and host counts as invalid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions.terms import (
    any_pattern,
    any_term,
    clamp,
    flag,
    literal_array,
    patterns_matched,
    terms_found_count,
)
from clauselake.functions.text import trimmed
from clauselake.values import domains as D
from clauselake.values import link_terms as L
from clauselake.values.suffix_rules import PRIVATE_RULES, REGISTRY_RULES
from clauselake.values.text_terms import PRIVACY_TERMS

# Second labels under which most countries register names, as in co.th or com.my.
COUNTRY_SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "govt", "mil", "ne", "net", "or", "org")
# Locale folders that mark a page as not English.
FOREIGN_LOCALES = (
    "de", "de-de", "fr", "fr-fr", "es", "es-es", "it", "it-it", "pt", "pt-br", "nl", "pl", "ru",
    "ja", "ko", "zh", "ar", "tr", "sv", "no", "da", "fi",
)
LOCALE_FOLDER = r"(?i)/(de|fr|es|it|pt|nl|pl|ru|ja|ko|zh|ar|tr|sv|no|da|fi)(-[a-z]{2})?/"
ENGLISH_FOLDERS = ("/us/", "/en/", "/en-us/")
# Path marks that lower the length limits of the extraction gate.
PRIVACY_PATH_MARKS = ("/privacy", "/datenschutz", "/confidentialite", "privacy-policy",
                      "data-protection")

_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def all_terms(lexicon: Mapping[str, Mapping[str, str]] = PRIVACY_TERMS) -> list[str]:
    """Distinct lower-cased words of a language table, in table order."""
    return list(dict.fromkeys(t.lower() for words in lexicon.values() for t in words.values()))


# --------------------------------------------------------------------------- parts


def url_host(url: Column) -> Column:
    """Lower-cased host, or null when the address has none."""
    return F.nullif(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def url_path(url: Column) -> Column:
    """Path without query and fragment; ``/`` when there is none, null when invalid."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(url_host(url).isNotNull(), F.coalesce(F.nullif(path, F.lit("")), F.lit("/")))


def url_origin(url: Column) -> Column:
    return F.nullif(
        F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)), F.lit("")
    )


def normalised_url(url: Column) -> Column:
    """Origin and path, lower case, no trailing slash; the whole address when invalid."""
    return F.coalesce(
        F.lower(F.concat(url_origin(url), F.regexp_replace(url_path(url), "/$", ""))),
        F.lower(url),
    )


def clean_domain(text: Column) -> Column:
    """Host of what a user typed; the cleaned input itself when it is no host."""
    plain = F.regexp_replace(F.lower(trimmed(text)), r"^https?://", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^www\.", ""), "/$", "")
    host = F.regexp_extract(plain, r"^([a-z0-9_-]+(?:\.[a-z0-9_-]+)+)(?:[:/?#]|$)", 1)
    return F.coalesce(F.nullif(host, F.lit("")), plain)


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``[a.b.c, b.c, c]``."""

    def grow(found: Column, label: Column) -> Column:
        longer = F.concat(label, F.lit("."), F.element_at(found, -1))
        return F.concat(found, F.array(F.when(F.size(found) == 0, label).otherwise(longer)))

    # From the last label up; nothing outside the step is mentioned, so the host is cut once.
    start = F.array().cast("array<string>")
    return F.reverse(F.aggregate(F.reverse(F.split(host, r"\.")), start, grow))


def parent_domain(host: Column) -> Column:
    """The host without its first label, null for a single label."""
    return F.nullif(F.regexp_extract(host, r"^[^.]*\.(.+)$", 1), F.lit(""))


def public_suffix(host: Column, suffixes: Sequence[str] | None = None) -> Column:
    """Public suffix of a host by the rules ``suffixes``, else its last label.

    Rules are written as in the public suffix list: ``a.b``, ``*.b`` for every label under ``b``, ``!a.b`` for
    what is no suffix in spite of that. An exception wins, then the longest rule. They go into the plan as
    sets, so the list is meant to be short; ``operators.suffixes`` takes a table. Without a list the built-in
    rules hold, and two labels under a country whose second is one of ``COUNTRY_SECOND``.
    """
    rules = (*REGISTRY_RULES, *PRIVATE_RULES) if suffixes is None else suffixes
    plain = [r for r in rules if r[:1] not in "*!"]
    above = [r[2:] for r in rules if r.startswith("*.")]
    out = [r[1:] for r in rules if r.startswith("!")]
    parts = host_suffixes(host)

    def is_rule(s: Column) -> Column:
        return s.isin(*plain) | F.coalesce(parent_domain(s).isin(*above), F.lit(False)) if above else s.isin(*plain)

    found = []
    if out:
        found.append(parent_domain(F.try_element_at(F.filter(parts, lambda s: s.isin(*out)), F.lit(1))))
    if rules:
        found.append(F.try_element_at(F.filter(parts, is_rule), F.lit(1)))
    if suffixes is None:
        pattern = rf"(?:^|\.)((?:{'|'.join(COUNTRY_SECOND)})\.[a-z]{{2}})$"
        found.append(F.nullif(F.regexp_extract(host, pattern, 1), F.lit("")))
    return F.coalesce(*found, F.element_at(F.split(host, r"\."), -1))


def registrable_domain(host: Column, suffixes: Sequence[str] | None = None) -> Column:
    """Public suffix and one label more, null when there is no such label."""
    suffix = public_suffix(host, suffixes)
    extra = F.size(F.split(host, r"\.")) - F.size(F.split(suffix, r"\."))
    return F.when(extra > 0, F.try_element_at(host_suffixes(host), extra))


def domain_parts(host: Column, suffixes: Sequence[str] | None = None) -> Column:
    """Struct of ``subdomain``, ``root_domain`` and ``tld``."""
    root = registrable_domain(host, suffixes)
    sub = F.substring(host, F.lit(1), F.length(host) - F.length(root) - 1)
    return F.struct(
        F.when(F.length(host) > F.length(root), sub).alias("subdomain"),
        F.coalesce(root, host).alias("root_domain"),
        public_suffix(host, suffixes).alias("tld"),
    )


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute address of a link, or null for fragments, script and mail links."""
    link = trimmed(href)
    origin = url_origin(base)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    target = F.regexp_extract(link, r"^([^?#]*)", 1)
    tail = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    path = F.when(F.startswith(link, F.lit("/")), target).otherwise(F.concat(folder, target))
    return (
        F.when(
            link.isNull()
            | (link == "")
            | F.startswith(link, F.lit("#"))
            | F.rlike(link, F.lit(r"^(?i)(javascript|mailto|tel|data):")),
            F.lit(None).cast("string"),
        )
        .when(F.rlike(link, F.lit(r"^(?i)https?://[^/?#]+$")), F.concat(link, F.lit("/")))
        .when(F.rlike(link, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, url_path(base), link))
        .otherwise(F.concat(origin, _no_dots(path), tail))
    )


def _no_dots(path: Column) -> Column:
    """Fold ``.`` and ``..`` steps of a path that starts with a slash."""
    steps = F.split(path, "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    closed = F.when(
        F.rlike(path, F.lit(r"/\.{1,2}$")) & ~F.endswith(joined, F.lit("/")),
        F.concat(joined, F.lit("/")),
    ).otherwise(joined)
    return F.when(F.contains(path, F.lit("/.")), closed).otherwise(path)


# --------------------------------------------------------------------------- predicates


def is_blocked_host(host: Column, blocked: Sequence[str] = D.BLOCKED_DOMAINS) -> Column:
    """The host, or a domain above it, is listed."""
    bare = F.regexp_replace(F.lower(host), r"^www\.", "")
    return F.coalesce(F.exists(host_suffixes(bare), lambda s: s.isin(*blocked)), F.lit(False))


def is_blocked_url(
    url: Column,
    blocked: Sequence[str] = D.BLOCKED_DOMAINS,
    patterns: Sequence[str] = D.BLOCKED_URL_PATTERNS,
) -> Column:
    """Listed host, listed pattern, or not an address at all."""
    host = url_host(url)
    return host.isNull() | is_blocked_host(host, blocked) | any_pattern(url, patterns, F.lower(url))


def is_auth_url(url: Column, markers: Sequence[str] = D.AUTH_MARKERS) -> Column:
    return any_term(F.lower(url), [m.lower() for m in markers])


def has_foreign_locale(url: Column) -> Column:
    return F.rlike(url, F.lit(rf"(?i)/({'|'.join(FOREIGN_LOCALES)})/"))


def english_variants(url: Column) -> Column:
    """The address with its first locale folder replaced by each English one; empty if none."""
    swaps = F.array(
        *[F.regexp_replace(url, rf"(?i)^(.*?){LOCALE_FOLDER[4:]}", "$1" + e) for e in ENGLISH_FOLDERS]
    )
    return F.when(F.rlike(url, F.lit(LOCALE_FOLDER)), swaps).otherwise(
        F.array().cast("array<string>")
    )


def is_homepage(url: Column) -> Column:
    full = F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://"), url))
    return F.coalesce(
        F.rlike(url_path(full), F.lit(r"(?i)^/(index\.(html?|php|asp))?$")), F.lit(False)
    )


def is_privacy_url(url: Column, patterns: Sequence[str] = L.PRIVACY_URL_PATTERNS) -> Column:
    return any_pattern(F.lower(url), patterns, F.lower(url))


def is_privacy_link_text(text: Column, texts: Sequence[str] = L.LINK_TEXTS) -> Column:
    return any_term(F.lower(text), list(dict.fromkeys(t.lower() for t in texts)))


# --------------------------------------------------------------------------- scores


def score_privacy_url(
    url: Column,
    patterns: Sequence[str] = L.PRIVACY_URL_PATTERNS,
    paths: Sequence[str] = L.PRIVACY_PATHS,
) -> Column:
    """20 per pattern, 30 per contained path (listed twice counts twice), 10 for a legal folder."""
    low = F.lower(url)
    folder = F.rlike(low, F.lit("/(legal|policies|rechtlich|juridisch|legale)/"))
    return F.least(
        F.lit(100),
        patterns_matched(low, patterns, low) * 20 + terms_found_count(low, paths) * 30 + flag(folder) * 10,
    )


def score_link_text(
    text: Column, texts: Sequence[str] = L.LINK_TEXTS, terms: Sequence[str] | None = None
) -> Column:
    """50 for a listed text, 20 per listed text contained, 10 per privacy word contained."""
    low = trimmed(F.lower(text))
    words = all_terms() if terms is None else terms
    return F.least(
        F.lit(100),
        flag(low.isin(*texts)) * 50
        + terms_found_count(low, texts) * 20
        + terms_found_count(low, words) * 10,
    )


def lexicon_for_host(
    host: Column,
    lexicon: Mapping[str, Mapping[str, str]] = PRIVACY_TERMS,
    tlds: Mapping[str, Sequence[str]] = L.TLD_LANGUAGES,
) -> Column:
    """English words and those of the languages of the host's ending, each once."""
    english = literal_array(lexicon["en"].values())
    local = F.concat(
        *[
            F.when(
                F.endswith(host, F.lit(tld)),
                literal_array([w for lang in langs for w in lexicon.get(lang, {}).values()]),
            ).otherwise(F.array().cast("array<string>"))
            for tld, langs in tlds.items()
        ]
    )
    return F.array_distinct(F.concat(english, F.coalesce(local, F.array().cast("array<string>"))))


def domain_quality(domain: Column, url: Column, blocked: Column) -> Column:
    """0 to 100: how much a host and path look like a company's own site; 0 when blocked."""
    bare = F.regexp_replace(F.lower(domain), r"^www\.", "")
    low = F.lower(url)
    tld = F.coalesce(
        *[F.when(F.endswith(bare, F.lit(t)), F.lit(bonus)) for t, bonus in D.TLD_SCORES], F.lit(0)
    )

    def hit(pattern: str) -> Column:
        return flag(F.rlike(low, F.lit(pattern)))

    score = (
        F.lit(50)
        + tld
        + hit("/(privacy|legal|datenschutz|confidentialite|privacidad)") * 15
        + hit("/(about|corporate|company|unternehmen)") * 5
        - hit("/profile/") * 30
        - hit("/(company|business|org)/[a-z0-9-]+$") * 40
        - hit(r"\?.*(?:id|ref|source|utm)=") * 5
    )
    return F.when(blocked, 0).otherwise(clamp(score, 0, 100))
