"""Text cleaning, tokens, hashes, page text and in-row sections.

Everything here works inside one row. A document is never exploded and put together again, so no
text crosses the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions.terms import SPACE_SET, SPACES, has_rare_space, let

# Elements dropped with their content, per extraction form.
DIRECT_DROP = ("script", "style", "noscript", "svg", "iframe")
READABLE_DROP = DIRECT_DROP + ("nav", "header", "footer", "aside")
CORPUS_DROP = READABLE_DROP + ("canvas", "menu", "button", "select", "textarea", "form")
# Class or id words that mark a block as page furniture.
READABLE_MARKS = ("nav", "header", "footer", "sidebar", "menu", "advertisement", "ad",
                  "social-share")
CORPUS_MARKS = ("cookie", "banner", "popup", "nav", "navbar", "navigation", "menu", "sidebar",
                "footer", "header", "breadcrumb", "social-share")
# Class or id words that mark the main content block.
CONTENT_MARKS = ("content", "main-content", "main", "post-content", "entry-content",
                 "article-content", "policy-content", "privacy-policy", "privacy-content",
                 "page-content")
# Inline elements leave no space behind, all other tags do.
INLINE_TAGS = ("a", "b", "i", "u", "em", "strong", "span", "small", "sub", "sup", "code", "mark",
               "abbr", "font")
# The entities decoded in page text, in decoding order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&amp;", "&"))


def trimmed(text: Column) -> Column:
    """Trim every white-space character; Spark's plain ``trim`` takes blanks only."""
    return F.btrim(text, F.lit(SPACES))


def single_spaced(text: Column) -> Column:
    return F.when(
        has_rare_space(text), F.regexp_replace(text, f"[{SPACE_SET}]+", " ")
    ).otherwise(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column, mode: str = "exact") -> Column:
    """SHA-256 of the trimmed text, or of the lower-cased, single-spaced, trimmed text."""
    if mode == "exact":
        return F.sha2(trimmed(text), 256)
    if mode == "normalized":
        return F.sha2(trimmed(single_spaced(F.lower(text))), 256)
    raise ValueError(f"unknown mode {mode!r}")


def word_count(text: Column) -> Column:
    return F.when(
        has_rare_space(text), F.regexp_count(text, F.lit(f"[^{SPACE_SET}]+"))
    ).otherwise(F.regexp_count(text, F.lit(r"\S+")))


def plain_words(text: Column, lowered: bool = False) -> Column:
    """Lower case (``lowered`` texts are), every run of other than ASCII word characters, ``'`` and ``-`` one space."""
    return F.btrim(F.regexp_replace(text if lowered else F.lower(text), r"[^\w'-]+", " "))


def looks_like_html(text: Column) -> Column:
    return (
        F.contains(text, F.lit("<!DOCTYPE"))
        | F.contains(text, F.lit("<html"))
        | (F.contains(text, F.lit("<head")) & F.contains(text, F.lit("<body")))
    )


# --------------------------------------------------------------------------- page text


def _drop(html: Column, tags: Sequence[str], marks: Sequence[str]) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?is)<({'|'.join(tags)})\b[^>]*>.*?</\1\s*>", " ")
    if marks:
        names = "|".join(marks)
        out = F.regexp_replace(
            out,
            r"(?is)<(div|section|ul|ol|p|span)\b[^>]*\b(?:class|id)\s*=\s*[\"'](?:[^\"']*[\s_-])?"
            rf"(?:{names})(?:[\s_-][^\"']*)?[\"'][^>]*>.*?</\1\s*>",
            " ",
        )
    return out


def strip_tags(html: Column) -> Column:
    """Tags out, entities decoded, one space between words."""
    out = F.regexp_replace(html, rf"(?i)</?(?:{'|'.join(INLINE_TAGS)})\b[^>]*>", "")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return trimmed(single_spaced(out))


def html_title(html: Column, default: str = "Privacy Policy") -> Column:
    """Text of ``<title>``, else the ``og:title`` value, else the first ``<h1>``."""
    found = [
        strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        F.regexp_extract(
            html, r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']+)[\"']", 1
        ),
        strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)),
    ]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit(default))


def html_text(html: Column, form: str = "readable") -> Column:
    """Readable text of a page.

    ``readable``  first content region with more than 200 characters, else the body
    ``corpus``    the same with the wider drop list and a limit of 500 characters
    ``direct``    the whole body without scripts and styles
    """
    if form == "direct":
        return strip_tags(_body(_drop(html, DIRECT_DROP, ())))
    tags, marks, least = {
        "readable": (READABLE_DROP, READABLE_MARKS, 200),
        "corpus": (CORPUS_DROP, CORPUS_MARKS, 500),
    }[form]
    kept = _drop(html, tags, marks)
    names = "|".join(CONTENT_MARKS)
    regions = F.array(
        F.regexp_extract(kept, r"(?is)<main\b[^>]*>(.*?)</main\s*>", 1),
        F.regexp_extract(kept, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1),
        F.regexp_extract(
            kept,
            r"(?is)<(div|section)\b[^>]*(?:role\s*=\s*[\"']main[\"']|\b(?:class|id)\s*=\s*"
            rf"[\"'](?:[^\"']*\s)?(?:{names})(?:\s[^\"']*)?[\"'])[^>]*>(.*)</\1\s*>",
            2,
        ),
    )
    long_enough = F.filter(
        F.transform(regions, strip_tags), lambda t: F.length(t) > F.lit(least)
    )
    return F.coalesce(F.try_element_at(long_enough, F.lit(1)), strip_tags(_body(kept)))


def _body(html: Column) -> Column:
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)", 1)
    return F.when(F.rlike(html, F.lit(r"(?i)<body\b")), body).otherwise(
        F.regexp_replace(html, r"(?is)<head\b.*?</head\s*>", " ")
    )


def pdf_text_normalise(text: Column) -> Column:
    """Line ends, blank lines and blanks of text that came out of a PDF."""
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    out = F.regexp_replace(out, f"\\n[{SPACE_SET}]*\\n", "\n\n")
    return trimmed(F.regexp_replace(out, r"[ \t]+", " "))


# --------------------------------------------------------------------------- tokens


def _no_addresses(text: Column) -> Column:
    """Tags, web and mail addresses blanked; each pattern runs only where its mark occurs."""

    def blank(value: Column, mark: str, pattern: str) -> Column:
        return F.when(
            F.contains(value, F.lit(mark)), F.regexp_replace(value, pattern, " ")
        ).otherwise(value)

    plain = F.when(looks_like_html(text), html_text(text, "corpus")).otherwise(
        blank(text, "<", r"<[^>]*>")
    )
    plain = blank(plain, "://", r"https?://[^\s]+")
    return blank(plain, "@", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")


def clean_for_tokens(text: Column) -> Column:
    """Words only: tags, addresses and signs removed, lower case, one space between words."""
    return F.btrim(F.regexp_replace(F.lower(_no_addresses(text)), r"[^a-z0-9'-]+", " "))


def tokens(text: Column, min_length: int = 3) -> Column:
    """Words of at least ``min_length`` characters that are not plain numbers, in text order.

    One pattern picks them out of the text: a run of word characters that is not all digits.
    """
    word = r"[a-z0-9'-]"
    return F.regexp_extract_all(
        F.lower(_no_addresses(text)),
        F.lit(rf"(?![0-9]+(?!{word})){word}{{{min_length},}}"),
        F.lit(0),
    )


def bigrams(words: Column) -> Column:
    """Neighbouring words of a token array, joined by one space."""
    n = F.size(words)
    pairs = F.arrays_zip(
        F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"),
        F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"),
    )
    return F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))


# --------------------------------------------------------------------------- positions, sections


def _starts(lengths: Column) -> Column:
    """Sum of the lengths before each one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        lengths, start,
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )


def find_all(text: Column, query: str, limit: int | None = None) -> Column:
    """Zero-based positions of ``query``, any case, overlapping; only the first ``limit`` if given."""
    needle = query.lower()
    if not needle:
        return F.array().cast("array<int>")
    if limit is None:
        return let(F.lower(text), lambda low: _all_positions(low, needle))

    def after(low: Column, position: Column) -> Column:
        return F.call_function("locate", F.lit(needle), low, position + 1)

    # Each step looks behind the hit before, so the text is read once up to the last hit.
    def search(low: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(2), F.lit(limit)) if limit > 1 else F.array().cast("array<int>"),
            F.array(after(low, F.lit(0))),
            lambda found, _: F.when(F.element_at(found, -1) == 0, found).otherwise(
                F.concat(found, F.array(after(low, F.element_at(found, -1))))
            ),
        )

    hits = F.filter(let(F.lower(text), search), lambda p: p > 0)
    return F.transform(hits, lambda p: p - 1)


def _all_positions(low: Column, needle: str) -> Column:
    """Cuts the text before every hit; sums of lengths are taken in blocks, so many hits stay cheap."""
    block = 1024
    lengths = F.transform(F.split(low, rf"(?=\Q{needle}\E)"), lambda p: F.length(p))

    def summed(parts: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / block).cast("int")),
            lambda b: F.slice(parts, b * block + 1, block),
        )
        firsts = _starts(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n)))
        return F.flatten(F.zip_with(blocks, firsts, lambda b, first: F.transform(_starts(b), lambda x: x + first)))

    # The first piece starts at 0, which is a hit only if the text starts with the needle.
    found = let(lengths, summed)
    return F.when(F.startswith(low, F.lit(needle)), found).otherwise(F.slice(found, 2, F.size(found)))


def chunks_by_header(text: Column, size: int = 8000, first_title: str = "Introduction") -> Column:
    """Array of ``(title, content)``: the text cut before short header lines.

    A section without its own header keeps the title of the section before it. Content longer
    than ``size`` is cut into numbered parts, line by line and at white space; a longer run
    without white space is cut at ``size``.
    """
    sections = F.split(text, r"\n\s*\n(?=[A-Z0-9][^.!?]{0,100}(?:\n|$))")

    def titled(section: Column) -> Column:
        first = F.substring_index(section, "\n", 1)
        has_title = (F.length(first) < 100) & (F.length(first) > 3)
        rest = trimmed(F.substr(section, F.length(first) + 2))
        return F.struct(
            F.when(has_title, trimmed(first)).alias("title"),
            F.when(has_title, rest).otherwise(section).alias("content"),
        )

    start = F.struct(
        F.lit(first_title).alias("title"),
        F.array().cast("array<struct<title:string,content:string>>").alias("out"),
    )

    def add(state: Column, s: Column) -> Column:
        title = F.coalesce(s["title"], state["title"])
        piece = F.array(F.struct(title.alias("title"), s["content"].alias("content")))
        return F.struct(title.alias("title"), F.concat(state["out"], piece).alias("out"))

    carried = F.aggregate(F.transform(sections, titled), start, add, lambda s: s["out"])

    def split_long(c: Column) -> Column:
        parts = F.regexp_extract_all(
            c["content"], F.lit(rf".{{1,{size}}}(?:\s|$)|.{{1,{size}}}"), F.lit(0)
        )
        numbered = F.transform(
            parts,
            lambda p, i: F.struct(
                F.concat(c["title"], F.lit(" (Part "), (i + 1).cast("string"), F.lit(")")).alias(
                    "title"
                ),
                trimmed(p).alias("content"),
            ),
        )
        whole = F.array(F.struct(c["title"].alias("title"), c["content"].alias("content")))
        return F.when(F.length(c["content"]) > size, numbered).otherwise(whole)

    return F.flatten(F.transform(carried, split_long))


# Heading shapes in the order they are tried, with the level each one gives.
HEADING_WORDS = (
    "What|How|Why|When|Who|Your|Our|The|Data|Information|Privacy|Cookie|Security|Contact|Changes|"
    "Rights|Third|Collection|Use|Sharing|Retention|Children|International|Updates?|Notice|Policy"
)
HEADING_MARKDOWN = r"^#+\s+(.+)$"
HEADING_CAPS = r"^([A-Z][A-Z\s]{3,}[A-Z])$"
HEADING_NUMBERED = r"^(\d+\.?\s+[A-Z][^.]+)$"
HEADING_TITLE = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*):?$"
HEADING_LEAD = rf"(?i)^({HEADING_WORDS}).+$"


def sections(text: Column, limit: int | None = None) -> Column:
    """Array of ``(pos, title, level)`` headings, only the first ``limit`` if given."""

    def heading(t: Column, i: Column, lines: Column) -> Column:
        follower = F.get(lines, i + 1)
        usable = (F.length(t) >= 3) & (F.length(t) <= 100)
        short = (
            (F.length(t) < 60)
            & (F.length(follower) > F.length(t) * 2)
            & F.rlike(t, F.lit("^[A-Z]"))
            & ~F.rlike(t, F.lit(r"[.!?]$"))
        )
        is_md = F.rlike(t, F.lit(HEADING_MARKDOWN))
        level = (
            F.when(is_md, F.least(F.length(F.regexp_extract(t, "^(#+)", 1)), F.lit(2)))
            .when(F.rlike(t, F.lit(HEADING_CAPS)), 1)
            .when(F.rlike(t, F.lit(HEADING_NUMBERED)), 1)
            .when(F.rlike(t, F.lit(HEADING_TITLE)), 2)
            .when(F.rlike(t, F.lit(HEADING_LEAD)), 2)
            .when(F.coalesce(short, F.lit(False)), 2)
        )
        # A lead-word heading is named by its lead word: that is what its pattern captures.
        title = (
            F.when(is_md, F.regexp_extract(t, HEADING_MARKDOWN, 1))
            .when(
                F.rlike(t, F.lit(HEADING_CAPS))
                | F.rlike(t, F.lit(HEADING_NUMBERED))
                | F.rlike(t, F.lit(HEADING_TITLE)),
                F.regexp_replace(t, ":$", ""),
            )
            .when(F.rlike(t, F.lit(HEADING_LEAD)), F.regexp_extract(t, HEADING_LEAD, 1))
            .otherwise(t)
        )
        clean = trimmed(F.regexp_replace(F.regexp_replace(title, r"^#+\s*", ""), ":$", ""))
        return F.when(
            usable & level.isNotNull(),
            F.struct(i.alias("pos"), clean.alias("title"), level.cast("int").alias("level")),
        )

    def headings(lines: Column) -> Column:
        return F.transform(lines, lambda t, i: heading(t, i, lines))

    lines = F.transform(F.split(text, "\n"), trimmed)
    found = F.filter(let(lines, headings), lambda h: h.isNotNull())
    paragraphs = F.split(text, r"\n\n+")

    def fallback(p: Column, i: Column) -> Column:
        first = F.substring_index(trimmed(p), "\n", 1)
        return F.when(
            (i % 5 == 0) & (F.length(trimmed(p)) > 0) & (F.length(first) < 80),
            F.struct(
                i.alias("pos"),
                F.when(F.length(first) > 50, F.concat(F.substring(first, 1, 50), F.lit("...")))
                .otherwise(first)
                .alias("title"),
                F.lit(2).alias("level"),
            ),
        )

    extra = F.filter(F.transform(paragraphs, fallback), lambda h: h.isNotNull())
    every = let(found, lambda f: F.when(F.size(f) < 3, F.concat(f, extra)).otherwise(f))
    return every if limit is None else F.slice(every, 1, limit)


def paragraphs(text: Column, separator: str = r"\n\n+") -> Column:
    """Non-blank paragraphs, untrimmed, in order."""
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), separator), lambda p: F.length(trimmed(p)) > 0
    )


def truncated(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


# Characters kept per consumer of a text.
TEXT_LIMITS = {
    "stored_version": 500_000,
    "analysis_prompt": 100_000,
    "changelog_side": 50_000,
    "claim_check": 25_000,
    "short_prompt": 15_000,
}
