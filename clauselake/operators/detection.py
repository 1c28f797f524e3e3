"""Policy detection and content validation over whole documents.

All rules are expressions on one row: a scan, one stage, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import terms as tm
from clauselake.functions import text as tx
from clauselake.functions.urls import PRIVACY_PATH_MARKS, all_terms
from clauselake.operators.keyed import small_side
from clauselake.operators.staging import computed
from clauselake.values import text_terms as V

# Category weights, thresholds and structure patterns of the detector.
CATEGORY_WEIGHTS = {
    "core": 3.0, "legal": 2.5, "dataHandling": 1.5, "rights": 1.5, "thirdParty": 1.2,
    "security": 1.2, "cookies": 1.2, "structure": 0.8,
}
MIN_DETECT_LENGTH = 500
POLICY_THRESHOLD = 0.6
STRUCTURE_PATTERNS = {
    "numbered_sections": r"(?i)\b(?:section|article|clause)\s*\d+",
    "definitions_section": r'(?i)\b(?:"[^"]+"\s+(?:means|refers to|shall mean)|definitions?:)',
    "date_reference": r"(?i)(?:effective|last\s+(?:updated|modified|revised))[:\s]+\d",
    "legal_boilerplate": r"(?i)to the (?:fullest|maximum) extent (?:permitted|allowed) by law",
    "contact_section":
        r"(?i)(?:contact\s+us|how\s+to\s+contact|questions?\s+(?:about|regarding)|reach\s+us)",
    "table_of_contents": r"(?i)(?:table\s+of\s+contents|contents:|index:)",
    "change_notification":
        r"(?i)we\s+(?:may|will|reserve\s+the\s+right\s+to)\s+(?:update|modify|change|revise)"
        r"\s+this",
}
# Limits of the content check.
MIN_LENGTH = 500
MIN_WORDS = 100
MIN_KEYWORDS = 3
MIN_TOPICS = 2


def structure_flags(text: Column, low: Column | None = None) -> Column:
    """Names of the structure patterns found, in list order."""
    return F.array_compact(
        F.array(
            *[
                F.when(tm.pattern_found(text, p, low), F.lit(n))
                for n, p in STRUCTURE_PATTERNS.items()
            ]
        )
    )


def document_type(words: Column | None,
                  types: Mapping[str, Sequence[str]] = V.DOCUMENT_TYPE_TERMS,
                  counts: Mapping[str, Column] | None = None) -> Column:
    """Best type above 0.15 and its confidence; ``words`` comes from ``plain_words``.

    Equal scores go to the type listed first. ``counts`` by type are taken instead of ``words`` where
    the caller has them.
    """

    def hits(name: str, terms: Sequence[str]) -> Column:
        return tm.word_hits(words, terms, 0.3, 3) if counts is None else tm.hits_of(counts[name], 0.3, 3)

    scores = F.array(
        *[
            F.struct(
                (hits(name, terms) / F.lit(float(len(terms)))).alias("score"),
                F.lit(-i).alias("order"),
                F.lit(name).alias("name"),
            )
            for i, (name, terms) in enumerate(types.items())
        ]
    )
    best = F.array_max(scores)
    enough = best["score"] > 0.15
    return F.struct(
        F.when(enough, best["name"]).alias("type"),
        F.when(enough, F.least(F.lit(1.0), best["score"])).otherwise(0.0).alias("confidence"),
    )


def detect_policy(docs: DataFrame, text: str = "text",
                  categories: Mapping[str, Sequence[str]] = V.DETECTOR_TERMS,
                  types: Mapping[str, Sequence[str]] = V.DOCUMENT_TYPE_TERMS,
                  weights: Mapping[str, float] = CATEGORY_WEIGHTS,
                  threshold: float = POLICY_THRESHOLD) -> DataFrame:
    """Add the detector's verdict to every document.

    Columns added: ``confidence, is_policy, document_type, document_type_confidence,
    matched_categories, structure``. Texts under 500 characters get confidence 0. Each projection
    below reads columns of the one before, so a text is cleaned once.
    """
    plain = F.when(tx.looks_like_html(F.col(text)), tx.html_text(F.col(text), "corpus")).otherwise(
        F.col(text)
    )
    read = computed(docs, _plain=plain)
    long_enough = F.length("_plain") >= MIN_DETECT_LENGTH
    lowered = computed(read, _low=F.when(long_enough, F.lower("_plain")))
    cleaned = computed(
        lowered,
        _words=tx.plain_words(F.col("_low"), lowered=True),
        _flags=F.when(long_enough, structure_flags(F.col("_plain"), F.col("_low"))),
    )
    # The words of all lists are counted in one pass; each list has its run of the counts.
    lists = [*categories.values(), *types.values()]
    every = [t for terms in lists for t in terms]
    counted = cleaned.drop("_low").withColumn("_counts", tm.word_counts(F.col("_words"), every))
    ends = list(accumulate(map(len, lists), initial=0))
    own = [F.slice("_counts", a + 1, b - a) for a, b in zip(ends, ends[1:])]
    scored = computed(
        counted,
        _scores=F.array(
            *[
                tm.hits_of(counts, 0.2, 4) / F.lit(float(len(terms)))
                for counts, terms in zip(own, categories.values())
            ]
        ),
        _type=document_type(None, types, dict(zip(types, own[len(categories):]))),
    )
    total = sum(weights.get(c, 1.0) for c in categories)
    weighted = F.lit(0.0)
    for i, c in enumerate(categories):
        weighted = weighted + F.col("_scores")[i] * F.lit(float(weights.get(c, 1.0)))
    final = F.least(
        F.lit(1.0),
        weighted / F.lit(total)
        + F.size("_flags") * F.lit(0.05)
        + F.col("_type.confidence") * F.lit(0.1),
    )
    names = F.array(
        *[F.when(F.col("_scores")[i] > 0, F.lit(c)) for i, c in enumerate(categories)]
    )
    usable = F.col("_words").isNotNull()
    return (
        scored.withColumn("confidence", F.when(usable, final).otherwise(0.0))
        .withColumn("is_policy", F.col("confidence") >= threshold)
        .withColumn("document_type", F.when(usable, F.col("_type.type")))
        .withColumn(
            "document_type_confidence", F.when(usable, F.col("_type.confidence")).otherwise(0.0)
        )
        .withColumn(
            "matched_categories",
            F.when(usable, F.array_compact(names)).otherwise(F.array().cast("array<string>")),
        )
        .withColumn(
            "structure", F.coalesce(F.col("_flags"), F.array().cast("array<string>"))
        )
        .drop("_plain", "_words", "_counts", "_scores", "_type", "_flags")
    )


def blend_external_label(detected: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Mix in an external verdict where the detector is unsure (0.4 up to 0.8).

    ``labels`` holds ``key, is_legal_document, label_type, label_confidence``, one row per key.
    """
    joined = detected.join(small_side(labels), key, "left")
    unsure = (
        (F.col("confidence") >= 0.4)
        & (F.col("confidence") < 0.8)
        & F.col("label_confidence").isNotNull()
    )
    return (
        joined.withColumn("_unsure", F.coalesce(unsure, F.lit(False)))
        .withColumn(
            "is_policy",
            F.when(F.col("_unsure"), F.col("is_policy") | F.coalesce("is_legal_document", F.lit(False)))
            .otherwise(F.col("is_policy")),
        )
        .withColumn(
            "confidence",
            F.when(
                F.col("_unsure"), F.col("confidence") * 0.6 + F.col("label_confidence") * 0.4
            ).otherwise(F.col("confidence")),
        )
        .withColumn(
            "document_type",
            F.when(F.col("_unsure") & (F.col("label_type") != "not_legal"), F.col("label_type"))
            .otherwise(F.col("document_type")),
        )
        .drop("_unsure", "is_legal_document", "label_type", "label_confidence")
    )


def detection_summary(detected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Documents found to be policies and documents in all."""
    return detected.groupBy(*by).agg(
        F.count_if("is_policy").alias("detected"), F.count(F.lit(1)).alias("total")
    )


# --------------------------------------------------------------------------- content checks


def best_language(counts: Column, lexicon: Mapping[str, Mapping[str, str]]) -> Column:
    """Language with most hits in an ``occurrence_map``; ties go to the first listed."""
    scores = F.array(
        *[
            F.struct(
                tm.occurrences_in(counts, list(words.values())).alias("hits"),
                F.lit(-i).alias("order"),
                F.lit(lang).alias("lang"),
            )
            for i, (lang, words) in enumerate(lexicon.items())
        ]
    )
    best = F.array_max(scores)
    return F.when(best["hits"] > 0, best["lang"])


def detect_language(docs: DataFrame, text: str = "text",
                    lexicon: Mapping[str, Mapping[str, str]] = V.PRIVACY_TERMS) -> DataFrame:
    """Add ``language`` by privacy-word hits, null without a hit.

    A language scores every occurrence of its words; a word it lists twice counts twice.
    """
    counted = computed(docs, _counts=tm.occurrence_map(F.lower(text), all_terms(lexicon)))
    return computed(counted, language=best_language(F.col("_counts"), lexicon)).drop("_counts")


def topics_found(low: Column, language: Column,
                 topics: Mapping[str, Sequence[str]] = V.REQUIRED_TOPICS) -> Column:
    """Topics of the language (English when it has none) and of English, each once."""
    per_language = F.create_map(
        *[x for lang, ts in topics.items() for x in (F.lit(lang), tm.literal_array(ts))]
    )
    own = F.coalesce(
        F.try_element_at(per_language, F.coalesce(language, F.lit("en"))),
        tm.literal_array(topics["en"]),
    )
    wanted = F.array_union(own, tm.literal_array(topics["en"]))
    return F.filter(wanted, lambda t: F.contains(low, F.lower(t)))


def content_signals(docs: DataFrame, text: str = "text",
                    lexicon: Mapping[str, Mapping[str, str]] = V.PRIVACY_TERMS,
                    topics: Mapping[str, Sequence[str]] = V.REQUIRED_TOPICS,
                    keywords: Sequence[str] = V.HIGH_CONFIDENCE_TERMS,
                    pairs: Sequence[str] = V.POLICY_BIGRAMS,
                    positive: Sequence[str] = V.POSITIVE_PATTERNS,
                    negative: Sequence[str] = V.NEGATIVE_PATTERNS) -> DataFrame:
    """Add the measures the content check is made of."""
    low = F.col("_low")
    lowered = computed(docs, _low=F.lower(text))
    counted = computed(
        lowered,
        _counts=tm.occurrence_map(low, all_terms(lexicon)),
        strong_keywords=tm.terms_found_count(low, [k.lower() for k in keywords]),
        strong_pairs=tm.terms_found_count(low, [p.lower() for p in pairs]),
        positive=tm.patterns_matched(F.col(text), positive, low),
        negative=tm.patterns_matched(F.col(text), negative, low),
        characters=F.length(text),
        words=tx.word_count(F.col(text)),
    )
    named = computed(counted, language=best_language(F.col("_counts"), lexicon))
    return computed(
        named,
        privacy_terms=F.map_keys("_counts"),
        keyword_count=F.aggregate(
            F.map_values("_counts"), F.lit(0), lambda total, n: total + n
        ),
        topics=topics_found(low, F.col("language"), topics),
    ).drop("_low", "_counts")


def validate_content(signals: DataFrame, cap_bonus: bool = False) -> DataFrame:
    """Add ``content_confidence, content_valid, content_issues`` to ``content_signals`` rows.

    ``cap_bonus`` limits the bonus for strong keywords and pairs to 30.
    """
    chars, n_words = F.col("characters"), F.col("words")
    keywords, n_topics = F.col("keyword_count"), F.size("topics")
    strong, pairs = F.col("strong_keywords"), F.col("strong_pairs")
    positive, negative = F.col("positive"), F.col("negative")
    bonus = strong * 2 + pairs * 5
    if cap_bonus:
        bonus = F.least(F.lit(30), bonus)
    score = (
        F.lit(40)
        + tm.flag(chars >= 2000) * 10
        + tm.flag(chars >= 5000) * 10
        + tm.flag(chars >= 10000) * 5
        - tm.flag(chars < 500) * 30
        + tm.flag(keywords >= 10) * 10
        + tm.flag(keywords >= 20) * 5
        + bonus
        + tm.flag(n_topics >= 5) * 10
        + tm.flag(n_topics >= 10) * 10
        + positive * 3
        - negative * 5
    )

    def say(condition: Column, *parts) -> Column:
        return F.when(
            condition,
            F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]),
        )

    issues = F.array_compact(
        F.array(
            say(chars < MIN_LENGTH, "Content too short (", chars, f" chars, need {MIN_LENGTH})"),
            say(n_words < MIN_WORDS, "Not enough words (", n_words, f", need {MIN_WORDS})"),
            say(keywords < MIN_KEYWORDS, "Not enough privacy keywords (", keywords,
                f", need {MIN_KEYWORDS})"),
            say(n_topics < MIN_TOPICS, "Not enough privacy topics covered (", n_topics,
                f", need {MIN_TOPICS})"),
            say(negative > positive, "More negative indicators (", negative,
                ") than positive (", positive, ") - may not be a privacy policy"),
        )
    )
    out = computed(signals, content_confidence=tm.clamp(score, 0, 100))
    return out.withColumn(
        "content_valid",
        (chars >= MIN_LENGTH)
        & ((keywords >= MIN_KEYWORDS) | (strong >= 5))
        & ((n_topics >= MIN_TOPICS) | (pairs >= 3))
        & (negative <= positive + 2)
        & (F.col("content_confidence") >= 40),
    ).withColumn("content_issues", issues)


def quick_reject(text: Column, terms: Sequence[str] | None = None) -> Column:
    """Reason a text is certainly no policy, or null; the first rule that fits."""
    low = F.lower(text)
    words = all_terms() if terms is None else [t.lower() for t in terms]

    def has(t: str) -> Column:
        return F.contains(low, F.lit(t))

    news = F.rlike(text, F.lit(r"(?i)\d+\s+min\s+read")) | F.rlike(
        text, F.lit(r"(?i)published\s+\d+\s+(hours?|days?|weeks?)\s+ago")
    )
    return (
        F.when(F.length(text) < 200, "Content too short")
        .when(
            has("linkedin") & (has("followers") | has("employees on linkedin")),
            "Appears to be a LinkedIn profile",
        )
        .when(
            has("facebook") & (has("likes") | has("people like this")),
            "Appears to be a Facebook page",
        )
        .when(news, "Appears to be a news article")
        .when(
            has("company size") & has("industry") & has("headquarters"),
            "Appears to be a company directory listing",
        )
        .when(~tm.any_term(low, words), "No privacy-related terms found")
    )


def is_garbage(text: Column, phrases: Sequence[str] = V.GARBAGE_PHRASES) -> Column:
    """A text under 1 000 characters that holds an error-page phrase."""
    return (F.length(text) < 1000) & tm.any_term(F.lower(text), phrases)


def is_plain_policy(text: Column) -> Column:
    """Older content check: 500 characters and three of ten everyday words."""
    # The ten words.
    words = ("privacy", "data", "personal information", "collect", "share", "cookies", "rights",
             "contact us", "policy", "terms")
    return (F.length(text) >= 500) & (tm.terms_found_count(F.lower(text), words) >= 3)


def is_login_page(html: Column, markers: Sequence[str] = V.LOGIN_MARKERS, least: int = 1,
                  scan_chars: int | None = None) -> Column:
    """At least ``least`` login markers. ``scan_chars`` looks at the head of the page only;
    5 000 was usual for fetched pages, the default reads all of it."""
    head = html if scan_chars is None else tx.truncated(html, scan_chars)
    return tm.terms_found_count(F.lower(head), markers) >= least


def page_evidence(text: Column, terms: Sequence[str] = V.EVIDENCE_TERMS,
                  patterns: Sequence[str] = V.EVIDENCE_PATTERNS) -> Column:
    """Struct of ``strong``, ``structural`` and ``is_policy``."""
    low = F.lower(text)
    strong = tm.terms_found_count(low, terms)
    structural = tm.patterns_matched(low, patterns, low)
    return F.struct(
        strong.alias("strong"),
        structural.alias("structural"),
        ((strong >= 2) | (structural >= 3) | ((strong >= 1) & (structural >= 1))).alias(
            "is_policy"
        ),
    )


def is_actual_policy(text: Column, terms: Sequence[str] = V.ACTUAL_POLICY_TERMS,
                     least: int = 5) -> Column:
    return tm.terms_found_count(F.lower(text), terms) >= least


def is_hub_page(text: Column, terms: Sequence[str] = V.HUB_PAGE_TERMS) -> Column:
    return tm.any_term(F.lower(text), terms)


def matches_type(body: Column, policy_type: Column,
                 keywords: Mapping[str, Sequence[str]] = V.TYPE_TERMS) -> Column:
    """A body of 1 000 characters with a keyword of its policy type."""
    low = F.lower(body)
    hit = F.coalesce(
        *[F.when(policy_type == t, tm.any_term(low, words)) for t, words in keywords.items()],
        F.lit(False),
    )
    return (F.length(body) >= 1000) & hit


def matching_types(body: Column, keywords: Mapping[str, Sequence[str]] = V.TYPE_TERMS) -> Column:
    """All policy types for which ``matches_type`` holds."""
    low = F.lower(body)
    types = F.array_compact(F.array(*[F.when(tm.any_term(low, w), F.lit(t)) for t, w in keywords.items()]))
    return F.when(F.length(body) >= 1000, types).otherwise(F.array().cast("array<string>"))


def extraction_gate(pages: DataFrame, url: str = "url", text: str = "text",
                    markdown: str | None = None,
                    terms: Sequence[str] = V.GATE_TEXT_TERMS) -> DataFrame:
    """Add ``reject_reason``: why extracted text is not worth analysing, null when it is.

    Pages whose address speaks of privacy need 100 characters, others 200 of text and 300 of
    converted text.
    """
    low_url = F.lower(url)
    likely = tm.any_term(low_url, PRIVACY_PATH_MARKS)
    text_likely = tm.any_term(low_url, PRIVACY_PATH_MARKS + ("/privacidad",))
    speaks = tm.any_term(F.lower(text), terms) | tm.any_term(
        low_url, ("privacy", "datenschutz", "confidentialite", "privacidad")
    )
    final = F.col(markdown or text)
    reason = (
        F.when(
            F.length(text) < F.when(text_likely, 100).otherwise(200),
            "insufficient text extracted",
        )
        .when(~speaks, "no privacy-related text found")
        .when(F.length(final) < F.when(likely, 100).otherwise(300), "content is too short")
    )
    return computed(pages, reject_reason=reason)


def classify_text(text: Column, privacy: Sequence[str], terms: Sequence[str],
                  scan_chars: int | None = None) -> Column:
    """``privacy``, ``terms`` or ``other`` by more than two keywords; privacy is tested first."""
    low = F.lower(text if scan_chars is None else tx.truncated(text, scan_chars))
    return (
        F.when(tm.terms_found_count(low, privacy) > 2, "privacy")
        .when(tm.terms_found_count(low, terms) > 2, "terms")
        .otherwise("other")
    )


def keep_verified(items: DataFrame, verified: DataFrame, key: Sequence[str], claim: str,
                  critical: Column, checked: int | None = None,
                  order: Sequence[Column] = ()) -> DataFrame:
    """Drop critical claims that are not in the verified table; other rows stay.

    ``checked`` reproduces a checker that only ever looked at that many claims per document: a
    claim past them cannot be in the verified table and goes too.
    """
    keys = [*key, claim]
    good = verified.select(*keys).distinct()
    if checked is not None:
        from clauselake.operators.keyed import top_per_key

        seen = top_per_key(items.where(critical), list(key), list(order), checked)
        good = good.join(seen.select(*keys).distinct(), keys, "left_semi")
    kept = items.where(critical).join(good, keys, "left_semi").select(*items.columns)
    return items.where(~F.coalesce(critical, F.lit(False))).unionByName(kept)
