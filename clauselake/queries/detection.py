"""Text queries: hashes, page text, sections, detection and content checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.functions import terms as tm
from clauselake.functions import text as tx
from clauselake.operators import detection as de
from clauselake.queries.base import (
    HASH,
    HASH_NORM,
    V_ANALYSES,
    WORDS,
    any_found,
    found,
    found_count,
    match_sum,
    matches,
    q,
    query,
    sql_list,
    trim_sql,
    with_views,
)
from clauselake.values import text_terms as V

# Words that occur in the given texts, in the shapes of the real lists.
LEXICON = {
    "en": {"privacy": "the ", "policy": "that", "terms": "with", "legal": "data"},
    "de": {"privacy": "der ", "policy": "und ", "terms": "nicht"},
    "fr": {"privacy": " le", "policy": "que", "terms": "dans", "legal": "que"},
    "es": {"privacy": "para", "policy": "los", "terms": "una "},
}
WORDLIST = list(dict.fromkeys(w for ws in LEXICON.values() for w in ws.values()))
TOPICS = {
    "en": ("of the", "and", "tion", "data", "er, the"),
    "de": ("der", "sch", "ung", "Und", "data"),
    "fr": ("eau", "ment", "tion"),
}
STRONG = ("the", "und", "que", "data", "with", "ción", "lich", "tion", "para", "dans", "für")
PAIRS = ("of the", "in the", "de la", "und der", "el la", "le que", "the and")
CATEGORIES = {
    "core": ("the", "of", "and that", "data"),
    "legal": ("und", "der", "die", "in der"),
    "dataHandling": ("que", "le", "la", "de la", "les"),
    "structure": ("with", "this", "los", "para"),
}
TYPES = {
    "privacy_policy": ("the", "this", "and the"),
    "terms_of_service": ("der", "die", "und"),
    "cookie_policy": ("le", "la"),
}


@query(f"SELECT doc_id, {HASH} AS exact_hash, {HASH_NORM} AS normal_hash, {WORDS} AS word_count FROM documents")
def content_hashes(t):
    return t.documents.select(
        "doc_id", tx.content_hash(F.col("text")).alias("exact_hash"),
        tx.content_hash(F.col("text"), "normalized").alias("normal_hash"),
        tx.word_count(F.col("text")).alias("word_count"),
    )


@query("SELECT name, CAST(count_if(length(text) > size) AS BIGINT) AS documents_over, "
       "CAST(sum(greatest(length(text) - size, 0)) AS BIGINT) AS chars_over, "
       "CAST(sum(length(substr(text, 1, size))) AS BIGINT) AS chars_kept FROM documents, (VALUES "
       + ", ".join(f"({q(k)}, {v})" for k, v in tx.TEXT_LIMITS.items())
       + ") l(name, size) GROUP BY name")
def text_budgets(t):
    """How many texts each consumer would cut, and how much of them."""
    limits = F.array(
        *[F.struct(F.lit(k).alias("name"), F.lit(v).alias("size"),
                   F.length(tx.truncated(F.col("text"), v)).alias("kept"))
          for k, v in tx.TEXT_LIMITS.items()]
    )
    rows = t.documents.select(F.length("text").alias("n"), F.inline(limits))
    return rows.groupBy("name").agg(
        F.count_if(F.col("n") > F.col("size")).alias("documents_over"),
        F.sum(F.greatest(F.col("n") - F.col("size"), F.lit(0))).alias("chars_over"),
        F.sum("kept").alias("chars_kept"),
    )


def _drop_sql(html: str, tags, marks) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in tags:
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    if marks:
        for tag in ("div", "section", "ul", "ol", "p", "span"):
            out = (
                rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*\b(?:class|id)\s*=\s*[\"'']"
                rf"(?:[^\"'']*[\s_-])?(?:{'|'.join(marks)})(?:[\s_-][^\"'']*)?[\"''][^>]*>.*?</{tag}\s*>', ' ', 'g')"
            )
    return out


def strip_sql(html: str) -> str:
    out = rf"regexp_replace({html}, '(?i)</?(?:{'|'.join(tx.INLINE_TAGS)})\b[^>]*>', '', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, plain in tx.ENTITIES:
        out = f"replace({out}, {q(entity)}, {q(plain)})"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


ARTICLE = r"regexp_extract(kept, '(?is)<article[^>]*>(.*?)</article\s*>', 1)"
KEPT = _drop_sql("html", tx.READABLE_DROP, tx.READABLE_MARKS)
V_TEXT = rf"""v_kept AS (SELECT page_id, url, html, {KEPT} AS kept FROM pages),
v_article AS (SELECT *, {strip_sql(ARTICLE)} AS article FROM v_kept),
v_text AS (SELECT page_id, url, html, CASE WHEN length(article) > 200 THEN article
 ELSE {strip_sql("regexp_extract(kept, '(?is)<body[^>]*>(.*)', 1)")} END AS text,
 coalesce(nullif({strip_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ''), 'Privacy Policy') AS title FROM v_article)"""


@query(with_views(V_TEXT) + "SELECT page_id, title, CAST(length(text) AS INT) AS chars, md5(text) AS text_hash FROM v_text")
def page_text(t):
    return t.pages.select(
        "page_id", tx.html_title(F.col("html")).alias("title"), tx.html_text(F.col("html")).alias("x")
    ).select("page_id", "title", F.length("x").alias("chars"), F.md5("x").alias("text_hash"))


@query(rf"""SELECT page_id, CAST(length(x) AS INT) AS chars, md5(x) AS text_hash FROM (
 SELECT page_id, {strip_sql("regexp_extract(" + _drop_sql("html", tx.DIRECT_DROP, ()) + ", '(?is)<body[^>]*>(.*)', 1)")} AS x FROM pages) p""")
def page_text_direct(t):
    return t.pages.select("page_id", tx.html_text(F.col("html"), "direct").alias("x")).select(
        "page_id", F.length("x").alias("chars"), F.md5("x").alias("text_hash")
    )


@query(rf"""SELECT doc_id, CAST(length(x) AS INT) AS chars, md5(x) AS text_hash FROM (SELECT doc_id,
 {trim_sql("regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(10) || '\\s*' || chr(10), chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')".replace(chr(92) * 2, chr(92)))} AS x FROM documents) d""")
def pdf_text(t):
    return t.documents.select("doc_id", tx.pdf_text_normalise(F.col("text")).alias("x")).select(
        "doc_id", F.length("x").alias("chars"), F.md5("x").alias("text_hash")
    )


@query(rf"""SELECT doc_id, CAST(len(p) AS INT) AS hits, array_to_string(p, ',') AS positions FROM (
 SELECT doc_id, list_filter(range(0, length(text) - 1), lambda i: substr(low, i + 1, 2) = 'en') AS p
 FROM (SELECT doc_id, text, lower(text) AS low FROM documents) x) d""")
def find_all_positions(t):
    hits = tx.find_all(F.col("text"), "EN")
    return t.documents.select("doc_id", hits.alias("p")).select(
        "doc_id", F.size("p").alias("hits"), F.array_join("p", ",").alias("positions")
    )


# White-space runs before a possible header are marked; a piece that does not open with one joins the piece before.
@query(rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '(\n\s*\n)([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS pieces FROM documents),
 e AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM p),
 h AS (SELECT *, sum(CASE WHEN i = 1 OR regexp_full_match(string_split(piece, chr(10))[1], '[A-Z0-9][^.!?]{{0,100}}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM e),
 g AS (SELECT doc_id, sec, string_agg(piece, '' ORDER BY i) AS body FROM h GROUP BY 1, 2),
 s AS (SELECT doc_id, sec, CASE WHEN sec < max(sec) OVER (PARTITION BY doc_id) THEN regexp_replace(body, '\n\s*\n$', '') ELSE body END AS body FROM g),
 f AS (SELECT doc_id, sec, body, string_split(body, chr(10))[1] AS first, length(first) > 3 AND length(first) < 100 AS has FROM s),
 c AS (SELECT doc_id, sec, coalesce(last_value(CASE WHEN has THEN {trim_sql('first')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec ROWS UNBOUNDED PRECEDING), 'Introduction') AS title,
  CASE WHEN has THEN {trim_sql('substr(body, length(first) + 2)')} ELSE body END AS content FROM f),
 parts AS (SELECT doc_id, sec, title, length(content) > 800 AS long, CASE WHEN length(content) > 800 THEN regexp_extract_all(content, '.{{1,800}}(?:\s|$)|.{{1,800}}') ELSE [content] END AS x FROM c),
 o AS (SELECT doc_id, sec, title, long, unnest(x) AS content, generate_subscripts(x, 1) AS k FROM parts)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, k) - 1 AS INT) AS pos,
 CASE WHEN long THEN title || ' (Part ' || k || ')' ELSE title END AS title, CAST(length(CASE WHEN long THEN {trim_sql('content')} ELSE content END) AS INT) AS chars FROM o""")
def chunks_by_header(t):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return t.documents.select(
        "doc_id", F.posexplode(tx.chunks_by_header(spaced, 800)).alias("pos", "c")
    ).select("doc_id", "pos", "c.title", F.length("c.content").alias("chars"))


_T = "t"
_HEAD = rf"""CASE WHEN length(t) < 3 OR length(t) > 100 THEN NULL
 WHEN regexp_matches(t, {q(tx.HEADING_MARKDOWN)}) THEN least(length(regexp_extract(t, '^(#+)', 1)), 2)
 WHEN regexp_matches(t, {q(tx.HEADING_CAPS)}) THEN 1
 WHEN regexp_matches(t, {q(tx.HEADING_NUMBERED)}) THEN 1
 WHEN regexp_matches(t, {q(tx.HEADING_TITLE)}) THEN 2
 WHEN regexp_matches(t, {q(tx.HEADING_LEAD)}) THEN 2
 WHEN length(t) < 60 AND length(nx) > length(t) * 2 AND regexp_matches(t, '^[A-Z]') AND NOT regexp_matches(t, '[.!?]$') THEN 2 END"""
_TITLE = rf"""CASE WHEN regexp_matches(t, {q(tx.HEADING_MARKDOWN)}) THEN regexp_extract(t, {q(tx.HEADING_MARKDOWN)}, 1)
 WHEN regexp_matches(t, {q(tx.HEADING_CAPS)}) OR regexp_matches(t, {q(tx.HEADING_NUMBERED)}) OR regexp_matches(t, {q(tx.HEADING_TITLE)}) THEN regexp_replace(t, ':$', '')
 WHEN regexp_matches(t, {q(tx.HEADING_LEAD)}) THEN regexp_extract(t, {q(tx.HEADING_LEAD)}, 1) ELSE t END"""


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, text FROM documents),
 t1 AS (SELECT doc_id, pos, text, {trim_sql('line')} AS t FROM l),
 t2 AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM t1),
 h AS (SELECT doc_id, pos, {_HEAD} AS level, {_TITLE} AS title FROM t2),
 found AS (SELECT doc_id, pos, level, trim(regexp_replace(regexp_replace(title, '^#+\s*', ''), ':$', '')) AS title, 0 AS part FROM h WHERE level IS NOT NULL),
 few AS (SELECT d.doc_id, {trim_sql('d.text')} AS body FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY 1) f ON d.doc_id = f.doc_id WHERE coalesce(n, 0) < 3),
 extra AS (SELECT doc_id, 0 AS pos, 2 AS level, CASE WHEN length(string_split(body, chr(10))[1]) > 50 THEN substr(string_split(body, chr(10))[1], 1, 50) || '...' ELSE string_split(body, chr(10))[1] END AS title, 1 AS part
  FROM few WHERE length(body) > 0 AND length(string_split(body, chr(10))[1]) < 80),
 u AS (SELECT * FROM found UNION ALL SELECT * FROM extra),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1 AS n FROM u)
SELECT doc_id, CAST(n AS INT) AS n, CAST(pos AS INT) AS pos, title, CAST(level AS INT) AS level FROM r""")
def extract_sections(t):
    return t.documents.select(
        "doc_id", F.posexplode(tx.sections(F.col("text"))).alias("n", "s")
    ).select("doc_id", "n", "s.pos", "s.title", "s.level")


# --------------------------------------------------------------------------- detector

PLAIN = r"trim(regexp_replace(lower(text), '[^\w''-]+', ' ', 'g'))"


def _word_hits(words, step: float, extra: int) -> str:
    counted = (
        rf"list_filter(list_transform({found('w', words)}, lambda t: len(regexp_extract_all(w, '\b' || t || '\b'))), lambda n: n > 0)"
    )
    return f"(coalesce(list_sum(list_transform({counted}, lambda n: 1.0 + least(n - 1, {extra}) * {step}::DOUBLE)), 0.0) / {len(words)})"


def _detector_sql(categories, types) -> str:
    weights = de.CATEGORY_WEIGHTS
    total = sum(weights.get(c, 1.0) for c in categories)
    weighted = " + ".join(f"{c} * {weights.get(c, 1.0)}::DOUBLE" for c in categories)
    flags = " + ".join(
        f"CAST({matches('text', p)} AS INT)" for p in de.STRUCTURE_PATTERNS.values()
    )
    cats = ", ".join(f"{_word_hits(ws, 0.2, 4)} AS {c}" for c, ws in categories.items())
    kinds = ", ".join(
        f"{{'s': {_word_hits(ws, 0.3, 3)}, 'o': {-i}, 'n': {q(n)}}}" for i, (n, ws) in enumerate(types.items())
    )
    names = ", ".join(f"CASE WHEN {c} > 0 THEN {q(c)} END" for c in categories)
    return f"""WITH w AS (SELECT doc_id, lang, text, length(text) >= 500 AS usable, {PLAIN} AS w FROM documents),
 s AS (SELECT doc_id, lang, usable, {cats}, list_max([{kinds}]) AS best, {flags} AS flags FROM w),
 k AS (SELECT *, CASE WHEN best.s > 0.15 THEN best.n END AS kind, CASE WHEN best.s > 0.15 THEN least(1.0, best.s) ELSE 0.0 END AS kind_conf FROM s),
 v_detected AS (SELECT doc_id, lang, CASE WHEN usable THEN least(1.0, ({weighted}) / {total}::DOUBLE + flags * 0.05::DOUBLE + kind_conf * 0.1::DOUBLE) ELSE 0.0 END AS confidence,
  CASE WHEN usable THEN kind END AS document_type, CASE WHEN usable THEN kind_conf ELSE 0.0 END AS document_type_confidence,
  CASE WHEN usable THEN array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') ELSE '' END AS matched_categories,
  CAST(CASE WHEN usable THEN flags ELSE 0 END AS INT) AS structure_flags FROM k)
"""


_DETECTED = """SELECT doc_id, round(confidence, 6) AS confidence, confidence >= 0.6 AS is_policy, document_type,
 round(document_type_confidence, 6) AS document_type_confidence, matched_categories, structure_flags FROM v_detected"""


def _detected(t, categories=CATEGORIES, types=TYPES):
    return de.detect_policy(t.documents, categories=categories, types=types)


def _shown(df):
    return df.select(
        "doc_id", F.round("confidence", 6).alias("confidence"), "is_policy", "document_type",
        F.round("document_type_confidence", 6).alias("document_type_confidence"),
        F.array_join("matched_categories", ",").alias("matched_categories"),
        F.size("structure").alias("structure_flags"),
    )


@query(_detector_sql(CATEGORIES, TYPES) + _DETECTED)
def detect_policy(t):
    return _shown(_detected(t))


@query(_detector_sql(V.DETECTOR_TERMS, V.DOCUMENT_TYPE_TERMS) + _DETECTED)
def detect_policy_standard(t):
    """The same with the standard lists."""
    return _shown(_detected(t, V.DETECTOR_TERMS, V.DOCUMENT_TYPE_TERMS))


@query(_detector_sql(CATEGORIES, TYPES)
       + "SELECT lang, count_if(confidence >= 0.6) AS detected, count(*) AS total FROM v_detected GROUP BY lang")
def detection_summary(t):
    return de.detection_summary(_detected(t), ["lang"]).withColumn(
        "detected", F.col("detected").cast("long")
    )


@query(_detector_sql(CATEGORIES, TYPES) + """SELECT doc_id, round(CASE WHEN unsure THEN confidence * 0.6 + lc * 0.4 ELSE confidence END, 6) AS confidence,
 CASE WHEN unsure THEN confidence >= 0.6 OR legal ELSE confidence >= 0.6 END AS is_policy,
 CASE WHEN unsure AND lt <> 'not_legal' THEN lt ELSE document_type END AS document_type FROM (
 SELECT v.*, quality = 1 AS legal, CASE toxic WHEN 1 THEN 'not_legal' ELSE 'other_legal' END AS lt, 0.5 + quality * 0.3::DOUBLE AS lc,
  confidence >= 0.4 AND confidence < 0.8 AND quality IS NOT NULL AS unsure FROM v_detected v LEFT JOIN labels l ON v.doc_id = l.doc_id) x""")
def blend_external_label(t):
    labels = t.read("labels").select(
        "doc_id", (F.col("quality") == 1).alias("is_legal_document"),
        F.when(F.col("toxic") == 1, "not_legal").otherwise("other_legal").alias("label_type"),
        (F.lit(0.5) + F.col("quality") * F.lit(0.3)).alias("label_confidence"),
    )
    out = de.blend_external_label(_detected(t), labels, "doc_id")
    return out.select("doc_id", F.round("confidence", 6).alias("confidence"), "is_policy",
                      "document_type")


# --------------------------------------------------------------------------- content checks


def _hits(word: str) -> str:
    return rf"len(regexp_extract_all(low, '\Q' || {q(word)} || '\E'))"


def _signals_sql() -> str:
    langs = ", ".join(
        f"{{'h': {' + '.join(_hits(w) for w in ws.values())}, 'o': {-i}, 'l': {q(lang)}}}"
        for i, (lang, ws) in enumerate(LEXICON.items())
    )
    own = " ".join(f"WHEN {q(k)} THEN {sql_list(v)}" for k, v in TOPICS.items())
    return f"""WITH b AS (SELECT doc_id, text, lower(text) AS low FROM documents),
 g AS (SELECT *, list_max([{langs}]) AS best, {' + '.join(_hits(w) for w in WORDLIST)} AS keyword_count, {found_count('low', WORDLIST)} AS terms_found,
  {match_sum('text', V.POSITIVE_PATTERNS)} AS positive, {match_sum('text', V.NEGATIVE_PATTERNS)} AS negative,
  {found_count('low', STRONG)} AS strong_keywords, {found_count('low', PAIRS)} AS strong_pairs, CAST(length(text) AS INT) AS characters, {WORDS} AS words FROM b),
 h AS (SELECT *, CASE WHEN best.h > 0 THEN best.l END AS language FROM g),
 v_signals AS (SELECT *, list_filter(list_distinct(list_concat(CASE coalesce(language, 'en') {own} ELSE {sql_list(TOPICS['en'])} END, {sql_list(TOPICS['en'])})), lambda t: contains(low, lower(t))) AS topics FROM h)
"""


def _signals(t):
    return de.content_signals(t.documents, "text", LEXICON, TOPICS, STRONG, PAIRS)


@query(_signals_sql() + "SELECT doc_id, language FROM v_signals")
def detect_language(t):
    return de.detect_language(t.documents, "text", LEXICON).select("doc_id", "language")


@query(_signals_sql() + """SELECT doc_id, CAST(keyword_count AS INT) AS keyword_count, terms_found, CAST(len(topics) AS INT) AS topics,
 strong_keywords, strong_pairs, CAST(positive AS INT) AS positive, CAST(negative AS INT) AS negative, characters, words FROM v_signals""")
def content_signals(t):
    return _signals(t).select(
        "doc_id", "keyword_count", F.size("privacy_terms").alias("terms_found"),
        F.size("topics").alias("topics"), "strong_keywords", "strong_pairs", "positive", "negative",
        "characters", "words",
    )


def _validated_sql(cap: bool) -> str:
    bonus = "strong_keywords * 2 + strong_pairs * 5"
    bonus = f"least(30, {bonus})" if cap else f"({bonus})"
    return _signals_sql() + f"""SELECT doc_id, content_confidence, characters >= 500 AND (keyword_count >= 3 OR strong_keywords >= 5) AND (nt >= 2 OR strong_pairs >= 3)
  AND negative <= positive + 2 AND content_confidence >= 40 AS content_valid,
 CAST((characters < 500)::INT + (words < 100)::INT + (keyword_count < 3)::INT + (nt < 2)::INT + (negative > positive)::INT AS INT) AS issues FROM (
 SELECT *, CAST(greatest(0, least(100, 40 + CASE WHEN characters >= 2000 THEN 10 ELSE 0 END + CASE WHEN characters >= 5000 THEN 10 ELSE 0 END
  + CASE WHEN characters >= 10000 THEN 5 ELSE 0 END - CASE WHEN characters < 500 THEN 30 ELSE 0 END + CASE WHEN keyword_count >= 10 THEN 10 ELSE 0 END
  + CASE WHEN keyword_count >= 20 THEN 5 ELSE 0 END + {bonus} + CASE WHEN nt >= 5 THEN 10 ELSE 0 END + CASE WHEN nt >= 10 THEN 10 ELSE 0 END
  + positive * 3 - negative * 5)) AS INT) AS content_confidence FROM (SELECT *, len(topics) AS nt FROM v_signals) s) c"""


def _validity(df):
    return df.select("doc_id", "content_confidence", "content_valid",
                     F.size("content_issues").alias("issues"))


@query(_validated_sql(False))
def validate_content(t):
    return _validity(de.validate_content(_signals(t)))


@query(_validated_sql(True))
def validate_content_capped(t):
    return _validity(de.validate_content(_signals(t), cap_bonus=True))


REJECT_WORDS = ("the ", "der ", "leaux")


@query(f"""SELECT doc_id, CASE WHEN length(text) < 200 THEN 'Content too short'
 WHEN contains(low, 'linkedin') AND (contains(low, 'followers') OR contains(low, 'employees on linkedin')) THEN 'Appears to be a LinkedIn profile'
 WHEN contains(low, 'facebook') AND (contains(low, 'likes') OR contains(low, 'people like this')) THEN 'Appears to be a Facebook page'
 WHEN regexp_matches(text, '(?i)\\d+\\s+min\\s+read') OR regexp_matches(text, '(?i)published\\s+\\d+\\s+(hours?|days?|weeks?)\\s+ago') THEN 'Appears to be a news article'
 WHEN contains(low, 'company size') AND contains(low, 'industry') AND contains(low, 'headquarters') THEN 'Appears to be a company directory listing'
 WHEN NOT {any_found('low', REJECT_WORDS)} THEN 'No privacy-related terms found' END AS reason FROM (SELECT *, lower(text) AS low FROM documents) d""")
def quick_reject(t):
    return t.documents.select("doc_id", de.quick_reject(F.col("text"), REJECT_WORDS).alias("reason"))


GARBAGE = ("le", "die ")
PLAIN_WORDS = ("privacy", "data", "personal information", "collect", "share", "cookies", "rights",
               "contact us", "policy", "terms")


@query(f"""SELECT doc_id, length(text) < 1000 AND {any_found('lower(text)', GARBAGE)} AS garbage,
 length(text) >= 500 AND {found_count('lower(text)', PLAIN_WORDS)} >= 3 AS plain_policy FROM documents""")
def garbage_texts(t):
    return t.documents.select(
        "doc_id", de.is_garbage(F.col("text"), GARBAGE).alias("garbage"),
        de.is_plain_policy(F.col("text")).alias("plain_policy"),
    )


LOGIN = ("track(1", "cheap", "<b>the", "sign in")


@query(f"""SELECT page_id, {found_count('lower(html)', LOGIN)} >= 1 AS any_marker, {found_count('lower(html)', LOGIN)} >= 2 AS two_markers,
 {found_count('substr(lower(html), 1, 5000)', LOGIN)} >= 1 AS in_head FROM pages""")
def login_pages(t):
    """``in_head`` is the reading that looks at the head of a fetched page only."""
    html = F.col("html")
    return t.pages.select(
        "page_id", de.is_login_page(html, LOGIN).alias("any_marker"),
        de.is_login_page(html, LOGIN, 2).alias("two_markers"),
        de.is_login_page(html, LOGIN, 1, 5000).alias("in_head"),
    )


EVIDENCE = ("und der", "of the", "de la", "que le")


@query(f"""SELECT doc_id, strong, structural, strong >= 2 OR structural >= 3 OR (strong >= 1 AND structural >= 1) AS is_policy FROM (
 SELECT doc_id, {found_count('lower(text)', EVIDENCE)} AS strong, CAST({match_sum('lower(text)', V.EVIDENCE_PATTERNS)} AS INT) AS structural FROM documents) d""")
def page_evidence(t):
    return t.documents.select(
        "doc_id", de.page_evidence(F.col("text"), EVIDENCE).alias("e")
    ).select("doc_id", "e.strong", "e.structural", "e.is_policy")


GATE = ("und", "tion")


@query(with_views(V_TEXT) + f"""SELECT page_id, CASE
 WHEN length(text) < CASE WHEN {any_found('lower(url)', de.PRIVACY_PATH_MARKS + ('/privacidad',))} THEN 100 ELSE 200 END THEN 'insufficient text extracted'
 WHEN NOT ({any_found('lower(text)', GATE)} OR {any_found('lower(url)', ('privacy', 'datenschutz', 'confidentialite', 'privacidad'))}) THEN 'no privacy-related text found'
 WHEN length(text) < CASE WHEN {any_found('lower(url)', de.PRIVACY_PATH_MARKS)} THEN 100 ELSE 300 END THEN 'content is too short' END AS reject_reason FROM v_text""")
def extraction_gate(t):
    texts = t.pages.select("page_id", "url", tx.html_text(F.col("html")).alias("text"))
    return de.extraction_gate(texts, terms=GATE).select("page_id", "reject_reason")


ACTUAL = ("the", "of", "and", "der", "die", "und", "le", "la", "que", "les", "para", "los")
HUB = ("cheap", "thaned", "nicht")


@query(f"SELECT doc_id, {found_count('lower(text)', ACTUAL)} >= 5 AS actual_policy, {any_found('lower(text)', HUB)} AS hub_page FROM documents")
def policy_or_hub(t):
    return t.documents.select(
        "doc_id", de.is_actual_policy(F.col("text"), ACTUAL).alias("actual_policy"),
        de.is_hub_page(F.col("text"), HUB).alias("hub_page"),
    )


BY_TYPE = {"en": ("thaned", "wh the"), "de": ("aulich", "für der"), "fr": ("eaux le", "çon"),
           "es": ("ción la", "para de")}
CLASSES = (("the", "of", "and", "that"), ("der", "und", "die", "sch"))


@query(f"""SELECT doc_id, length(text) >= 1000 AND CASE lang {' '.join(f"WHEN {q(k)} THEN {any_found('lower(text)', v)}" for k, v in BY_TYPE.items())} ELSE false END AS fits_type,
 CASE WHEN {found_count('lower(text)', CLASSES[0])} > 2 THEN 'privacy' WHEN {found_count('lower(text)', CLASSES[1])} > 2 THEN 'terms' ELSE 'other' END AS class FROM documents""")
def type_checks(t):
    return t.documents.select(
        "doc_id", de.matches_type(F.col("text"), F.col("lang"), BY_TYPE).alias("fits_type"),
        de.classify_text(F.col("text"), *CLASSES).alias("class"),
    )


@query(with_views(V_ANALYSES) + """, f AS (SELECT id, unnest(key_findings) AS x FROM v_analyses), items AS (SELECT id, x.category AS category, x.text AS claim FROM f),
 verified AS (SELECT DISTINCT id, claim FROM items WHERE id % 3 <> 0)
SELECT id, category, claim FROM items WHERE category NOT IN ('THREAT', 'CONCERNING') OR EXISTS (SELECT 1 FROM verified v WHERE v.id = items.id AND v.claim = items.claim)""")
def keep_verified_claims(t):
    items = t.analyses.select("id", F.inline("key_findings")).withColumnRenamed("text", "claim")
    verified = items.where("id % 3 <> 0").select("id", "claim")
    return de.keep_verified(
        items, verified, ["id"], "claim", F.col("category").isin("THREAT", "CONCERNING")
    )


# A word list made by rule, long enough for the index: all words of three of these syllables.
SYLLABLES = ("th", "en", "er", "ou", "in", "an", "on", "re", "es", "ti")
MANY_TERMS = [a + b + c for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES]


@query(f"""SELECT doc_id, len(f) AS terms_found, array_to_string(f, ' ') AS terms, CAST(coalesce(list_sum(list_transform(f, lambda t:
 (length(x) - length(replace(x, t, ''))) // length(t))), 0) AS INT) AS occurrences FROM (
 SELECT doc_id, x, list_filter([{', '.join(map(q, MANY_TERMS))}], lambda t: contains(x, t)) AS f FROM (SELECT doc_id, lower(text) AS x FROM documents) a) b""")
def many_terms(t):
    """A long word list over whole texts, by the index of letters."""
    low = F.lower("text")
    return t.documents.select("doc_id", tm.occurrence_map(low, MANY_TERMS).alias("found")).select(
        "doc_id", F.size("found").alias("terms_found"), F.array_join(F.map_keys("found"), " ").alias("terms"),
        F.aggregate(F.map_values("found"), F.lit(0), lambda a, n: a + n).alias("occurrences"))


@query(_signals_sql() + """SELECT doc_id, array_to_string(list_filter([
 CASE WHEN characters < 500 THEN 'Content too short (' || characters || ' chars, need 500)' END,
 CASE WHEN words < 100 THEN 'Not enough words (' || words || ', need 100)' END,
 CASE WHEN keyword_count < 3 THEN 'Not enough privacy keywords (' || keyword_count || ', need 3)' END,
 CASE WHEN len(topics) < 2 THEN 'Not enough privacy topics covered (' || len(topics) || ', need 2)' END,
 CASE WHEN negative > positive THEN 'More negative indicators (' || negative || ') than positive (' || positive || ') - may not be a privacy policy' END],
 lambda s: s IS NOT NULL), ' | ') AS issues FROM v_signals""")
def content_issue_texts(t):
    """What the content check says, word by word."""
    return de.validate_content(_signals(t)).select("doc_id", F.array_join("content_issues", " | ").alias("issues"))
