"""Link features, the link model and the rules around its score."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import terms as tm
from clauselake.functions import text as tx
from clauselake.functions import urls as ur
from clauselake.operators.detection import page_evidence
from clauselake.operators.keyed import spread_join
from clauselake.operators.staging import computed
from clauselake.session import durable, exists
from clauselake.values import feature_terms as V

# Feature names in model order.
FEATURE_NAMES = (
    "has_privacy_keyword", "has_terms_keyword", "has_cookie_keyword", "has_legal_keyword",
    "text_match_strength", "url_has_privacy_path", "url_has_terms_path", "url_has_legal_path",
    "url_depth", "url_length", "url_is_https", "is_in_footer", "is_in_nav", "is_in_legal_hub",
    "is_in_body", "page_has_privacy_content", "page_has_policy_structure",
    "page_has_legal_jargon", "page_word_count", "page_has_contact_info", "link_text_length",
    "link_has_icon", "link_is_external", "link_has_year",
)
PAGE_FEATURES = FEATURE_NAMES[15:20]


def _scaled(value: Column, top: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / F.lit(top)))


def _number(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def page_features(content: Column) -> Column:
    """The five content features as a struct; zeros without content.

    They are computed once per page and joined to the links of the page, not once per link.
    """
    low = F.lower(content)
    there = F.coalesce(F.length(content) > 0, F.lit(False))
    phone = F.rlike(low, F.lit(r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"))
    parts = (
        _number(there & tm.any_term(low, V.PRIVACY_WORDS)),
        _number(there & (tm.terms_found_count(low, V.STRUCTURE_WORDS) >= 3)),
        _number(there & (tm.terms_found_count(low, V.JARGON_WORDS) >= 2)),
        F.when(there, _scaled(tx.word_count(low), 5000.0)).otherwise(0.0),
        _number(
            there
            & (F.contains(low, F.lit("@")) | F.contains(low, F.lit("contact us")) | phone)
        ),
    )
    return F.struct(*[p.alias(n) for p, n in zip(parts, PAGE_FEATURES)])


def text_features(text: Column) -> Column:
    """The features of a link text as a struct."""
    words = tx.trimmed(F.lower(text))
    all_words = V.PRIVACY_WORDS + V.TERMS_WORDS + V.COOKIE_WORDS
    return F.struct(
        _number(tm.any_term(words, V.PRIVACY_WORDS)).alias("privacy"),
        _number(tm.any_term(words, V.TERMS_WORDS)).alias("terms"),
        _number(tm.any_term(words, V.COOKIE_WORDS)).alias("cookie"),
        _number(tm.any_term(words, V.LEGAL_WORDS)).alias("legal"),
        _scaled(tm.terms_found_count(words, all_words), 5.0).alias("strength"),
        _scaled(F.length(words), 50.0).alias("length"),
        tm.any_term(words, ("🔒", "🛡", "⚖")).alias("icon"),
        _number(F.rlike(words, F.lit(r"\b20[2-3]\d\b"))).alias("year"),
    )


def link_features(text: Column, href: Column, context: Column, base: Column,
                  page: Column | None = None, words: Column | None = None) -> Column:
    """Array of the 24 link features in the order of ``FEATURE_NAMES``.

    ``page`` is a struct from ``page_features``; without it the content features are 0. ``words``
    is a struct from ``text_features`` where the same text stands behind many rows.
    """
    said = text_features(text) if words is None else words
    url, base_url = F.lower(href), F.lower(base)
    full = ur.resolve_url(href, base)
    segments = F.filter(F.split(ur.url_path(full), "/"), lambda s: F.length(s) > 0)
    icon = said["icon"] | tm.any_term(href, ("shield", "lock", "secure"))
    content = (
        [F.lit(0.0)] * 5 if page is None
        else [F.coalesce(page[n], F.lit(0.0)) for n in PAGE_FEATURES]
    )
    return F.array(
        said["privacy"],
        said["terms"],
        said["cookie"],
        said["legal"],
        said["strength"],
        _number(tm.any_term(url, V.URL_WORDS[:8])),
        _number(tm.any_term(url, V.URL_WORDS[8:14])),
        _number(tm.any_term(url, ("legal", "policies"))),
        F.coalesce(_scaled(F.size(segments), 5.0), F.lit(0.0)),
        _scaled(F.length(url), 200.0),
        _number(F.startswith(url, F.lit("https")) | F.startswith(base_url, F.lit("https"))),
        _number(context == "footer"),
        _number(context == "nav"),
        _number(context == "legal_hub"),
        _number(context.isin("body", "unknown")),
        *content,
        said["length"],
        _number(icon),
        _number(ur.url_host(full) != ur.url_host(base)),
        said["year"],
    )


def url_features(url: Column, base: Column) -> Column:
    """``link_features`` of an address alone; 24 zeros when it is no address."""
    full = ur.resolve_url(url, base)
    path = F.lower(ur.url_path(full))
    return F.when(
        path.isNotNull(), link_features(path, url, F.lit("unknown"), base)
    ).otherwise(F.array_repeat(F.lit(0.0), len(FEATURE_NAMES)))


def link_features9(text: Column, href: Column, context: Column) -> Column:
    """The nine features of the older model."""
    low, url = F.lower(text), F.lower(href)
    slashes = F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))
    return F.array(
        _number(context == "footer"),
        _number(context == "nav"),
        _number(tm.any_term(low, ("privacy", "data protection"))),
        _number(tm.any_term(low, ("terms", "conditions"))),
        _number(F.contains(low, F.lit("legal")) | F.contains(url, F.lit("legal"))),
        F.least(slashes, F.lit(5)) / F.lit(5.0),
        F.least(F.length(low), F.lit(50)) / F.lit(50.0),
        _number(F.startswith(url, F.lit("https"))),
        _number(F.rlike(low, F.lit(r"\b20[2-3][0-9]\b"))),
    )


# --------------------------------------------------------------------------- model


def load_weights(text: str) -> list[tuple[list[list[float]], list[float]]]:
    """Layers ``(matrix, bias)`` from a JSON list of ``{"weights": [[..]], "bias": [..]}``."""
    return [(layer["weights"], layer["bias"]) for layer in json.loads(text)]


def score_links(links: DataFrame, layers: Sequence[tuple], features: str = "features",
                name: str = "model_score") -> DataFrame:
    """Add the network's score, ``is_policy`` and ``model_confidence`` to rows of features.

    ``layers`` are ``(matrix, bias)`` pairs, first to last, with a sigmoid after each. A batch of
    rows is one matrix product; the weights are a few thousand numbers and travel with the task.
    """
    stack = [(np.asarray(w, dtype="float64"), np.asarray(b, dtype="float64")) for w, b in layers]

    @F.pandas_udf("double")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            if rows.empty:
                yield pd.Series([], dtype="float64")
                continue
            x = np.vstack(rows.to_numpy())
            for w, b in stack:
                x = 1.0 / (1.0 + np.exp(-np.clip(x @ w.T + b, -500, 500)))
            yield pd.Series(x[:, 0])

    far = F.abs(F.col(name) - 0.5)
    # The function gets a finished column, never an expression, and so is run once per row.
    scored = computed(links, _input=F.col(features)).withColumn(name, forward(F.col("_input")))
    return (
        scored.drop("_input")
        .withColumn("is_policy", F.col(name) > 0.5)
        .withColumn(
            "model_confidence",
            F.when(far > 0.35, "high").when(far > 0.15, "medium").otherwise("low"),
        )
    )


def first_weights(layers: Sequence[int], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Normal weights and biases of variance ``2 / inputs``, the same for the same seed."""
    draw = np.random.default_rng(seed)
    spread = [np.sqrt(2.0 / n) for n in layers]
    return [(draw.normal(0, s, (out, n)), draw.normal(0, s, out)) for n, out, s in zip(layers, layers[1:], spread)]


def gradient_sums(stack: Sequence[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per layer the summed directions that lower half the squared error of a sigmoid network."""
    seen = [x]
    for w, b in stack:
        seen.append(1.0 / (1.0 + np.exp(-np.clip(seen[-1] @ w.T + b, -500, 500))))
    error, out = y[:, None] - seen[-1], []
    for (w, _), before, after in zip(reversed(stack), reversed(seen[:-1]), reversed(seen[1:])):
        step = error * after * (1 - after)
        out.append((step.T @ before, step.sum(0)))
        error = step @ w
    return out[::-1]


def train_link_model(examples: DataFrame, layers: Sequence[int] = (24, 32, 16, 1), newest: int | None = None,
                     seed: int = 7, epochs: int = 5, batch_rows: int = 65_536, rate: float = 0.15, momentum: float = 0.9,
                     features: str = "features", target: str = "target") -> tuple[list[tuple[list, list]], float]:
    """Train a sigmoid network by gradient descent with momentum; returns ``(layers, accuracy)``.

    The layers go into ``score_links``. Rows are dealt into batches of about ``batch_rows`` by a hash of their
    values and kept as matrices by Spark, a few partitions per batch; an epoch reads every batch once, in an order
    drawn from the seed. The tasks of a batch send the sum of their rows' gradients, and one step follows their mean. With
    ``batch_rows=1`` that is descent row by row. ``newest`` trains on the newest rows only (10 000 was usual).
    Rows with a null target, or features that are null, of another length or hold a null, teach nothing. The accuracy
    is that of the trained rows; without any it is 0 and the first weights come back.
    """
    rows = examples
    if newest is not None:
        rows = rows.orderBy(F.col("created_at").desc()).limit(newest)
    x, y = F.col(features).cast("array<double>"), F.col(target).cast("double")
    usable = y.isNotNull() & (F.size(x) == layers[0]) & ~F.exists(x, lambda v: v.isNull())
    data = durable(rows.select(x.alias("x"), y.alias("y")).where(F.coalesce(usable, F.lit(False)))
                   .withColumn("row", F.monotonically_increasing_id()))
    stack = first_weights(layers, seed)
    count = data.count()
    if count:
        batches, pieces = -(-count // batch_rows), max(1, min(PIECES, batch_rows // PIECE_ROWS))
        # Equal rows still differ in their place, so that no value fills a batch.
        dealt = F.pmod(F.xxhash64(F.lit(seed), "x", "y", "row"), F.lit(batches))
        piece = F.pmod(F.xxhash64(F.lit(seed), "row", F.lit("piece")), F.lit(pieces))
        blocks = _blocks(data.repartitionById(batches * pieces, (dealt * pieces + piece).cast("int")).sortWithinPartitions("row"), layers[0])
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        stack = _descend(blocks, stack, batches, pieces, epochs, seed, rate, momentum)
        blocks.unpersist()
    plain = [(w.tolist(), b.tolist()) for w, b in stack]
    right = score_links(data.select("x", "y"), plain, "x").agg(F.avg((F.col("is_policy").cast("double") == F.col("y")).cast("double")))
    return plain, right.first()[0] if count else 0.0


# Tasks of a batch, and the rows that make another task worth its start.
PIECES, PIECE_ROWS = 8, 4096


def _blocks(dealt: DataFrame, inputs: int) -> RDD:
    """Matrices ``(x, y)`` of the rows of each partition, as the tasks of a step take them."""

    def pack(parts):
        for part in parts:
            if part.num_rows:
                x, y = (np.asarray(c, dtype="float64").tobytes() for c in (part.column(0).flatten(), part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()), pa.array([y], pa.binary())], ["x", "y"])

    def matrices(row):
        return np.frombuffer(row.x).reshape(-1, inputs), np.frombuffer(row.y)

    return dealt.select("x", "y").mapInArrow(pack, "x binary, y binary").rdd.map(matrices)


def _descend(blocks, stack, batches, pieces, epochs, seed, rate, momentum):
    context = blocks.context
    rows = blocks.mapPartitionsWithIndex(lambda i, parts: [(i // pieces, sum(len(y) for _, y in parts))]).collect()
    counts = np.bincount([b for b, _ in rows], [n for _, n in rows], batches)

    def step(stack):
        def sums(parts):
            total = None
            for x, y in parts:
                found = gradient_sums(stack, x, y)
                total = found if total is None else [(a + c, b + d) for (a, b), (c, d) in zip(total, found)]
            return [] if total is None else [np.concatenate([v.ravel() for pair in total for v in pair])]

        return sums

    speed = [np.zeros_like(v) for pair in stack for v in pair]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for b in order.permutation(np.flatnonzero(counts)).tolist():
            # Only the tasks of the batch run; each sends one row of a few thousand numbers, in the order of the pieces.
            found = context.runJob(blocks, step(stack), range(b * pieces, (b + 1) * pieces))
            mean = np.sum(found, axis=0) / counts[b]
            at, flat = 0, [v for pair in stack for v in pair]
            for i, v in enumerate(flat):
                speed[i] = momentum * speed[i] + rate * mean[at:at + v.size].reshape(v.shape)
                at += v.size
            moved = [v + s for v, s in zip(flat, speed)]
            stack = list(zip(moved[::2], moved[1::2]))
    return stack


def feedback_examples(feedback: DataFrame, pages: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Training rows from feedback ``domain, correct_url, incorrect_url`` and crawled pages.

    A right address gives target 1, a wrong one 0. The page stands for the link text (its first
    ``text_chars`` characters only, if given). Pages that were not crawled give rows without content;
    of several with one address the one with the smallest hash counts.
    """
    named = feedback.select(
        "domain",
        F.inline(
            F.array_compact(
                F.array(
                    F.struct(F.col("correct_url").alias("url"), F.lit(1).alias("target")),
                    F.when(
                        F.col("incorrect_url").isNotNull(),
                        F.struct(F.col("incorrect_url").alias("url"), F.lit(0).alias("target")),
                    ),
                )
            )
        ),
    )
    # Page features are made in the scan, so that no page is shuffled.
    head = F.col("html") if text_chars is None else F.substring("html", 1, text_chars)
    content = (
        computed(pages.select("url", "html"), _words=text_features(head), _page=page_features(F.col("html")),
                 _hash=F.xxhash64("html"))
        .groupBy("url").agg(F.min_by(F.struct("_words", "_page"), "_hash").alias("_c"))
        .select("url", "_c.*")
    )
    unread = text_features(F.lit(""))
    return spread_join(named, content, ["url"], "left").select(
        "domain", "url", "target",
        link_features(
            F.lit(""), F.col("url"), F.lit("footer"), F.col("domain"), F.col("_page"),
            F.coalesce(F.col("_words"), unread),
        ).alias("features"),
    )


def adjust_prediction(rows: DataFrame, score: str = "model_score",
                      confidence: str = "model_confidence", url: str = "url",
                      content: str = "html", fetched: str | None = None) -> DataFrame:
    """Correct a model score by what the page itself shows.

    Adds ``adjusted_score, adjusted_confidence, adjusted_policy``.
    """
    s, page, low = F.col(score), F.col(content), F.lower(url)
    strong = tm.any_term(
        low,
        ("/privacy-policy", "/privacy_policy", "/privacypolicy", "/datenschutz",
         "/policies/privacy", "/legal/privacy"),
    )
    missing = page.isNull() if fetched is None else ~F.col(fetched)
    proof = F.col("_evidence")
    cases = (
        (missing, F.least(s * 0.1, F.lit(0.15)), F.lit("low")),
        (F.coalesce(F.length(page) < 100, F.lit(True)), F.least(s, F.lit(0.2)), F.lit("low")),
        (ur.is_homepage(F.col(url)) & ~proof, F.least(s, F.lit(0.2)), F.lit("low")),
        (ur.is_homepage(F.col(url)) | proof, s, F.col(confidence)),
        (strong & (F.length(page) > 5000), F.greatest(s * 0.85, F.lit(0.6)), F.lit("medium")),
        (strong, F.greatest(s * 0.7, F.lit(0.5)), F.lit("medium")),
    )
    value, level = None, None
    for condition, v, c in cases:
        value = F.when(condition, v) if value is None else value.when(condition, v)
        level = F.when(condition, c) if level is None else level.when(condition, c)
    return (
        computed(
            computed(rows, _evidence=page_evidence(page)["is_policy"]),
            adjusted_score=value.otherwise(F.least(s, F.lit(0.35))),
            adjusted_confidence=level.otherwise(F.lit("low")),
        )
        .withColumn("adjusted_policy", F.col("adjusted_score") > 0.5)
        .drop("_evidence")
    )


def combine_confidence(model_score: Column, content_confidence: Column, content_valid: Column,
                       strong_keywords: Column) -> Column:
    """Struct of ``confidence`` and ``valid`` from the model and the content check."""
    model = F.coalesce(model_score, F.lit(0.0)) * 100
    return F.struct(
        F.when(model > 0, tm.round_half_up(model * 0.6 + content_confidence * 0.4))
        .otherwise(content_confidence.cast("int"))
        .alias("confidence"),
        ((model >= 70) | content_valid | ((model >= 50) & (strong_keywords >= 3))).alias("valid"),
    )


# --------------------------------------------------------------------------- policy score

# Finding categories, old names, and their order in a report.
LEGACY_CATEGORIES = {
    "THREAT": "CONCERNING", "WARNING": "NOTABLE", "CAUTION": "ATTENTION", "NORMAL": "STANDARD",
    "GOOD": "POSITIVE", "BRILLIANT": "EXCELLENT",
}
CATEGORY_ORDER = (
    "CONCERNING", "THREAT", "NOTABLE", "WARNING", "ATTENTION", "CAUTION", "STANDARD", "NORMAL",
    "POSITIVE", "GOOD", "EXCELLENT", "BRILLIANT",
)


def map_legacy_category(category: Column) -> Column:
    return F.coalesce(
        *[F.when(category == old, F.lit(new)) for old, new in LEGACY_CATEGORIES.items()], category
    )


def category_rank(category: Column) -> Column:
    """Place in the report order; a missing category counts as NORMAL, an unknown one leads."""
    named = F.coalesce(category, F.lit("NORMAL"))
    return F.array_position(tm.literal_array(CATEGORY_ORDER), named).cast("int") - 1


def sort_findings(findings: Column) -> Column:
    """Array of ``category, text`` in report order; equal categories keep their order."""
    keyed = F.transform(
        findings, lambda f, i: F.struct(category_rank(f["category"]).alias("r"), i.alias("i"),
                                        f.alias("f"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def policy_score(analyses: DataFrame, clauses: str = "clauses_found",
                 sharing: str = "third_party_sharing", findings: str = "key_findings",
                 reading: str = "reading_level", contact: str = "contact_info",
                 deletion_clause: str = "deletion_clause",
                 contact_clause: str = "contact_clause",
                 optout_clause: str = "opt_out_clause") -> DataFrame:
    """Add ``policy_score`` (1 to 100) and the list of ``deductions``."""
    nothing = F.array().cast("array<string>")
    has = F.coalesce(F.col(clauses), nothing)
    shared = F.transform(F.coalesce(F.col(sharing), nothing), F.lower)
    said = F.lower(F.coalesce(F.array_join(F.col(f"{findings}.text"), " "), F.lit("")))
    no_contact = ~F.array_contains(has, contact_clause) & (
        F.coalesce(F.col(contact), F.lit("")) == ""
    )

    def share_has(word: str) -> Column:
        return F.exists(shared, lambda s: F.contains(s, F.lit(word)))

    def speaks(*words: str) -> Column:
        return tm.any_term(said, words)

    sells, markets = share_has("sell"), share_has("marketing")
    n = F.size(shared)
    level = F.coalesce(F.col(reading), F.lit(""))
    # Rule, points, reason.
    rules = (
        (~F.array_contains(has, deletion_clause), -15, "No data deletion clause (-15)"),
        (no_contact, -10, "No contact information (-10)"),
        (sells, -18, "Sells user data (-18)"),
        (~sells & markets, -12, "Shares for marketing (-12)"),
        (~sells & ~markets & (n > 5), -8, "Many third-party data shares (-8)"),
        (~sells & ~markets & (n > 2) & (n <= 5), -4, "Some third-party data shares (-4)"),
        (level == "Complex", -7, "Complex legal jargon (-7)"),
        (level == "Moderate", -3, "Moderate complexity (-3)"),
        (speaks("vague", "unclear"), -8, "Vague or unclear language (-8)"),
        (speaks("indefinite", "forever"), -6, "Indefinite data retention (-6)"),
        (speaks("track") & speaks("third"), -5, "Third-party tracking (-5)"),
        (F.array_contains(has, optout_clause), 3, "Opt-out available (+3)"),
        (level == "Simple", 2, "Clear, simple language (+2)"),
    )
    score = F.lit(100)
    for condition, points, _ in rules:
        score = score + tm.flag(condition) * points
    return analyses.withColumn("policy_score", tm.clamp(score, 1, 100)).withColumn(
        "deductions", F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, _, r in rules]))
    )


def aggregate_policy_score(results: DataFrame, domain: str = "domain", type: str = "policy_type",
                           score: str = "score", status: str | None = None,
                           weights: Mapping[str, int] | None = None) -> DataFrame:
    """Weighted mean score per domain: privacy counts 3, terms 2, other types 1."""
    w = weights or {"privacy": 3, "terms": 2}
    weight = F.coalesce(*[F.when(F.col(type) == t, F.lit(v)) for t, v in w.items()], F.lit(1))
    rows = results.where(F.col(score).isNotNull())
    if status is not None:
        rows = rows.where(F.col(status) == "complete")
    return (
        rows.groupBy(domain)
        .agg(
            F.sum(F.col(score) * weight).alias("_sum"),
            F.sum(weight).alias("_weight"),
            F.count(F.lit(1)).alias("policies"),
        )
        .select(
            domain,
            tm.round_half_up(F.col("_sum") / F.col("_weight")).alias("aggregate_score"),
            "policies",
        )
    )
