"""Version history, cache state, comparisons and change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import text as tx
from clauselake.functions.terms import let
from clauselake.operators.keyed import (
    first_per_key,
    spread_join,
    top_per_key,
    upsert,
    with_previous,
)
from clauselake.operators.staging import computed

KEY = ("domain", "policy_type")

# Light columns of a history list, and the display names mapped to cache types in
# the order of the replacements.
HISTORY_COLUMNS = ("id", "domain", "policy_type", "content_hash", "score", "word_count",
                   "analyzed_at")
TYPE_RULES = (
    ("privacy policy", "privacy"),
    ("terms of service|terms & conditions|terms", "terms"),
    ("cookie policy|cookies", "cookies"),
    ("data processing|dpa", "dpa"),
    ("acceptable use|aup", "aup"),
    ("security", "security"),
)


def policy_type_from_name(name: Column) -> Column:
    """Cache type of a display name; each rule replaces its first hit."""
    out = F.lower(name)
    for pattern, short in TYPE_RULES:
        out = F.regexp_replace(out, rf"(?s)^(.*?)(?:{pattern})", "$1" + short)
    return out


def newest_first() -> list[Column]:
    return [F.col("analyzed_at").desc(), F.col("id").desc()]


def latest_version(versions: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Newest version per domain and type."""
    return first_per_key(versions, keys, newest_first())


def version_history(versions: DataFrame, limit: int = 20, keys: Sequence[str] = KEY,
                    columns: Sequence[str] = HISTORY_COLUMNS) -> DataFrame:
    """Newest versions per domain and type, light columns only."""
    light = versions.select(*[c for c in columns if c in versions.columns])
    return top_per_key(light, keys, newest_first(), limit)


def cache_status(versions: DataFrame, current: DataFrame, as_of: Column, ttl_days: int = 7,
                 keys: Sequence[str] = KEY) -> DataFrame:
    """State of the newest version of every requested key.

    ``current`` has one row per key and the hash of the text as it is now (null when unknown).
    States: ``none``, ``fresh`` (younger than ``ttl_days``), ``unchanged``, ``changed``. An
    unknown hash counts as changed.
    """
    latest = latest_version(versions.select(*keys, "id", "content_hash", "analyzed_at"), keys)
    age = as_of.cast("timestamp") - F.expr(f"INTERVAL {ttl_days} DAYS")
    return current.join(latest, list(keys), "left").select(
        *keys, F.col("id").alias("version_id"), "analyzed_at",
        F.when(F.col("id").isNull(), "none")
        .when(F.col("analyzed_at") > age, "fresh")
        .when(F.col("content_hash") == F.col("current_hash"), "unchanged")
        .otherwise("changed")
        .alias("status"),
    )


def needs_analysis(status: DataFrame) -> DataFrame:
    """Add ``to_do``: true where no usable version is cached."""
    return status.withColumn("to_do", ~F.col("status").isin("fresh", "unchanged"))


def save_versions(base: DataFrame, analysed: DataFrame) -> DataFrame:
    """Upsert new analyses on (domain, type, hash); an existing row keeps its id.

    ``analysed`` holds ``id, domain, policy_type, policy_url, raw_text, score, analyzed_at`` and
    whatever else the base has.
    """
    rows = (
        analysed.withColumn(
            "domain", F.lower(F.regexp_replace("domain", r"^www\.", ""))
        )
        .withColumn("content_hash", tx.content_hash(F.col("raw_text")))
        .withColumn("word_count", tx.word_count(F.col("raw_text")))
    )
    return upsert(base, rows, ["domain", "policy_type", "content_hash"], newest_first(),
                  keep=["id"])


def consecutive_pairs(versions: DataFrame, carry: Sequence[str] = ("id", "score", "word_count"),
                      keys: Sequence[str] = KEY) -> DataFrame:
    """Each version with columns of the version before it: ``prev_...``, null for the first.

    Only narrow columns go through the ordering; texts are joined afterwards by id.
    """
    narrow = versions.select(*dict.fromkeys([*keys, "analyzed_at", "id", *carry]))
    return with_previous(narrow, keys, ["analyzed_at", "id"], carry)


def named_pairs(versions: DataFrame, pairs: DataFrame,
                carry: Sequence[str] = ("score", "word_count")) -> DataFrame:
    """Versions picked by id (``left_id, right_id``), put into time order as old and new."""
    light = versions.select("id", "analyzed_at", *carry)
    one = light.select(F.struct("analyzed_at", "id", *carry).alias("a"), F.col("id").alias("left_id"))
    two = light.select(F.struct("analyzed_at", "id", *carry).alias("b"), F.col("id").alias("right_id"))
    both = spread_join(spread_join(pairs, one, ["left_id"]), two, ["right_id"])
    ordered = both.select(F.least("a", "b").alias("o"), F.greatest("a", "b").alias("n"))
    return ordered.select(
        F.col("o.id").alias("prev_id"), F.col("n.id").alias("id"),
        *[F.col(f"o.{c}").alias(f"prev_{c}") for c in carry],
        *[F.col(f"n.{c}").alias(c) for c in carry],
    )


def version_compare(pairs: DataFrame) -> DataFrame:
    """Score and word-count change of pairs; a missing number counts as 0."""

    def change(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"prev_{c}"), F.lit(0))

    return pairs.withColumn("score_diff", change("score")).withColumn(
        "word_count_diff", change("word_count")
    )


def _forms(texts: DataFrame, separator: str) -> DataFrame:
    """Paragraphs of every version in the scan: version, position and hash of the compared form."""
    split = texts.select(
        F.col("id").alias("_id"),
        F.posexplode(tx.paragraphs(F.col("raw_text"), separator)).alias("pos", "paragraph"),
    )
    return split.select(
        "_id", "pos", F.sha2(F.lower(tx.trimmed(F.col("paragraph"))), 256).alias("_form")
    )


def _side(pairs: DataFrame, forms: DataFrame, column: str) -> DataFrame:
    """The hashed paragraphs of one side of the pairs."""
    wanted = pairs.select(F.col("id").alias("pair_id"), F.col(column).alias("_id"))
    return forms.join(wanted, "_id")


def paragraph_diff(pairs: DataFrame, texts: DataFrame, separator: str = r"\n\n+") -> DataFrame:
    """Added, removed and unchanged paragraphs of version pairs ``id, prev_id``.

    ``texts`` holds ``id, raw_text``. Paragraphs are compared trimmed and in lower case, by hash;
    repeated paragraphs stay repeated on the output side. Only hashes are compared; the paragraphs
    of the result are fetched once, by version and position.
    """
    known = pairs.where(F.col("prev_id").isNotNull())
    forms = _forms(texts, separator)
    new, old = _side(known, forms, "id"), _side(known, forms, "prev_id")
    on = ["pair_id", "_form"]
    before = old.select(*on).distinct().withColumn("_known", F.lit(True))
    kept_or_new = new.join(before, on, "left").select(
        "pair_id", F.when(F.col("_known"), "unchanged").otherwise("added").alias("status"), "_id",
        "pos",
    )
    gone = old.join(new.select(*on).distinct(), on, "left_anti").select(
        "pair_id", F.lit("removed").alias("status"), "_id", "pos"
    )
    said = texts.select(
        F.col("id").alias("_id"),
        F.posexplode(tx.paragraphs(F.col("raw_text"), separator)).alias("pos", "paragraph"),
    )
    return kept_or_new.unionByName(gone).join(said, ["_id", "pos"]).select(
        "pair_id", "status", "pos", "paragraph"
    )


def paragraph_diff_counts(pairs: DataFrame, texts: DataFrame, separator: str = r"\n\n+"
                          ) -> DataFrame:
    """Numbers of added, removed and unchanged paragraphs per pair.

    Hashes meet the pairs by version; one shuffle of (pair, hash) with partial sums does the rest.
    """
    known = pairs.where(F.col("prev_id").isNotNull())
    forms = _forms(texts, separator)

    def marked(column: str, is_new: int) -> DataFrame:
        return _side(known, forms, column).select("pair_id", "_form", F.lit(is_new).alias("_new"))

    both = marked("id", 1).unionByName(marked("prev_id", 0))
    per_form = both.groupBy("pair_id", "_form").agg(
        F.sum("_new").alias("_n"), F.sum(1 - F.col("_new")).alias("_o")
    )
    counts = per_form.groupBy("pair_id").agg(
        F.sum(F.when(F.col("_o") == 0, F.col("_n")).otherwise(0)).alias("added"),
        F.sum(F.when(F.col("_n") == 0, F.col("_o")).otherwise(0)).alias("removed"),
        F.sum(F.when(F.col("_o") > 0, F.col("_n")).otherwise(0)).alias("unchanged"),
    )
    return known.select(F.col("id").alias("pair_id"), "prev_id").join(counts, "pair_id", "left").select(
        "pair_id", "prev_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "removed", "unchanged")],
    )


# Keys of an analysis that are compared.
COMPARED_KEYS = ("summary", "score", "data_collected", "third_party_sharing", "user_rights")


def analysis_key_diff(pairs: DataFrame, old: str = "old_analysis", new: str = "new_analysis",
                      keys: Sequence[str] = COMPARED_KEYS, keep: Sequence[str] = ("id",)
                      ) -> DataFrame:
    """One row per pair and compared key: both values as JSON and whether they differ."""

    def value(side: str, key: str) -> Column:
        return F.get_json_object(F.to_json(F.col(side)), f"$.{key}")

    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("key"), value(old, k).alias("old_value"),
                value(new, k).alias("new_value"),
            )
            for k in keys
        ]
    )
    return pairs.select(*keep, F.inline(rows)).withColumn(
        "changed", ~F.col("old_value").eqNullSafe(F.col("new_value"))
    )


def analysis_set_diff(old: Column, new: Column) -> Column:
    """Struct of ``added`` and ``removed`` string lists; repeats are kept."""
    before = F.coalesce(old, F.array().cast("array<string>"))
    after = F.coalesce(new, F.array().cast("array<string>"))
    # The difference sets are small and hashed; only they are searched per element.

    def only(side: Column, other: Column) -> Column:
        return let(
            F.array_except(side, other),
            lambda rest: F.filter(side, lambda x: F.array_contains(rest, x)),
        )

    return F.struct(only(after, before).alias("added"), only(before, after).alias("removed"))


# --------------------------------------------------------------------------- tracking


def track(base: DataFrame, requests: DataFrame, checked_at: Column) -> DataFrame:
    """Start tracking (user, domain) pairs that are not tracked yet.

    ``requests``: user_id, domain, policy_url, score, threats and ``policy_hash`` (or ``raw_text``,
    which is hashed here; hash it once per domain where many users ask for one).
    """
    from clauselake.operators.keyed import insert_if_absent

    hashed = (
        F.col("policy_hash") if "policy_hash" in requests.columns
        else tx.content_hash(F.col("raw_text"), "normalized").alias("policy_hash")
    )
    rows = requests.select(
        "user_id", "domain", "policy_url", hashed,
        checked_at.alias("last_checked"), F.col("score").alias("last_score"),
        F.col("threats").alias("last_threats"), F.lit(False).alias("has_changes"),
        F.lit(None).cast("int").alias("previous_score"),
        F.lit(None).cast("int").alias("previous_threats"),
    )
    return insert_if_absent(base, rows, ["user_id", "domain"],
                            [F.col("policy_hash"), F.col("last_score")])


def detect_changes(tracked: DataFrame, snapshot: DataFrame, salt_hot: bool = False) -> DataFrame:
    """New tracking state after a re-check of all domains.

    ``tracked``   user_id, domain, policy_hash, last_score, last_threats, last_checked
    ``snapshot``  domain, new_hash, new_score, new_threats, checked_at: one row per domain
    A changed hash or score sets the flag and moves the old numbers to ``previous_``. Many users may
    track one domain: ``salt_hot`` salts the join, else adaptive execution splits it.
    """
    joined = spread_join(
        tracked, snapshot.withColumn("_seen", F.lit(True)), ["domain"], "left", salt_hot
    )
    seen = F.coalesce("_seen", F.lit(False))
    changed = seen & (
        ~F.col("policy_hash").eqNullSafe(F.col("new_hash"))
        | ~F.col("last_score").eqNullSafe(F.col("new_score"))
    )

    def roll(new: str, old: str) -> Column:
        return F.when(seen, F.col(new)).otherwise(F.col(old))

    def keep_old(column: str) -> Column:
        if f"previous_{column}" in tracked.columns:
            before = F.col(f"previous_{column}")
        else:
            before = F.lit(None).cast("int")
        return F.when(changed, F.col(f"last_{column}")).when(~seen, before)

    flag = F.col("has_changes") if "has_changes" in tracked.columns else F.lit(False)
    return joined.select(
        "user_id", "domain",
        roll("new_hash", "policy_hash").alias("policy_hash"),
        roll("checked_at", "last_checked").alias("last_checked"),
        keep_old("score").alias("previous_score"),
        keep_old("threats").alias("previous_threats"),
        roll("new_score", "last_score").alias("last_score"),
        roll("new_threats", "last_threats").alias("last_threats"),
        F.when(seen, changed).otherwise(flag).alias("has_changes"),
    )


def change_summary(old_score: Column, new_score: Column, old_threats: Column,
                   new_threats: Column) -> Column:
    """Sentence about what changed between two analyses."""
    diff = new_score - old_score
    score_part = F.when(
        old_score != new_score,
        F.concat(
            F.lit("Score "), F.when(diff > 0, "improved").otherwise("decreased"), F.lit(" by "),
            F.abs(diff).cast("string"), F.lit(" points ("), old_score.cast("string"),
            F.lit(" → "), new_score.cast("string"), F.lit(")"),
        ),
    )
    o, n = F.coalesce(old_threats, F.lit(0)), F.coalesce(new_threats, F.lit(0))
    threat_part = F.when(
        n > o, F.concat((n - o).cast("string"), F.lit(" new threat(s) detected"))
    ).when(o > n, F.concat((o - n).cast("string"), F.lit(" threat(s) resolved")))
    said = F.concat_ws(". ", score_part, threat_part)
    return F.when(said == "", F.lit("Policy content has been updated")).otherwise(said)


def change_records(tracked: DataFrame) -> DataFrame:
    """What changed, for every tracked row with the flag set and both analyses known."""
    rows = tracked.where(
        F.col("has_changes") & F.col("previous_score").isNotNull() & F.col("last_score").isNotNull()
    )
    return rows.select(
        "user_id", "domain", F.col("last_checked").alias("detected_at"),
        F.when(F.col("previous_score") != F.col("last_score"), "score_changed")
        .otherwise("content_changed")
        .alias("change_type"),
        F.col("previous_score").alias("old_score"), F.col("last_score").alias("new_score"),
        change_summary(F.col("previous_score"), F.col("last_score"), F.col("previous_threats"),
                       F.col("last_threats")).alias("summary"),
    )


def notification_counts(tracked: DataFrame) -> DataFrame:
    """Rows with unseen changes per user; users without any keep a 0."""
    return tracked.groupBy("user_id").agg(F.count_if("has_changes").alias("notifications"))


def mark_viewed(tracked: DataFrame, viewed: DataFrame) -> DataFrame:
    """Clear flag and previous numbers of viewed (user, domain) pairs."""
    seen = viewed.select("user_id", "domain").distinct().withColumn("_viewed", F.lit(True))
    done = F.col("_viewed").isNotNull()
    out = tracked.join(seen, ["user_id", "domain"], "left")
    return out.select(
        *[
            F.when(done, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "has_changes"
            else F.when(~done, F.col(c)).alias(c) if c.startswith("previous_")
            else F.col(c)
            for c in tracked.columns
        ]
    )
