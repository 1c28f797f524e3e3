"""Personal risk, breaches, data exposure and community votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import terms as tm
from clauselake.operators.keyed import first_per_key, spread_join, top_per_key
from clauselake.values.risk_values import DATA_TYPES

# Regions with their risk, the goals users pick from, breach classes per check.
REGION_RISK = {"EU": 20, "UK": 25, "US_CA": 35, "CA": 30, "AU": 40, "BR": 35, "US_OTHER": 60,
               "OTHER": 50}
GOALS = ("avoid_data_selling", "limit_tracking", "protect_family", "business_compliance",
         "find_safe_alternatives", "monitor_changes", "understand_rights", "minimize_sharing")
# Three readings of a critical breach: classes, must be verified, retired ones excluded.
CRITICAL_CLASSES = {
    "summary": (("Passwords", "Credit cards"), False, False),
    "check": (("Passwords", "Credit cards", "Bank account numbers", "Financial data",
               "Social security numbers"), True, True),
    "stats": (("Passwords", "Credit cards", "Bank account numbers"), True, False),
}


def region_risk(region: Column) -> Column:
    """Risk of a region; missing and unknown regions count as OTHER."""
    named = F.coalesce(F.nullif(region, F.lit("")), F.lit("OTHER"))
    return F.coalesce(*[F.when(named == r, F.lit(v)) for r, v in REGION_RISK.items()], F.lit(50))


# --------------------------------------------------------------------------- breaches


def is_critical(classes: Column, verified: Column, retired: Column | None = None,
                profile: str = "check",
                critical: Sequence[str] | None = None) -> Column:
    """A breach that exposes one of the critical classes, in one of the three readings."""
    names, needs_verified, not_retired = CRITICAL_CLASSES[profile]
    hit = F.arrays_overlap(F.coalesce(classes, F.array().cast("array<string>")),
                           tm.literal_array(critical or names))
    if needs_verified:
        hit = hit & F.coalesce(verified, F.lit(False))
    if not_retired and retired is not None:
        hit = hit & ~F.coalesce(retired, F.lit(False))
    return F.coalesce(hit, F.lit(False))


def is_recent(breach_date: Column, as_of: Column, profile: str = "check") -> Column:
    """Within 365 days (``summary``) or one calendar year (``check``, ``stats``)."""
    if profile == "summary":
        start = F.date_sub(F.to_date(as_of), 365)
    else:
        start = F.add_months(F.to_date(as_of), -12)
    return F.coalesce(F.to_date(breach_date) > start, F.lit(False))


def breach_counts(breaches: DataFrame, as_of: Column, profile: str = "summary",
                  critical: Sequence[str] | None = None, user: str = "user_id") -> DataFrame:
    """Total, critical and recent breaches per user, from one row per breach."""
    retired = F.col("is_retired") if "is_retired" in breaches.columns else None
    crit = is_critical(F.col("data_classes"), F.col("is_verified"), retired, profile, critical)
    recent = is_recent(F.col("breach_date"), as_of, profile)
    if profile == "check":
        recent = recent & F.coalesce("is_verified", F.lit(False))
    return breaches.groupBy(user).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(crit).alias("critical"),
        F.count_if(recent).alias("recent"),
    )


def exposed_classes(breaches: DataFrame, user: str = "user_id") -> DataFrame:
    """Breaches per user and data class, with the place of each class in the user's list.

    ``breaches`` of a class are counted before ranking, so the list of a user is as long as the
    number of different classes, not of breaches.
    """
    return (
        breaches.select(user, "breach_date", F.explode(F.array_distinct("data_classes")).alias("data_class"))
        .groupBy(user, "data_class")
        .agg(F.count(F.lit(1)).alias("breaches"), F.min("breach_date").alias("first_breach"))
    )


def breach_summary(breaches: DataFrame, as_of: Column, critical: Sequence[str] | None = None,
                   shown: int = 10, user: str = "user_id") -> DataFrame:
    """Counts per user and the first ``shown`` exposed classes, by first breach, then name."""
    counts = breach_counts(breaches, as_of, "summary", critical, user)
    first = top_per_key(
        exposed_classes(breaches, user), [user], [F.col("first_breach"), F.col("data_class")], shown
    )
    return counts.join(_listed(first, user, "exposed_data"), user, "left")


def breach_check(breaches: DataFrame, as_of: Column, critical: Sequence[str] | None = None,
                 user: str = "user_id") -> DataFrame:
    """Counts per user in the strict reading, and the exposed classes by name with their number."""
    counts = breach_counts(breaches, as_of, "check", critical, user)
    classes = exposed_classes(breaches, user).groupBy(user).agg(
        F.count(F.lit(1)).alias("exposed_types"),
        F.sort_array(F.collect_list("data_class")).alias("exposed_data"),
    )
    return counts.join(classes, user, "left").withColumn(
        "exposed_types", F.coalesce("exposed_types", F.lit(0))
    ).withColumn("exposed_data", F.coalesce("exposed_data", F.array().cast("array<string>")))


def breach_stats(users: DataFrame, breaches: DataFrame, as_of: Column,
                 critical: Sequence[str] | None = None, shown: int = 5, user: str = "user_id"
                 ) -> DataFrame:
    """Counts, the most frequent exposed classes and a level from SAFE to CRITICAL per user."""
    counts = breach_counts(breaches, as_of, "stats", critical, user)
    top = top_per_key(
        exposed_classes(breaches, user), [user],
        [F.col("breaches").desc(), F.col("data_class")], shown,
    )
    joined = users.select(user).join(counts, user, "left").join(
        _listed(top, user, "top_exposed_data"), user, "left"
    )
    n = F.coalesce("total", F.lit(0))
    crit, recent = F.coalesce("critical", F.lit(0)), F.coalesce("recent", F.lit(0))
    level = (
        F.when(n == 0, "SAFE")
        .when((crit > 2) | (n > 10), "CRITICAL")
        .when((crit > 0) | (n > 5), "HIGH")
        .when((recent > 0) | (n > 2), "MEDIUM")
        .otherwise("LOW")
    )
    return joined.select(
        user, n.alias("total"), crit.alias("critical"), recent.alias("recent"),
        F.coalesce("top_exposed_data", F.array().cast("array<string>")).alias("top_exposed_data"),
        level.alias("risk_level"),
    )


def _listed(ranked: DataFrame, user: str, name: str) -> DataFrame:
    """Names of a ranked list in order; the list is short, its length is a report size."""
    return ranked.groupBy(user).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "data_class"))), lambda r: r["data_class"]
        ).alias(name)
    )


def password_exposure(passwords: DataFrame, leaked: DataFrame, password: str = "password"
                      ) -> DataFrame:
    """How often each password occurs in a table of leaked hashes ``prefix, suffix, occurrences``.

    Only hashes leave the scan. The table is joined by prefix bucket and suffix; equal passwords
    are joined once.
    """
    digest = F.upper(F.sha1(F.col(password)))
    hashed = passwords.withColumn("_hash", digest).drop(password)
    asked = hashed.select("_hash").distinct().select(
        "_hash", F.substring("_hash", 1, 5).alias("prefix"),
        F.substring("_hash", 6, 35).alias("suffix"),
    )
    table = leaked.groupBy("prefix", "suffix").agg(F.sum("occurrences").alias("occurrences"))
    found = asked.join(table, ["prefix", "suffix"]).select("_hash", "occurrences")
    return spread_join(hashed, found, ["_hash"], "left").select(
        *[c for c in passwords.columns if c != password],
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        F.col("occurrences").isNotNull().alias("compromised"),
    )


# --------------------------------------------------------------------------- risk


def service_counts(analyses: DataFrame, keys: Sequence[str] = ("user_id", "domain")) -> DataFrame:
    """Analyses per user and domain with the latest score and version.

    ``analyses``: user_id, domain, score, version_id, analyzed_at.
    """
    newest = F.max_by(F.struct("score", "version_id"), F.struct("analyzed_at", "version_id"))
    return (
        analyses.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("analysis_count"),
            F.min("analyzed_at").alias("first_analyzed_at"),
            F.max("analyzed_at").alias("last_analyzed_at"),
            newest.alias("_new"),
        )
        .select(
            *keys, "analysis_count", "first_analyzed_at", "last_analyzed_at",
            F.col("_new.score").alias("latest_score"),
            F.col("_new.version_id").alias("latest_version_id"),
        )
    )


def risk_factors(users: DataFrame, services: DataFrame, breaches: DataFrame,
                 user: str = "user_id") -> DataFrame:
    """Six risk factors per user.

    ``users``: user_id, region. ``services``: user_id, latest_score. ``breaches``: user_id, total.
    Users without a scored service get an average of 100.
    """
    score = F.col("latest_score")
    per_user = services.groupBy(user).agg(
        F.count(F.lit(1)).alias("_services"),
        F.sum(score).alias("_sum"),
        F.count(score).alias("_scored"),
        F.count_if(score < 50).alias("_low"),
        F.count_if(score < 30).alias("_bad"),
    )
    joined = users.join(per_user, user, "left").join(breaches.select(user, "total"), user, "left")

    def number(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    mean = F.when(number("_scored") > 0, tm.round_half_up(F.col("_sum") / F.col("_scored")))
    exposure = number("_services") * 5 + number("_low") * 15 + number("_bad") * 25
    return joined.select(
        *users.columns,
        F.coalesce(mean, F.lit(100)).alias("average_score"),
        number("total").alias("breach_count"),
        number("_low").alias("concerning_services"),
        number("_bad").alias("high_risk_services"),
        region_risk(F.col("region")).alias("region_risk"),
        F.least(F.lit(100), exposure).cast("int").alias("data_exposure"),
    )


def risk_score(factors: DataFrame) -> DataFrame:
    """Add ``overall_score`` (higher is safer) and ``risk_level``."""
    breach = F.least(F.col("breach_count") * 10, F.lit(100))
    # Weights in hundredths, so the sum is exact before it is rounded.
    hundredths = (
        F.col("average_score") * 35
        + (100 - breach) * 20
        + (100 - F.col("region_risk")) * 10
        + (100 - F.col("data_exposure")) * 20
        + F.greatest(F.lit(0), 100 - F.col("concerning_services") * 10) * 15
    )
    overall = F.floor((hundredths + 50) / 100).cast("int")
    level = (
        F.when(overall >= 75, "LOW")
        .when(overall >= 50, "MODERATE")
        .when(overall >= 25, "HIGH")
        .otherwise("CRITICAL")
    )
    return factors.withColumn("overall_score", overall).withColumn("risk_level", level)


def top_concerns(services: DataFrame, versions: DataFrame, limit: int = 5,
                 user: str = "user_id") -> DataFrame:
    """Worst services per user with a score below 50 and the first serious finding.

    ``services``: user_id, domain, latest_score, latest_version_id; ``versions``: id,
    key_findings. The list is cut to ``limit`` first; services without a version drop out after.
    """
    worst = top_per_key(
        services.where(F.col("latest_score") < 50), [user],
        [F.col("latest_score"), F.col("domain")], limit,
    ).where(F.col("latest_version_id").isNotNull())
    findings = versions.select(F.col("id").alias("latest_version_id"), "key_findings")
    serious = F.filter("key_findings", lambda f: f["category"].isin("CONCERNING", "THREAT"))
    text = F.try_element_at(serious, F.lit(1))["text"]
    return spread_join(worst, findings, ["latest_version_id"], "left").select(
        user, "rank", "domain", F.col("latest_score").alias("score"),
        F.coalesce(F.nullif(text, F.lit("")), F.lit("Low privacy score")).alias("main_concern"),
    )


def recommendations(factors: DataFrame, goals: str = "goals", region: str = "region",
                    name: str = "recommendations") -> DataFrame:
    """Add the first six recommendations that apply; a filler when fewer than five do."""

    def plural(c: str, end: str) -> Column:
        return F.when(F.col(c) > 1, end).otherwise("")

    def goal(g: str) -> Column:
        return F.coalesce(F.array_contains(goals, g), F.lit(False))

    breaches, bad, low = "breach_count", "high_risk_services", "concerning_services"
    # Texts shown to the user, in the order they are considered.
    rules = (
        (F.col(breaches) > 0, F.concat(
            F.lit("🔴 Your email appears in "), F.col(breaches).cast("string"),
            F.lit(" data breach"), plural(breaches, "es"),
            F.lit(". Change passwords for affected accounts and enable 2FA."))),
        (F.col(bad) > 0, F.concat(
            F.lit("⚠️ You use "), F.col(bad).cast("string"), F.lit(" service"), plural(bad, "s"),
            F.lit(" with critical privacy concerns. Consider alternatives or limit data "
                  "shared."))),
        (F.col(low) > 2, F.concat(
            F.lit("📊 "), F.col(low).cast("string"),
            F.lit(" of your services score below 50. Review which services truly need your "
                  "data."))),
        (F.col(region) == "EU", F.lit(
            "🇪🇺 Under GDPR, you have the right to request data deletion and portability from "
            "all services.")),
        (F.col(region) == "US_CA", F.lit(
            '🇺🇸 California residents can opt-out of data sales. Look for "Do Not Sell My '
            'Personal Information" links.')),
        (F.col(region) == "US_OTHER", F.lit(
            "📋 Your state may have limited privacy laws. Consider using privacy-focused "
            "service alternatives.")),
        (goal("protect_family"), F.lit(
            "👨‍👩‍👧‍👦 Enable parental controls and review privacy settings on services your children "
            "use.")),
        (goal("limit_tracking"), F.lit(
            "🛡️ Use a privacy-focused browser and consider a VPN to limit cross-site tracking.")),
        (goal("avoid_data_selling"), F.lit(
            "💰 Opt-out of data sharing on each service's privacy settings page when "
            "available.")),
        (F.col("data_exposure") > 50, F.lit(
            "📉 Your data exposure is high. Consider deleting accounts you no longer use.")),
    )
    filler = F.array(F.lit("✅ Enable two-factor authentication on all important accounts."))
    said = F.array_compact(F.array(*[F.when(c, t) for c, t in rules]))
    full = F.when(F.size("_said") < 5, F.concat(F.col("_said"), filler)).otherwise(F.col("_said"))
    return factors.withColumn("_said", said).withColumn(name, F.slice(full, 1, 6)).drop("_said")


# --------------------------------------------------------------------------- exposure


def exposure_rows(services: DataFrame, versions: DataFrame) -> DataFrame:
    """Which service of a user collects which data type: one row per triple.

    ``services``: user_id, domain, latest_version_id; ``versions``: id, data_collected. Rows stay
    rows, so a data type that nearly every service collects is never one long list.
    """
    types = versions.select(F.col("id").alias("latest_version_id"), "data_collected")
    known = services.where(F.col("latest_version_id").isNotNull())
    return spread_join(known, types, ["latest_version_id"]).select(
        "user_id", "domain", F.explode("data_collected").alias("data_type")
    )


def _type_info(data_type: Column, table: Sequence[tuple]) -> Column:
    """Struct of ``category`` and ``risk``; types not listed are Other and low."""
    pairs = F.create_map(
        *[
            x
            for name, category, risk in table
            for x in (F.lit(name), F.struct(F.lit(category).alias("category"),
                                            F.lit(risk).alias("risk")))
        ]
    )
    return F.coalesce(
        F.try_element_at(pairs, data_type),
        F.struct(F.lit("Other").alias("category"), F.lit("low").alias("risk")),
    )


def exposure_map(exposure: DataFrame) -> DataFrame:
    """Services per user and data type."""
    return exposure.groupBy("user_id", "data_type").agg(F.count(F.lit(1)).alias("services"))


def exposure_by_category(exposure: DataFrame, table: Sequence[tuple] = DATA_TYPES) -> DataFrame:
    """Data types and services per user, category and risk."""
    return (
        exposure_map(exposure)
        .withColumn("_info", _type_info(F.col("data_type"), table))
        .groupBy("user_id", F.col("_info.category").alias("category"),
                 F.col("_info.risk").alias("risk"))
        .agg(F.count(F.lit(1)).alias("data_types"), F.sum("services").alias("services"))
    )


def exposure_by_service(exposure: DataFrame, table: Sequence[tuple] = DATA_TYPES) -> DataFrame:
    """Data types and high-risk types per user and service."""
    return (
        exposure.withColumn("_info", _type_info(F.col("data_type"), table))
        .groupBy("user_id", "domain")
        .agg(
            F.count(F.lit(1)).alias("data_types"),
            F.count_if(F.col("_info.risk") == "high").alias("high_risk"),
        )
    )


def exposure_totals(exposure: DataFrame) -> DataFrame:
    """Different data types and services per user.

    Both distinct counts run on pre-grouped pairs, not on sets held per user.
    """
    types = exposure.groupBy("user_id", "data_type").agg(F.lit(1).alias("_x"))
    services = exposure.groupBy("user_id", "domain").agg(F.lit(1).alias("_x"))
    return (
        types.groupBy("user_id").agg(F.count("_x").alias("total_types"))
        .join(services.groupBy("user_id").agg(F.count("_x").alias("total_services")), "user_id")
    )


# --------------------------------------------------------------------------- votes


def valid_votes(votes: DataFrame, low: int = 0, high: int = 100) -> tuple[DataFrame, DataFrame]:
    """Votes inside the range, and the rejected ones with the reason."""
    ok = F.coalesce(F.col("score").between(low, high), F.lit(False))
    return votes.where(ok), votes.where(~ok).withColumn(
        "reason", F.lit(f"Score must be between {low} and {high}.")
    )


def community_score(votes: DataFrame, domains: DataFrame | None = None,
                    order: Sequence[Column] | None = None) -> DataFrame:
    """Rounded mean and number of votes per domain, one vote per user.

    With ``order`` the first row per user and domain in that order is the vote that counts. With
    ``domains`` every listed domain is returned, null and 0 without votes.
    """
    single = votes if order is None else first_per_key(votes, ["user_id", "domain"], order)
    scored = single.groupBy("domain").agg(
        tm.round_half_up(F.sum("score") / F.count("score")).alias("average_score"),
        F.count(F.lit(1)).alias("votes"),
    )
    if domains is None:
        return scored
    return domains.join(scored, "domain", "left").withColumn(
        "votes", F.coalesce("votes", F.lit(0))
    )


def risk_profile_update(profiles: DataFrame, scores: DataFrame, at: Column) -> DataFrame:
    """Profiles with the new score and calculation time where one was calculated."""
    new = scores.select("user_id", F.col("overall_score").alias("_new"))
    return profiles.join(new, "user_id", "left").select(
        *[
            F.coalesce("_new", c).alias(c) if c == "personal_risk_score"
            else F.when(F.col("_new").isNotNull(), at).otherwise(F.col(c)).alias(c)
            if c == "last_risk_calculation"
            else F.col(c)
            for c in profiles.columns
        ]
    )


