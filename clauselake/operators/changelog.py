"""Roll-ups and filters over policy changelogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.operators.keyed import spread_join, top_per_key

# Severities from worst to mildest, change types and the counts they feed.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
COUNTED_TYPES = {"additions_count": "WORSE", "removals_count": "BETTER",
                 "modifications_count": "NEUTRAL"}


def _count(items: Column, field: str, value: str) -> Column:
    return F.coalesce(F.size(F.filter(items, lambda c: c[field] == value)), F.lit(0))


def overall_severity(items: Column) -> Column:
    """Worst of the four severities among the items; LOW when there is none or no list."""

    def found(severity: str) -> Column:
        return F.when(F.exists(items, lambda c: c["severity"] == severity), F.lit(severity))

    return F.coalesce(*[found(s) for s in SEVERITIES[:-1]], F.lit(SEVERITIES[-1]))


def changelog_rollup(changelogs: DataFrame, versions: DataFrame, items: str = "changelog_items"
                     ) -> DataFrame:
    """Add scores, score change, counts by change type and the overall severity.

    ``versions`` holds ``id, score``; an unknown version counts as score 0.
    """
    column = F.col(items)
    scores = versions.select("id", "score")
    old = scores.select(F.col("id").alias("old_version_id"), F.col("score").alias("old_score"))
    new = scores.select(F.col("id").alias("new_version_id"), F.col("score").alias("new_score"))
    joined = changelogs.join(old, "old_version_id", "left").join(new, "new_version_id", "left")
    out = joined.withColumn("old_score", F.coalesce("old_score", F.lit(0))).withColumn(
        "new_score", F.coalesce("new_score", F.lit(0))
    )
    out = out.withColumn("score_change", F.col("new_score") - F.col("old_score"))
    for name, change in COUNTED_TYPES.items():
        out = out.withColumn(name, _count(column, "type", change))
    return out.withColumn("overall_severity", overall_severity(column))


def changelog_filter(changelogs: DataFrame, change_type: str | None = None,
                     severity: str | None = None, items: str = "changelog_items") -> DataFrame:
    """Keep only items of a type and severity; counts by type stay those of all items."""

    def wanted(c: Column) -> Column:
        ok = F.lit(True)
        if change_type is not None:
            ok = ok & (c["type"] == change_type)
        if severity is not None:
            ok = ok & (c["severity"] == severity)
        return ok

    counted = changelogs
    for name, change in (("worse", "WORSE"), ("better", "BETTER"), ("neutral", "NEUTRAL")):
        counted = counted.withColumn(name, _count(F.col(items), "type", change))
    return counted.withColumn(items, F.filter(F.col(items), wanted))


def recent_changelogs(changelogs: DataFrame, limit: int = 10, key: str = "domain") -> DataFrame:
    """Newest changelogs per domain."""
    return top_per_key(
        changelogs, [key], [F.col("detected_at").desc(), F.col("new_version_id").desc()], limit
    )


def tracked_changelogs(tracked: DataFrame, changelogs: DataFrame) -> DataFrame:
    """Changelogs of the domains each user tracks.

    Users who track one popular domain are many, its changelogs few: the user side is
    split where a domain is hot.
    """
    return spread_join(tracked.select("user_id", "domain").distinct(), changelogs, ["domain"])


def tracked_changelog_counts(tracked: DataFrame, changelogs: DataFrame) -> DataFrame:
    """Per user the number of changelogs of the tracked domains and the smallest ``new_version_id`` among them.

    The changelogs are counted per domain before they meet the users: the rows that
    meet are those of ``tracked``, not one per user and changelog.
    """
    per_domain = changelogs.groupBy("domain").agg(
        F.count(F.lit(1)).alias("changelogs"), F.min("new_version_id").alias("first_id")
    )
    return tracked_changelogs(tracked, per_domain).groupBy("user_id").agg(
        F.sum("changelogs").alias("changelogs"), F.min("first_id").alias("first_id")
    )


def critical_changes(tracked: DataFrame, changelogs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest CRITICAL or HIGH changelogs per user.

    Only the newest ``limit`` of a domain can be among the newest of any user, so the changelogs
    are cut per domain before they meet the users.
    """
    severe = changelogs.where(F.col("overall_severity").isin("CRITICAL", "HIGH"))
    order = [F.col("detected_at").desc(), F.col("new_version_id").desc()]
    few = top_per_key(severe, ["domain"], order, limit).drop("rank")
    return top_per_key(tracked_changelogs(tracked, few), ["user_id"], order, limit)
