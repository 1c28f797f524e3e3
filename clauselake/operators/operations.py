"""Logs, sessions, queue and list views of an analysis service."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import terms as tm
from clauselake.operators.keyed import with_previous

# Queue states.
QUEUE_STATES = ("pending", "processing", "completed", "failed")


def _millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end."""
    span = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(span / 1000).cast("long")


def contains_ci(column: str | Column, text: str) -> Column:
    """Case-blind substring test; an empty text fits everything."""
    col = F.col(column) if isinstance(column, str) else column
    return F.contains(F.lower(col.cast("string")), F.lit(text.lower()))


def filter_analysis_log(log: DataFrame, only_failures: bool = False,
                        only_with_feedback: bool = False, domain: str | None = None,
                        limit: int | None = None) -> DataFrame:
    """Analysis log by outcome, feedback and part of the domain, newest first when limited."""
    out = log
    if only_failures:
        out = out.where(~F.col("success"))
    if only_with_feedback:
        out = out.where(F.col("feedback_type").isNotNull())
    if domain is not None:
        out = out.where(F.contains(F.col("domain"), F.lit(domain)))
    return out if limit is None else recent(out, "timestamp", limit, ["id"])


def recent(rows: DataFrame, time: str, limit: int = 20, ties: Sequence[str] = ()) -> DataFrame:
    """Newest rows; every task sends at most ``limit`` of them."""
    return rows.orderBy(F.col(time).desc(), *[F.col(c).desc() for c in ties]).limit(limit)


def analysis_stats(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, outcomes, feedback and rounded mean score."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("feedback_type") == "positive").alias("positive_feedback"),
        F.count_if(F.col("feedback_type") == "negative").alias("negative_feedback"),
        F.when(
            F.count("score") > 0, tm.round_half_up(F.sum("score") / F.count("score"))
        ).alias("avg_score"),
    )


def attach_feedback(log: DataFrame, feedback: DataFrame,
                    order: Sequence[str] = ("timestamp", "id")) -> DataFrame:
    """Set feedback on the newest analysis of each domain.

    ``feedback``: domain, feedback_type, feedback_url, feedback_at; the newest row per domain
    counts. Only (domain, id) of the newest analyses travels; the log keeps its other columns.
    """
    newest = log.groupBy("domain").agg(F.max_by("id", F.struct(*order)).alias("id"))
    said = feedback.groupBy("domain").agg(
        F.max_by(
            F.struct("feedback_type", "feedback_url", "feedback_at"),
            F.struct("feedback_at", "feedback_type"),
        ).alias("_said")
    )
    target = newest.join(said, "domain").select("id", "_said")
    joined = log.join(target, "id", "left")
    names = ("feedback_type", "feedback_url", "feedback_at")
    hit = F.col("_said").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col(f"_said.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
            for c in log.columns
        ]
    )


def queue_stats(queue: DataFrame, states: Sequence[str] = QUEUE_STATES) -> DataFrame:
    """One row with a count per state; states that do not occur stay at 0, others are ignored."""
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


def next_pending(queue: DataFrame, n: int = 1, status: str = "pending") -> DataFrame:
    """Oldest waiting items, as a plan for a worker; nothing is locked."""
    return queue.where(F.col("status") == status).orderBy("created_at", "id").limit(n)


def set_status(queue: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Queue with the state and result of finished items (``id, status, result``)."""
    new = results.select("id", F.col("status").alias("_status"), F.col("result").alias("_result"))
    joined = queue.join(new, "id", "left")
    done = F.col("_status").isNotNull()
    swap = {"status": F.col("_status"), "result": F.col("_result"), "updated_at": at}
    return joined.select(
        *[
            F.when(done, swap[c]).otherwise(F.col(c)).alias(c) if c in swap else F.col(c)
            for c in queue.columns
        ]
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` of each table; Parquet counts come from file footers."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        out = row if out is None else out.unionByName(row)
    return out


# --------------------------------------------------------------------------- sessions


def log_sessions(logs: DataFrame, newest: int | None = None, init_phase: str = "request_init",
                 input_path: str = "$.input") -> DataFrame:
    """Sessions of the log: first and last time, input, distinct phases.

    ``logs``: session_id, phase, ts, data (JSON text). ``newest`` takes that many entries only. The
    log is first reduced to one row per session and phase, so a session's list is as long as the
    number of different phases.
    """
    rows = logs if newest is None else recent(logs, "ts", newest, ["session_id", "phase"])
    asked = F.when(F.col("phase") == init_phase, F.get_json_object("data", input_path))
    per_phase = rows.groupBy("session_id", "phase").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
        F.min_by(asked, F.struct("ts", asked)).alias("_input"),
    )
    return per_phase.groupBy("session_id").agg(
        F.min("_first").alias("start_time"),
        F.max("_last").alias("end_time"),
        F.sum("_n").alias("entries"),
        F.coalesce(F.max("_input"), F.lit("Unknown")).alias("input"),
        F.sort_array(F.collect_list("phase")).alias("phases"),
    )


def all_phases(logs: DataFrame) -> DataFrame:
    return logs.select("phase").distinct()


def filter_sessions(sessions: DataFrame, text: str = "", phase: str | None = None) -> DataFrame:
    """Sessions whose input or id holds a text and that went through a phase."""
    out = sessions.where(contains_ci("input", text) | contains_ci("session_id", text))
    return out if phase is None else out.where(F.array_contains("phases", phase))


def session_summary(entries: DataFrame) -> DataFrame:
    """Requests, errors, distinct strategies, duration and outcome per session.

    ``entries``: session_id, ts, category, subcategory, level, strategy (may be null). The outcome
    is the level of the ``session_end`` entry: ``success`` on info, ``failed`` otherwise, and
    ``running`` when there is none.
    """
    is_strategy = (F.col("category") == "discovery") & F.contains(
        F.col("subcategory"), F.lit("strategy")
    )
    name = F.when(is_strategy, F.coalesce("strategy", "subcategory"))
    ended = F.col("subcategory") == "session_end"
    per_strategy = entries.withColumn("_strategy", name).groupBy("session_id", "_strategy").agg(
        F.count_if(F.col("category") == "network").alias("_http"),
        F.count_if(F.col("level").isin("error", "critical")).alias("_errors"),
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
        F.max(F.when(ended, F.when(F.col("level") == "info", "success").otherwise("failed"))).alias(
            "_status"
        ),
    )
    return per_strategy.groupBy("session_id").agg(
        F.sum("_http").alias("http_requests"),
        F.sum("_errors").alias("errors"),
        F.count("_strategy").alias("strategies"),
        F.min("_first").alias("start_time"),
        F.max("_last").alias("end_time"),
        _millis_between(F.min("_first"), F.max("_last")).alias("duration_ms"),
        F.coalesce(F.max("_status"), F.lit("running")).alias("status"),
    )


def request_bursts(requests: DataFrame, window: str = "15 seconds", limit: int = 5) -> DataFrame:
    """Windows in which a host got more than ``limit`` requests."""
    return (
        requests.groupBy("host", F.window("ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > limit)
        .select("host", F.col("w.start").alias("window_start"), "requests")
    )


def request_spacing(requests: DataFrame, least_ms: int = 2000) -> DataFrame:
    """Requests that follow the one before to the same host by less than ``least_ms``.

    ``requests``: host, ts, id. A host with very many requests is split over range partitions.
    """
    pairs = with_previous(requests.select("host", "ts", "id"), ["host"], ["ts", "id"], ["ts"])
    gap = _millis_between(F.col("prev_ts"), F.col("ts"))
    return pairs.where(gap < least_ms).select("host", "id", "ts", gap.alias("gap_ms"))


