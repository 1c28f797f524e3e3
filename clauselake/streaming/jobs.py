"""Policy changes, log sessions and request bursts as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clauselake.session import durable
from clauselake.sources.writers import read_state

CHANGE_SCHEMA = (
    "domain string, policy_type string, analyzed_at timestamp, old_score int, new_score int, "
    "change_type string"
)
STATE_SCHEMA = "content_hash string, score int, analyzed_at timestamp"


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
             ) -> Iterator[pd.DataFrame]:
    """Compare the snapshots of one key, oldest first, with the last state.

    Only the newest few columns of a key are held; snapshots not newer than the state are late
    and dropped.
    """
    moved, newest = _compared(key, batches, state.get if state.exists else None)
    if newest is not None:
        state.update(newest)
    if moved is not None:
        yield moved


def _compared(key: tuple, batches: Iterator[pd.DataFrame], before: tuple | None) -> tuple[pd.DataFrame | None, tuple | None]:
    """Changes among the snapshots of one key behind its last ``(hash, score, time)``, and the newest one."""
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["analyzed_at", "content_hash"])
    old_hash, old_score, last = before or (None, None, None)
    if last is not None:
        rows = rows[rows["analyzed_at"] > pd.Timestamp(last)]
    rows = rows.drop_duplicates("analyzed_at")
    if rows.empty:
        return None, None
    score = rows["score"].astype("Int32")
    before_hash, before = rows["content_hash"].shift(), score.shift()
    known = pd.Series(True, rows.index)
    before_hash.iloc[0], before.iloc[0], known.iloc[0] = old_hash, old_score, last is not None
    moved_score = (score != before).fillna(True) & ~(score.isna() & before.isna())
    moved = known & (moved_score | (rows["content_hash"] != before_hash))
    last_row = rows.iloc[-1]
    newest = (last_row["content_hash"], None if pd.isna(last_row["score"]) else int(last_row["score"]),
              pd.Timestamp(last_row["analyzed_at"]).to_pydatetime())
    if not moved.any():
        return None, newest
    return pd.DataFrame({
        "domain": key[0], "policy_type": key[1], "analyzed_at": pd.to_datetime(rows["analyzed_at"]),
        "old_score": before, "new_score": score,
        "change_type": moved_score.map({True: "score_changed", False: "content_changed"}),
    })[moved], newest


class ChangeProcessor(StatefulProcessor):
    """Keeps the last snapshot of a key as a value, and a timer that clears the value of a silent key."""

    def __init__(self, silent_ms: int | None = None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE_SCHEMA)

    def _keep(self, newest: tuple) -> None:
        """Remember the snapshot until the watermark is ``silent_ms`` behind it (times are those of a UTC session)."""
        self.last.update(newest)
        if self.silent_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(pd.Timestamp(newest[2], tz="UTC").timestamp() * 1000) + self.silent_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        moved, newest = _compared(key, rows, self.last.get() if self.last.exists() else None)
        if newest is not None:
            self._keep(newest)
        if moved is not None:
            yield moved

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # Several rows of one key: the newest one counts, as it would in the stream.
        self._keep(_compared(key, iter([initialState]), None)[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


#: State of this kind needs the store on local disks with changes in the checkpoint folder.
STORE = ("spark.sql.streaming.stateStore.providerClass",
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stateful_policy_changes(snapshots: DataFrame, known: DataFrame | None = None, late: str = "1 hour",
                            silent_ms: int | None = None) -> DataFrame:
    """The changes of ``stream_policy_changes`` with state that begins with a table and ends with silence.

    ``known`` holds the last snapshots before the stream, in the same columns; it is read by the first batch only.
    A key without snapshots for ``silent_ms`` of event time is forgotten, and its next snapshot is a first one again; null
    keeps all. The session must use the state store that ``STORE`` names. Limit a batch by ``maxFilesPerTrigger``:
    the narrow rows of a key in one batch are sorted in one task.
    """
    keys, columns = ["domain", "policy_type"], ["domain", "policy_type", "content_hash", "score", "analyzed_at"]
    start = None if known is None else known.select(*columns).groupBy(*keys)
    rows = snapshots.select(*columns).withWatermark("analyzed_at", late)
    return rows.groupBy(*keys).transformWithStateInPandas(
        ChangeProcessor(silent_ms), CHANGE_SCHEMA, "append", "EventTime" if silent_ms is not None else "None", start)


def stream_policy_changes(snapshots: DataFrame) -> DataFrame:
    """Changes of hash or score per (domain, policy type) from a stream of snapshots.

    ``snapshots``: domain, policy_type, content_hash, score, analyzed_at. The state per key is one
    hash, one score and one time. The rows of one key in one micro-batch are sorted in one task:
    limit the batch (``maxFilesPerTrigger``), or use ``run_policy_changes`` where one key may hold
    much of a large batch.
    """
    narrow = snapshots.select("domain", "policy_type", "content_hash", "score", "analyzed_at")
    return narrow.groupBy("domain", "policy_type").applyInPandasWithState(
        _changes, CHANGE_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def policy_changes_batch(snapshots: DataFrame) -> DataFrame:
    """The same changes from all snapshots at once."""
    from clauselake.operators.keyed import with_previous

    narrow = snapshots.select("domain", "policy_type", "content_hash", "score", "analyzed_at")
    pairs = with_previous(
        narrow, ["domain", "policy_type"], ["analyzed_at", "content_hash"],
        ["content_hash", "score", "analyzed_at"],
    ).where(F.col("prev_analyzed_at").isNotNull())
    score_moved = ~F.col("score").eqNullSafe(F.col("prev_score"))
    moved = score_moved | (F.col("content_hash") != F.col("prev_content_hash"))
    return pairs.where(moved).select(
        "domain", "policy_type", "analyzed_at", F.col("prev_score").alias("old_score"),
        F.col("score").alias("new_score"),
        F.when(score_moved, "score_changed").otherwise("content_changed").alias("change_type"),
    )


def run_policy_changes(snapshots: DataFrame, root: str, checkpoint: str) -> None:
    """Changes from a stream of snapshots with batch operators, for hot keys and large batches.

    Each micro-batch is put behind the last state of its keys and compared row by row over range
    partitions, so a key with most of the rows is spread over tasks. Changes go to
    ``root/changes/batch=N``, the state after batch N to ``root/state/batch=N``. Both are written
    whole per batch number, so a repeated batch gives the same result again. Snapshots not newer
    than the state of their key are late and dropped.
    """
    keys = ["domain", "policy_type"]
    columns = [*keys, "content_hash", "score", "analyzed_at"]

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns)
        before = read_state(batch.sparkSession, f"{root}/state/batch={number - 1}", rows.limit(0))
        held = before.select(*keys, F.col("analyzed_at").alias("_last"))
        fresh = rows.join(held, keys, "left").where(
            F.col("_last").isNull() | (F.col("analyzed_at") > F.col("_last"))
        ).select(*columns)
        touched = before.join(fresh.select(*keys).distinct(), keys, "left_semi")
        # Written once: the changes and the new state both read it.
        timeline = durable(touched.select(*columns).unionByName(fresh))
        policy_changes_batch(timeline).write.mode("overwrite").parquet(
            f"{root}/changes/batch={number}"
        )
        newest = timeline.groupBy(*keys).agg(
            F.max_by(
                F.struct("content_hash", "score", "analyzed_at"),
                F.struct("analyzed_at", "content_hash"),
            ).alias("_new")
        ).select(*keys, "_new.*")
        unmoved = before.select(*columns).join(newest.select(*keys), keys, "left_anti")
        unmoved.unionByName(newest).write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    query = (
        snapshots.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _timed(rows: DataFrame, late: str, once_by: Sequence[str] = ()) -> DataFrame:
    """Event time as a zoned timestamp, with a watermark on streams; each key ``once_by`` once."""
    out = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    if not rows.isStreaming:
        return out.dropDuplicates(list(once_by)) if once_by else out
    out = out.withWatermark("ts", late)
    return out.dropDuplicatesWithinWatermark(list(once_by)) if once_by else out


def stream_log_sessions(logs: DataFrame, gap: str = "30 minutes", late: str = "1 hour",
                        once_by: Sequence[str] = ()) -> DataFrame:
    """Sessions of a log stream, closed after a pause of ``gap``.

    ``logs``: session_id, ts, category, level. Works on a batch frame too; the watermark is then
    ignored. Entries that are delivered again are counted once if ``once_by`` names their key; a stream knows them again
    for as long as the watermark allows.
    """
    rows = _timed(logs, late, once_by)
    return (
        rows.groupBy("session_id", F.session_window("ts", gap).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.count_if(F.col("category") == "network").alias("http_requests"),
            F.count_if(F.col("level").isin("error", "critical")).alias("errors"),
        )
        .select(
            "session_id", F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"),
            "entries", "http_requests", "errors",
        )
    )


def stream_request_bursts(requests: DataFrame, window: str = "15 seconds", limit: int = 5,
                          late: str = "1 minute", once_by: Sequence[str] = ()) -> DataFrame:
    """Windows in which a host got more than ``limit`` requests.

    Counts are partial on every task before the shuffle, so a busy host sends one row per window
    and task. ``once_by`` names the key of a request that may be delivered again.
    """
    from clauselake.operators.operations import request_bursts

    rows = _timed(requests, late, once_by)
    return request_bursts(rows, window, limit)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, write Parquet to ``sink``, stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


#: Event time of the end mark, later than any entry.
END = "9999-01-01 00:00:00"


def run_to_end(rows: DataFrame, build: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, marks: str,
               time: str = "ts") -> None:
    """Process what is there and close what is open: the stream ends with this run.

    ``build`` makes the result stream from ``rows``. When all entries are read, a mark with nothing but a very late
    ``time`` is written to the folder ``marks``, which the same query reads as well. It moves the watermark past all
    windows, so that they are written by the engine itself; its own window is never closed. Entries that come
    later are late and dropped: call ``run_available`` instead as long as more is expected. A run that broke off
    is finished by calling it again.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(marks)
    both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(marks))
    run_available(build(both), sink, checkpoint)
    mark = [F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in rows.schema]
    spark.range(1).select(*mark).coalesce(1).write.mode("append").parquet(marks)
    run_available(build(both), sink, checkpoint)
