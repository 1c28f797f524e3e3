"""Log, session, queue and list queries; streams over the given files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clauselake.operators import operations as op
from clauselake.functions.text import content_hash
from clauselake.queries.base import HASH, V_ANALYSIS_LOG, V_LOGS, Tables, query, with_views
from clauselake.session import durable, remove, shared_folder
from clauselake.sources.writers import read_state
from clauselake.streaming import jobs

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(with_views(V_ANALYSIS_LOG) + """SELECT success, count(*) AS total, count_if(success) AS successful, count_if(NOT success) AS failed, count(CASE WHEN feedback_type = 'positive' THEN 1 END) AS positive_feedback,
 count(CASE WHEN feedback_type = 'negative' THEN 1 END) AS negative_feedback, CAST(floor(sum(score) / count(score)::DOUBLE + 0.5) AS INT) AS avg_score FROM v_log GROUP BY 1""")
def analysis_stats(t):
    return op.analysis_stats(t.analysis_log, ["success"])


@query(with_views(V_ANALYSIS_LOG) + """SELECT 'failures' AS part, id FROM v_log WHERE NOT success UNION ALL SELECT 'feedback', id FROM v_log WHERE feedback_type IS NOT NULL AND contains(domain, 'site1')
 UNION ALL SELECT * FROM (SELECT 'newest', id FROM v_log WHERE contains(domain, '2.com') ORDER BY timestamp DESC, id DESC LIMIT 50) x""")
def filter_analysis_log(t):
    log = t.analysis_log

    def part(name, df):
        return df.select(F.lit(name).alias("part"), "id")

    return (
        part("failures", op.filter_analysis_log(log, only_failures=True))
        .unionByName(part("feedback", op.filter_analysis_log(log, only_with_feedback=True, domain="site1")))
        .unionByName(part("newest", op.filter_analysis_log(log, domain="2.com", limit=50)))
    )


@query(with_views(V_ANALYSIS_LOG) + """, n AS (SELECT id, domain FROM v_log QUALIFY row_number() OVER (PARTITION BY domain ORDER BY timestamp DESC, id DESC) = 1),
 f AS (SELECT 'site' || c_custkey || '.com' AS domain, CASE WHEN c_custkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS ft, 'https://site' || c_custkey AS fu FROM customer)
SELECT l.id, CASE WHEN f.domain IS NOT NULL AND n.id IS NOT NULL THEN ft ELSE feedback_type END AS feedback_type, CASE WHEN f.domain IS NOT NULL AND n.id IS NOT NULL THEN fu END AS feedback_url
 FROM v_log l LEFT JOIN n ON n.id = l.id LEFT JOIN f ON f.domain = n.domain""")
def attach_feedback(t):
    key = F.col("c_custkey")
    feedback = t.read("customer").select(
        F.concat(F.lit("site"), key.cast("string"), F.lit(".com")).alias("domain"),
        F.when(key % 2 == 0, "positive").otherwise("negative").alias("feedback_type"),
        F.concat(F.lit("https://site"), key.cast("string")).alias("feedback_url"),
        F.lit("2024-03-01").cast("timestamp").alias("feedback_at"),
    )
    return op.attach_feedback(t.analysis_log, feedback).select("id", "feedback_type", "feedback_url")


@query("""SELECT CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS "O", CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS "F", CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS "P", CAST(count_if(o_orderstatus = 'X') AS BIGINT) AS "X" FROM orders""")
def queue_stats(t):
    return op.queue_stats(t.queue, ("O", "F", "P", "X"))


@query("SELECT o_orderkey AS id, o_custkey AS domain FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def next_pending(t):
    return op.next_pending(t.queue, 25, "P").select("id", "domain")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'P' THEN 'completed' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'P' THEN 'done' END AS result FROM orders""")
def set_queue_status(t):
    queue = t.queue.withColumn("result", F.lit(None).cast("string")).withColumn("updated_at", F.col("created_at"))
    done = queue.where("id % 2 = 0 AND status = 'P'").select(
        "id", F.lit("completed").alias("status"), F.lit("done").alias("result")
    )
    return op.set_status(queue, done, F.lit("2024-01-01").cast("timestamp")).select("id", "status", "result")


TABLES = ("customer", "orders", "documents", "events", "pages", "supplier")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES))
def table_counts(t):
    return op.table_counts({n: t.read(n) for n in TABLES})


@query(f"SELECT event_id, user_id, {STAMP.format('ts')} AS ts FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 20")
def recent_rows(t):
    return op.recent(t.read("events").select("event_id", "user_id", "ts"), "ts", 20, ["event_id"]).withColumn(
        "ts", _stamp("ts")
    )


@query("""SELECT c_custkey, contains(lower(c_name), 'er#0000') AS by_name, contains(lower(c_mktsegment), 'mach') AS by_segment FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)) AND c_acctbal <> 0""")
def filtered_customers(t):
    """Equality, inequality, lists and text parts; the list from a table is a semi-join."""
    nations = t.read("nation").where(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("c_nationkey"))
    rows = t.read("customer").where(F.col("c_acctbal") != 0).join(nations, "c_nationkey", "left_semi")
    return rows.select("c_custkey", op.contains_ci("c_name", "ER#0000").alias("by_name"),
                       op.contains_ci("c_mktsegment", "MACH").alias("by_segment"))


# --------------------------------------------------------------------------- sessions

SESSION_SQL = """, p AS (SELECT session_id, phase, count(*) AS n, min(ts) AS a, max(ts) AS b, arg_min(CASE WHEN phase = 'signup' THEN data ->> '$.k' END, struct_pack(t := ts, d := CASE WHEN phase = 'signup' THEN data ->> '$.k' END)) AS i FROM {src} GROUP BY 1, 2)
SELECT session_id, strftime(min(a), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(max(b), '%Y-%m-%d %H:%M:%S') AS end_time, CAST(sum(n) AS BIGINT) AS entries, coalesce(max(i), 'Unknown') AS input, string_agg(phase, ',' ORDER BY phase) AS phases FROM p GROUP BY 1"""


def _sessions(df):
    return df.select(
        "session_id", _stamp("start_time"), _stamp("end_time"), "entries", "input",
        F.array_join("phases", ",").alias("phases"),
    )


@query(with_views(V_LOGS) + SESSION_SQL.format(src="v_logs"))
def log_sessions(t):
    return _sessions(op.log_sessions(t.logs, None, "signup", "$.k"))


@query(with_views(V_LOGS, "v_newest AS (SELECT * FROM v_logs ORDER BY ts DESC, session_id DESC, phase DESC LIMIT 1000)") + SESSION_SQL.format(src="v_newest"))
def log_sessions_newest(t):
    """The list view: sessions of the newest 1000 entries."""
    return _sessions(op.log_sessions(t.logs, 1000, "signup", "$.k"))


@query(with_views(V_LOGS) + """SELECT session_id FROM v_logs GROUP BY 1 HAVING contains(CAST(session_id AS VARCHAR), '1') AND count_if(phase = 'error') > 0""")
def filter_sessions(t):
    rows = op.log_sessions(t.logs, None, "signup", "$.none").withColumn("input", F.lit(""))
    return op.filter_sessions(rows, "1", "error").select("session_id")


@query(with_views(V_LOGS) + """SELECT session_id, CAST(count_if(category = 'network') AS BIGINT) AS http_requests, CAST(count_if(level = 'error') AS BIGINT) AS errors, count(DISTINCT CASE WHEN category = 'discovery' AND contains(subcategory, 'strategy') THEN subcategory END) AS strategies,
 (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms, CASE WHEN count_if(subcategory = 'session_end') > 0 THEN 'success' ELSE 'running' END AS status FROM v_logs GROUP BY 1""")
def session_summary(t):
    return op.session_summary(t.logs).drop("start_time", "end_time")


V_REQUESTS = """v_requests AS (SELECT event_type AS host, ts, event_id AS id FROM events)"""


def _requests(t):
    return t.read("events").select(F.col("event_type").alias("host"), "ts", F.col("event_id").alias("id"))


@query(with_views(V_REQUESTS) + f"SELECT host, {STAMP.format('w')} AS window_start, count(*) AS requests FROM (SELECT host, time_bucket(INTERVAL '30 minutes', ts) AS w FROM v_requests) x GROUP BY 1, x.w HAVING count(*) > 3")
def request_bursts(t):
    return op.request_bursts(_requests(t), "30 minutes", 3).withColumn("window_start", _stamp("window_start"))


@query(with_views(V_REQUESTS) + """SELECT host, id, gap AS gap_ms FROM (SELECT host, id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY host ORDER BY ts, id))) // 1000 AS gap FROM v_requests) x WHERE gap < 60000""")
def request_spacing(t):
    return op.request_spacing(_requests(t), 60000).drop("ts")


SESSIONS = f""", g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM v_logs WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS sid FROM g)
SELECT session_id, {STAMP.format('min(ts)')} AS start_time, {STAMP.format("max(ts) + INTERVAL '6 hours'")} AS end_time, count(*) AS entries, CAST(count_if(category = 'network') AS BIGINT) AS http_requests, CAST(count_if(level = 'error') AS BIGINT) AS errors FROM s GROUP BY session_id, sid"""


@query(with_views(V_LOGS) + SESSIONS)
def windowed_log_sessions(t):
    rows = jobs.stream_log_sessions(t.logs, "6 hours")
    return rows.withColumn("start_time", _stamp("start_time")).withColumn("end_time", _stamp("end_time"))


# --------------------------------------------------------------------------- streams


def _stream(t: Tables, table: str):
    """The files of a table as a stream. A pattern fits a single file and a folder of files; a stream over a plain path
    must be a folder."""
    return t.spark.readStream.schema(t.read(table).schema).parquet(f"{t.sf_dir}/{table}.parque[t]")


def _run(t: Tables, stream):
    """Run a stream over the files that are there; sink and state go to the shared folder."""
    root = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_available(stream, f"{root}/out", f"{root}/state")
    out = durable(t.spark.read.schema(stream.schema).parquet(f"{root}/out"))
    remove(t.spark, root)
    return out


CHANGE_SQL = f"""WITH v AS (SELECT source AS domain, lang AS policy_type, {HASH} AS h, CAST(1 + (doc_id * 37) % 100 AS INT) AS score, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS at_time FROM documents),
 l AS (SELECT *, lag(h) OVER w AS ph, lag(score) OVER w AS ps FROM v WINDOW w AS (PARTITION BY domain, policy_type ORDER BY at_time))
SELECT domain, policy_type, {STAMP.format('at_time')} AS analyzed_at, ps AS old_score, score AS new_score, CASE WHEN ps <> score THEN 'score_changed' ELSE 'content_changed' END AS change_type FROM l WHERE ph IS NOT NULL AND (ph <> h OR ps <> score)"""


def _snapshots(t):
    d = _stream(t, "documents")
    return d.select(
        F.col("source").alias("domain"), F.col("lang").alias("policy_type"),
        content_hash(F.col("text")).alias("content_hash"),
        (1 + (F.col("doc_id") * 37) % 100).cast("int").alias("score"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("analyzed_at"),
    )


@query(CHANGE_SQL)
def stream_policy_changes(t):
    """Keyed state in the streaming engine."""
    out = _run(t, jobs.stream_policy_changes(_snapshots(t)))
    return out.withColumn("analyzed_at", _stamp("analyzed_at"))


@query(CHANGE_SQL + " AND at_time >= TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((SELECT max(doc_id) // 4 FROM documents) AS INT))")
def stateful_policy_changes(t):
    """State that begins with a table: the oldest quarter is known, the rest comes as a stream in three parts."""
    root, spark = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}", t.spark
    d = t.read("documents")
    rows = durable(d.select(
        F.col("source").alias("domain"), F.col("lang").alias("policy_type"), content_hash(F.col("text")).alias("content_hash"),
        (1 + (F.col("doc_id") * 37) % 100).cast("int").alias("score"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("analyzed_at"), "doc_id"))
    last = rows.agg(F.max("doc_id")).first()[0] or 0
    cuts = [last // 4, last // 2, last * 3 // 4, last + 1]
    known = rows.where(F.col("doc_id") < cuts[0]).drop("doc_id")
    before = spark.conf.get(jobs.STORE[0])
    spark.conf.set(*jobs.STORE)
    try:
        for low, high in zip(cuts, cuts[1:]):
            rows.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).drop("doc_id").write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", 1000).parquet(f"{root}/in")
            jobs.run_available(jobs.stateful_policy_changes(stream, known), f"{root}/out", f"{root}/state")
    finally:
        spark.conf.set(jobs.STORE[0], before)
    out = durable(spark.read.parquet(f"{root}/out"))
    remove(spark, root)
    return out.withColumn("analyzed_at", _stamp("analyzed_at"))


@query(CHANGE_SQL)
def batched_policy_changes(t):
    """State as a table, each micro-batch through the batch operators."""
    root = f"{shared_folder(t.spark)}/changes-{uuid.uuid4().hex}"
    jobs.run_policy_changes(_snapshots(t), root, f"{root}/checkpoint")
    out = durable(read_state(t.spark, f"{root}/changes", t.spark.createDataFrame([], jobs.CHANGE_SCHEMA)).drop("batch"))
    remove(t.spark, root)
    return out.withColumn("analyzed_at", _stamp("analyzed_at"))


@query(with_views(V_REQUESTS) + f"""SELECT host, {STAMP.format('w')} AS window_start, count(*) AS requests FROM (SELECT host, time_bucket(INTERVAL '30 minutes', ts) AS w FROM v_requests) x
 WHERE w + INTERVAL '30 minutes' <= (SELECT max(ts) FROM v_requests) - INTERVAL '1 minute' GROUP BY host, w HAVING count(*) > 3""")
def stream_request_bursts(t):
    """Windows that ended before the watermark; open ones are written when later files close them."""
    e = _stream(t, "events")
    rows = e.select(F.col("event_type").alias("host"), "ts", F.col("event_id").alias("id"))
    out = _run(t, jobs.stream_request_bursts(rows, "30 minutes", 3))
    return out.withColumn("window_start", _stamp("window_start"))


@query(with_views(V_LOGS) + SESSIONS + " HAVING max(ts) + INTERVAL '6 hours' <= (SELECT max(ts) FROM v_logs) - INTERVAL '1 hour'")
def stream_log_sessions(t):
    """Sessions that ended before the watermark; open ones are written when later files close them."""
    rows = _stream(t, "events").select(
        F.col("user_id").alias("session_id"), "ts",
        F.when(F.col("event_type") == "view", "network").otherwise("system").alias("category"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
    )
    out = _run(t, jobs.stream_log_sessions(rows, "6 hours"))
    return out.withColumn("start_time", _stamp("start_time")).withColumn("end_time", _stamp("end_time"))




# --------------------------------------------------------------------------- streams to their end


def _run_to_end(t: Tables, rows, build):
    root = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_to_end(rows, build, f"{root}/out", f"{root}/state", f"{root}/marks")
    out = durable(t.spark.read.parquet(f"{root}/out"))
    remove(t.spark, root)
    return out


def _delivered_twice(rows):
    """A third of the entries comes a second time."""
    return rows.unionByName(rows.where(F.col("event_id") % 3 == 0))


@query(with_views(V_REQUESTS) + f"""SELECT host, {STAMP.format('w')} AS window_start, count(*) AS requests
 FROM (SELECT host, time_bucket(INTERVAL '30 minutes', ts) AS w FROM v_requests) x GROUP BY host, w HAVING count(*) > 3""")
def stream_request_bursts_to_end(t):
    """All windows, also those that are open when the entries end; repeated requests count once."""
    rows = _delivered_twice(_stream(t, "events").select(F.col("event_type").alias("host"), "ts", "event_id", F.col("event_id").alias("id")))
    out = _run_to_end(t, rows, lambda r: jobs.stream_request_bursts(r, "30 minutes", 3, once_by=["event_id"]))
    return out.withColumn("window_start", _stamp("window_start"))


@query(with_views(V_LOGS) + SESSIONS)
def stream_log_sessions_to_end(t):
    """All sessions, also those that are open when the log ends; repeated entries count once."""
    rows = _delivered_twice(_stream(t, "events").select(
        F.col("user_id").alias("session_id"), "ts", "event_id",
        F.when(F.col("event_type") == "view", "network").otherwise("system").alias("category"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
    ))
    out = _run_to_end(t, rows, lambda r: jobs.stream_log_sessions(r, "6 hours", once_by=["event_id"]))
    return out.withColumn("start_time", _stamp("start_time")).withColumn("end_time", _stamp("end_time"))
