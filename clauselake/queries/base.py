"""Registry, table access, bridge views and small SQL builders.

The given tables hold no policy words, so queries pass word lists that do occur. Bridge views give
the tables the shapes of versions, services, breaches, logs and candidates; each exists as a data
frame and as SQL text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import text as tx
from clauselake.operators.staging import computed
from clauselake.sources.tables import balanced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL when it has one."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


class Tables:
    """The given tables of one scale factor and the bridge views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return balanced(self.read("documents"), "doc_id")

    @property
    def pages(self) -> DataFrame:
        return balanced(self.read("pages"), "page_id")

    @property
    def laid_pages(self) -> DataFrame:
        """Pages whose menu stays one, or becomes a footer, a legal box or part of the body, in turn."""
        html = F.col("html")
        for i, (start, end) in enumerate(LAYOUTS):
            moved = F.replace(F.replace("html", F.lit("<nav>"), F.lit(start)), F.lit("</nav>"), F.lit(end))
            html = F.when(F.col("page_id") % len(LAYOUTS) == i, moved).otherwise(html)
        return self.pages.withColumn("html", html)

    # -- bridge views

    @property
    def versions(self) -> DataFrame:
        # Plain columns: a query that does not use one of them never reads or works it out.
        return self.documents.select(
            F.col("doc_id").alias("id"), F.col("source").alias("domain"),
            F.col("lang").alias("policy_type"), F.col("text").alias("raw_text"),
            tx.content_hash(F.col("text")).alias("content_hash"),
            tx.word_count(F.col("text")).alias("word_count"),
            (1 + (F.col("doc_id") * 37) % 100).cast("int").alias("score"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("analyzed_at"),
        )

    @property
    def analyses(self) -> DataFrame:
        """Analysis results by version: findings, data types, sharing, clauses."""
        d = F.col("doc_id")

        def pick(values: Sequence[str], i) -> "F.Column":
            return F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))

        return self.read("documents").select(
            d.alias("id"), F.col("source").alias("domain"), F.col("lang").alias("policy_type"),
            F.array(
                F.struct(pick(CATEGORIES, d).alias("category"),
                         F.concat(pick(SAYINGS, d), F.lit(" "), F.col("source")).alias("text")),
                F.struct(pick(CATEGORIES, d * 5 + 1).alias("category"),
                         F.concat(pick(SAYINGS, d + 3), F.lit(" "), F.col("lang")).alias("text")),
                F.struct(pick(CATEGORIES, d * 7 + 2).alias("category"),
                         F.concat(pick(SAYINGS, d * 3 + 1), F.lit(" x")).alias("text")),
            ).alias("key_findings"),
            F.array_distinct(
                F.array(pick(TYPE_NAMES, d), pick(TYPE_NAMES, d * 7), F.col("source"))
            ).alias("data_collected"),
            F.slice(
                F.array(*[F.lit(s) for s in SHARING]), (d % 4 + 1).cast("int"),
                (d % 7).cast("int"),
            ).alias("third_party_sharing"),
            F.slice(
                F.array(*[F.lit(c) for c in CLAUSES]), (d % 3 + 1).cast("int"),
                (d % 4).cast("int"),
            ).alias("clauses_found"),
            pick(LEVELS, d).alias("reading_level"),
            F.when(d % 5 == 0, F.lit("mail")).alias("contact_info"),
        )

    @property
    def services(self) -> DataFrame:
        """Latest score and version per user and domain, from all analyses."""
        from clauselake.operators.risk import service_counts

        return service_counts(self.service_analyses)

    @property
    def service_analyses(self) -> DataFrame:
        """One row per analysis of a service; the version is unique within user, domain, time."""
        items = self.read("lineitem").select(
            "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_partkey", "l_shipdate"
        )
        orders = self.read("orders").select("o_orderkey", "o_custkey")
        return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("domain"),
            F.when(F.col("l_linenumber") != 7, (F.col("l_quantity") * 2).cast("int")).alias("score"),
            F.col("l_partkey").alias("version_id"), F.col("l_shipdate").alias("analyzed_at"),
        ).groupBy("user_id", "domain", "analyzed_at", "version_id").agg(F.max("score").alias("score"))

    @property
    def profiles(self) -> DataFrame:
        region = F.get(F.array(*[F.lit(r) for r in REGIONS]), F.col("c_nationkey") % 8)
        return self.read("customer").select(
            F.col("c_custkey").alias("user_id"), region.alias("region"),
            F.array(
                F.when(F.col("c_mktsegment") == "AUTOMOBILE", "limit_tracking")
                .when(F.col("c_mktsegment") == "HOUSEHOLD", "protect_family")
                .when(F.col("c_mktsegment") == "BUILDING", "avoid_data_selling")
                .otherwise("monitor_changes")
            ).alias("goals"),
        )

    @property
    def breaches(self) -> DataFrame:
        items = self.read("lineitem").where("l_returnflag = 'R'").select(
            "l_orderkey", "l_partkey", "l_shipdate", "l_linestatus", "l_linenumber"
        )
        orders = self.read("orders").select("o_orderkey", "o_custkey")
        parts = self.read("part").select("p_partkey", "p_type", "p_brand")
        return (
            items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("o_custkey").alias("user_id"), F.col("l_shipdate").alias("breach_date"),
                F.array("p_type", "p_brand").alias("data_classes"),
                (F.col("l_linestatus") == "F").alias("is_verified"),
                (F.col("l_linenumber") == 3).alias("is_retired"),
            )
        )

    @property
    def candidates(self) -> DataFrame:
        item = self.read("lineitem").select(
            "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"
        )
        return item.select(
            F.concat(F.lit("d"), F.col("l_suppkey").cast("string"), F.lit(".example.com")).alias(
                "domain"
            ),
            F.get(F.array(*[F.lit(s) for s in SOURCES]), F.col("l_linenumber") - 1).alias("source"),
            (F.col("l_quantity") * 2).cast("int").alias("confidence"),
            F.concat(
                F.lit("https://d"), F.col("l_suppkey").cast("string"), F.lit(".example.com/p"),
                F.col("l_partkey").cast("string"),
            ).alias("url"),
            F.get(F.array(*[F.lit(t) for t in TYPES]), (F.col("l_partkey") % 8).cast("int")).alias(
                "type"
            ),
            F.col("l_partkey").alias("part"),
        )

    @property
    def logs(self) -> DataFrame:
        e = F.col("event_type")
        return self.read("events").select(
            F.col("user_id").alias("session_id"), e.alias("phase"), "ts",
            F.col("props").alias("data"), "event_id",
            F.when(e == "view", "network").when(e == "click", "discovery").otherwise("system").alias(
                "category"
            ),
            F.when(e == "click", F.concat(F.lit("strategy_"), F.get_json_object("props", "$.k")))
            .when(e == "signup", "session_end").otherwise("step").alias("subcategory"),
            F.when(e == "error", "error").otherwise("info").alias("level"),
            F.lit(None).cast("string").alias("strategy"),
        )

    @property
    def analysis_log(self) -> DataFrame:
        kind = F.col("event_type")
        return self.read("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("site"), F.col("user_id").cast("string"), F.lit(".com")).alias("domain"),
            F.col("ts").alias("timestamp"), (kind != "error").alias("success"),
            F.when(kind != "error", F.floor("value").cast("int")).alias("score"),
            F.when(kind == "purchase", "positive").when(kind == "signup", "negative").alias(
                "feedback_type"
            ),
            F.lit(None).cast("string").alias("feedback_url"),
            F.lit(None).cast("timestamp").alias("feedback_at"),
        )

    @property
    def queue(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("domain"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"),
        )

    @property
    def votes(self) -> DataFrame:
        return self.read("events").select(
            "user_id", F.col("event_type").alias("domain"), F.col("value").alias("score"), "ts",
            F.col("event_id").alias("id"),
        )

    @property
    def changelogs(self) -> DataFrame:
        items = (
            self.read("lineitem")
            .select(
                "l_orderkey",
                F.struct(
                    F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
                    F.when(F.col("l_returnflag") == "R", "WORSE")
                    .when(F.col("l_returnflag") == "A", "BETTER").otherwise("NEUTRAL").alias("type"),
                    F.get(
                        F.array(*[F.lit(s) for s in CHANGE_SEVERITIES]), F.col("l_linenumber") - 1
                    ).alias("severity"),
                    F.col("l_linestatus").alias("category"),
                ).alias("item"),
            )
            .groupBy("l_orderkey")
            .agg(F.sort_array(F.collect_list("item")).alias("changelog_items"))
        )
        return (
            self.read("orders")
            .join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
            .select(
                F.concat(F.lit("d"), (F.col("o_custkey") % 97).cast("string")).alias("domain"),
                F.col("o_custkey").alias("old_version_id"), F.col("o_orderkey").alias("new_version_id"),
                "changelog_items", F.col("o_orderdate").alias("detected_at"),
            )
        )

    @property
    def tracked(self) -> DataFrame:
        """Tracked domains of users, with the state of the first version of each source."""
        # Texts are hashed in the scan, so that none is shuffled.
        hashed = tx.content_hash(F.col("text"), "normalized").alias("hash")
        first = self.documents.select("source", F.struct("doc_id", hashed).alias("d")).groupBy("source").agg(
            F.min_by("d", "d.doc_id").alias("f")
        )
        base = first.select(
            F.col("source"), F.col("f.hash").alias("policy_hash"),
            (1 + (F.col("f.doc_id") * 37) % 100).cast("int").alias("last_score"),
            (F.col("f.doc_id") % 4).cast("int").alias("last_threats"),
        )
        users = self.read("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lit("src"), (F.col("c_custkey") % 23).cast("string")).alias("domain"),
        )
        return users.join(base.withColumnRenamed("source", "domain"), "domain", "left").select(
            "user_id", "domain", "policy_hash", "last_score", "last_threats",
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_checked"),
        )

    @property
    def snapshot(self) -> DataFrame:
        """Newest text of every source whose name ends in an even digit, others unchanged."""
        hashed = tx.content_hash(F.col("text"), "normalized").alias("hash")
        last = self.documents.select("source", F.struct("doc_id", hashed).alias("d")).groupBy("source").agg(
            F.max_by("d", "d.doc_id").alias("n"), F.min_by("d", "d.doc_id").alias("f"),
        )
        pick = F.when(F.col("source").rlike("[02468]$"), F.col("n")).otherwise(F.col("f"))
        return last.select("source", pick.alias("v")).where("source <> 'src5'").select(
            F.col("source").alias("domain"),
            F.col("v.hash").alias("new_hash"),
            (1 + (F.col("v.doc_id") * 37) % 100).cast("int").alias("new_score"),
            (F.col("v.doc_id") % 4).cast("int").alias("new_threats"),
            F.lit("2024-06-01 00:00:00").cast("timestamp").alias("checked_at"),
        )


# --------------------------------------------------------------------------- constants of the views

LAYOUTS = (("<nav>", "</nav>"), ("<footer>", "</footer>"), ('<div class="legal-box">', "</div>"),
           ("<section>", "</section>"))

CATEGORIES = ("CONCERNING", "THREAT", "NOTABLE", "WARNING", "ATTENTION", "CAUTION", "STANDARD",
              "NORMAL", "POSITIVE", "GOOD", "EXCELLENT", "BRILLIANT")
SAYINGS = ("vague words", "kept forever", "third parties track", "clear text", "unclear scope",
           "indefinite storage", "plain")
SHARING = ("ads", "we sell lists", "Marketing mail", "hosting", "payments", "analytics", "support",
           "delivery", "tax")
CLAUSES = ("deletion_clause", "contact_clause", "opt_out_clause", "retention_clause")
LEVELS = ("Simple", "Moderate", "Complex")
TYPE_NAMES = ("Email", "Name", "Location", "GPS data", "Credit cards", "Passwords", "Cookies",
              "Usage data", "Shoe size", "Purchase history", "Fingerprints")
REGIONS = ("EU", "UK", "US_CA", "CA", "AU", "BR", "US_OTHER", "OTHER")
SOURCES = ("special_domain", "direct_fetch", "footer_link", "standard_path", "sitemap",
           "search_fallback", "manual")
TYPES = ("privacy", "terms", "cookies", "security", "gdpr", "ccpa", "ai", "acceptable_use")
CHANGE_SEVERITIES = ("LOW", "MEDIUM", "LOW", "HIGH", "LOW", "CRITICAL", "MEDIUM")

# --------------------------------------------------------------------------- SQL builders


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: Iterable[str]) -> str:
    return "([" + ", ".join(q(v) for v in values) + "]::VARCHAR[])"


def found(text: str, values: Iterable[str]) -> str:
    return f"list_filter({sql_list(values)}, lambda t: contains({text}, t))"


def found_count(text: str, values: Iterable[str]) -> str:
    return f"CAST(len({found(text, values)}) AS INT)"


def any_found(text: str, values: Iterable[str]) -> str:
    return f"(len({found(text, values)}) > 0)"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def match_sum(text: str, patterns: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST({matches(text, p)} AS INT)" for p in patterns) + ")"


def pick_sql(values: Sequence[str], index: str) -> str:
    return f"{sql_list(values)}[1 + CAST(({index}) % {len(values)} AS INT)]"


def half_up(expr: str) -> str:
    return f"CAST(floor(({expr}) + 0.5) AS INT)"


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def trim_sql(expr: str) -> str:
    return f"trim({expr}, {WS})"


HASH = f"sha256({trim_sql('text')})"
SPACED = r"regexp_replace(lower(text), '\s+', ' ', 'g')"
HASH_NORM = f"sha256({trim_sql(SPACED)})"
WORDS = r"CAST(len(regexp_extract_all(text, '\S+')) AS INT)"

V_VERSIONS = f"""v_versions AS (SELECT doc_id AS id, source AS domain, lang AS policy_type, text AS raw_text,
 {HASH} AS content_hash, {WORDS} AS word_count, CAST(1 + (doc_id * 37) % 100 AS INT) AS score,
 TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS analyzed_at FROM documents)"""

V_ANALYSES = f"""v_analyses AS (SELECT doc_id AS id, source AS domain, lang AS policy_type,
 [{{'category': {pick_sql(CATEGORIES, 'doc_id')}, 'text': {pick_sql(SAYINGS, 'doc_id')} || ' ' || source}},
  {{'category': {pick_sql(CATEGORIES, 'doc_id * 5 + 1')}, 'text': {pick_sql(SAYINGS, 'doc_id + 3')} || ' ' || lang}},
  {{'category': {pick_sql(CATEGORIES, 'doc_id * 7 + 2')}, 'text': {pick_sql(SAYINGS, 'doc_id * 3 + 1')} || ' x'}}] AS key_findings,
 list_distinct([{pick_sql(TYPE_NAMES, 'doc_id')}, {pick_sql(TYPE_NAMES, 'doc_id * 7')}, source]) AS data_collected,
 list_slice({sql_list(SHARING)}, 1 + doc_id % 4, doc_id % 4 + doc_id % 7) AS third_party_sharing,
 list_slice({sql_list(CLAUSES)}, 1 + doc_id % 3, doc_id % 3 + doc_id % 4) AS clauses_found,
 {pick_sql(LEVELS, 'doc_id')} AS reading_level, CASE WHEN doc_id % 5 = 0 THEN 'mail' END AS contact_info FROM documents)"""

V_SERVICES = """v_analysis_rows AS (SELECT o_custkey AS user_id, l_suppkey AS domain, l_shipdate AS analyzed_at, l_partkey AS version_id,
 max(CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity * 2 AS INT) END) AS score
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
v_services AS (SELECT user_id, domain, count(*) AS analysis_count, min(analyzed_at) AS first_analyzed_at, max(analyzed_at) AS last_analyzed_at,
 arg_max({'s': score, 'v': version_id}, {'a': analyzed_at, 'v': version_id}).s AS latest_score,
 arg_max({'s': score, 'v': version_id}, {'a': analyzed_at, 'v': version_id}).v AS latest_version_id
 FROM v_analysis_rows GROUP BY 1, 2)"""

V_PROFILES = f"""v_profiles AS (SELECT c_custkey AS user_id, {sql_list(REGIONS)}[1 + c_nationkey % 8] AS region,
 [CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'limit_tracking' WHEN 'HOUSEHOLD' THEN 'protect_family'
  WHEN 'BUILDING' THEN 'avoid_data_selling' ELSE 'monitor_changes' END] AS goals FROM customer)"""

V_BREACHES = """v_breaches AS (SELECT o_custkey AS user_id, l_shipdate AS breach_date, [p_type, p_brand] AS data_classes,
 l_linestatus = 'F' AS is_verified, l_linenumber = 3 AS is_retired
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')"""

V_CANDIDATES = f"""v_candidates AS (SELECT 'd' || l_suppkey || '.example.com' AS domain, {sql_list(SOURCES)}[l_linenumber] AS source,
 CAST(l_quantity * 2 AS INT) AS confidence, 'https://d' || l_suppkey || '.example.com/p' || l_partkey AS url,
 {sql_list(TYPES)}[1 + l_partkey % 8] AS type, list_position({sql_list(SOURCES)}, {sql_list(SOURCES)}[l_linenumber]) AS source_order,
 l_partkey AS part FROM lineitem)"""

V_LOGS = """v_logs AS (SELECT user_id AS session_id, event_type AS phase, ts, props AS data, event_id,
 CASE event_type WHEN 'view' THEN 'network' WHEN 'click' THEN 'discovery' ELSE 'system' END AS category,
 CASE event_type WHEN 'click' THEN 'strategy_' || (props ->> '$.k') WHEN 'signup' THEN 'session_end' ELSE 'step' END AS subcategory,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level FROM events)"""

V_ANALYSIS_LOG = """v_log AS (SELECT event_id AS id, 'site' || user_id || '.com' AS domain, ts AS timestamp, event_type <> 'error' AS success,
 CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INT) END AS score,
 CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'signup' THEN 'negative' END AS feedback_type FROM events)"""

V_CHANGELOGS = f"""v_changelogs AS (SELECT 'd' || (o_custkey % 97) AS domain, o_custkey AS old_version_id, o_orderkey AS new_version_id,
 items AS changelog_items, o_orderdate AS detected_at FROM orders LEFT JOIN (
 SELECT l_orderkey, list_sort(list({{'n': l_linenumber, 'p': l_partkey,
  'type': CASE l_returnflag WHEN 'R' THEN 'WORSE' WHEN 'A' THEN 'BETTER' ELSE 'NEUTRAL' END,
  'severity': {sql_list(CHANGE_SEVERITIES)}[l_linenumber], 'category': l_linestatus}})) AS items
 FROM lineitem GROUP BY 1) i ON l_orderkey = o_orderkey)"""

V_TRACKED = f"""v_first AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1),
v_last AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1),
v_tracked AS (SELECT c_custkey AS user_id, 'src' || (c_custkey % 23) AS domain, {HASH_NORM} AS policy_hash,
 CAST(1 + (doc_id * 37) % 100 AS INT) AS last_score, CAST(doc_id % 4 AS INT) AS last_threats
 FROM customer LEFT JOIN v_first ON source = 'src' || (c_custkey % 23)),
v_snapshot AS (SELECT source AS domain, {HASH_NORM} AS new_hash, CAST(1 + (doc_id * 37) % 100 AS INT) AS new_score,
 CAST(doc_id % 4 AS INT) AS new_threats FROM (SELECT * FROM v_last WHERE regexp_matches(source, '[02468]$')
 UNION ALL SELECT * FROM v_first WHERE NOT regexp_matches(source, '[02468]$')) t WHERE source <> 'src5')"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
