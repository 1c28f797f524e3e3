"""Risk, breach, exposure and vote queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.operators import risk as ri
from clauselake.plans import flows
from clauselake.queries.base import (
    V_ANALYSES,
    V_BREACHES,
    V_PROFILES,
    V_SERVICES,
    q,
    query,
    sql_list,
    with_views,
)
from clauselake.values.risk_values import DATA_TYPES

AS_OF = "2024-01-01"
# Classes that occur in the given parts and stand for the critical ones.
CRITICAL = ("Brand#1", "Brand#11", "Brand#2", "Brand#23", "PROMO", "ECONOMY")


def _as_of():
    return F.lit(AS_OF).cast("date")


@query(with_views(V_SERVICES) + """SELECT user_id, domain, analysis_count, strftime(first_analyzed_at, '%Y-%m-%d') AS first_day, strftime(last_analyzed_at, '%Y-%m-%d') AS last_day, latest_score, latest_version_id
 FROM (SELECT user_id, domain, count(*) AS analysis_count, min(analyzed_at) AS first_analyzed_at, max(analyzed_at) AS last_analyzed_at,
 arg_max(struct_pack(s := score, v := version_id), struct_pack(a := analyzed_at, v := version_id)).s AS latest_score, max(version_id) FILTER (WHERE analyzed_at = m) AS latest_version_id
 FROM (SELECT *, max(analyzed_at) OVER (PARTITION BY user_id, domain) AS m FROM v_analysis_rows) x GROUP BY 1, 2) y""")
def service_counts(t):
    return t.services.select(
        "user_id", "domain", "analysis_count",
        F.date_format("first_analyzed_at", "yyyy-MM-dd").alias("first_day"),
        F.date_format("last_analyzed_at", "yyyy-MM-dd").alias("last_day"),
        "latest_score", "latest_version_id",
    )


V_COUNTS = """v_counts AS (SELECT user_id, count(*) AS total FROM v_breaches GROUP BY 1)"""
V_FACTORS = f"""v_agg AS (SELECT user_id, count(*) AS n, sum(latest_score) AS s, count(latest_score) AS k, count_if(latest_score < 50) AS low, count_if(latest_score < 30) AS bad FROM v_services GROUP BY 1),
v_factors AS (SELECT p.user_id, p.region, p.goals, CAST(CASE WHEN coalesce(k, 0) > 0 THEN floor(s / k::DOUBLE + 0.5) ELSE 100 END AS INT) AS average_score, coalesce(total, 0) AS breach_count,
 coalesce(low, 0) AS concerning_services, coalesce(bad, 0) AS high_risk_services, CAST(CASE p.region {' '.join(f"WHEN {q(k)} THEN {v}" for k, v in ri.REGION_RISK.items())} ELSE 50 END AS INT) AS region_risk,
 CAST(least(100, coalesce(n, 0) * 5 + coalesce(low, 0) * 15 + coalesce(bad, 0) * 25) AS INT) AS data_exposure
 FROM v_profiles p LEFT JOIN v_agg a ON a.user_id = p.user_id LEFT JOIN v_counts c ON c.user_id = p.user_id),
v_risk AS (SELECT *, CAST((average_score * 35 + (100 - least(100, breach_count * 10)) * 20 + (100 - region_risk) * 10 + (100 - data_exposure) * 20 + greatest(0, 100 - concerning_services * 10) * 15 + 50) // 100 AS INT) AS overall_score FROM v_factors)"""
RISK = with_views(V_SERVICES, V_PROFILES, V_BREACHES, V_COUNTS, V_FACTORS)


def _totals(t):
    return ri.breach_counts(t.breaches, _as_of()).select("user_id", "total")


@query(RISK + """SELECT user_id, region, average_score, breach_count, concerning_services, high_risk_services, region_risk, data_exposure, overall_score,
 CASE WHEN overall_score >= 75 THEN 'LOW' WHEN overall_score >= 50 THEN 'MODERATE' WHEN overall_score >= 25 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM v_risk""")
def risk_score(t):
    return ri.risk_score(ri.risk_factors(t.profiles, t.services, _totals(t))).drop("goals")


@query(RISK + f"""SELECT user_id, average_score, breach_count, concerning_services, high_risk_services, region_risk, data_exposure FROM v_factors""")
def risk_factors(t):
    return ri.risk_factors(t.profiles, t.services, _totals(t)).drop("goals", "region")


@query(RISK + """SELECT user_id, overall_score, CAST(least(6, n + CASE WHEN n < 5 THEN 1 ELSE 0 END) AS INT) AS shown FROM (SELECT *, (breach_count > 0)::INT + (high_risk_services > 0)::INT + (concerning_services > 2)::INT
 + (region IN ('EU', 'US_CA', 'US_OTHER'))::INT + list_contains(goals, 'protect_family')::INT + list_contains(goals, 'limit_tracking')::INT + list_contains(goals, 'avoid_data_selling')::INT + (data_exposure > 50)::INT AS n FROM v_risk) r""")
def personal_risk(t):
    return flows.personal_risk(t.profiles, t.services, _totals(t)).select(
        "user_id", "overall_score", F.size("recommendations").alias("shown")
    )


@query(RISK + """SELECT user_id, CAST(overall_score AS INT) AS personal_risk_score, CASE WHEN overall_score IS NULL THEN 'never' ELSE '2024-01-01' END AS calculated FROM v_risk WHERE user_id % 2 = 0
 UNION ALL SELECT user_id, CAST(-1 AS INT), 'never' FROM v_profiles WHERE user_id % 2 = 1""")
def risk_profile_update(t):
    scores = ri.risk_score(ri.risk_factors(t.profiles, t.services, _totals(t))).where("user_id % 2 = 0")
    old = t.profiles.select(
        "user_id", F.lit(-1).alias("personal_risk_score"), F.lit("never").alias("last_risk_calculation")
    )
    return ri.risk_profile_update(old, scores, F.lit(AS_OF)).withColumnRenamed(
        "last_risk_calculation", "calculated"
    )


@query(with_views(V_SERVICES, V_ANALYSES) + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY latest_score, domain) AS rank FROM v_services WHERE latest_score < 50),
 f AS (SELECT id, list_filter(key_findings, lambda x: x.category IN ('CONCERNING', 'THREAT')) AS bad FROM v_analyses)
SELECT user_id, CAST(rank AS INT) AS rank, domain, latest_score AS score, coalesce(bad[1].text, 'Low privacy score') AS main_concern FROM r LEFT JOIN f ON id = latest_version_id WHERE rank <= 5 AND latest_version_id IS NOT NULL""")
def top_concerns(t):
    return ri.top_concerns(t.services, t.analyses)


@query(with_views(V_SERVICES) + """SELECT user_id, count(*) AS services, count(doc_id) AS with_version, CAST(sum(n_chars) AS BIGINT) AS chars FROM v_services LEFT JOIN documents ON doc_id = latest_version_id GROUP BY 1""")
def services_with_versions(t):
    """Services joined to their version rows."""
    from clauselake.operators.keyed import spread_join

    docs = t.read("documents").select(F.col("doc_id").alias("latest_version_id"), "n_chars")
    rows = spread_join(t.services, docs, ["latest_version_id"], "left")
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("services"), F.count("n_chars").alias("with_version"),
        F.sum("n_chars").alias("chars"),
    )


# --------------------------------------------------------------------------- breaches

HIT = f"len(list_intersect(data_classes, {sql_list(CRITICAL)})) > 0"
V_CLASSES = """v_classes AS (SELECT user_id, c AS data_class, count(*) AS breaches, min(breach_date) AS first_breach FROM (SELECT user_id, breach_date, unnest(list_distinct(data_classes)) AS c FROM v_breaches) x GROUP BY 1, 2)"""


@query(with_views(V_BREACHES, V_CLASSES) + f""", a AS (SELECT user_id, count(*) AS total, count_if({HIT}) AS critical, count_if(CAST(breach_date AS DATE) > DATE '{AS_OF}' - 365) AS recent FROM v_breaches GROUP BY 1),
 e AS (SELECT user_id, string_agg(data_class, '|' ORDER BY first_breach, data_class) AS exposed_data FROM (SELECT * FROM v_classes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first_breach, data_class) <= 10) k GROUP BY 1)
SELECT a.user_id, total, critical, recent, exposed_data FROM a JOIN e ON a.user_id = e.user_id""")
def breach_summary(t):
    return ri.breach_summary(t.breaches, _as_of(), CRITICAL).withColumn(
        "exposed_data", F.array_join("exposed_data", "|")
    )


@query(with_views(V_BREACHES, V_CLASSES) + f""", a AS (SELECT user_id, count(*) AS total, count_if({HIT} AND is_verified AND NOT is_retired) AS critical,
  count_if(CAST(breach_date AS DATE) > DATE '2023-01-01' AND is_verified) AS recent FROM v_breaches GROUP BY 1), c AS (SELECT user_id, count(*) AS exposed_types, string_agg(data_class, '|' ORDER BY data_class) AS exposed_data FROM v_classes GROUP BY 1)
SELECT a.user_id, total, critical, recent, exposed_types, exposed_data FROM a JOIN c ON a.user_id = c.user_id""")
def breach_check(t):
    return ri.breach_check(t.breaches, _as_of(), CRITICAL).withColumn(
        "exposed_data", F.array_join("exposed_data", "|")
    )


@query(with_views(V_BREACHES, V_CLASSES) + f""", a AS (SELECT user_id, count(*) AS total, count_if({HIT} AND is_verified) AS critical, count_if(CAST(breach_date AS DATE) > DATE '2023-01-01') AS recent FROM v_breaches GROUP BY 1),
 e AS (SELECT user_id, string_agg(data_class, '|' ORDER BY breaches DESC, data_class) AS top FROM (SELECT * FROM v_classes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY breaches DESC, data_class) <= 5) k GROUP BY 1),
 j AS (SELECT c_custkey AS user_id, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(recent, 0) AS recent, coalesce(top, '') AS top_exposed_data FROM customer LEFT JOIN a ON a.user_id = c_custkey LEFT JOIN e ON e.user_id = c_custkey)
SELECT *, CASE WHEN total = 0 THEN 'SAFE' WHEN critical > 2 OR total > 10 THEN 'CRITICAL' WHEN critical > 0 OR total > 5 THEN 'HIGH' WHEN recent > 0 OR total > 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM j""")
def breach_stats(t):
    return ri.breach_stats(t.profiles, t.breaches, _as_of(), CRITICAL).withColumn(
        "top_exposed_data", F.array_join("top_exposed_data", "|")
    )


@query("""WITH p AS (SELECT c_custkey AS user_id, c_mktsegment || (c_custkey % 40) AS password FROM customer), h AS (SELECT user_id, upper(sha1(password)) AS hash FROM p),
 l AS (SELECT upper(sha1(event_type || (user_id % 40))) AS hash, count(*) AS occurrences FROM events GROUP BY 1 UNION ALL SELECT DISTINCT upper(sha1(c_mktsegment || (c_custkey % 40))), 1000 + length(c_mktsegment) FROM customer WHERE c_custkey % 3 = 0)
SELECT user_id, CAST(coalesce(occurrences, 0) AS BIGINT) AS occurrences, occurrences IS NOT NULL AS compromised FROM h LEFT JOIN l USING (hash)""")
def password_exposure(t):
    c = t.read("customer")
    word = F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string"))
    passwords = c.select(F.col("c_custkey").alias("user_id"), word.alias("password"))

    def hashed(df, col, n):
        h = F.upper(F.sha1(col))
        return df.select(F.substring(h, 1, 5).alias("prefix"), F.substring(h, 6, 35).alias("suffix"), n.alias("occurrences"))

    seen = t.read("events").select(F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("w"))
    leaked = hashed(seen, F.col("w"), F.lit(1).cast("long")).unionByName(
        hashed(c.where("c_custkey % 3 = 0").select(word.alias("w"), "c_mktsegment").distinct(), F.col("w"),
               (1000 + F.length("c_mktsegment")).cast("long"))
    )
    return ri.password_exposure(passwords, leaked)


# --------------------------------------------------------------------------- exposure

INFO = "CASE data_type " + " ".join(f"WHEN {q(n)} THEN {q(c)}" for n, c, _ in DATA_TYPES) + " ELSE 'Other' END"
LEVEL = "CASE data_type " + " ".join(f"WHEN {q(n)} THEN {q(r)}" for n, _, r in DATA_TYPES) + " ELSE 'low' END"
V_EXPOSURE = """v_exposure AS (SELECT user_id, s.domain, unnest(data_collected) AS data_type FROM v_services s JOIN v_analyses a ON a.id = s.latest_version_id)"""
EXPOSED = with_views(V_SERVICES, V_ANALYSES, V_EXPOSURE)


def _exposure(t):
    return ri.exposure_rows(t.services, t.analyses)


@query(EXPOSED + "SELECT user_id, data_type, count(*) AS services FROM v_exposure GROUP BY 1, 2")
def exposure_map(t):
    return ri.exposure_map(_exposure(t))


@query(EXPOSED + f"SELECT user_id, category, risk, count(*) AS data_types, CAST(sum(n) AS BIGINT) AS services FROM (SELECT user_id, data_type, {INFO} AS category, {LEVEL} AS risk, count(*) AS n FROM v_exposure GROUP BY 1, 2) x GROUP BY 1, 2, 3")
def exposure_by_category(t):
    return ri.exposure_by_category(_exposure(t))


@query(EXPOSED + f"SELECT user_id, domain, count(*) AS data_types, count_if({LEVEL} = 'high') AS high_risk FROM v_exposure GROUP BY 1, 2")
def exposure_by_service(t):
    return ri.exposure_by_service(_exposure(t))


@query(EXPOSED + "SELECT user_id, count(DISTINCT data_type) AS total_types, count(DISTINCT domain) AS total_services FROM v_exposure GROUP BY 1")
def exposure_totals(t):
    return ri.exposure_totals(_exposure(t))


# --------------------------------------------------------------------------- votes


@query("""WITH v AS (SELECT * FROM events WHERE value BETWEEN 0 AND 100 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
 d AS (SELECT DISTINCT event_type AS domain FROM events UNION ALL SELECT 'silent')
SELECT d.domain, CAST(floor(sum(value) / count(value) + 0.5) AS INT) AS average_score, count(value) AS votes FROM d LEFT JOIN v ON v.event_type = d.domain GROUP BY 1""")
def community_score(t):
    good, _ = ri.valid_votes(t.votes)
    domains = t.votes.select("domain").distinct()
    silent = domains.limit(1).select(F.lit("silent").alias("domain"))
    return ri.community_score(
        good, domains.unionByName(silent), [F.col("ts").desc(), F.col("id").desc()]
    )


@query("""SELECT event_id AS id, 'Score must be between 0 and 100.' AS reason FROM events WHERE NOT coalesce(value BETWEEN 0 AND 100, false)""")
def rejected_votes(t):
    return ri.valid_votes(t.votes)[1].select("id", "reason")


