"""Keyed tables, versions, changelogs, risk and operations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clauselake.operators import changelog as cl
from clauselake.operators import keyed as ke
from clauselake.operators import operations as op
from clauselake.operators import risk as ri
from clauselake.operators import versions as ve
from clauselake.plans import flows

T0 = dt.datetime(2024, 1, 1)


def days(n, **kw):
    return T0 + dt.timedelta(days=n, **kw)


def as_set(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


# --------------------------------------------------------------------------- keyed


@pytest.mark.parametrize("parts", [1, 8])
def test_with_previous_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = as_set(ke.with_previous(df, ["k"], ["t", "id"], ["id", "t"]), "k", "id", "prev_id", "prev_t")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, last = set(), {}
    for k, t, i in sorted(rows):
        p = last.get(k, (None, None))
        want.add((k, i, p[0], p[1]))
        last[k] = (i, t)
    assert got == want


def test_with_previous_keeps_null_keys_apart(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, t int")
    assert as_set(ke.with_previous(df, ["k"], ["t"], ["t"]), "k", "t", "prev_t") == {(None, 1, None), (None, 2, 1), ("a", 1, None)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    left = spark.range(6000).select((F.col("id") % 3 * (F.col("id") % 50 == 0).cast("int")).alias("k"), "id")
    left = left.unionByName(spark.createDataFrame([(None, 9999)], "k long, id long"))
    right = spark.createDataFrame([(0, "x"), (0, "y"), (2, "z"), (7, "w")], "k long, v string")
    got = ke.spread_join(left, right, ["k"], how, True, min_rows=100)
    assert "_salt" not in got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
    assert ke.hot_keys(left, ["k"], 0.02, 100) == [(0,)]


def test_spread_join_refuses_outer(spark):
    df = spark.range(2)
    with pytest.raises(ValueError):
        ke.spread_join(df, df, ["id"], "full_outer")


def test_small_side_checks_size(spark):
    assert "broadcast" in ke.small_side(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in ke.small_side(spark.range(6), 5)._jdf.queryExecution().logical().toString().lower()


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, k string, v int")
    new = spark.createDataFrame([(8, "b", 21, 1), (9, "b", 22, 2), (7, "c", 30, 1)], "id int, k string, v int, at int")
    once = ke.upsert(base, new, ["k"], [F.col("at").desc()], ["id"])
    assert as_set(once, "id", "k", "v") == {(1, "a", 10), (2, "b", 22), (7, "c", 30)}
    assert as_set(ke.upsert(once, new, ["k"], [F.col("at").desc()], ["id"]), "id", "k", "v") == as_set(once, "id", "k", "v")
    gone = spark.createDataFrame([(3, "a", None, 1)], "id int, k string, v int, at int")
    assert as_set(ke.upsert(base, gone, ["k"], [F.col("at")], ["id"]), "id", "k", "v") == {(1, "a", None), (2, "b", 20)}


def test_insert_delete_trim(spark):
    base = spark.createDataFrame([("u", "a.com")], "user string, domain string")
    more = spark.createDataFrame([("u", "a.com"), ("u", "b.com"), ("u", "b.com")], "user string, domain string")
    out = ke.insert_if_absent(base, more, ["user", "domain"])
    assert sorted(map(tuple, out.collect())) == [("u", "a.com"), ("u", "b.com")]
    raw = spark.createDataFrame([(" A.com ",), ("a.com",), ("",), ("  ",)], "domain string")
    assert as_set(ke.queue_domains(raw), "domain", "status") == {("a.com", "pending")}
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, d string")
    kept, gone = ke.delete_where(df, F.col("d") == "x")
    assert as_set(kept, "id") == {(1,), (3,)} and gone.first().deleted == 1
    assert ke.trim_latest(spark.range(50), [F.col("id").desc()], 3).count() == 3


# --------------------------------------------------------------------------- versions

VERS = "id string, domain string, policy_type string, content_hash string, score int, word_count int, raw_text string, analyzed_at timestamp"


def version(i, day, h="h", score=50, text="x", domain="a", kind="privacy", **kw):
    return (i, domain, kind, h, score, 1, text, days(day, **kw))


def test_cache_states(spark):
    v = spark.createDataFrame([version("1", -7, hours=1, domain="fresh"), version("2", -7, domain="same"), version("3", -7, "old", domain="other"),
                               version("4", -7, domain="unknown"), version("5", -30, domain="same")], VERS)
    cur = spark.createDataFrame([(d, "privacy", h) for d, h in (("fresh", "zz"), ("same", "h"), ("other", "new"), ("unknown", None), ("none", "h"))],
                                "domain string, policy_type string, current_hash string")
    st = ve.cache_status(v, cur, F.lit(T0))
    assert as_set(st, "domain", "version_id", "status") == {("fresh", "1", "fresh"), ("same", "2", "unchanged"), ("other", "3", "changed"),
                                                            ("unknown", "4", "changed"), ("none", None, "none")}
    assert as_set(ve.needs_analysis(st).where("to_do"), "domain") == {("other",), ("unknown",), ("none",)}
    assert as_set(flows.stale_keys(st), "domain") == {("other",), ("unknown",), ("none",)}


def test_compare_and_diff(spark):
    v = spark.createDataFrame([version("1", 0, text="A\n\nb\n\nb\n\ngone", score=40), version("2", 1, text="a \n\nB\n\nnew\n\nnew", score=None),
                               version("9", 0, text="", domain="z")], VERS)
    pairs = ve.version_compare(ve.consecutive_pairs(v))
    assert as_set(pairs, "id", "prev_id", "score_diff") == {("1", None, 40), ("2", "1", -40), ("9", None, 50)}
    diff = ve.paragraph_diff(pairs, v)
    got = sorted((r.status, r.paragraph) for r in diff.collect())
    assert got == [("added", "new"), ("added", "new"), ("removed", "gone"), ("unchanged", "B"), ("unchanged", "a ")]
    assert as_set(ve.paragraph_diff_counts(pairs, v), "pair_id", "added", "removed", "unchanged") == {("2", 2, 1, 2)}
    same = spark.createDataFrame([("1", "1")], "id string, prev_id string")
    assert as_set(ve.paragraph_diff(same, v), "status") == {("unchanged",)}
    named = ve.named_pairs(v, spark.createDataFrame([("2", "1")], "left_id string, right_id string"))
    assert as_set(named, "prev_id", "id") == {("1", "2")}


def test_set_and_key_diff(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c", "c"]), (None, ["x"])], "o array<string>, n array<string>")
    got = df.select(ve.analysis_set_diff(F.col("o"), F.col("n")).alias("d")).collect()
    assert [(r.d.added, r.d.removed) for r in got] == [(["c", "c"], ["a"]), (["x"], [])]
    pair = spark.createDataFrame([(1, ("s", 1, ["a"]), ("s", 2, ["a"]))],
                                 "id int, old_analysis struct<summary:string,score:int,user_rights:array<string>>, new_analysis struct<summary:string,score:int,user_rights:array<string>>")
    assert as_set(ve.analysis_key_diff(pair, keys=("summary", "score", "user_rights", "none")), "key", "changed") == {
        ("summary", False), ("score", True), ("user_rights", False), ("none", False)}


def test_type_names(spark):
    names = ["Privacy Policy", "Terms & Conditions", "Cookie Policy", "DPA", "Acceptable Use", "Security Policy", "Terms of Service"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.t for r in df.select("i", ve.policy_type_from_name(F.col("n")).alias("t")).orderBy("i").collect()]
    assert got == ["privacy", "terms", "cookies", "dpa", "aup", "security policy", "terms"]


TRACKED = "user_id string, domain string, policy_hash string, last_score int, last_threats int, last_checked timestamp"


def test_changes(spark):
    t = spark.createDataFrame([("u", d, h, s, 1, T0) for d, h, s in (("same", "h", 5), ("hash", "h", 5), ("score", "h", 5), ("null", None, 5), ("unseen", "h", 5))], TRACKED)
    snap = spark.createDataFrame([(d, h, s, n, days(1)) for d, h, s, n in (("same", "h", 5, 1), ("hash", "g", 5, 3), ("score", "h", 9, 0), ("null", None, 5, 1))],
                                 "domain string, new_hash string, new_score int, new_threats int, checked_at timestamp")
    state, records = flows.recheck(t, snap)
    assert as_set(state, "domain", "has_changes", "previous_score", "last_score") == {
        ("same", False, None, 5), ("hash", True, 5, 5), ("score", True, 5, 9), ("null", False, None, 5), ("unseen", False, None, 5)}
    assert as_set(records, "domain", "change_type", "summary") == {
        ("hash", "content_changed", "2 new threat(s) detected"),
        ("score", "score_changed", "Score improved by 4 points (5 → 9). 1 threat(s) resolved")}
    assert as_set(ve.notification_counts(state), "user_id", "notifications") == {("u", 2)}
    seen = ve.mark_viewed(state, spark.createDataFrame([("u", "hash")], "user_id string, domain string"))
    assert as_set(seen.where("has_changes"), "domain") == {("score",)}
    # A second check without news clears the flag; an unseen domain keeps its state.
    again = ve.detect_changes(state, snap.where("domain = 'score'"))
    assert as_set(again.where("has_changes"), "domain") == {("hash",)}


# --------------------------------------------------------------------------- changelogs


def test_changelog(spark):
    items = "array<struct<type:string,severity:string>>"
    c = spark.createDataFrame([("d", 1, 2, [("WORSE", "LOW"), ("BETTER", "HIGH"), ("WORSE", "MEDIUM")], T0), ("d", 1, 9, None, T0)],
                              f"domain string, old_version_id int, new_version_id int, changelog_items {items}, detected_at timestamp")
    v = spark.createDataFrame([(1, 70), (2, 40)], "id int, score int")
    got = as_set(cl.changelog_rollup(c, v), "new_version_id", "score_change", "overall_severity", "additions_count", "removals_count", "modifications_count")
    assert got == {(2, -30, "HIGH", 2, 1, 0), (9, -70, "LOW", 0, 0, 0)}
    kept = cl.changelog_filter(c, "WORSE", "LOW").where("new_version_id = 2").first()
    assert len(kept.changelog_items) == 1 and (kept.worse, kept.better, kept.neutral) == (2, 1, 0)


def test_critical_changes_limit(spark):
    c = spark.createDataFrame([("d", i, "CRITICAL" if i % 2 else "LOW", days(i)) for i in range(60)],
                              "domain string, new_version_id int, overall_severity string, detected_at timestamp")
    t = spark.createDataFrame([("u", "d"), ("w", "e")], "user_id string, domain string")
    assert as_set(cl.critical_changes(t, c), "user_id", "new_version_id") == {("u", i) for i in range(21, 60, 2)}


# --------------------------------------------------------------------------- risk


def risk(spark, scores, region="EU", breaches=0, goals=()):
    users = spark.createDataFrame([("u", region, list(goals))], "user_id string, region string, goals array<string>")
    services = spark.createDataFrame([("u", f"d{i}", s) for i, s in enumerate(scores)], "user_id string, domain string, latest_score int")
    total = spark.createDataFrame([("u", breaches)], "user_id string, total long")
    return flows.personal_risk(users, services, total).first()


def test_risk_factors(spark):
    r = risk(spark, [29, 30, 49, 50, None], region=None, breaches=11)
    assert (r.average_score, r.concerning_services, r.high_risk_services, r.region_risk, r.data_exposure) == (40, 3, 1, 50, 95)
    # 40*.35 + 0 + 50*.1 + 5*.2 + 70*.15 = 30.5, rounded up
    assert (r.overall_score, r.risk_level) == (31, "HIGH")
    none = risk(spark, [], region="XX")
    assert (none.average_score, none.region_risk, none.overall_score, none.risk_level) == (100, 50, 95, "LOW")


def test_recommendations(spark):
    few = risk(spark, [80]).recommendations
    assert len(few) == 2 and few[0].startswith("🇪🇺") and few[1].startswith("✅")
    many = risk(spark, [10, 10, 10, 10], breaches=2, goals=("protect_family", "limit_tracking", "avoid_data_selling")).recommendations
    assert len(many) == 6 and many[0].startswith("🔴 Your email appears in 2 data breaches") and "limit" in many[5] or many[5].startswith("🛡️")
    one = risk(spark, [10], breaches=1).recommendations
    assert "1 data breach." in one[0] and "1 service with" in one[1]


BREACH = "user_id string, breach_date date, data_classes array<string>, is_verified boolean, is_retired boolean"


def test_breaches(spark):
    d = dt.date
    rows = [("u", d(2023, 6, 1), ["Passwords", "Email"], True, False), ("u", d(2020, 1, 1), ["Email"], True, False),
            ("u", d(2023, 1, 2), ["Credit cards"], False, False), ("u", d(2019, 1, 1), ["Passwords"], True, True)]
    b = spark.createDataFrame(rows, BREACH)
    at = F.lit("2024-01-01").cast("date")
    s = ri.breach_summary(b, at).first()
    assert (s.total, s.critical, s.recent, s.exposed_data) == (4, 3, 2, ["Passwords", "Email", "Credit cards"])
    c = ri.breach_check(b, at).first()
    assert (c.critical, c.recent, c.exposed_types, c.exposed_data) == (1, 1, 3, ["Credit cards", "Email", "Passwords"])
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    st = {r.user_id: r for r in ri.breach_stats(users, b, at).collect()}
    assert (st["u"].critical, st["u"].risk_level, st["u"].top_exposed_data) == (2, "HIGH", ["Email", "Passwords", "Credit cards"])
    assert (st["v"].total, st["v"].risk_level) == (0, "SAFE")


@pytest.mark.parametrize("n, critical, recent, level", [(1, 0, 0, "LOW"), (3, 0, 0, "MEDIUM"), (1, 0, 1, "MEDIUM"), (6, 0, 0, "HIGH"), (1, 1, 0, "HIGH"),
                                                        (3, 3, 0, "CRITICAL"), (11, 0, 0, "CRITICAL")])
def test_breach_levels(spark, n, critical, recent, level):
    rows = [("u", dt.date(2023, 12, 1) if i < recent else dt.date(2019, 1, 1), ["Passwords"] if i < critical else ["Email"], True, False) for i in range(n)]
    users = spark.createDataFrame([("u",)], "user_id string")
    got = ri.breach_stats(users, spark.createDataFrame(rows, BREACH), F.lit("2024-01-01").cast("date")).first()
    assert got.risk_level == level


def test_concerns_and_exposure(spark):
    s = spark.createDataFrame([("u", f"d{i}", 10 + i, None if i == 0 else i) for i in range(7)] + [("u", "ok", 90, 1)],
                              "user_id string, domain string, latest_score int, latest_version_id int")
    v = spark.createDataFrame([(1, [("GOOD", "g"), ("THREAT", "t")], ["Email", "GPS data"]), (2, [], ["Email", "Odd"])],
                              "id int, key_findings array<struct<category:string,text:string>>, data_collected array<string>")
    got = as_set(ri.top_concerns(s, v), "domain", "main_concern")
    assert got == {("d1", "t"), ("d2", "Low privacy score"), ("d3", "Low privacy score"), ("d4", "Low privacy score")}
    e = ri.exposure_rows(s, v)
    assert as_set(ri.exposure_map(e), "data_type", "services") == {("Email", 3), ("GPS data", 2), ("Odd", 1)}
    assert as_set(ri.exposure_by_category(e), "category", "risk", "data_types", "services") == {
        ("Identity", "medium", 1, 3), ("Location", "high", 1, 2), ("Other", "low", 1, 1)}
    assert ("d1", 2, 1) in as_set(ri.exposure_by_service(e), "domain", "data_types", "high_risk")
    assert as_set(ri.exposure_totals(e), "total_types", "total_services") == {(3, 3)}


def test_votes_and_passwords(spark):
    v = spark.createDataFrame([("u", "a", 10, 1), ("u", "a", 21, 2), ("w", "a", 20, 1), ("w", "a", 101, 9)], "user_id string, domain string, score int, at int")
    good, bad = ri.valid_votes(v)
    assert bad.count() == 1
    domains = spark.createDataFrame([("a",), ("b",)], "domain string")
    assert as_set(ri.community_score(good, domains, [F.col("at").desc()]), "domain", "average_score", "votes") == {("a", 21, 2), ("b", None, 0)}
    leaked = spark.createDataFrame([("5BAA6", "1E4C9B93F3F0682250B6CF8331B7EE68FD8", 7)], "prefix string, suffix string, occurrences long")
    p = spark.createDataFrame([(1, "password"), (2, "safe-one"), (3, "password")], "id int, password string")
    out = ri.password_exposure(p, leaked)
    assert "password" not in out.columns
    assert as_set(out, "id", "occurrences", "compromised") == {(1, 7, True), (2, 0, False), (3, 7, True)}


# --------------------------------------------------------------------------- operations


def test_sessions_out_of_order(spark):
    logs = spark.createDataFrame([("s", "b", days(0, minutes=5), "{}"), ("s", "request_init", days(0, minutes=1), '{"input":"a.com"}'), ("s", "b", days(0), "{}"),
                                  ("t", "x", days(1), "{}")], "session_id string, phase string, ts timestamp, data string")
    got = {r.session_id: r for r in op.log_sessions(logs).collect()}
    assert (got["s"].start_time, got["s"].end_time, got["s"].entries, got["s"].input, got["s"].phases) == (days(0), days(0, minutes=5), 3, "a.com", ["b", "request_init"])
    assert got["t"].input == "Unknown"
    assert as_set(op.filter_sessions(op.log_sessions(logs), "A.CO", "b"), "session_id") == {("s",)}
    assert op.log_sessions(logs, 1).count() == 1


def test_session_summary(spark):
    rows = [("s", days(0), "network", "get", "info", None), ("s", days(0, seconds=1), "discovery", "strategy_start", "error", "Direct"),
            ("s", days(0, seconds=2), "discovery", "strategy_x", "critical", None), ("s", days(0, seconds=3), "discovery", "strategy_start", "info", "Direct"),
            ("s", days(0, milliseconds=3500), "system", "session_end", "error", None), ("t", days(0), "system", "x", "info", None)]
    e = spark.createDataFrame(rows, "session_id string, ts timestamp, category string, subcategory string, level string, strategy string")
    assert as_set(op.session_summary(e), "session_id", "http_requests", "errors", "strategies", "duration_ms", "status") == {
        ("s", 1, 3, 2, 3500, "failed"), ("t", 0, 0, 0, 0, "running")}


def test_bursts_and_spacing(spark):
    rows = [("a", days(0, seconds=s), i) for i, s in enumerate((0, 1, 2, 3, 4, 5, 16, 19))] + [("b", days(0, seconds=s), 20 + s) for s in range(5)]
    r = spark.createDataFrame(rows, "host string, ts timestamp, id int")
    assert as_set(op.request_bursts(r), "host", "requests") == {("a", 6)}
    assert as_set(op.request_spacing(r), "host", "id", "gap_ms") == {("a", i, 1000) for i in range(1, 6)} | {("b", 20 + s, 1000) for s in range(1, 5)}


def test_log_and_queue(spark):
    log = spark.createDataFrame([(1, "a", days(0), True, 80, None), (2, "a", days(1), True, 85, None), (3, "b", days(0), False, None, "negative")],
                                "id int, domain string, timestamp timestamp, success boolean, score int, feedback_type string")
    st = op.analysis_stats(log).first()
    assert (st.total, st.successful, st.failed, st.negative_feedback, st.avg_score) == (3, 2, 1, 1, 83)
    full = log.withColumn("feedback_url", F.lit(None).cast("string")).withColumn("feedback_at", F.lit(None).cast("timestamp"))
    said = spark.createDataFrame([("a", "positive", "u", days(2)), ("zz", "positive", "u", days(2))], "domain string, feedback_type string, feedback_url string, feedback_at timestamp")
    assert as_set(op.attach_feedback(full, said), "id", "feedback_type") == {(1, None), (2, "positive"), (3, "negative")}
    q = spark.createDataFrame([(1, "a", "pending", days(1)), (2, "b", "pending", days(0)), (3, "c", "odd", days(0))], "id int, domain string, status string, created_at timestamp")
    assert tuple(op.queue_stats(q).first()) == (2, 0, 0, 0) and op.next_pending(q).first().id == 2
    assert as_set(op.table_counts({"q": q, "log": log}), "table_name", "row_count") == {("q", 3), ("log", 3)}


def test_changelogs_are_counted_per_domain_before_they_meet_users(spark):
    tracked = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "none"), (None, "a"), (4, None)], "user_id long, domain string")
    logs = spark.createDataFrame([("a", 5), ("a", None), ("b", 2), ("b", 9), (None, 1)], "domain string, new_version_id long")
    plain = cl.tracked_changelogs(tracked, logs).groupBy("user_id").agg(F.count(F.lit(1)).alias("changelogs"), F.min("new_version_id").alias("first_id"))
    got = sorted(map(tuple, cl.tracked_changelog_counts(tracked, logs).collect()), key=str)
    assert got == sorted(map(tuple, plain.collect()), key=str) == [(1, 4, 2), (2, 2, 2), (None, 2, 5)]
    # One domain that all track: 4 * 10 ** 10 pairs of user and changelog.
    n = 200_000
    users, logs = spark.range(n).select(F.col("id").alias("user_id"), F.lit("d").alias("domain")), spark.range(n).select(
        F.lit("d").alias("domain"), F.col("id").alias("new_version_id"))
    assert cl.tracked_changelog_counts(users, logs).agg(F.sum("changelogs"), F.max("first_id")).first()[:] == (n * n, 0)
