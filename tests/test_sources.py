"""Readers, writers and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from clauselake import schemas
from clauselake.operators import corpus as co
from clauselake.operators import operations as op
from clauselake.sources import readers, tables, writers
from clauselake.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def test_corpus_files(spark, tmp_path):
    for name, text in (("a.txt", "one\n\ntwo\n"), ("b.MD", "# x"), ("c.html", "<p>y</p>"), ("d.pdf", "no")):
        (tmp_path / name).write_text(text)
    got = {tuple(r) for r in readers.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", "one\n\ntwo\n"), ("b.MD", "# x"), ("c.html", "<p>y</p>")}


def test_event_files(spark, tmp_path):
    (tmp_path / "log_2025-11-20T19-11-15-383Z_search_query.json").write_text(json.dumps({"query": "q"}, indent=2))
    (tmp_path / "log_2025-11-20T19-11-48-138Z_fetch_success.json").write_text(json.dumps({"url": "u", "textLength": 5}))
    (tmp_path / "other.json").write_text("{}")
    got = {r.event_type: r for r in readers.read_event_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"search_query", "fetch_success"} and got["search_query"].query == "q"
    assert got["fetch_success"].event_time == dt.datetime(2025, 11, 20, 19, 11, 48, 138000) and got["fetch_success"].textLength == 5


def test_jsonl_logs(spark, tmp_path):
    entry = {"id": "1", "timestamp": "2024-01-01T00:00:00.000Z", "sessionId": "s", "category": "network", "data": {"a": "b"}}
    (tmp_path / "deep_log_2024-01-01.jsonl").write_text(json.dumps(entry) + "\n\n" + json.dumps(entry | {"id": "2"}) + "\n")
    (tmp_path / "deep_log_2024-01-02.jsonl").write_text(json.dumps(entry | {"id": "3"}) + "\n")
    day = readers.read_jsonl_logs(spark, str(tmp_path), "2024-01-01").collect()
    assert sorted(r.id for r in day) == ["1", "2"] and day[0].timestamp == T0 and day[0].data == {"a": "b"}
    assert readers.read_jsonl_logs(spark, str(tmp_path)).count() == 3
    assert readers.stream_jsonl_logs(spark, str(tmp_path)).isStreaming


def test_analysis_log(spark, tmp_path):
    path = tmp_path / "analyses.json"
    path.write_text(json.dumps([{"id": "1", "domain": "a.com", "timestamp": "2026-02-01T09:12:26.496Z", "success": True, "score": 81, "policyType": "privacy", "analysisTimeMs": 0}]))
    r = readers.read_analysis_log(spark, str(path)).first()
    assert (r.domain, r.score, r.policy_type, r.feedback_type) == ("a.com", 81, "privacy", None)
    assert readers.read_analysis_log(spark, str(tmp_path / "none.json")).count() == 0


def test_terms_table(spark, tmp_path):
    (tmp_path / "t.json").write_text("\n".join(json.dumps({"lang": "sw", "concept": c, "term": t}) for c, t in (("privacy", "faragha"), ("policy", "sera"))))
    assert readers.read_terms(spark, str(tmp_path / "t.json")) == {"sw": {"privacy": "faragha", "policy": "sera"}}


def test_writers(spark, tmp_path):
    words = spark.createDataFrame([(f"w{i}", i, 1) for i in range(5)], "term string, count long, documents long")
    writers.write_frequencies(words, words, str(tmp_path / "f"), 3, 2)
    assert {r.term for r in spark.read.json(str(tmp_path / "f/words")).collect()} == {"w4", "w3", "w2"}
    keys = spark.createDataFrame([("a", 1, 1, 0.5, "high_confidence"), ("b", 1, 1, 0.4, "low_confidence")],
                                 "term string, frequency long, document_frequency long, score double, category string")
    writers.write_keywords(keys, str(tmp_path / "k"))
    assert (tmp_path / "k/category=high_confidence").is_dir()
    assert spark.read.json(str(tmp_path / "k")).where("category = 'low_confidence'").first().term == "b"
    for _ in range(2):
        writers.append_examples(spark.range(2), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 4


def test_replace_table_read_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], "id long")
    assert writers.read_state(spark, path, empty).count() == 0
    writers.replace_table(spark.range(3), path)
    writers.replace_table(spark.read.parquet(path).where("id > 0"), path)
    writers.replace_table(spark.read.parquet(path).where("id > 1"), path)
    assert [r.id for r in writers.read_state(spark, path, empty).collect()] == [2]
    assert spark.read.parquet(path + "__before").count() == 2


def test_versions_layout(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", t, "h", 1) for t in ("privacy", "terms")], "id string, domain string, policy_type string, content_hash string, score int")
    writers.write_versions(df, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v")).where("policy_type = 'terms'")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(policy_type" in back._jdf.queryExecution().executedPlan().toString()


def test_schemas_parse(spark):
    for name, ddl in vars(schemas).items():
        if name.isupper() and not name.endswith("_DDL"):
            assert spark.createDataFrame([], ddl).columns, name


def test_balanced_leaves_many_files_alone(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    spark.range(100).coalesce(1).write.parquet(one)
    spark.range(100).repartition(40).write.parquet(many)
    few = tables.balanced(spark.read.parquet(one), "id")
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism * 2
    assert "Exchange" not in tables.balanced(spark.read.parquet(many), "id")._jdf.queryExecution().executedPlan().toString()


# --------------------------------------------------------------------------- plans


def test_term_counts_shuffle_once(spark, tmp_path):
    df = spark.createDataFrame([("a b c",)], "text string")
    df.write.parquet(str(tmp_path / "d"))
    plan = co.word_frequencies(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan


def test_top_per_key_cuts_before_the_shuffle(spark):
    from clauselake.operators.versions import version_history

    df = spark.createDataFrame([("1", "a", "p", "h", 1, 1, T0)], "id string, domain string, policy_type string, content_hash string, score int, word_count int, analyzed_at timestamp")
    plan = version_history(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# --------------------------------------------------------------------------- streams


def snapshots(n=400):
    rng = random.Random(3)
    return [(rng.choice(["a", "b", "c"]), "privacy", rng.choice("xyz"), rng.choice([1, 2, None]), T0 + dt.timedelta(hours=i)) for i in range(n)]


SNAP = "domain string, policy_type string, content_hash string, score int, analyzed_at timestamp"


def in_parts(spark, rows, schema, path, parts=4):
    size = (len(rows) + parts - 1) // parts
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_changes_equal_batch(spark, tmp_path):
    rows = snapshots()
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    in_parts(spark, rows, SNAP, src, 1)
    jobs.run_available(jobs.stream_policy_changes(stream_of(spark, src, SNAP)), out, str(tmp_path / "c"))
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in jobs.policy_changes_batch(spark.createDataFrame(rows, SNAP)).collect()}
    assert got == want and len(got) > 200


def test_batched_changes_equal_batch(spark, tmp_path):
    rows = snapshots(90)
    src, root, check = str(tmp_path / "s"), str(tmp_path / "r"), str(tmp_path / "c")
    late = ("a", "privacy", "q", 7, T0 - dt.timedelta(days=1))
    for part in (rows[:30], rows[30:60] + [late], rows[60:]):
        spark.createDataFrame(part, SNAP).coalesce(1).write.mode("append").parquet(src)
        jobs.run_policy_changes(stream_of(spark, src, SNAP), root, check)
    got = {tuple(r) for r in spark.read.parquet(root + "/changes").drop("batch").collect()}
    want = {tuple(r) for r in jobs.policy_changes_batch(spark.createDataFrame(rows, SNAP)).collect()}
    assert got == want and len(got) > 40


def test_late_snapshot_is_dropped(spark, tmp_path):
    src, out, check = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    first = [("a", "p", "x", 1, T0 + dt.timedelta(hours=2))]
    late = [("a", "p", "y", 9, T0), ("a", "p", "z", 1, T0 + dt.timedelta(hours=3))]
    for part in (first, late):
        spark.createDataFrame(part, SNAP).coalesce(1).write.mode("append").parquet(src)
        jobs.run_available(jobs.stream_policy_changes(stream_of(spark, src, SNAP)), out, check)
    assert [(r.new_score, r.change_type) for r in spark.read.parquet(out).collect()] == [(1, "content_changed")]


@pytest.fixture
def disk_state(spark):
    spark.conf.set(*jobs.STORE)
    yield
    spark.conf.unset(jobs.STORE[0])


def test_stateful_changes_begin_with_a_table_and_go_on_after_a_restart(spark, tmp_path, disk_state):
    rows = snapshots(120)
    src, out, check = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    known = spark.createDataFrame(rows[:30], SNAP)
    for a, b in ((30, 60), (60, 61), (61, 120)):
        in_parts(spark, rows[a:b], SNAP, src, 1 if b - a < 3 else 3)
        jobs.run_available(jobs.stateful_policy_changes(stream_of(spark, src, SNAP), known), out, check)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    every = {tuple(r) for r in jobs.policy_changes_batch(spark.createDataFrame(rows, SNAP)).collect()}
    assert got == {r for r in every if r[2] >= rows[30][4]} and len(got) > 40


def test_silent_keys_are_forgotten(spark, tmp_path, disk_state):
    src, out, check = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    parts = [[("a", "p", "x", 1, T0), ("b", "p", "x", 1, T0)], [("b", "p", "y", 1, T0 + dt.timedelta(days=3))],
             [("b", "p", "y", 1, T0 + dt.timedelta(days=6))], [("a", "p", "z", 1, T0 + dt.timedelta(days=7)), ("b", "p", "z", 1, T0 + dt.timedelta(days=7))]]
    for part in parts:
        in_parts(spark, part, SNAP, src, 1)
        jobs.run_available(jobs.stateful_policy_changes(stream_of(spark, src, SNAP), silent_ms=4 * 86_400_000), out, check)
    assert sorted((r.domain, r.analyzed_at) for r in spark.read.parquet(out).collect()) == [
        ("b", T0 + dt.timedelta(days=3)), ("b", T0 + dt.timedelta(days=7))]


def test_a_stream_to_its_end_closes_all_and_counts_once(spark, tmp_path):
    schema = "session_id string, ts timestamp, category string, level string, id int"
    rows = [("s", T0 + dt.timedelta(minutes=10 * i), "network", "error" if i % 2 else "info", i) for i in range(20)]
    rows += [("t", T0 + dt.timedelta(minutes=m), "x", "info", 100 + m) for m in (0, 50, 199)]
    src, out, check, marks = (str(tmp_path / x) for x in "socm")
    in_parts(spark, rows + rows[5:9], schema, src, 1)
    build = lambda r: jobs.stream_log_sessions(r, once_by=["id"])
    jobs.run_to_end(stream_of(spark, src, schema), build, out, check, marks)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    df = spark.createDataFrame(rows + rows[5:9], schema)
    assert got == sorted(map(tuple, build(df).collect())) and len(got) == 4
    jobs.run_to_end(stream_of(spark, src, schema), build, out, check, marks)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == got


LOG = "session_id string, ts timestamp, category string, level string"


def test_stream_sessions_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((rng.choice("st"), T0 + dt.timedelta(minutes=rng.randrange(3000)), rng.choice(["network", "x"]), rng.choice(["error", "info"])) for _ in range(200))
    rows.sort(key=lambda r: r[1])
    src, out, check = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    in_parts(spark, rows, LOG, src, 1)
    run = lambda: jobs.run_available(jobs.stream_log_sessions(stream_of(spark, src, LOG)), out, check)
    run()
    spark.createDataFrame([("end", T0 + dt.timedelta(days=9), "x", "info")], LOG).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in jobs.stream_log_sessions(spark.createDataFrame(rows, LOG)).collect()}
    assert got == want and len(want) > 3


def test_stream_bursts_equal_batch(spark, tmp_path):
    schema = "host string, ts timestamp, id int"
    rows = [("a", T0 + dt.timedelta(seconds=s), s) for s in range(6)] + [("b", T0 + dt.timedelta(seconds=s), s) for s in range(5)]
    src, out, check = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    in_parts(spark, rows, schema, src, 1)
    run = lambda: jobs.run_available(jobs.stream_request_bursts(stream_of(spark, src, schema)), out, check)
    run()
    spark.createDataFrame([("z", T0 + dt.timedelta(hours=9), 1)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    got = {(r.host, r.requests) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 6)} == {(r.host, r.requests) for r in op.request_bursts(spark.createDataFrame(rows, schema)).collect()}


def test_unused_columns_are_pruned(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = df.select("doc_id", F.length("text"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_streams_read_tables_of_one_file_and_of_a_folder_of_files(spark, tmp_path):
    from clauselake.queries import load

    rows = [(i, f"text {i % 3}", "en", f"s{i % 2}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    folder, single, none = tmp_path / "folder", tmp_path / "single", tmp_path / "none"
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    single.mkdir()
    next((tmp_path / "one").glob("part-*")).rename(single / "documents.parquet")
    docs.limit(0).write.parquet(str(none / "documents.parquet"))
    batched, streamed = (load()[0][name] for name in ("batched_policy_changes", "stream_policy_changes"))
    got = {at: sorted(map(tuple, batched(spark, str(at)).collect())) for at in (folder, single, none)}
    assert len(got[folder]) == 10 and got[folder] == got[single] and got[none] == []
    assert sorted(map(tuple, streamed(spark, str(folder)).collect())) == got[folder]
