"""Stored tables by key buckets, and sitemap indexes of indexes."""

import glob
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clauselake.operators import keyed
from clauselake.sources import readers, stored

SCHEMA = "k long, d string, v int, first int"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/{stored.BUCKET}=*/part-*")}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    base = spark.createDataFrame([(i, "x", i, i) for i in range(400)], SCHEMA)
    stored.create_stored(base, path, ["k", "d"], 16)
    return path, base


def test_update_touches_its_buckets_only(spark, table):
    path, base = table
    before = files(path)
    updates = spark.createDataFrame([(3, "x", 90, 1), (3, "x", 80, 2), (1000, "y", 5, 5)], SCHEMA)
    n = stored.upsert_stored(spark, path, updates, ["k", "d"], [F.desc("v")], 16, keep=["first"])
    assert 1 <= n <= 2
    after = files(path)
    same = [f for f in before if after.get(f) == before[f]]
    assert len({os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in same}) == n
    want = keyed.upsert(base, updates, ["k", "d"], [F.desc("v")], keep=["first"])
    assert sorted(map(tuple, stored.read_stored(spark, path).collect())) == sorted(map(tuple, want.collect()))
    assert {tuple(r) for r in stored.read_stored(spark, path).where("k in (3, 1000)").collect()} == {(3, "x", 90, 3), (1000, "y", 5, 5)}


def test_only_touched_buckets_are_read(spark, table):
    path, _ = table
    rows = spark.createDataFrame([(3, "x")], "k long, d string").withColumn(stored.BUCKET, stored.bucket_of(["k", "d"], 16))
    found, base = stored._touched(spark, path, rows, 16)
    assert len(found) == 1
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and stored.BUCKET in plan.split("PartitionFilters")[1].split("]")[0]


def test_repeated_updates_change_nothing(spark, table):
    path, _ = table
    updates = spark.createDataFrame([(i, "x", 1000 + i, 0) for i in range(50)], SCHEMA)
    for _ in range(2):
        stored.upsert_stored(spark, path, updates, ["k", "d"], [F.desc("v")], 16)
        last = sorted(map(tuple, stored.read_stored(spark, path).collect()))
        assert len(last) == 400 and last[3] == (3, "x", 1003, 0)


def test_no_updates(spark, table):
    path, base = table
    before = files(path)
    assert stored.upsert_stored(spark, path, base.limit(0), ["k", "d"], [F.desc("v")], 16) == 0
    assert files(path) == before


def test_insert_and_delete(spark, table):
    path, base = table
    rows = spark.createDataFrame([(5, "x", -1, -1), (2000, "x", 1, 1), (2000, "x", 2, 2)], SCHEMA)
    assert stored.insert_stored(spark, path, rows, ["k", "d"], 16, [F.desc("v")]) <= 2
    got = {r.k: r for r in stored.read_stored(spark, path).collect()}
    assert len(got) == 401 and got[5].v == 5 and got[2000].v == 2
    assert stored.delete_stored(spark, path, base.unionByName(rows), ["k", "d"], 16) == 16
    assert glob.glob(f"{path}/{stored.BUCKET}=*/part-*") == []


def test_null_keys_are_inserted(spark, table):
    path, _ = table
    updates = spark.createDataFrame([(None, "x", 1, 1)], SCHEMA)
    stored.upsert_stored(spark, path, updates, ["k", "d"], [F.desc("v")], 16)
    assert stored.read_stored(spark, path).where("k is null").count() == 1


def maps(spark):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    leaf = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    rows = [("top", index("mid", "mid", "lost", "leaf1")), ("mid", index("low", "leaf1")), ("low", index("leaf2", "top")), ("self", index("self")),
            ("leaf1", leaf("u1", "u1")), ("leaf2", leaf("<![CDATA[u2]]>")), ("empty", None), ("bad", "")]
    return spark.createDataFrame(rows, "url string, body string")


def test_indexes_of_indexes_and_loops(spark):
    got = sorted((r.sitemap_url, r["loc"]) for r in readers.read_sitemap_urls(maps(spark)).collect())
    every = [("u1"), ("u1"), ("u2")]
    assert got == sorted([("leaf1", "u1")] * 2 + [("leaf2", "u2")] + [(i, u) for i in ("top", "mid", "low") for u in every])


def test_depth_can_be_bounded(spark):
    got = {r.sitemap_url for r in readers.read_sitemap_urls(maps(spark), max_depth=1).where("loc = 'u2'").collect()}
    assert got == {"leaf2", "low"}


def test_long_chains_and_rings_of_indexes(spark):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    leaf = lambda loc: f"<urlset><url><loc>{loc}</loc></url></urlset>"
    n = 40
    chain = [(f"c{i}", index(f"c{i + 1}", f"leaf{i}")) for i in range(n)] + [(f"leaf{i}", leaf(f"u{i}")) for i in range(n)]
    ring = [(f"r{i}", index(f"r{(i + 1) % 9}", f"r{(i + 4) % 9}")) for i in range(8)] + [("r8", index("r0", "leaf0")), (None, index("r3", "leaf1"))]
    maps = spark.createDataFrame(chain + ring, "url string, body string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sitemaps", "")
    got = {(r.sitemap_url, r["loc"]) for r in readers.read_sitemap_urls(maps).collect()}
    assert len(jobs.getJobIdsForGroup("sitemaps")) < 120
    spark.sparkContext.setJobGroup("", "")
    leaves = {(f"leaf{i}", f"u{i}") for i in range(n)}
    assert got == leaves | {(f"c{i}", f"u{k}") for i in range(n) for k in range(i, n)} | {(f"r{i}", "u0") for i in range(9)} | {
        (None, "u0"), (None, "u1")}
    for depth in (1, 2, 3, 6):
        got = {(r.sitemap_url, r["loc"]) for r in readers.read_sitemap_urls(maps, max_depth=depth).collect() if (r.sitemap_url or "r")[0] == "c"}
        assert got == {(f"c{i}", f"u{k}") for i in range(n) for k in range(i, min(n, i + depth))}


def brute_sitemaps(rows, depth=10**9):
    """(sitemap, address) with repeats, by following every index by hand."""
    named = lambda body: list(dict.fromkeys(re.findall(r"<loc>(.*?)</loc>", body or "")))
    files, indexes, got = [], {}, []
    for url, body in rows:
        if "<sitemapindex" in (body or ""):
            indexes.setdefault(url, set()).update(named(body))
        else:
            files.append((url, re.findall(r"<loc>(.*?)</loc>", body or "")))
    for index, to in indexes.items():
        seen, edge, steps = set(to), set(to), 1
        while edge and steps < depth:
            edge = {x for e in edge for x in indexes.get(e, ())} - seen
            seen, steps = seen | edge, steps + 1
        got += [(index, loc) for url, locs in files for loc in locs if url in seen]
    return Counter(got + [(url, loc) for url, locs in files for loc in locs])


def test_sitemaps_mark_the_first_row_of_an_address(spark):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    leaf = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    deal = random.Random(5)
    rows = [(f"i{k}", index(*deal.sample([f"i{x}" for x in range(90)], 2), *deal.sample([f"f{x}" for x in range(60)], 2))) for k in range(80)]
    rows += [(f"f{k}", leaf(*deal.choices([f"u{x}" for x in range(70)], k=3), f"only{k}")) for k in range(60)]
    # Files of one address that come twice, an address that is an index and a file, and addresses that are missing.
    rows += [(f"f{k}", leaf("again", f"only{k}")) for k in range(5)] + [("i3", leaf("u1", "mine")), ("i4", index("f9", "i4")), ("i4", leaf("u2", "u2"))]
    rows += [(None, index("f3", "i79")), (None, leaf("u3", "nobody's")), ("i85", None), ("many", leaf(*[f"m{x}" for x in range(1200)], "m1")), ("i0", index("many"))]
    maps = spark.createDataFrame(rows, "url string, body string").repartition(5)
    for depth in (None, 1, 2, 4):
        want = brute_sitemaps(rows, depth or 10**9)
        got = readers.read_sitemap_urls(maps, max_depth=depth, first="first").collect()
        assert Counter((r.sitemap_url, r["loc"]) for r in got) == want
        assert Counter((r.sitemap_url, r["loc"]) for r in got if r.first) == Counter(want.keys())
    assert Counter(map(tuple, readers.read_sitemap_urls(maps).collect())) == brute_sitemaps(rows)


def test_rows_of_nested_indexes_are_not_shuffled(spark):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    n = 200
    maps = spark.createDataFrame([(f"c{i}", index(f"c{i + 1}", f"f{i}")) for i in range(n)] + [
        (f"f{i}", f"<urlset><url><loc>u{i}</loc></url><url><loc>all</loc></url></urlset>") for i in range(n)], "url string, body string")
    got = readers.read_sitemap_urls(maps)
    assert got.count() == n * (n + 1) + 2 * n
    rows = got.agg(F.count("loc").alias("n"))
    assert rows.collect()[0].n == n * (n + 1) + 2 * n

    def written(node):
        held = node.metrics().get("shuffleRecordsWritten")
        below = [node.children().apply(i) for i in range(node.children().size())]
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            below = [node.executedPlan()]
        elif kind.endswith("QueryStageExec"):
            below = [node.plan()]
        return (held.get().value() if held.isDefined() else 0) + sum(map(written, below))

    assert written(rows._jdf.queryExecution().executedPlan()) < 10_000
