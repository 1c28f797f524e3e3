"""Public suffix rules: as a short list in the plan, as a table, and what owner checks make of them."""

import pytest
from pyspark.sql import functions as F

from clauselake.functions import urls as ur
from clauselake.operators import addresses, suffixes
from clauselake.sources import readers

RULES = ["com", "uk", "co.uk", "*.sch.uk", "jp", "tokyo.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "k12.ca.us", "us",
         "ca.us", "a.b.example"]
PRIVATE = ["github.io", "herokuapp.com", "*.elb.amazonaws.com"]
# host, subdomain, registrable domain, suffix
CASES = [
    ("example.com", None, "example.com", "com"),
    ("www.shop.example.co.uk", "www.shop", "example.co.uk", "co.uk"),
    ("co.uk", None, None, "co.uk"),
    ("a.high.sch.uk", None, "a.high.sch.uk", "high.sch.uk"),
    ("b.a.high.sch.uk", "b", "a.high.sch.uk", "high.sch.uk"),
    ("sch.uk", None, "sch.uk", "uk"),
    ("x.tokyo.jp", None, "x.tokyo.jp", "tokyo.jp"),
    ("x.y.kawasaki.jp", None, "x.y.kawasaki.jp", "y.kawasaki.jp"),
    ("city.kawasaki.jp", None, "city.kawasaki.jp", "kawasaki.jp"),
    ("w.city.kawasaki.jp", "w", "city.kawasaki.jp", "kawasaki.jp"),
    ("www.ck", None, "www.ck", "ck"),
    ("b.ck", None, None, "b.ck"),
    ("s.k12.ca.us", None, "s.k12.ca.us", "k12.ca.us"),
    ("x.github.io", None, "x.github.io", "github.io"),
    ("app.eu.elb.amazonaws.com", None, "app.eu.elb.amazonaws.com", "eu.elb.amazonaws.com"),
    ("no.rule.example", "no", "rule.example", "example"),
    ("localhost", None, None, "localhost"),
    ("x.a.b.example", None, "x.a.b.example", "a.b.example"),
]


@pytest.fixture(scope="module")
def rules(spark):
    return suffixes.suffix_rules(spark.createDataFrame([(r, False) for r in RULES] + [(r, True) for r in PRIVATE], "rule string, private boolean"))


def hosts(spark):
    return spark.createDataFrame([(c[0],) for c in CASES] + [(None,), ("example.com",)], "host string")


def test_table_of_rules(spark, rules):
    got = suffixes.host_parts(hosts(spark), rules)
    assert sorted(map(tuple, got.collect())) == sorted(CASES)


def test_short_list_in_the_plan(spark):
    host = F.col("host")
    got = hosts(spark).where("host is not null").distinct().select(
        "host", ur.registrable_domain(host, RULES + PRIVATE).alias("root"), ur.public_suffix(host, RULES + PRIVATE).alias("tld"))
    assert sorted(map(tuple, got.collect())) == sorted((h, r, t) for h, _, r, t in CASES)


def test_private_rules_can_be_left_out(spark, rules):
    df = spark.createDataFrame([("x.github.io",), ("a.tokyo.jp",)], "host string")
    got = suffixes.host_parts(df, rules, private=False)
    assert sorted((r.host, r.root_domain) for r in got.collect()) == [("a.tokyo.jp", "a.tokyo.jp"), ("x.github.io", "github.io")]


STRANGERS = [("x.github.io", "y.github.io"), ("s.k12.ca.us", "t.k12.ca.us"), ("a.one.sch.uk", "b.one.sch.uk"), ("x.tokyo.jp", "y.tokyo.jp"),
             ("x.herokuapp.com", "y.herokuapp.com"), ("x.co.th", "y.co.th"), ("github.io", "herokuapp.com")]
RELATIVES = [("docs.x.github.io", "x.github.io"), ("a.shop.co.uk", "shop.co.uk"), ("w.city.kawasaki.jp", "city.kawasaki.jp")]


@pytest.mark.parametrize("table", [False, True])
def test_owners(spark, rules, table):
    df = spark.createDataFrame([(f"https://{a}/privacy", b, i < len(STRANGERS)) for i, (a, b) in enumerate(STRANGERS + RELATIVES)],
                               "url string, domain string, stranger boolean").withColumn("host", F.lit("x"))
    more = suffixes.suffix_rules(spark.createDataFrame([("co.th",), ("github.io",)], "rule string"), private=None)
    got = addresses.check_owner(df, "url", "domain", suffixes=rules.unionByName(more) if table else None)
    assert {(r.stranger, r.owner_valid, r.owner_confidence) for r in got.collect()} == {(True, False, 0), (False, True, 95)}
    valid = addresses.validate_urls(df, "url", "domain", suffixes=rules.unionByName(more) if table else None)
    assert {(r.stranger, r.url_valid) for r in valid.collect()} == {(True, False), (False, True)}


def test_missing_addresses_stay(spark, rules):
    df = spark.createDataFrame([(None, "x.com"), ("no address", "x.com"), ("https://x.com/", None)], "url string, domain string")
    got = addresses.check_owner(df, "url", "domain", suffixes=rules).collect()
    assert len(got) == 3 and {r.owner_confidence for r in got} == {0}


def test_list_file(spark, tmp_path):
    text = ("// a comment\n// ===BEGIN ICANN DOMAINS===\ncom\n\n*.ck  // all of them\n!www.ck\n// ===END ICANN DOMAINS===\n"
            "// ===BEGIN PRIVATE DOMAINS===\r\n// someone\ngithub.io\nCOM\n// ===END PRIVATE DOMAINS===\nlate.example\n")
    path = tmp_path / "suffixes.dat"
    path.write_text(text)
    got = readers.read_public_suffixes(spark, str(path))
    assert sorted(map(tuple, got.collect())) == [("exception", "www.ck", False), ("rule", "com", False), ("rule", "github.io", True),
                                                 ("rule", "late.example", False), ("wildcard", "ck", False)]


def test_rules_are_broadcast_and_hosts_made_distinct_first(spark, rules):
    got = suffixes.host_parts(spark.range(1000).selectExpr("concat('x', id % 3, '.com') AS host"), rules)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 3 and plan.index("Generate") < plan.rindex("Aggregate [host") and "strategy=broadcast" in plan
