"""Golden rows for addresses, links and candidates."""

import pytest
from pyspark.sql import functions as F

from clauselake.functions import urls as ur
from clauselake.operators import addresses as ad
from clauselake.operators import candidates as ca
from clauselake.operators import links as li
from clauselake.plans import flows
from clauselake.sources.readers import read_sitemap_urls, sitemap_lines, sitemap_sources


def each(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "href, want",
    [
        ("https://x.org/a?b#c", "https://x.org/a?b#c"), ("https://x.org", "https://x.org/"),
        ("/a", "https://h.com/a"), ("a", "https://h.com/d/a"), ("../a", "https://h.com/a"),
        ("./a/../b?q=../z", "https://h.com/d/b?q=../z"), ("//o.com/a", "https://o.com/a"),
        ("?p=1", "https://h.com/d/e?p=1"), ("../../../a", "https://h.com/a"), ("a/..", "https://h.com/d/"),
        ("#x", None), ("mailto:a@b", None), ("javascript:f()", None), ("", None),
    ],
)
def test_resolve(spark, href, want):
    assert each(spark, [href], lambda c: ur.resolve_url(c, F.lit("https://h.com/d/e?x=1#f"))) == [want]


def test_domains(spark):
    assert each(spark, ["https://www.Spotify.com/", " netflix.com ", "http://a.b.co.uk/x?y", "some name"], ur.clean_domain) == [
        "spotify.com", "netflix.com", "a.b.co.uk", "some name"]
    parts = each(spark, ["a.b.co.uk", "x.com", "co.uk", "localhost"], ur.domain_parts)
    assert [tuple(p) for p in parts] == [
        ("a", "b.co.uk", "co.uk"), (None, "x.com", "com"), (None, "co.uk", "co.uk"), (None, "localhost", "localhost")]


def test_blocked(spark):
    assert each(spark, ["facebook.com", "www.facebook.com", "m.facebook.com", "notfacebook.com", "x.com"], ur.is_blocked_host) == [
        True, True, True, False, True]
    urls = ["https://en.example.org/a", "no address", "https://linkedin.com/x", "https://yelp.co/biz/1", "https://a.com/?u=wikipedia.org/wiki/Privacy",
            "https://a.com/?u=wikipedia.org/wiki/Cats"]
    assert each(spark, urls, ur.is_blocked_url) == [False, True, True, True, False, True]
    assert each(spark, ["https://a.com/x?returnurl=1", "https://a.com/SignIn", "https://a.com/p"], ur.is_auth_url) == [True, True, False]


def test_locale_and_home(spark):
    assert each(spark, ["https://a.com/DE/p", "https://a.com/pt-br/p", "https://a.com/en/p"], ur.has_foreign_locale) == [True, True, False]
    assert each(spark, ["https://a.com/de-at/x/fr/y", "https://a.com/x"], ur.english_variants) == [
        ["https://a.com/us/x/fr/y", "https://a.com/en/x/fr/y", "https://a.com/en-us/x/fr/y"], []]
    assert each(spark, ["https://a.com", "a.com/", "https://a.com/index.PHP", "https://a.com/x"], ur.is_homepage) == [True, True, True, False]


def test_scores(spark):
    # /privacy-policy: 1 pattern (20), /privacy listed 11 times and /privacy-policy 4 times.
    assert each(spark, ["https://a.com/privacy-policy", "https://a.com/dataschutz", "https://a.com/kvkk"], ur.score_privacy_url) == [100, 0, 50]
    assert each(spark, ["Imprint page"], lambda c: ur.score_link_text(c, ("imprint", "page"), ("imp",))) == [50]
    assert each(spark, ["imprint "], lambda c: ur.score_link_text(c, ("imprint", "page"), ("imp",))) == [80]
    words = each(spark, ["a.ch", "a.com"], ur.lexicon_for_host)
    assert "datenschutz" in words[0] and "riservatezza" in words[0] and "datenschutz" not in words[1]


def owners(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, u string, d string")
    return [(r.url_valid, r.url_confidence, len(r.url_issues)) for r in ad.validate_urls(df, "u", "d").orderBy("i").collect()]


def test_owner(spark):
    df = spark.createDataFrame(
        [("https://www.a.com/x", "a.com"), ("https://legal.a.com/x", "www.a.com"), ("https://icloud.com/x", "apple.com"),
         ("https://facebook.com/privacy", "meta.com"), ("https://b.com", "a.com"), ("nonsense", "a.com")], "u string, d string")
    got = [(r.owner_confidence, r.owner_valid) for r in ad.check_owner(df, "u", "d").collect()]
    assert got == [(100, True), (95, True), (90, True), (0, False), (0, False), (0, False)]
    pairs = [("https://evil.co.th/privacy", "bank.co.th"), ("https://a.com.my", "b.com.my"), ("https://x.bank.co.th", "bank.co.th"),
             ("https://a.github.io", "b.github.io")]
    df = spark.createDataFrame(pairs, "u string, d string")
    # Neighbours under the name of a private owner are strangers, by the built-in rules too.
    assert [r.owner_confidence for r in ad.check_owner(df, "u", "d").collect()] == [0, 0, 95, 0]
    listed = ad.check_owner(df, "u", "d", suffixes=("co.th", "com.my", "github.io")).collect()
    assert [r.owner_confidence for r in listed] == [0, 0, 95, 0]
    assert owners(spark, [("https://a.com/privacy", "a.com"), ("https://a.com/profile/1", "a.com"), ("https://b.com/x", "a.com")]) == [
        (True, 100, 0), (True, 80, 0), (False, 0, 1)]


PAGE = ("<html><body><nav><a href='/cookies-info'>Cookies</a></nav><div class='legal-box'><a href='/terms' title='Privacy'>T</a></div>"
        "<p><a href='/privacy'>Body privacy</a></p><!-- <a href='/hidden'>privacy</a> --><script>'<a href=\"/s\">privacy</a>'</script>"
        "<footer><a class=x href='/privacy'>Privacy <b>Policy</b></a><a href='mailto:privacy@a'>privacy</a></footer></body></html>")


def pages(spark, html=PAGE, url="https://a.com/"):
    return spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")


def test_extract_by_context(spark):
    got = {(r.context, r.href, r.text) for r in li.extract_links(pages(spark), least=3).collect()}
    assert got == {("footer", "/privacy", "Privacy Policy"), ("footer", "mailto:privacy@a", "privacy"),
                   ("legal_hub", "/terms", "T"), ("nav", "/cookies-info", "Cookies")}
    every = {(r.context, r.href) for r in li.extract_links(pages(spark), only_privacy=False).collect()}
    assert ("nav", "/cookies-info") in every and ("body", "/privacy") in every
    assert not any(h in ("/hidden", "/s") for _, h in every)


def test_body_gate(spark):
    few = "<body><p><a href='/privacy'>x</a></p><footer><a href='/p1'>privacy</a></footer></body>"
    many = "<body><p><a href='/privacy'>x</a></p><footer>" + "".join(f"<a href='/p{i}'>privacy</a>" for i in range(3)) + "</footer></body>"
    assert {r.context for r in li.extract_links(pages(spark, few), least=3).collect()} == {"footer", "body"}
    assert {r.context for r in li.extract_links(pages(spark, many), least=3).collect()} == {"footer"}
    assert {r.context for r in li.extract_links(pages(spark, many)).collect()} == {"footer", "body"}


def test_homepage_confidence(spark):
    rows = li.dedupe_links_first(li.score_homepage_links(li.extract_links(pages(spark), least=3))).withColumn("domain", F.lit("a.com"))
    got = {r.link_url: (r.score, r.confidence) for r in li.homepage_confidence(rows).collect()}
    assert got["https://a.com/privacy"][1] == 98 and got["https://a.com/privacy"][0] == 100 + 100 + 25 + 20
    assert li.homepage_confidence(rows.withColumn("m", F.lit(0.0)), model_score="m").count() == len(got)


def test_deep_links(spark):
    html = "<body><a href='/privacy/datenschutzerklaerung'>x</a><a href='/cats'>cats</a></body>"
    deep = li.score_deep_links(li.extract_links(pages(spark, html), only_privacy=False)).collect()
    assert [r.href for r in deep] == ["/privacy/datenschutzerklaerung"] and deep[0].score == 140


def edge(spark, rows):
    return spark.createDataFrame(rows, "url string, link_url string, score int, from_hub boolean")


def test_expand(spark):
    starts = spark.createDataFrame([("a.com", "https://a.com/p")], "domain string, url string")
    edges = edge(spark, [("https://a.com/p", "https://a.com/q", 10, False), ("https://a.com/q/", "https://a.com/r", 5, False),
                         ("https://a.com/r", "https://a.com/p", 30, False), ("https://a.com/p", "https://b.com/x", 40, False),
                         ("https://a.com/r", "https://a.com/s", 10, True), ("https://a.com/s", "https://a.com/t", 40, True)])
    got = {(r.found_url, r.confidence, r.depth) for r in li.expand_links(starts, edges).collect()}
    # q: 60 is followed, not reported; r: 5+60 followed; at depth 2 r reports p and s; s is past the limit.
    assert got == {("https://a.com/p", 90, 3), ("https://a.com/s", 85, 3)}


def test_classify(spark):
    df = spark.createDataFrame([("footer", "Privacy Policy", "/privacy"), ("body", "x", "/legal"), ("nav", "Terms", "/x")],
                               "context string, text string, href string")
    got = {(r.text, r.type, r.confidence) for r in li.classify_links(df).collect()}
    assert ("Privacy Policy", "privacy", 6.0) in got and ("Terms", "terms", 2.0) in got and not any(t == "x" for t, _, _ in got)
    crawl = {(r.text, r.type, r.confidence) for r in li.classify_links(df, li.L.CRAWL_LINK_PATTERNS, "crawl").collect()}
    assert ("Privacy Policy", "privacy", 50.0) in crawl and ("Terms", "terms", 35.0) in crawl
    hub = li.classify_links(df, li.L.CRAWL_LINK_PATTERNS, "legal_hub").collect()
    assert {r.confidence for r in hub} == {75.0} and len({r.text for r in hub}) == len(hub)


def test_direct_page(spark):
    text = "<title>Privacy</title> personal data, privacy, how we use, your data " + "x" * 20
    got = li.direct_page_confidence(pages(spark, text, "https://a.com/privacy")).first()
    # "privacy" stands in the list twice.
    assert (got.term_count, got.confidence) == (5, 95)
    login = text + "enter your password forgot password"
    assert li.direct_page_confidence(pages(spark, login)).count() == 0


CAND = "domain string, source string, confidence int, url string"


def test_best_candidate_stops_early(spark):
    df = spark.createDataFrame([("a", "direct_fetch", 85, "u1"), ("a", "sitemap", 90, "u2"), ("b", "direct_fetch", 84, "u1"),
                                ("b", "sitemap", 90, "u2"), ("c", "sitemap", 70, "z"), ("c", "sitemap", 70, "y")], CAND)
    assert {(r.domain, r.url) for r in ca.best_candidate(df).collect()} == {("a", "u1"), ("b", "u2"), ("c", "y")}


def test_best_validated(spark):
    rows = [("a", "sitemap", 90, "a1"), ("b", "sitemap", 90, "b1"), ("b", "sitemap", 80, "b2"), ("b", "sitemap", 70, "b3"),
            ("c", "sitemap", 45, "c1"), ("d", "sitemap", 60, "d1")] + [("e", "sitemap", 90 - i, f"e{i}") for i in range(7)]
    checks = [("a1", True, 75, False), ("b1", False, 10, True), ("b2", False, 10, True), ("b3", True, 95, False), ("c1", False, 0, True),
              ("d1", False, 0, False)] + [(f"e{i}", i == 6, 50, True) for i in range(7)]
    got = ca.best_validated_candidate(spark.createDataFrame(rows, CAND), spark.createDataFrame(
        checks, "url string, valid boolean, content_confidence int, search_on boolean"))
    assert {(r.domain, r.url, r.confidence, r.outcome) for r in got.collect()} == {
        ("a", "a1", 97, "validated"), ("b", "b3", 95, "alternative"), ("c", "c1", 30, "inconclusive"), ("d", "d1", 60, "unchecked"),
        ("e", "e0", 70, "inconclusive")}


def test_best_per_type(spark):
    df = spark.createDataFrame([("a", "sitemap", 79, "x", "terms"), ("a", "sitemap", 79, "w", "terms"), ("a", "sitemap", 80, "p", "privacy"),
                                ("a", "sitemap", 49, "g", "gdpr"), ("a", "sitemap", 50, "c", "ccpa")], CAND + ", type string")
    got = {r.type: (r.url, r.level, r.type_order) for r in ca.best_per_type(df).collect()}
    assert got == {"terms": ("w", "medium", 2), "privacy": ("p", "high", 1), "gdpr": ("g", "low", 5), "ccpa": ("c", "medium", 6)}


def test_consensus(spark):
    v = [("x", "A.com", 90), ("x", "a.com", 80), ("x", "a.com", 70), ("y", "b.com", 90), ("y", "b.com", 60), ("y", "c.com", 99),
         ("z", "d.com", 50), ("n", None, 0)]
    got = {r.company: (r.domain, r.votes, r.score, r.confidence) for r in
           ca.consensus_domain(spark.createDataFrame(v, "company string, domain string, confidence int")).collect()}
    assert got == {"x": ("a.com", 3, 170.0, 80), "y": ("b.com", 2, 135.0, 64), "z": ("d.com", 1, 80.0, 30)}


def test_lookups(spark):
    d = spark.createDataFrame([("www.meta.com",), ("facebook.com",), ("bhphotovideo.com",), ("none.org",)], "domain string")
    got = ca.special_domain_override(d).collect()
    assert {(r.domain, r.type) for r in got} == {("www.meta.com", "privacy"), ("facebook.com", "privacy"), ("facebook.com", "terms"),
                                                 ("bhphotovideo.com", "privacy"), ("bhphotovideo.com", "terms"), ("bhphotovideo.com", "cookies")}
    names = spark.createDataFrame([("Deutsche Bank",), ("N-26",), ("nobody",)], "name string")
    table = spark.createDataFrame([("deutschebank", "deutsche-bank.de"), ("n26", "n26.com")], "company string, domain string")
    assert {tuple(r) for r in ca.resolve_company(names, table).collect()} == {("Deutsche Bank", "deutsche-bank.de"), ("N-26", "n26.com")}


def test_rerank(spark):
    df = spark.createDataFrame([("q", "https://a.com/help", "t"), ("q", "https://x/?uddg=https%3A%2F%2Fa.com%2Fprivacy&z", "Policy"),
                                ("q", "https://a.com/login", "privacy")], "query string, url string, title string")
    got = ca.rerank_search_results(df).collect()
    assert [(r.target, round(r.score, 2)) for r in got] == [("https://a.com/privacy", 14.0 - 0.05 + 0.0), ("https://a.com/help", -5.9)]


def test_merge_and_validate(spark):
    a = spark.createDataFrame([("d", "privacy", "u1")], "domain string, type string, url string")
    b = spark.createDataFrame([("d", "privacy", "u2"), ("d", "terms", "u3")], "domain string, type string, url string")
    assert {(r.type, r.url) for r in ca.merge_by_priority([a, b]).collect()} == {("privacy", "u1"), ("terms", "u3")}
    p = spark.createDataFrame([("u1", "privacy", "crawl", "medium", 0.2), ("u2", "terms", "crawl", "medium", 0.9), ("u3", "gdpr", "crawl", "low", 0.1)],
                              "url string, type string, source string, level string, model_score double")
    bodies = spark.createDataFrame([("u1", "we collect " + "x" * 1000), ("u3", "gdpr")], "url string, body string")
    assert {r.url for r in ca.validate_by_type(p, bodies).collect()} == {"u1", "u2"}


def test_paths(spark):
    d = spark.createDataFrame([("a.com",)], "domain string")
    ps = spark.createDataFrame([(1, "http://www.a.com/privacy/", "x" * 3000), (2, "https://a.com/terms", "x"), (3, "https://a.com/policy", "x" * 3000)],
                               "page_id int, url string, html string")
    got = {(r.path, r.url) for r in ca.path_candidates(d, ps, min_body=2000, with_www=True).collect()}
    assert got == {("/privacy", "http://www.a.com/privacy/"), ("/policy", "https://a.com/policy")}
    start = spark.createDataFrame([("a.com", "https://a.com/datenschutz/")], "domain string, url string")
    body = "<body>dsgvo gdpr datenschutzhinweise personenbezogene daten wir erheben" + "x" * 3000
    nested = spark.createDataFrame([(1, "https://a.com/datenschutz/datenschutzerklaerung", body)], "page_id int, url string, html string")
    assert [(r.confidence, r.depth) for r in ca.nested_path_candidates(start, nested).collect()] == [(95, 1)]


def test_sitemaps(spark):
    maps = spark.createDataFrame(
        [("https://a.com/sitemap.xml", "<sitemapindex><sitemap><loc>https://a.com/s1.xml</loc></sitemap><sitemap><loc>https://a.com/s2.xml</loc></sitemap></sitemapindex>"),
         ("https://a.com/s1.xml", "<urlset><url><loc>https://a.com/privacy</loc></url><url><loc><![CDATA[https://a.com/x]]></loc></url></urlset>"),
         ("https://a.com/s2.xml", "<urlset><url><loc>https://a.com/y</loc></url></urlset>")],
        "url string, body string")
    got = {tuple(r) for r in read_sitemap_urls(maps).collect()}
    assert got == {(m, u) for m in ("https://a.com/sitemap.xml", "https://a.com/s1.xml") for u in ("https://a.com/privacy", "https://a.com/x")} | {
        (m, "https://a.com/y") for m in ("https://a.com/sitemap.xml", "https://a.com/s2.xml")}
    robots = spark.createDataFrame([("https://a.com/robots.txt", "User-agent: *\nsitemap: s1\nSitemap:s2\nSITEMAP: s3\nSitemap: s4")], "url string, body string")
    domains = spark.createDataFrame([("a.com",), ("b.com",)], "domain string")
    assert {tuple(r) for r in sitemap_sources(domains, sitemap_lines(robots), 3).collect()} == {
        ("a.com", "s1"), ("a.com", "s2"), ("a.com", "s3"), ("b.com", "https://b.com/sitemap.xml")}


def test_search_and_old_scores(spark):
    df = spark.createDataFrame([("a.com", "https://facebook.com/a.com", 1), ("a.com", "https://a.com/1", 2), ("a.com", "https://x.a.com/2", 3),
                                ("a.com", "https://b.com", 4), ("a.com", "https://a.com/3", 5), ("a.com", "https://a.com/4", 6)], "domain string, url string, position int")
    assert {(r.url, r.confidence) for r in ca.search_candidates(df).collect()} == {("https://a.com/1", 50), ("https://x.a.com/2", 40), ("https://a.com/3", 30)}
    row = spark.createDataFrame([("https://a.com/en/privacy", "Privacy")], "u string, t string")
    got = row.select(li.old_link_score(F.col("u"), F.col("t"), F.lit(True)).alias("a"),
                     li.old_link_score(F.col("u"), F.col("t"), F.lit(True), "universal", F.lit(True)).alias("b"),
                     li.old_link_score(F.lit("https://a.com/login"), F.col("t"), F.lit(True)).alias("c")).first()
    assert tuple(got) == (150, 125, None)


def test_discovery_flow(spark):
    home = "<body><p>x</p><footer><a href='/privacy'>Privacy Policy</a><a href='/tos'>Terms of Service</a></footer></body>"
    ps = spark.createDataFrame([(1, "https://shop.example.com/", home), (2, "https://meta.com/", home), (3, "https://shop.example.com/cookies", "x" * 3000)],
                               "page_id int, url string, html string")
    got = {(r.domain, r.type): (r.url, r.source, r.level) for r in flows.discover_policies(ps).collect()}
    assert got[("meta.com", "privacy")][1] == "special_domain" and ("meta.com", "terms") not in got
    assert got[("shop.example.com", "privacy")] == ("https://shop.example.com/privacy", "footer_link", "medium")
    assert got[("shop.example.com", "cookies")] == ("https://shop.example.com/cookies", "direct_probe", "medium")
