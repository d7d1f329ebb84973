"""Host reputation where it decides, and odd tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentria.llm import url_reputation
from tests.llm.test_operators import PAGES

SUFFIXES = ("co.test", "com.test")


def pages_of(spark, *urls):
    return spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)


def test_domain_parts(spark):
    hosts = ["a.b.co.test", "co.test", "b.co.test", "x.test", "test", "", "a.notco.test", "a.b.c.d"]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *(c.alias(n) for c, n in zip(url_reputation.domain_parts(F.col("host"), SUFFIXES), ("domain", "suffix"), strict=True))).collect()
    assert {r["host"]: (r["domain"], r["suffix"]) for r in got} == {
        "a.b.co.test": ("b.co.test", "co.test"), "co.test": ("co.test", "co.test"), "b.co.test": ("b.co.test", "co.test"), "x.test": ("x.test", "test"), "test": ("test", "test"), "": ("", ""),
        "a.notco.test": ("notco.test", "test"), "a.b.c.d": ("c.d", "d"),
    }


def test_posterior_decides(spark):
    """A host with bad outcomes only, its unlabelled neighbour in the same domain, and hosts that are fine."""
    urls = [f"https://www.spam.co.test/{i}" for i in range(60)] + [f"http://shop.fine{i % 20}.co.test/{i}" for i in range(200)] + ["http://new.spam.co.test/", "http://unseen.test/"]
    pages = pages_of(spark, *urls)
    outcomes = spark.createDataFrame([(i, int(i < 60)) for i in range(260)], "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_reputation.url_filter(pages, outcomes, [], suffixes=SUFFIXES).collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[i] for i in range(60, 260)} == {"allow"} and got[261] == "allow"
    # with the last label as the suffix, all are of one domain: the host's own outcomes still decide
    plain = {r["page_id"]: r["verdict"] for r in url_reputation.url_filter(pages, outcomes, []).collect()}
    assert plain[0] == "block" and plain[100] == "allow"
    # a rule goes before the posterior
    ruled = url_reputation.url_filter(pages, outcomes, [("allow", "spam.co.test/1")], suffixes=SUFFIXES).filter("rule is not null").select("verdict").distinct().collect()
    assert [r["verdict"] for r in ruled] == ["allow"]


def test_odd_tables(spark):
    pages = pages_of(spark, None, "", "x", "http://", "http://A.test", "http://A.test", "://?x").selectExpr("*", "1 as host", "2 as path", "3 as bad", "4 as domain", "5 as rate")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = url_reputation.url_filter(pages, none, [("block", "a.test/")])
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()) == [(0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.test", "", None, "allow"), (5, "a.test", "", None, "allow"), (6, "", "", None, "allow")]
    assert url_reputation.url_filter(pages.limit(0), none, []).count() == 0
    # a tie of outcomes counts as bad, several of one page by majority
    ties = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (5, 0), (5, 1), (4, None)], "page_id long, bad int")
    rates = {r["host"]: r["rate"] for r in url_reputation.url_filter(pages, ties, []).collect()}
    assert 0 < rates["a.test"] < 1
