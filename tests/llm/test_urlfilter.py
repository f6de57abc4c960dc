import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import queries, urlfilter

URLS = [
    (1, "http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    (2, "https://example.net/fr/", "example.net", "/fr/", "net/", "block"),
    (3, "http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    (4, "http://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
    (5, "http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    (6, "http://net", "net", "", None, "allow"),
    (7, None, "", "", None, "allow"),
    (8, "no scheme/net/", "", "", None, "allow"),
    (9, "http://listed.com/a/?utm_source=q&k=1#f", "listed.com", "/a/", None, "block"),
    (9, "http://listed.com/a/?utm_source=q&k=1#f", "listed.com", "/a/", None, "block"),
    (10, "http://other.com/a?k=1", "other.com", "/a", None, "allow"),
    (11, "://", "", "", None, "allow"),
    (12, "http://x.net?://y/", "x.net", "", None, "allow"),
]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_judged(spark, limit):
    pages = spark.createDataFrame([u[:2] for u in URLS], "page_id long, url string").withColumns({"verdict": F.lit("old"), "html": F.lit("h")})
    listed = spark.createDataFrame([("https://LISTED.com/a?k=1",), (None,), ("",), ("http://www.example.net/",)], "url string")
    done = urlfilter.judged(pages, listed, queries.URL_RULES, broadcast_bytes=limit)
    assert set(done.columns) == {"page_id", "url", "html", "host", "path", "rule", "verdict"}
    assert sorted([(r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in done.collect()], key=str) == sorted(URLS, key=str)


def test_filter_loses_nothing(spark):
    urls = spark.range(3000).select(F.concat(F.lit("http://h"), "id", F.lit(".com/")).alias("url"))
    done = urlfilter.judged(urls, urls.where("hash(url) % 2 = 0"), [])
    got = done.groupBy((F.hash("url") % 2 == 0).alias("on"), "verdict").count().collect()
    assert {(r.on, r.verdict) for r in got} == {(True, "block"), (False, "allow")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert urlfilter.judged(none, some, queries.URL_RULES).count() == 0
    assert [r.verdict for r in urlfilter.judged(some, none, queries.URL_RULES).collect()] == ["allow"]
