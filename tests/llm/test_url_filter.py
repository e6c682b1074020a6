"""URL filter: hosts, paths and rules against a plain reading of the contract; learned verdicts on planted hosts."""

import re

from routelens.llm import url_filter as U
from routelens.sources.tables import read_table

SF0001 = "/root/testdata/sf0.001"


def plain(url):
    """host, path, rule, verdict (None where the method decides)."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


ODD = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/1?x#y", "http://example.org/en/2", "x://org", "x://org/",
       "http://xorg/en/", "http://a.com/fr/1", "http://a.com/de", "http://a.com/de/", "a://b://c/d", "http://É.COM/fr/\n2",
       "http://h.net?q=/de/", "http://h.net#f", "http://notexample.org/es/1", "http://h.com//de/", "http://" + "a" * 50000]


def test_query_equals_plain_reading(spark):
    from routelens.llm.queries import QUERIES
    pages = {r["page_id"]: r["url"] for r in read_table(spark, SF0001, "pages").select("page_id", "url").collect()}
    got = QUERIES["op10_url_filter"](spark, SF0001).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = plain(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(ODD)] + [(3, ODD[3], "x", "y")],
                               "page_id long, url string, host string, purity string")
    got = U.url_digest(df).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == plain(ODD[r["page_id"]])[:3], ODD[r["page_id"]]
    assert U.url_digest(df.limit(0)).count() == 0
    unlabelled = U.url_digest(spark.createDataFrame([(1, "http://h.net/a/b")], "page_id long, url string")).collect()
    assert unlabelled[0]["verdict"] == "allow"


def test_tokens(spark):
    df = spark.createDataFrame([("/en/123/a1.html//2024-01-02/0123abcd9f/News",)], "p string")
    assert df.select(U.tokens_of(df.p)).first()[0] == ["en", "{n}", "{mixed}.html", "{date}", "{hex}", "news"]


def test_learned_verdicts(spark):
    """On one host /spam/... is blocked, /blog/... allowed; unruled URLs of the same templates follow."""
    rules = (("site.net", "/spam/x", "block"), ("site.net", "/blog/x", "allow"), ("site.net", "/news/x", "allow"))
    urls = [f"http://site.net/{d}/x{i}" for d in ("spam", "blog", "news") for i in range(20)]
    urls += ["http://site.net/spam/other", "http://site.net/blog/other", "http://www.site.net/news/other"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in U.judge(df, rules).select("__row.page_id", "verdict", "purity").collect()}
    assert got[60]["verdict"] == "block" and got[60]["purity"] > 0.8
    assert got[61]["verdict"] == "allow" and got[61]["purity"] < 0.2
