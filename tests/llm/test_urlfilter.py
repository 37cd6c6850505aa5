import pytest
from pyspark.sql import functions as F

from custlattice.llm import urlfilter

URLS = {
    None: ("", "", None),
    "no scheme/a": ("", "", None),
    "": ("", "", None),
    "HTTP://WWW.Example.ORG/es/1?x#y": ("www.example.org", "/es/1", "example.org/es/"),
    "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"),
    "https://example.org/en/2": ("example.org", "/en/2", "org/"),
    "https://notexample.org/es/1": ("notexample.org", "/es/1", "org/"),
    "http://a.com/fr/": ("a.com", "/fr/", "com/fr/"),
    "http://a.com/de/x?y=/fr/": ("a.com", "/de/x", "com/de/"),
    "http://com?/fr/": ("com", "", None),
    "http://org#/": ("org", "", None),
    "http://É.ORG/É": ("É.org", "/É", "org/"),
    "x://y://z/": ("y:", "//z/", None),
    "http:///path": ("", "/path", None),
    "http://a.net/de/ x": ("a.net", "/de/ x", None),
}


@pytest.fixture(scope="module")
def model(spark):
    return urlfilter.fit(urlfilter.labelled_urls(spark))


def test_hosts_paths_and_rules(spark, model):
    pages = spark.createDataFrame([(i, u, "h", "old") for i, u in enumerate(URLS)], "page_id bigint, url string, html string, host string")
    rows = {r.url: r for r in urlfilter.judged(pages, model).collect()}
    assert {u: (r.host, r.path, r.rule) for u, r in rows.items()} == URLS
    verdicts = dict(urlfilter.RULES)
    for r in rows.values():
        assert r.verdict == (verdicts[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow")
        assert r.html == "h" and 0 <= r.score <= 1
    assert urlfilter.judged(pages.limit(0), model).count() == 0


def test_judges_hosts_it_has_not_seen(spark, model):
    bad = [f"http://{h}.example.net/en/{i}" for i, h in enumerate(("casino-win", "www.cheap-pills", "free-bets", "m.ads-track", "adult-x", "blog.spam-farm"))]
    good = [f"https://{h}.example.net/fr/{i}" for i, h in enumerate(("ththon", "blog.tionsh", "m.thernd", "www.garden-notes", "letters"))]
    pages = spark.createDataFrame([(u,) for u in bad + good], "url string")
    got = {r.url: r.verdict for r in urlfilter.judged(pages, model).collect()}
    assert [got[u] for u in bad] == ["block"] * len(bad)
    assert [got[u] for u in good] == ["allow"] * len(good)


def test_no_python_in_the_plan(spark, model):
    pages = spark.createDataFrame([("http://a.b/c",)], "url string").where(F.length("url") > 0)
    plan = urlfilter.judged(pages, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
