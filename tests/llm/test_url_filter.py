import pytest

from tablescope.llm import url_filter as u


@pytest.mark.parametrize(
    "url, expected",
    [
        (None, ("", "")),
        ("", ("", "")),
        ("no scheme.org/x", ("", "")),
        ("HTTP://WWW.Example.ORG", ("www.example.org", "")),
        ("http://a.org/P/q?x=/y#z", ("a.org", "/P/q")),
        ("http://a.org?x", ("a.org", "")),
        ("http://a.org#/x", ("a.org", "")),
        ("a://b://c", ("b:", "//c")),
        ("x://É.org/é", ("É.org", "/é")),
    ],
)
def test_host_and_path(url, expected):
    assert u.host_and_path(url) == expected


def test_longest_rule_wins_on_hosts_and_subdomains():
    rules = u.Rules(u.RULES)
    assert rules.find("example.org", "/en/1") == ("example.org/en/1", "block")
    assert rules.find("m.example.org", "/en/2") == ("org/", "allow")
    assert rules.find("badexample.org", "/es/") == ("org/", "allow")
    assert rules.find("org", "/") == ("org/", "allow")
    assert rules.find("org", "") is None
    assert rules.find("a.com", "/de/x") == ("com/de/", "block")
    assert rules.find("", "") is None
    tie = u.Rules([("allow", "a.b", "/"), ("block", "b", "/xx"), ("block", "a.b", "/")])
    assert tie.find("a.b", "/xx")[1] == "block"


def hits(url, strict=("bad",), soft=("sad", "mad")):
    return u.Vocabulary(strict, soft).hits(url)


def test_terms_need_boundaries():
    assert hits("http://bad.com") == [("bad", "strict")]
    assert hits("http://badly.com/abad") == []
    assert hits("http://x.com/BAD_bad-1bad") == [("bad", "strict")] * 2
    assert hits("bad") == [("bad", "strict")]
    assert u.Vocabulary((), ()).hits("bad") == []


def test_overlapping_terms_all_count():
    found = u.Vocabulary(("cheap-pills",), ("cheap", "pills")).hits("x://cheap-pills.com")
    assert sorted(found) == [("cheap", "soft"), ("cheap-pills", "strict"), ("pills", "soft")]


def verdicts(spark, urls, **terms):
    df = spark.createDataFrame([(i, x, "x", "y") for i, x in enumerate(urls)], "page_id long, url string, key string, host string")
    return [r.verdict for r in sorted(u.filter_urls(df, "page_id", "url", **terms).collect(), key=lambda r: r.page_id)]


def test_one_strict_or_two_different_soft_terms_block(spark):
    terms = {"strict": ["bad"], "soft": ["sad", "mad"]}
    urls = ["x://a/bad", "x://a/sad", "x://a/sad/sad", "x://a/sad/mad", None, "", "x://" + "a" * 100_000 + "/sad/mad"]
    assert verdicts(spark, urls, **terms) == ["block", "allow", "allow", "block", "allow", "allow", "block"]
    assert verdicts(spark, ["x://a.org/bad"], rules=u.RULES, **terms) == ["allow"]


def test_empty_frame_and_repeated_rows(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert u.filter_urls(df, "page_id", "url").count() == 0
    df = spark.createDataFrame([(1, "x://a"), (1, "x://a"), (None, "x://b")], "page_id long, url string")
    assert sorted(r.host for r in u.filter_urls(df, "page_id", "url").collect()) == ["a", "a", "b"]
