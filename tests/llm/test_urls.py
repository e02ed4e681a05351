"""URL filter against plain loops and regular expressions, and its odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from graintable.llm import urls

ODD = [None, "", "no scheme casino", "http://", "HTTP://A.Example.NET/en/x", "https://example.net/en/", "https://example.net/en", "http://net/", "http://net", "http://xnet/a", "http://a.net?x=/", "http://a.net#/en/",
       "http://u@b.net:80/", "://org/fr/casino", "http://org/fr/casino", "http://org/casino", "http://x.com/?casino", "http://x.com/casino#", "http://x.com/casinos", "http://x.com/free_bets", "http://x.com/free-free", "http://x.com/FREE/Bets",
       "http://x.com/éwin-écasinoé", "http://a://b.net/", "http://example.com/de/" + "free-" * 50_000, "http://x.com/a\nb/casino", "http://Ünïcode.NET/", "http://" + "a." * 2000 + "net/"]


def plain(url, terms, rules, limit):
    at = (url or "").find("://")
    host = path = ""
    if at >= 0:
        rest = url[at + 3:]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), len(r.split("/")[0]), v == "block", r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.split("[?#]", url or "")[0])
    found = {t for t in terms if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)}
    strict, soft = sorted(t for t in found if terms[t] == "strict"), sorted(t for t in found if terms[t] == "soft")
    rule = max(fits)[3:] if fits else (None, None)
    return host, path, rule[0], rule[1] or ("block" if strict or len(soft) >= limit else "allow"), strict, soft


def test_equals_plain_loops_on_odd_urls(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*ODD, *ODD])], "page_id long, url string")
    terms = urls.vocabulary(urls.STRICT, urls.SOFT)
    for r in urls.filter_urls(df).collect():
        assert (r.host_, r.path_, r.rule_, r.verdict_, r.strict_, r.soft_) == plain(r.url, terms, urls.RULES, 2), r.url[:80]


@pytest.mark.parametrize("rules", [(), (("allow", "net/a"), ("block", "b.net/")), (("allow", "net/aa"), ("block", "b.net/"), ("allow", "b.net/"), ("block", "x.b.net/a/b"))])
def test_rules_of_any_length(spark, rules):
    paths = ["/", "/a", "/aa", "/aab", "/a/b/c", "", "?/a"]
    df = spark.createDataFrame([(f"http://{h}{p}",) for h in ("net", "b.net", "x.b.net", "xb.net", "y.x.b.net") for p in paths], "url string")
    for r in urls.filter_urls(df, strict=["aab"], soft=["aa", "b", "c"], rules=rules).collect():
        assert (r.rule_, r.verdict_) == plain(r.url, urls.vocabulary(["aab"], ["aa", "b", "c"]), rules, 2)[2:4]


def test_columns_terms_and_empty_tables(spark):
    df = spark.createDataFrame([("http://x.com/a b", 1)], "url string, `a.b` int").withColumns({c: F.lit(9) for c in ("host_", "verdict_", "_found_x", "rule", "page_id")})
    row = urls.filter_urls(df, strict=[], soft=["A", "a", "B", ""], rules=[]).first()
    assert (row["a.b"], row.host_, row.verdict_, row.soft_, row.rule, row.page_id) == (1, "x.com", "block", ["a", "b"], 9, 9)
    assert urls.filter_urls(df, strict=[], soft=[]).first().verdict_ == "allow"
    assert urls.filter_urls(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        urls.filter_urls(df, rules=[("maybe", "x/")])


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.1/pages.parquet'")
    got = con.execute(urls.SQL)
    columns = [c[0] for c in got.description]
    want = sorted(got.fetchall())
    assert sorted(tuple(r) for r in urls.op12_url_filter(spark, "/root/testdata/sf0.1").select(*columns).collect()) == want
    assert {r[columns.index("verdict")] for r in want if r[columns.index("rule")] is None} == {"allow", "block"}
