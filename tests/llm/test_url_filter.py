"""URL filter against trying every rule."""

import duckdb
import pandas as pd

from rallyplan.llm import url_filter as U

URLS = [
    None, "", "example.org/es/", "http://example.org/es/1", "http://EXAMPLE.org/en/12?x=/es/", "https://www.example.org/en/2#top", "http://example.com/fr/", "http://a.b.com/de/x", "http://com/fr/", "ftp://notexample.org", "x://y://z/",
    "http://org", "http://blog.cheap-pills.example.net/en/1", "http://cheap.pillsx.net/", "http://a.net/Free_Money", "http://a.net/free", "http://a.net/setup.exe", "http://a.net/exeter", "http://poker.com/de/casino", "http://é.org/ü?a", "http://", "://example.org/es/",
    "http://a.net/" + "x/" * 20_000 + "casino", "http://a.net?casino", "http://secure-login.net\nx",
    "http://spam-farm.example.org/en/1", "http://not-spam-farm.example.org/", "http://my-casino.net", "http://a.net/casino", "http://casino-royal.net?x", "http://ocasino.net/", "http://ads.adserver.net/x", "http://a.net/?sort=price&order=asc",
    "http://a.net/?sort=price&x=1&order=asc#y", "http://a.net/?order=asc&sort=price", "http://a.net/tag/x/page/12/", "http://a.net/tag/x/page/1", "http://a.net/calendar/2024/05", "http://a.net/?a=b&PHPSESSID=0123456789ab", "http://a.net/x/print#", "http://a.net/print\n",
    "http://a.net/wp-login.php?redirect=1", "http://a.net/cgi-bin/x", "http://a.net/?add-to-cart=5", "http://a.net/get-free-gift", "http://a.net/#/cgi-bin/", "no scheme/cgi-bin/",
]


def brute(url):
    host, path = U.host_and_path(url or "")
    fits = [(len(h + p), h + p, v) for v, h, p in U.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    names = [n for n, p, _ in sorted(U.PATTERN_RULES) if U.re.search(p, U.matched_part(url or ""))]
    name = names[0] if names else None
    return (host, path, *max(fits)[1:], name) if fits else (host, path, None, "block" if name else "allow", name)


def test_every_rule_and_the_oracle(spark):
    rows = [(i, x) for i, x in enumerate(URLS)] + [(None, URLS[3]), (3, URLS[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS html")
    got = sorted((tuple(r) for r in U.judge_urls(pages).collect()), key=str)
    assert got == sorted(((i, *brute(x)) for i, x in rows), key=str)
    assert U.judge_urls(pages.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([r for r in rows if r[0] is not None], columns=["page_id", "url"]))
    want = con.sql(U.oracle()).fetchall()
    assert sorted(map(str, want)) == sorted(str(x) for x in got if x[0] is not None)


def test_host_and_path():
    assert U.host_and_path("HTTP://A.b/c?d#e") == ("a.b", "/c")
    assert U.host_and_path("a://b#c/d") == ("b", "")


def test_a_match_holds_the_rule_s_tokens():
    parts = [U.matched_part(x or "") for x in URLS]
    matched = set()
    for name, pattern, own in U.PATTERN_RULES:
        for part in parts:
            if U.re.search(pattern, part):
                assert set(own) <= U.tokens(part)
                matched.add(name)
    assert len(matched) > 14
