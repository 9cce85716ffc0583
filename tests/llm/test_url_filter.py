from __future__ import annotations

import duckdb
import pytest

from batchloom.llm import queries, url_filter
from batchloom.llm.url_filter import HostPattern, Rule, judge_urls

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, token string, best int"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", "y", "z", "t", 1) for i, u in enumerate(urls)], SCHEMA)


def verdicts(spark, urls, rules, **more):
    return [(r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages(spark, urls), rules, **more).orderBy("page_id").collect()]


def test_query_is_its_sql(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tables}/pages.parquet'")
    df = queries.op10_url_filter(spark, tables)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.OP10_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_rules(spark):
    urls = ["http://a.example.com/en/7x", "http://EXAMPLE.com/en/8", "http://example.com/en", "http://notexample.net/de/8", "http://example.net/de/80?x", "https://x.org/es/#t", "org/es/", None, "", "http://", "http://com/en/?q", "x://y://com/en/", "http://example.com/EN/7"]
    got = verdicts(spark, urls, queries.URL_RULES)
    assert [(g[2], g[3]) for g in got] == [("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow")]
    assert [g[:2] for g in got[6:12]] == [("", ""), ("", ""), ("", ""), ("", ""), ("com", "/en/"), ("y:", "//com/en/")]


def test_against_plain_matching(spark):
    hosts = ["a.com", "b.a.com", "ba.com", "c-d.net", "x.c-d.net", "é.org", "a+b.org"]
    paths = ["", "/", "/p", "/p/q.html", "/P/q", "/p/qq/", "/p//q", "/p(1)/"]
    rules = [Rule(h + p, a) for h, a in (("a.com", "block"), ("c-d.net", "allow"), ("net", "block"), ("é.org", "block"), ("a+b.org", "allow"), ("zzz.org", "block")) for p in ("", "/p", "/p/q", "/p(1)/")]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    for (host, path, rule, verdict), h, p in zip(verdicts(spark, urls, rules, patterns=()), (h for h in hosts for _ in paths), (p for _ in hosts for p in paths), strict=True):
        fit = [r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.host + r.path), r.text), default=None)
        assert (host, path, rule, verdict) == (h, p, best and best.text, best.action if best else "allow")


def test_patterns_and_odd_rows(spark):
    own = (HostPattern(r"^bad-", ("bad",)), HostPattern(r"\.ok\.", ("ok",), "allow"))
    assert [v[3] for v in verdicts(spark, ["http://bad-x.com/", "http://a.ok.com", "http://bad-x.ok.com/", "http://xbad-.com/"] * 2, [], patterns=own)] == ["block", "allow", "block", "allow"] * 2
    assert verdicts(spark, [], queries.URL_RULES) == []
    with pytest.raises(ValueError, match="literal token"):
        verdicts(spark, ["http://a/"], [Rule("/x", "block")])
    assert Rule("example.com/en/7", "allow").tokens == ["com", "en", "example"]


def test_own_patterns(spark):
    bad = ["http://casino-win.example.com/", "https://m.free-bets.example.com", "x://best-poker-room.org/a?b", "http://a.link-farm.net", "http://PILLS.net/", "http://a.example.com.xxx.org/"]
    good = ["http://alphabets.org/", "http://casinos.example.com", "http://example.casino", "http://x.org/casino-win.example.com/", "http://link.farm.net/", "http://spamless.org/", "http://link-to-farm.org", "http://x.org/a.poker.b"]
    assert [v[3] for v in verdicts(spark, bad + good, [])] == ["block"] * len(bad) + ["allow"] * len(good)


def test_a_rule_is_filed_under_its_rarest_token(spark):
    urls = [f"http://h{i}.com/p{i}" for i in range(40)] + ["http://rare.com/p"]
    assert verdicts(spark, urls, [Rule("rare.com/", "block")])[-1][3] == "block"
    assert "Python" not in judge_urls(pages(spark, urls), queries.URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert url_filter.BROADCAST_RULES >= 1000
