import random

import pytest

from lectern.llm.url_filters import RULES, judge_urls


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[2:]) if fit else (host, path, None, "allow")


URLS = [None, "", "no scheme", "://", "http://", "http://NET", "http://net/", "https://a.net/x?q=/en/", "http://example.net/en/", "http://a.b.example.net/en/1#x", "http://example.net/EN/", "http://badexample.com/de/", "http://example.com/de/x", "http://x.org/fr/", "http://x.org?/fr/", "http://user@net:80/", "a://b://c.net/", "http://münchen.net/ü", "http://a..net/", "http://net./", "http://x.net/\x00/y\nz", "http://a.net/\U0010ffffx", "http://a.net/\U0010ffff\U0010ffff", "http://com/", "http://b.com/?q", "http://b.com/?r"]


@pytest.mark.parametrize("ranges", [1, 5])
def test_contract_rules(spark, ranges):
    pages = spark.createDataFrame([(i, u, "clash", 1, 2, 3, 4) for i, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string, _url int, hit int, `a.b` int, key int")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = judge_urls(pages, rules, ranges=ranges).collect()
    assert len(got) == 2 * len(URLS) and got[0].asDict().keys() == {"page_id", "url", "_url", "hit", "a.b", "key", "host", "path", "rule", "verdict"}
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"], RULES), r


def test_many_nested_rules(spark):
    rnd = random.Random(3)
    hosts = ["c", "b.c", "a.b.c", "bb.c", "x.c", "d"]
    paths = ["/", "/p", "/p/", "/p/q", "/p/q/", "/q", "/pp/", ""]
    rules = list({(h, p): (rnd.choice(("allow", "block")), h, p) for h in hosts for p in paths if rnd.random() < 0.6}.values())
    urls = [f"http://{rnd.choice(['', 'www.', 'z.y.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', 'q/', '/r', 'p/q/1'])}" for _ in range(1500)]
    pages = spark.createDataFrame(list(enumerate(urls + urls[:1] * 700)), "page_id long, url string")
    got = judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), ranges=7).collect()
    assert len(got) == 2200
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"], rules), r


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert [(r["rule"], r["verdict"]) for r in judge_urls(pages, rules, default="block").collect()] == [(None, "block")]
    assert judge_urls(pages.limit(0), spark.createDataFrame(RULES, "verdict string, host string, path string")).count() == 0
