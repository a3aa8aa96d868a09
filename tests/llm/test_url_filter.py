import random

from helpers import rows_of

from groundwork.llm import url_filter as u

URLS = [None, "", "no scheme/en/", "http://", "://", "http://NET/", "http://net", "http://a.net?x=/", "https://x.example.net/en/1", "https://example.net/en",
        "https://example.net/en/", "http://notexample.net/en/", "http://m.Example.COM/de/x?y#z", "http://example.com/de", "http://org/fr/a", "http://a.org/FR/a",
        "http://a.org#/fr/", "http://u:p@a.org:80/fr/", "ftp://a.b.org/fr//x", "http://ünï.org/fr/" + "x" * 50_000, "http://a.net/://b.org/fr/"]


def plain(url, rules, default="allow"):
    if not url or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[3:]) if fits else (host, path, None, default)


def table(spark, urls):
    return spark.createDataFrame([(k, url, "x") for k, url in enumerate(urls)], "page_id long, url string, rule string")


def test_given_rules(spark):
    got = u.judge(table(spark, URLS)).collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(got, key=lambda r: r["page_id"])] == [plain(url, u.RULES) for url in URLS]
    assert "rule" in got[0].asDict() and len(got[0]) == 6


def test_trie_and_join_agree_with_the_definition(spark):
    rng = random.Random(5)
    hosts = ["a", "b.a", "c.b.a", "b", "a.b", "net.a"]
    paths = ["/", "/x", "/x/", "/x/y", "/xy", "", "/x/y/z"]
    rules = list({(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(25)})
    urls = [f"http://{rng.choice(['', 'q.', 'A.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'k', '?q', '#/x/'])}" for _ in range(300)] + URLS
    want = sorted(((k, *plain(url, rules)) for k, url in enumerate(urls)), key=repr)
    names = ("page_id", "host", "path", "rule", "verdict")
    assert rows_of(u.judge(table(spark, urls), rules), *names) == want
    rows = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert rows_of(u.judge_by_join(table(spark, urls), rows), *names) == want


def test_empty_tables(spark):
    assert u.judge(table(spark, [])).count() == 0
    assert rows_of(u.judge(table(spark, ["http://a/"]), []), "rule", "verdict") == [(None, "allow")]
