import random

from pathloom.llm import url_filter as U


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        host = rest[: min(ends)] if ends else rest
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[len(host) :].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0]) or r[0] == "") and path.startswith(r[1])]
    best = max(fits, key=lambda r: (r[0].count(".") + bool(r[0]), len(r[1])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://COM", "http://com/", "https://Example.COM/en/1?x=/en/", "http://www.example.com/en/", "http://a.www.example.com/en/x#y",
    "http://example.com/en", "http://badexample.com/en/1", "http://x.net/es/1", "http://net/fr/", "x://y://www.example.com/en/", "http://x.net?/es/", "http://É.com/", "http://.com//", "http://example.com:80/en/", "http://a\nb.com/c\nd",
]
MORE = [("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x/", "allow"), ("b.a.com", "/", "allow"), ("a.com", "/x/y", "block"), ("a.com", "", "block"), ("b.a.com", "/x/y/z", "block")]


def frame(spark, urls):
    return spark.createDataFrame([(k, u, "html") for k, u in enumerate(urls)], "page_id long, url string, host string")


def check(spark, urls, rules, run):
    rows = {r.page_id: tuple(r)[1:] for r in run(frame(spark, urls), rules).collect()}
    assert rows == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_urls(spark):
    check(spark, URLS, U.RULES, U.judge)


def test_random_paths(spark):
    rng = random.Random(5)
    urls = [f"http://{rng.choice(['', 'b.', 'c.b.', 'x'])}{rng.choice(['a.com', 'com', 'A.com'])}{rng.choice(['', '/', '/x', '/xx', '/x/', '/x/y', '/x/y/z', '/x/yy/', '//x'])}" for _ in range(300)]
    check(spark, urls, MORE, U.judge)
    check(spark, urls, MORE, lambda d, r: U.judge(d, spark.createDataFrame(r, "host string, path string, verdict string"), max_trie_rules=3))


def test_join_is_the_same(spark):
    check(spark, URLS, U.RULES, lambda d, r: U.judge(d, r, max_trie_rules=2))


def test_empty(spark):
    assert U.judge(frame(spark, []), U.RULES).collect() == []
    assert U.judge(frame(spark, ["http://com/"]), []).first().rule is None


def test_null_rules_many_beginnings_and_long_urls(spark):
    rules = [("a.com", f"/{'x' * (k % 40)}{k}", "block") for k in range(3_000)] + [("a.com", "", "allow")]
    urls = ["http://a.com/" + "x" * (k % 40) + str(k) + "y" for k in range(0, 3_000, 111)] + ["http://" + "b." * 5_000 + "a.com/" + "x/" * 20_000]
    check(spark, urls, rules, U.judge)
    nulls = spark.createDataFrame([(None, "/", "block"), ("a.com", None, "block"), ("a.com", "/", None), ("com", "/", "block")], "host string, path string, verdict string")
    for most in (10, 1):
        assert [r.rule for r in U.judge(frame(spark, ["http://a.com/"]), nulls, max_trie_rules=most).collect()] == ["com/"]
