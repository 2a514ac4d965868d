from urllib.parse import quote

from pyspark.sql import functions as F

from tessera.llm import url_filter
from tessera.llm.queries import URL_RULES


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:at], rest[at:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://example.com",
    "http://example.com?x=/en/", "https://a.b.net/es/1", "https://net/fr/", "https://net/fr", "http://xnet/es/",
    "http://..com/en/", "http://example.com/en/", "http://example.com/en/", "://com/", "http://ÄÖ.com/a\nb#c",
    "http://" + "a." * 3000 + "com/" + quote("x" * 5000), "http://notexample.com/en/",
]


def check(spark, rules, **more):
    urls = spark.createDataFrame([(i, u, "clash", 7) for i, u in enumerate(URLS)], "page_id long, url string, rule string, k int")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(urls, listed, **more).collect()}
    kept = [r for r in rules if None not in r]
    assert got == {i: brute(u, kept) for i, u in enumerate(URLS)}


def test_against_brute_force(spark):
    check(spark, URL_RULES)


def test_shards_beyond_the_bound_give_the_same(spark):
    check(spark, URL_RULES, size_bound=30)


def test_empty_and_null_rules(spark):
    check(spark, [])
    check(spark, [(None, "/", "block"), ("net", "", "block")])


def test_empty_table(spark):
    urls = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(urls, rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 4000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.BloomCascade.build(listed, universe)
    assert len(cascade.levels) > 1
    found = {r.key for r in universe.where(cascade.has(F.col("key"))).collect()}
    assert found == {f"k{i}" for i in range(0, 4000, 7)}
