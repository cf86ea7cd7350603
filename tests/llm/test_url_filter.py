import random

from docloom.llm import url_filter
from docloom.llm.queries import RULES

URLS = [
    "http://a.com/x", "https://www.Example.COM/en/1?q#f", "https://m.example.com/en/", "http://example.com/EN/", "http://example.com", "http://net/es/1", "ftp://x.net/es/", "http://x.net/fr/a",
    "http://x.net/fr", "http://xnet/fr/", "no scheme", "", None, "://", "http://", "http:///en/", "http://example.com/en/?a=b/c", "http://example.com?x=/en/", "a://b://c/d", "http://.com/", "http://com/", "http://b.com:80/x", "http://example.com/en/" + "x" * 5000,
]


def judged(url, rules, default="allow"):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), a == "block", h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], default if best is None else "block" if best[2] else "allow"


def run(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    return {r[0]: tuple(r)[1:] for r in url_filter.judge_urls(pages, spark.createDataFrame(list(rules), "host string, path string, action string"), **options).collect()}


def test_rules_against_brute_force(spark):
    random.seed(3)
    urls = [*URLS, *(f"http://{random.choice(['', 'a.', 'www.', 'b.c.'])}{random.choice(['example.com', 'net', 'example.net', 'com', 'org'])}{random.choice(['/en/', '/es/', '/fr/', '/', ''])}{random.choice(['', '1', 'x?y'])}" for _ in range(150))]
    got = run(spark, urls, RULES)
    assert got == {i: judged(u, RULES) for i, u in enumerate(urls)}


def test_long_list_in_several_passes_and_ties(spark):
    random.seed(4)
    rules = [(f"s{i}.org", "/" + "p" * (i % 3), random.choice(["allow", "block"])) for i in range(60)] + [("s1.org", "/p", "block"), ("s1.org", "/p", "allow"), (None, "/", "block"), ("", "/", "block"), ("z.org", None, "block")]
    urls = [f"http://{random.choice(['', 'w.'])}s{random.randrange(90)}.org/{'p' * random.randrange(4)}" for _ in range(200)]
    got = run(spark, urls, rules, max_filter_bits=256)
    good = [r for r in rules if r[0] and r[1]]
    assert got == {i: judged(u, good) for i, u in enumerate(urls)}


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = universe.where("cast(substring(key, 2) as int) % 20 = 0")
    first = url_filter.build_level(listed, 256, 2, 1)
    cascade = url_filter.build_cascade(listed, first, universe.where(first.has(universe["key"])))
    assert len(cascade.levels) > 2
    got = {r[0] for r in universe.where(cascade.has(universe["key"])).collect()}
    assert got == {f"k{i}" for i in range(0, 3000, 20)}


def test_empty_tables_and_repeated_rows(spark):
    assert run(spark, [], RULES) == {}
    pages = spark.createDataFrame([(1, "http://x.net/es/"), (1, "http://x.net/es/"), (None, None)], "page_id long, url string")
    rows = sorted(map(tuple, url_filter.judge_urls(pages, spark.createDataFrame([], "host string, path string, action string"), "block").collect()), key=str)
    assert rows == [(1, "x.net", "/es/", None, "block")] * 2 + [(None, "", "", None, "block")]
