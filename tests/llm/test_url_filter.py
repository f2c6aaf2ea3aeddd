import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import url_filter as uf

URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?q", "https://www.example.com/en/1#t", "http://www.example.com/fr/1", "http://x.net/es/", "http://net/fr/a",
        "http://notexample.com/en/1", "http://a.com", "http://a.com?x=/en/", "x://y://example.com/en/", "http://xnet/es/", "ftp://deep.er.www.example.com/en/?", "http://EXAMPLE.com/EN/"]


def brute(url, rules, other="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if host and (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    best = max(fits, key=lambda r: (len(r), r.find("/")), default=None)
    return host, path, best, rules[best] if best else other


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*URLS, URLS[4]])], T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType())]))
    for r in uf.judge(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute([*URLS, URLS[4]][r.page_id], dict(uf.RULES))
    assert uf.judge(pages.limit(0)).count() == 0


def test_many_rules_stay_exact(spark):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    rules = {f"{host()}/{'/'.join(rng.choice('xy') for _ in range(rng.randint(0, 2)))}": rng.choice(["allow", "block"]) for _ in range(60)}
    urls = [f"http://{host()}/{'/'.join(rng.choice('xyz') for _ in range(3))}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in uf.judge(pages, tuple(rules.items())).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules)
    assert {r.rule for r in uf.judge(pages, ()).collect()} == {None}


def test_cascade_is_exact_over_its_universe():
    keys = [f"k{k}" for k in range(3000)]
    cascade = uf.build_local(set(keys[:700]), set(keys[700:]))
    assert len(cascade.levels) > 2
    assert [k in cascade for k in keys] == [k < 700 for k in range(3000)]


def test_long_urls_give_few_short_keys(spark):
    """Keys grow neither with a url's length nor with its dots, and the verdict stays right."""
    urls = [f"http://{'a.' * n}{end}" for n in (500, 4000, 32_000) for end in ("www.example.com/en/" + "x/" * n, "net/es/1", "org/fr/", "." * n + "com/")]
    urls += ["http://" + "b" * 200_000 + ".com/" + "y" * 200_000]
    lengths, hosts = {len(k[k.find("/") :]) for k in dict(uf.RULES)}, {k.split("/")[0] for k in dict(uf.RULES)}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    keys = pages.select(uf.keys_of(uf.host_of(F.col("url")), uf.path_of(F.col("url")), hosts, lengths).alias("keys")).collect()
    assert all(len(r["keys"]) <= 9 and sum(map(len, r["keys"])) <= 180 for r in keys)
    for r in uf.judge(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], dict(uf.RULES))
