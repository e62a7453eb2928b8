import re

from quern.llm import urls as U


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        p = "/" + p
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), verdict == "block")
            if best is None or key > best[0]:
                best = (key, rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [
    "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://www.example.com/en", "http://notexample.com/en/", "http://example.com", "ftp://x.net/es/a", "http://x.net/fr/?q", "no scheme", "", None,
    "http://com/", "http://a.com//b", "http://a.com?x=/en/", "x://y://z.com/", "http://user@www.example.com:80/en/", "http://É.example.com/en/ü", "http://a..com/",
]


def test_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate([*URLS, URLS[0]])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = U.RULES + [("block", "a.com//b"), ("block", "z.com/"), ("allow", "example.com/en/x"), ("block", "example.com/e")]
    for limit in (U.MAX_BROADCAST_RULES, 0):  # broadcast, and salted join
        old, U.MAX_BROADCAST_RULES = U.MAX_BROADCAST_RULES, limit
        try:
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, U.rules_table(spark, rules)).collect()}
        finally:
            U.MAX_BROADCAST_RULES = old
        assert got == {i: brute(u, rules) for i, u in rows}


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "http://x.com/"), (None, "http://x.com/"), (1, None)], "page_id long, url string")
    assert U.judge(df, U.rules_table(spark, U.RULES)).count() == 3
    assert U.judge(df.limit(0), U.rules_table(spark, U.RULES)).count() == 0


def test_long_urls_cost_what_the_rules_ask_for(spark):
    url = "http://" + "a." * 150 + "example.com/en/" + "x/" * 20_000
    df = spark.createDataFrame([(i, url) for i in range(200)], "page_id long, url string")
    n, shapes = U._shapes(U.rules_table(spark, U.RULES))
    assert n == 5 and shapes == {1: ([1, 4], []), 2: ([4], []), 3: ([4], [])}
    rows = df.select(U.host_of(U.F.col("url")).alias("h"), U.path_of(U.F.col("url")).alias("p"))
    assert rows.select(U.F.size(U._expressions(U.F.col("h"), U.F.col("p"), shapes)).alias("n")).distinct().collect() == [(5,)]
    assert {(r.rule, r.verdict) for r in U.judge(df, U.rules_table(spark, U.RULES)).collect()} == {brute(url, U.RULES)[2:]}
