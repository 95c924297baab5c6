import itertools
import random

import duckdb

from pairforge.llm import queries, url_filter


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_random_rules(spark):
    rng = random.Random(7)
    labels = ["a", "b", "com", "org", "example", "a-b"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/é", "/X"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(host(), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http{rng.choice(['', 's'])}://{host().upper() if rng.random() < 0.2 else host()}{rng.choice(paths)}{rng.choice(['', '?q=://z/', '#f', 'z'])}"
            for _ in range(1500)] + ["http://a.com/x"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    for parts in (1, 7, 64):
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(df, r, partitions=parts).collect()}
        assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "http:///p", "x://HOST", "http://a.b?c", "http://a.b#/x", "http://a.b/\n/x", "http://a.b/x", "http://a.b/x"]
    rows = [(i if i != 4 else None, u, "h", "p", "r", "v") for i, u in enumerate(urls)] + [(9, "http://a.b/x", "h", "p", "r", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string")
    rules = [("a.b", "/", "allow"), ("A.B", "/x", None), ("a.b", "/x", "allow"), (None, "/", "block"), ("", "/", "block"), ("host", None, "block")]
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = [(h.lower(), p or "", v or "block") for h, p, v in rules if h]
    got = sorted((str(x.page_id), x.host, x.path, x.rule or "", x.verdict) for x in url_filter.filter_urls(df, r).collect())
    assert got == sorted((str(i), h, p, u or "", v) for i, url, *_ in rows for h, p, u, v in [plain(url, want)])
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(x.rule, x.verdict) for x in url_filter.filter_urls(df, none, default="block").collect()} == {(None, "block")}
    assert url_filter.filter_urls(df.limit(0), r).count() == 0


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(map(str, con.execute(f"select {', '.join(cols)} from ({queries.ORACLE['op5_url_filter']})").fetchall()))
    got = queries.op5_url_filter(spark, sf).select(cols).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert len(list(itertools.groupby(got))) == len(got)
