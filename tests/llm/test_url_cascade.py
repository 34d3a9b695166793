"""URL cascade against plain matching: odd urls, long lists, both ways to judge, levels."""

import random

import pytest
from pyspark.sql import functions as F

from residuum.llm import url_cascade as U
from residuum.session import shared_path
from tests.conftest import SF_SMALL


def plain(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


ODD = [None, "", "no scheme", "http://", "http://Example.NET", "http://Example.NET/", "https://a.b.example.net/en/x?y=/de/#z",
       "http://example.net?x", "http://x.example.com/de/1#a", "http://notexample.com/de/1", "http://org/fr/", "http://a.ORG/fr/x/y", "ftp://.net/q",
       "http://net./q", "http://a..net/q", "http://é.net/ü\n/x", "http://u@h.net:80/x", "x://y://z.net/q", "http://net/de/", "http://" + "a." * 300 + "net/" + "x/" * 3000]


def judged(df, *rest, **options):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(df, *rest, **options).collect()), key=repr)


def frame(spark, urls):
    """With columns named like those used inside, a null id and repeated ids."""
    rows = [(None if i == 3 else i // 2, u, "k", "h", 1, "p") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, key string, host string, at int, path string").repartition(3), rows


def test_rules_of_the_query_on_odd_urls(spark):
    df, rows = frame(spark, ODD * 2)
    want = sorted(((i, *plain(u, U.RULES)) for i, u, *_ in rows), key=repr)
    assert judged(df, U.rule_table(spark)) == want
    assert judged(df, U.rule_table(spark), max_filter_bytes=0) == want
    assert {w[4] for w in want} == {"allow", "block"}


def test_long_lists_taken_from_the_urls(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url")
    rows = pages.collect()
    rng = random.Random(5)
    rules = set()
    for r in rng.choices(rows, k=60):
        host, path, *_ = plain(r.url, ())
        host = host.split(".", rng.randrange(host.count(".") + 1))[-1]
        rules.add((rng.choice(["allow", "block"]), host, path[:rng.randrange(len(path) + 1)]))
    rules |= {(rng.choice(["allow", "block"]), f"absent{i}.example.net", "/en/") for i in range(700)}
    table = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    one = {}
    for v, h, p in rules:
        one[h + p] = max((v, h, p), one.get(h + p, ("", h, p)))
    want = sorted(((r.page_id, *plain(r.url, one.values())) for r in rows), key=repr)
    assert judged(pages, table) == want
    assert judged(pages, table, max_filter_bytes=10) == want


def test_levels_are_exact_over_the_universe(spark):
    listed = spark.range(300).select(F.concat(F.lit("in"), "id").alias("key"))
    asked = spark.range(20000).select(F.concat(F.lit("out"), "id").alias("key"))
    loose = U._filled(listed, U._shape(1, 300, 0.3))  # lets many through, so there are several levels
    levels = U.rest_of_cascade(loose, listed, asked.where(U._passes(F.col("key"), loose)))
    assert len(levels) > 3
    assert listed.where(U.member(F.col("key"), levels)).count() == 300
    assert asked.where(U.member(F.col("key"), levels)).count() == 0
    assert U.filter_bytes(10**6, 10**11) < 6 << 20


def test_empty_tables_and_bad_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judged(none, U.rule_table(spark)) == []
    df, rows = frame(spark, ODD)
    assert {(r[3], r[4]) for r in judged(df, U.rule_table(spark).limit(0))} == {(None, "allow")}
    with pytest.raises(ValueError):
        U.judge(df, spark.createDataFrame([("block", "", "/")], "verdict string, host string, path string"))


def test_plan_has_neither_python_nor_a_join(spark):
    out = U.judge(spark.read.parquet(f"{SF_SMALL}/pages.parquet"), U.rule_table(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "Exchange" not in plan
    assert "html" not in plan.split("ReadSchema")[1]
