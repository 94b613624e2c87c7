import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.llm import queries, reputation
from riskloom.llm.reputation import Rule

URLS = [
    ("https://A.Example.ORG/es/1?x=/en/#y", "a.example.org", "/es/1"), ("http://org/", "org", "/"),
    ("ftp://x.org", "x.org", ""), ("no scheme.org/es", "", ""), (None, "", ""), ("", "", ""), ("://", "", ""),
    ("http://u:p@h.com:80/fr/a", "u:p@h.com:80", "/fr/a"), ("http://h.com?q=1/de/", "h.com", ""),
    ("http://a://b/c", "a:", "//b/c"), ("x\ny://h.com#f/", "h.com", ""), ("http://" + "a" * 100_000 + ".com/fr/", "a" * 100_000 + ".com", "/fr/"),
]


def test_hosts_and_paths(spark):
    rows = spark.createDataFrame([(u,) for u, _, _ in URLS], "u string").select(
        reputation.host_of(F.col("u")), reputation.path_of(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == [(h, p) for _, h, p in URLS]


@pytest.mark.parametrize("host, suffix, domain", [
    ("a.b.example.com", "com", "example.com"), ("example.com", "com", "example.com"), ("com", "com", "com"), ("", "", ""),
    ("a.shop.co.uk", "co.uk", "shop.co.uk"), ("co.uk", "co.uk", "co.uk"), ("u@a.x.org:8080", "org", "x.org"),
    ("10.0.0.7:80", "10.0.0.7", "10.0.0.7"), ("x.org.", "org", "x.org")])
def test_suffixes(spark, host, suffix, domain):
    row = spark.range(1).select(*reputation.suffix_and_domain(F.lit(host))).first()
    assert tuple(row) == (suffix, domain)


def test_longest_rule_wins(spark):
    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1")]
    cases = [("example.org", "/es/2", "example.org/es/"), ("a.example.org", "/en/12", "example.org/en/1"),
             ("anexample.org", "/es/2", "org/"), ("example.org", "/en/2", "org/"), ("example.org", "", None), ("org", "/", "org/")]
    rows = spark.createDataFrame([c[:2] for c in cases], "host string, path string").select(
        reputation.rule_of(F.col("host"), F.col("path"), rules)[0]).collect()
    assert [r[0] for r in rows] == [c[2] for c in cases]
    assert spark.range(1).select(*reputation.rule_of(F.lit("a"), F.lit("/"), [])).first() == (None, None)


def plain(counts, z=1.645):
    """Host to (mean, bound), level by level in plain Python. ``counts``: host, suffix, domain, trials, good."""
    def level(units, prior):
        use = [(n, k, prior(u)) for u, (n, k) in units.items() if n]
        scale = sum(n * (n - 1) * m * (1 - m) for n, k, m in use)
        rho = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in use) / scale if scale else 1e-4
        rho = min(max(rho, 1e-4), 0.5)
        s, out = (1 - rho) / rho, {}
        for u, (n, k) in units.items():
            a, b = k + s * prior(u), n - k + s * (1 - prior(u))
            mean = a / (a + b)
            out[u] = mean, mean - z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        return out

    def sums(*at):
        got = defaultdict(lambda: [0, 0])
        for row in counts:
            unit = tuple(row[i] for i in at)
            got[unit][0] += row[3]
            got[unit][1] += row[4]
        return got
    overall = (sum(r[4] for r in counts) + 0.5) / (sum(r[3] for r in counts) + 1)
    tops = level(sums(1), lambda u: overall)
    domains = level(sums(1, 2), lambda u: tops[u[:1]][0])
    hosts = level(sums(1, 2, 0), lambda u: domains[u[:2]][0])
    return {u[2]: v for u, v in hosts.items()}


def test_shrinkage_against_plain_version(spark):
    counts = [(f"{h}.{d}.{s}", s, f"{d}.{s}", n, k) for s, d, h, n, k in [
        ("com", "a", "x", 900, 890), ("com", "a", "y", 3, 0), ("com", "a", "z", 0, 0), ("com", "b", "x", 50, 10),
        ("org", "c", "x", 40, 39), ("org", "c", "y", 8, 8), ("net", "d", "x", 0, 0), ("co.uk", "e", "x", 5, 1)]]
    frame = spark.createDataFrame([(r[0], r[3], r[4]) for r in counts], "host string, trials long, good long")
    got = {r["host"]: (r["reputation"], r["bound"]) for r in reputation.host_reputation(frame).collect()}
    want = plain(counts)
    assert got.keys() == want.keys()
    for host in got:
        assert got[host] == pytest.approx(want[host], abs=1e-12)
    # Three bad pages weigh less than the domain's good name; a host without labels inherits its domain.
    assert 0 < got["y.a.com"][0] < got["z.a.com"][0] < got["x.a.com"][0]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    columns = "page_id, host, path, rule, verdict, reputation, n_labelled"
    got = sorted(map(tuple, queries.op11_host_reputation(spark, sf).selectExpr(*columns.split(", ")).collect()), key=str)
    with duckdb.connect() as db:
        for t in ("pages", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = sorted(db.execute(f"SELECT {columns} FROM ({queries.ORACLES['op11_host_reputation']})").fetchall(), key=str)
    assert got == want


def test_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.com/", 0, 0), (1, "http://a.com/", 0, 0), (None, None, 0, 0), (2, "", 0, 0), (3, "http://b.com/", 0, 0)],
        "page_id long, url string, host int, verdict int")
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, 1), (3, None), (3, 7)], "page_id long, good int")
    rows = reputation.judge_urls(pages, marks, [Rule("allow", "b.com", "/")]).collect()
    assert sorted((r["page_id"] or 0, r["host"], r["n_labelled"], r["rule"]) for r in rows) == [
        (0, "", 0, None), (1, "a.com", 4, None), (1, "a.com", 4, None), (2, "", 0, None), (3, "b.com", 0, "b.com/")]
    assert reputation.judge_urls(pages.limit(0), marks, []).count() == 0
    bare = reputation.judge_urls(pages, marks.limit(0), []).select("reputation", "verdict").distinct().collect()
    assert [tuple(r) for r in bare] == [(0.5, "block")]
