import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import radix, scan


@pytest.fixture(scope="module")
def rows():
    """One group holds most rows, many values repeat."""
    rng = random.Random(7)
    groups = ["hot"] * 900 + ["warm"] * 80 + ["one"]
    return [(g, round(rng.random(), 2), i) for i, g in enumerate(groups)]


def test_ranked_matches_sorting(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(7)
    got = {r["i"]: r["rank"] for r in scan.ranked(df, ["g"], [F.desc("v"), F.asc("i")]).collect()}
    for name in ("hot", "warm", "one"):
        order = sorted((r for r in rows if r[0] == name), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_global_rank(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(5)
    got = {r["i"]: r["rank"] for r in scan.ranked(df, [], [F.asc("v"), F.desc("i")]).collect()}
    order = sorted(rows, key=lambda r: (r[1], -r[2]))
    assert [got[r[2]] for r in order] == list(range(1, len(rows) + 1))


def test_running_totals(spark, rows):
    df = spark.createDataFrame([(g, v, i % 5, i) for g, v, i in rows], "g string, v double, w long, i long").repartition(6)
    got = {r["i"]: (r["position"], r["running_w"]) for r in scan.running(df, ["g"], [F.asc("v"), F.asc("i")], ["w"]).collect()}
    for name in ("hot", "warm"):
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2])), 1):
            total += r[2] % 5
            assert got[r[2]] == (n, total)


def test_quantiles_are_exact(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, i long")
    values = defaultdict(list)
    for g, v, _ in rows:
        values[g].append(v)
    got = {r["g"]: r for r in radix.quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    for g, v in values.items():
        assert np.allclose([got[g]["q1"], got[g]["q2"], got[g]["q3"]], np.quantile(v, [0.25, 0.5, 0.75]))
    whole = radix.quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.median([r[1] for r in rows]))


def test_more_groups_than_a_driver_should_hold(spark):
    """60,000 groups of three rows: ranks by the scan equal ranks by a window."""
    from pyspark.sql import Window

    rows = spark.range(180_000).select((F.col("id") % 60_000).alias("g"), F.xxhash64("id").alias("v"))
    want = rows.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("v")))
    both = scan.ranked(rows, ["g"], [F.col("v").asc()]).join(want, ["g", "v"])
    assert both.count() == 180_000 and both.where("rank <> w").count() == 0
