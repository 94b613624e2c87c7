"""Radix selection against sorted lists."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from riskloom.operators import radix
from riskloom.staging import stage

SPECIAL = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, 1.7976931348623157e308,
           -1.7976931348623157e308, math.inf, -math.inf, math.nan, math.nextafter(1, 2), math.nextafter(1, 0), 0.1, 1e-300, 2.0 ** 52 + 1]


def bits(x):
    """The image straight from the bytes of a double."""
    if math.isnan(x):
        return 2 ** 63 - 1
    size = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -size if x < 0 else size


def test_images_are_the_bits_of_doubles(spark):
    draw = random.Random(4)
    values = SPECIAL + [s * math.ldexp(1 + k * 2.0 ** -52, e) for s in (1, -1) for e in (-1022, -3, 0, 1, 9, 52, 1023) for k in (0, 1, 2 ** 52 - 1)]
    values += [struct.unpack("<d", struct.pack("<Q", draw.getrandbits(64)))[0] for _ in range(2000)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, x double")
    got = {r["i"]: r for r in frame.select("i", radix.image(F.col("x")).alias("k")).withColumn("back", radix.value(F.col("k"))).collect()}
    for i, v in enumerate(values):
        assert got[i]["k"] == bits(v)
        assert got[i]["back"] == v or math.isnan(v) and math.isnan(got[i]["back"])
    assert got[len(values)]["k"] is None


def rows_of(draw):
    out = []
    for g in "ab":
        for p in "xyz":
            for _ in range(draw.choice([1, 7, 60])):
                out.append((g, p, draw.choice([draw.gauss(0, 1), float(draw.randrange(-3, 4)), 0.0, -0.0, 1e9, math.inf]), draw.randint(1, 4)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ranks_of_all_one_and_all_but_one_part(spark, seed):
    rows = rows_of(random.Random(seed))
    counts = stage(spark.createDataFrame(rows, "g string, p string, v double, n long").select(
        "g", "p", radix.image(F.col("v")).alias("image"), "n").groupBy("g", "p", "image").agg(F.sum("n").alias("n")))
    wanted, want = [], {}
    for g in "ab":
        for p in "xyzw":  # no row has the part w
            for mode, mine in ((radix.ALL, lambda q: True), (radix.ONLY, lambda q, p=p: q == p), (radix.WITHOUT, lambda q, p=p: q != p)):
                line = sorted(v for h, q, v, n in rows for _ in range(n) if h == g and mine(q))
                for rank in {0, len(line) // 2, len(line) - 1, len(line)}:
                    wanted.append((g, p, mode, rank))
                    if 0 <= rank < len(line):
                        want[g, p, mode, rank] = line[rank]
    frame = spark.createDataFrame([w for w in wanted if w[3] >= 0], "g string, p string, mode string, rank long")
    got = {(r["g"], r["p"], r["mode"], r["rank"]): r["value"] for r in radix.order_statistics(counts, frame, ["g"], "p").collect()}
    assert got == want


def test_quantiles_of_odd_values(spark):
    rows = [("nan", v) for v in (1.0, math.nan, 2.0)] + [("one", 7.5)] + [("tie", -0.0)] * 5 + [("tie", 0.0)] * 4 + [("null", None)]
    got = {r["g"]: (r["low"], r["mid"], r["high"]) for r in radix.quantiles(
        spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.0, "mid": 0.5, "high": 1.0}).collect()}
    assert got["one"] == (7.5,) * 3 and got["tie"] == (0.0,) * 3 and got["nan"][:2] == (1.0, 2.0) and math.isnan(got["nan"][2])
    assert set(got) == {"one", "tie", "nan"}
    assert radix.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"m": 0.5}).count() == 0
