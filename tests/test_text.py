from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import labels, text

# One text per word of the vocabulary, then look-alikes that are other words.
YES = ["Quick fix", "it is FIXED now", "two fixes in one", "A bug!", "fewer bugs", "bugfix", "last bugfixes of May",
       "defect 12", "known defects", "no crash", "crashes on start", "it crashed", "incorrect sum", "incorrectly rounded",
       "exception lost", "all exceptions", "npe", "NPEs again", "a regression", "regressions since May", "(fix)", "fix-up",
       "regreſſion of the ſum"]
NO = ["unfixed width", "fixing", "fixer", "bugle", "crashing waves", "exceptionally good", "incorrectness", "defective",
      "regress", "fix2", "bug_tracker", "", "   ", "Tidy up the build", None]


def test_bug_fix_words(spark):
    rows = spark.createDataFrame([(m,) for m in YES + NO], "m string").select("m", text.is_bug_fix(F.col("m")).alias("y"))
    found = {r["m"]: r["y"] for r in rows.collect()}
    assert all(found[m] for m in YES) and not any(found[m] for m in NO)


@pytest.mark.parametrize("url,slug", [
    ("https://github.com/orb/tool", "orb/tool"),
    ("HTTPS://www.github.com/orb/a.b_c-d.git/", "orb/a.b_c-d"),
    ("\thttps://github.com//orb///tool\n", "orb/tool"),
    # another scheme or host
    ("ftp://github.com/orb/tool", None), ("github.com/orb/tool", None), ("https://github.org/orb/tool", None),
    # too few or too many parts, or parts beside the path
    ("https://github.com/orb", None), ("https://github.com/orb/tool/tree/main", None),
    ("https://me:pw@github.com/orb/tool", None), ("https://github.com:8443/orb/tool", None),
    ("https://github.com/orb/tool?x=1", None), ("https://github.com/orb/tool#readme", None),
    # names that cannot be
    ("https://github.com/orb-/tool", None), ("https://github.com/" + "o" * 40 + "/tool", None),
    ("https://github.com/orb/.", None), ("https://github.com/o b/tool", None), (None, None),
])
def test_repository_identity(spark, url, slug):
    row = spark.createDataFrame([(url,)], "u string").select(text.repository_identity(F.col("u"))["slug"].alias("s")).first()
    assert row["s"] == slug


def test_cleaning(spark):
    raw = [("1d",), ("0x1p3",), ("-.5e1",), ("NaN",), (" Unknown ",), ("<NA>",), ("1e3",), ("inf",), (" x ",), ("2024-02-30",), ("2024-01-05T23:30:00-02:00",)]
    c = F.col("r")
    rows = spark.createDataFrame(raw, "r string").select(
        text.clean_text(c).alias("t"), text.clean_number(c, T.StringType()).alias("n"),
        text.utc_day(text.clean_text(c), T.StringType()).alias("d")).collect()
    assert [r["t"] for r in rows] == ["1d", "0x1p3", "-.5e1", None, None, None, "1e3", "inf", "x", "2024-02-30", "2024-01-05T23:30:00-02:00"]
    assert [r["n"] for r in rows] == [None, None, -5.0, None, None, None, 1000.0, None, None, None, None]
    assert rows[9]["d"] is None and rows[10]["d"] == date(2024, 1, 6)


def test_numeric_days_are_rejected():
    with pytest.raises(ValueError):
        text.utc_day(F.lit(1), T.LongType())


def test_developer_falls_back_to_name(spark):
    rows = spark.createDataFrame([(" A@X.org ", "Ann"), (None, " Bob "), ("  ", "Cy")], "e string, n string")
    got = [r[0] for r in rows.select(text.developer_identity(F.col("e"), F.col("n"))).collect()]
    assert got == ["a@x.org", "name:bob", "name:cy"]


@pytest.mark.parametrize("high,total,level", [(0, 0, "LOW"), (0, 20, "LOW"), (1, 20, "MODERATE"), (2, 20, "ELEVATED"), (5, 20, "HIGH")])
def test_attention(spark, high, total, level):
    got = spark.createDataFrame([(high, total)], "h long, t long").select(labels.attention_level(F.col("h"), F.col("t"))).first()[0]
    assert got == level


def test_attention_rejects_bad_counts(spark):
    with pytest.raises(Exception, match="attention level"):
        spark.createDataFrame([(3, 2)], "h long, t long").select(labels.attention_level(F.col("h"), F.col("t"))).collect()
