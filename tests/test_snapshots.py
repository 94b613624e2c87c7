import calendar
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from support import history_frame
from riskloom.operators.snapshots import build_snapshots, file_month_grid, prepare_history, quarter_ends
from riskloom.schemas import FEATURE_COLUMNS, TARGET

LEXER, CACHE = "kit/Lexer.java", "kit/Cache.java"
PAST = [
    ("p1", "ann", "2019-08-07T08:30:00+00:00", "Write lexer", LEXER, 40, 0),
    ("p2", "bob", "2019-09-12T17:05:00+00:00", "Tidy names", LEXER, 6, 9),
    ("p3", "cy", "2019-11-21T06:00:00+00:00", "Fix lost token", LEXER, 2, 5),
    ("p4", "ann", "2019-08-30T21:45:00+00:00", "Write cache", CACHE, 17, 0),
    ("p5", "bob", "2020-04-18T12:00:00+00:00", "Notes", "kit/Notes.java", 1, 1),
]


def at(df, path, day):
    return df.where((F.col("file_path") == path) & (F.col("snapshot_date") == day)).first()


def test_history_against_the_plain_version(spark):
    rows = build_snapshots(history_frame(spark, PAST)).select(FEATURE_COLUMNS[1:]).collect()
    assert {tuple(map(str, r)) for r in rows} == {tuple(map(str, r)) for r in brute_force(PAST)}
    # August to December, the last month that ends ninety days before the last change.
    assert sorted(str(r["snapshot_date"]) for r in rows if r["file_path"] == LEXER) == [
        "2019-08-31", "2019-09-30", "2019-10-31", "2019-11-30", "2019-12-31"]
    september = next(r for r in rows if r["file_path"] == LEXER and str(r["snapshot_date"]) == "2019-09-30")
    assert list(september)[2:] == [2, 2, 46, 9, 55, 54, 18, 0, 1]


@pytest.mark.parametrize("days", [-3, 0, 1, 45, 90, 91, 130])
def test_window_edges(spark, days):
    fix = date(2019, 8, 31) + timedelta(days=days)
    rows = [PAST[0], ("fix", "cy", f"{fix}T23:59:00+00:00", "Fix bug", LEXER, 1, 0),
            ("end", "bob", "2020-12-05T00:00:00+00:00", "End", CACHE, 1, 0)]
    r = at(build_snapshots(history_frame(spark, rows)), LEXER, "2019-08-31")
    assert (r[TARGET], r["previous_bug_fixes"]) == (int(0 < days <= 90), int(days <= 0))


def test_offsets_decide_the_utc_day(spark):
    rows = [("p1", "d", "2019-10-31T22:10:00-03:30", "Add", LEXER, 1, 0),
            ("end", "d", "2020-09-09T00:00:00+00:00", "End", CACHE, 1, 0)]
    days = [str(r["snapshot_date"]) for r in build_snapshots(history_frame(spark, rows)).where(
        F.col("file_path") == LEXER).orderBy("snapshot_date").collect()]
    assert days[0] == "2019-11-30"


def test_future_changes_only_touch_labels(spark):
    early = history_frame(spark, PAST)
    late = history_frame(spark, [r for r in PAST if r[0] != "p3"])
    features = FEATURE_COLUMNS[:-1]
    then = F.col("snapshot_date") == "2019-09-30"
    left, right = (build_snapshots(h).where(then & (F.col("file_path") == LEXER)) for h in (early, late))
    assert left.select(*features).collect() == right.select(*features).collect()
    assert left.first()[TARGET] == 1 and right.first()[TARGET] == 0


def brute_force(changes):
    end = max(date.fromisoformat(c[2][:10]) for c in changes)
    out = set()
    for path in {c[4] for c in changes}:
        mine = [(date.fromisoformat(c[2][:10]), c) for c in changes if c[4] == path]
        first = min(d for d, _ in mine)
        day = first
        while True:
            day = date(day.year, day.month, calendar.monthrange(day.year, day.month)[1])
            if day > end - timedelta(days=90):
                break
            past = [(d, c) for d, c in mine if d <= day]
            fix = [(d, c) for d, c in mine if "Fix" in c[3]]
            added, deleted = sum(c[5] for _, c in past), sum(c[6] for _, c in past)
            out.add((path, day, len({c[0] for _, c in past}), len({c[1] for _, c in past}), added, deleted,
                     added + deleted, (day - first).days, (day - max(d for d, _ in past)).days,
                     len([1 for d, _ in fix if d <= day]),
                     int(any(day < d <= day + timedelta(days=90) for d, _ in fix))))
            day += timedelta(days=1)
    return out


def test_against_brute_force_with_a_hot_file(spark):
    rng = random.Random(3)
    changes = []
    for i in range(300):
        day = date(2020, 1, 1) + timedelta(days=rng.randrange(700))
        path = "src/Hot.java" if rng.random() < 0.5 else f"src/F{rng.randrange(8)}.java"
        changes.append((f"c{i}", f"d{rng.randrange(6)}", f"{day}T00:00:00+00:00",
                        rng.choice(["Fix it", "Add", "Work"]), path, rng.randrange(9), rng.randrange(5)))
    got = {tuple(r)[1:] for r in build_snapshots(history_frame(spark, changes)).collect()}
    assert got == brute_force(changes)


def test_plan_does_not_shuffle_after_the_expansion(spark):
    plan = build_snapshots(history_frame(spark, PAST))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan
    assert "Exchange hashpartitioning" not in plan[:plan.index("Generate")]


def test_quarter_ends(spark):
    rows = PAST[:4] + [("p6", "bob", "2020-12-20T01:00:00+00:00", "End", CACHE, 1, 0)]
    days = {str(r["snapshot_date"]) for r in quarter_ends(
        build_snapshots(history_frame(spark, rows)), "2019-09-01", "2020-03-31").collect()}
    assert days == {"2019-09-30", "2019-12-31", "2020-03-31"}
