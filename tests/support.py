"""Frames that several test modules build; fixtures are in ``conftest.py``."""

from __future__ import annotations

import calendar
from datetime import date

from riskloom.schemas import FEATURE_COLUMNS, HISTORY_COLUMNS

HISTORY = ("repository string, commit_hash string, author_name string, author_email string, commit_date string, "
           "commit_message string, file_path string, lines_added bigint, lines_deleted bigint")


def month_ends(first: date, count: int) -> list[date]:
    days = []
    for i in range(count):
        m = first.year * 12 + first.month - 1 + i
        days.append(date(m // 12, m % 12 + 1, calendar.monthrange(m // 12, m % 12 + 1)[1]))
    return days


def feature_rows(repository: str = "alpha", offset: int = 0, months: int = 34, files: int = 3) -> list[tuple]:
    """Month ends from March 2020; every third file-month or so is defective, busy files more often."""
    rows = []
    for m, day in enumerate(month_ends(date(2020, 3, 31), months)):
        for i in range(files):
            busy = (5 * m + 2 * i + offset) % 7
            commits, added, deleted = 3 + m // 2 + busy, 20.0 * busy + 4 * i + m, 9.0 * busy + offset
            rows.append((repository, f"core/Unit{i}.java", day, float(commits), float(1 + (m + 2 * i) % 5), added, deleted,
                         added + deleted, 31.0 * m + 12 * i + 6, float((11 * m + 5 * i + offset) % 23),
                         float(m // (4 + i)), int(busy >= 5 or (i == 1 and m % 6 == offset))))
    return rows


def features_frame(spark, rows):
    kinds = ["string", "string", "date", *["double"] * 8, "int"]
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(FEATURE_COLUMNS, kinds)))


def ends_frame(spark, names, day=date(2030, 12, 31)):
    return spark.createDataFrame([(n, day) for n in names], "repository string, observation_end date")


def history_frame(spark, changes):
    """changes: (commit, developer, day text, message, file, added, deleted)."""
    rows = [("owner/demo", c, dev, f"{dev}@example.com", day, message, path, a, d)
            for c, dev, day, message, path, a, d in changes]
    assert len(HISTORY_COLUMNS) == 9
    return spark.createDataFrame(rows, HISTORY)


OBSERVATIONS = [
    ("lib/Parser.java", "2023-05-31", 0.84, "previous_bug_fixes", 0.45),
    ("lib/Parser.java", "2023-06-30", 0.78, "previous_bug_fixes", 0.35),
    ("lib/Parser.java", "2023-07-31", 0.55, "lines_added", 0.15),
    ("app/Main.java", "2023-05-31", 0.91, "code_churn", 0.60),
    ("app/Main.java", "2023-07-31", 0.20, "code_churn", -0.30),
    ("lib/Cache.java", "2023-06-30", 0.65, "lines_deleted", -0.25),
    ("lib/Cache.java", "2023-07-31", 0.05, "lines_deleted", -0.40),
]
DRIVERS = "array<struct<k:double,feature:string,feature_value:double,model_input_value:double,contribution:double>>"


def samples_frame(spark, project="owner/example", observations=OBSERVATIONS):
    rows = []
    for path, day, score, feature, c in observations:
        drivers = sorted([(-abs(c), feature, 7.0, 1.5, c), (-0.08, "file_age_days", 90.0, -0.5, -0.08)])
        rows.append((project, path, day, score, 0, "example", "within_project_temporal_test", "predict_proba", 0.5,
                     drivers, "linear_coefficient_transformed", "log_odds"))
    return spark.createDataFrame(rows, (
        "project string, file_path string, snapshot_date string, risk_score double, true_label int, model string, "
        f"evaluation_mode string, score_method string, decision_threshold double, drivers {DRIVERS}, "
        "explanation_method string, contribution_space string"))
