"""Declarative data-quality rules: one aggregate pass, one row per rule.

A rule is a name and a Boolean column that is true for a bad row. ``violations`` counts the bad
rows of all rules at once; ``require`` raises for the first broken rule in the listed order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.text import any_number, blank, is_java_path, utc_day, utc_timestamp
from riskloom.schemas import (
    FEATURE_COLUMNS, HISTORY_COLUMNS, MODEL_FEATURES, SNAPSHOT_KEYS, TARGET,
)

Rule = tuple[str, Column]
HISTORY_KEYS = ["repository", "commit_hash", "file_path"]


class DataQualityError(ValueError):
    """A table breaks a rule of its contract."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataQualityError(f"Missing required columns: {', '.join(missing)}.")


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise DataQualityError("The table has no rows.")


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(position, rule, violations) with one row per rule, from a single aggregation."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"r{i}")
                      for i, (_, bad) in enumerate(rules)])
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("rule"),
                 F.col(f"r{i}").alias("violations"))
        for i, (name, _) in enumerate(rules)])
    return counts.select(F.inline(entries))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def duplicate_violation(df: DataFrame, keys: Sequence[str], position: int) -> DataFrame:
    return duplicate_keys(df, keys).agg(
        F.lit(position).alias("position"), F.lit("duplicate_key").alias("rule"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("violations"))


def distinct_days_violation(df: DataFrame, minimum: int, position: int,
                            group: Sequence[str] = ()) -> DataFrame:
    """Groups with fewer than ``minimum`` distinct snapshot days."""
    days = df.select(*group, "snapshot_date").distinct()
    sizes = days.groupBy(*group).agg(F.count(F.lit(1)).alias("days"))
    name = "too_few_dates_per_repository" if group else "too_few_dates"
    return sizes.agg(F.lit(position).alias("position"), F.lit(name).alias("rule"),
                     F.count_if(F.col("days") < minimum).alias("violations"))


def require(report: DataFrame) -> None:
    """Raise for the first broken rule; the report holds one row per rule."""
    broken = report.where("violations > 0").orderBy("position").first()
    if broken:
        raise DataQualityError(f"Rule {broken['rule']} is broken by {broken['violations']} row(s).")


def _dtype(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def null_rules(columns: Sequence[str]) -> list[Rule]:
    return [(f"null_{c}", F.col(c).isNull()) for c in columns]


def blank_rules(columns: Sequence[str]) -> list[Rule]:
    return [(f"blank_{c}", F.col(c).isNull() | (blank(F.col(c)) == "")) for c in columns]


def day_rule(df: DataFrame, column: str) -> Rule:
    kind = _dtype(df, column)
    if isinstance(kind, T.StringType):
        bad = utc_timestamp(F.col(column)).isNull()
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        bad = F.col(column).isNull()
    else:
        bad = F.lit(True)  # numeric dates are ambiguous
    return f"invalid_date_{column}", bad


def whole_number_rule(df: DataFrame, column: str) -> Rule:
    number = any_number(F.col(column), _dtype(df, column))
    bad = number.isNull() | (number < 0) | (number % 1 != 0)
    return f"not_whole_{column}", bad


def non_negative_rule(df: DataFrame, column: str) -> Rule:
    number = any_number(F.col(column), _dtype(df, column))
    return f"not_finite_non_negative_{column}", number.isNull() | (number < 0)


def binary_rule(df: DataFrame, column: str) -> Rule:
    number = any_number(F.col(column), _dtype(df, column))
    return f"not_binary_{column}", number.isNull() | ~number.isin(0.0, 1.0)


def unit_rule(df: DataFrame, column: str) -> Rule:
    number = any_number(F.col(column), _dtype(df, column))
    return f"not_in_unit_interval_{column}", number.isNull() | (number < 0) | (number > 1)


def history_rules(df: DataFrame) -> list[Rule]:
    return [
        *blank_rules(["repository", "commit_hash", "author_name", "file_path"]),
        ("not_java_file_path", ~is_java_path(F.col("file_path"))),
        day_rule(df, "commit_date"),
        whole_number_rule(df, "lines_added"),
        whole_number_rule(df, "lines_deleted"),
    ]


def history_report(history: DataFrame) -> DataFrame:
    """All rules of a change-history table."""
    require_columns(history, HISTORY_COLUMNS)
    rules = history_rules(history)
    return violations(history, rules).unionByName(
        duplicate_violation(history, HISTORY_KEYS, len(rules)))


def feature_rules(df: DataFrame) -> list[Rule]:
    return [
        *null_rules(FEATURE_COLUMNS),
        *blank_rules(["repository", "file_path"]),
        day_rule(df, "snapshot_date"),
        *[non_negative_rule(df, c) for c in MODEL_FEATURES],
        binary_rule(df, TARGET),
    ]


def feature_report(features: DataFrame, multi_repository: bool = False) -> DataFrame:
    """All rules of a snapshot table."""
    require_columns(features, FEATURE_COLUMNS)
    rules = feature_rules(features)
    n = len(rules)
    parts = [violations(features, rules), duplicate_violation(features, SNAPSHOT_KEYS, n),
             distinct_days_violation(features, 3, n + 1)]
    if multi_repository:
        parts.append(distinct_days_violation(features, 2, n + 2, ["repository"]))
    return reduce(DataFrame.unionByName, parts)


def score_report(ranking: DataFrame) -> DataFrame:
    return violations(ranking, [unit_rule(ranking, "risk_score"), unit_rule(ranking, "decision_threshold")])


def partition_report(parted: DataFrame) -> DataFrame:
    """Rules of the retained partitions: real days, binary labels, unique identities."""
    kept = parted.where(F.col("partition").isNotNull())
    rules = [day_rule(kept, "snapshot_date"), binary_rule(kept, TARGET)]
    return violations(kept, rules).unionByName(
        duplicate_violation(kept, ["partition", *SNAPSHOT_KEYS], len(rules)))


def clean_history(history: DataFrame) -> DataFrame:
    """Validated history with whole-number counts as longs; raises on the first broken rule."""
    require_columns(history, HISTORY_COLUMNS)
    require_rows(history)
    require(history_report(history))
    return history.select(*[
        F.col(c).cast("string").cast("double").cast("long").alias(c)
        if c in ("lines_added", "lines_deleted") and not isinstance(_dtype(history, c), T.LongType)
        else F.col(c) for c in HISTORY_COLUMNS])


def clean_features(features: DataFrame, multi_repository: bool = False) -> DataFrame:
    """Validated, typed snapshots; columns outside the contract are kept but never predictors."""
    require_columns(features, FEATURE_COLUMNS)
    require_rows(features)
    require(feature_report(features, multi_repository))
    typed = {"snapshot_date": utc_day(F.col("snapshot_date"), _dtype(features, "snapshot_date")),
             TARGET: F.col(TARGET).cast("int")}
    typed.update({c: F.col(c).cast("double") for c in MODEL_FEATURES})
    return features.withColumns(typed)


