"""Leakage-safe temporal partitions, leave-one-project-out folds and their audits."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scan import lookup
from riskloom.schemas import (
    LABEL_HORIZON_DAYS, MODEL_FEATURES, SNAPSHOT_KEYS, TARGET,
)

PARTITIONS = ["train", "validation", "test"]


class PartitionError(ValueError):
    """A temporal split is not possible or not safe."""


@dataclass(frozen=True)
class Calendar:
    validation_start: date
    test_start: date
    test_end: date


def _as_day(value: str | date) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def fix_calendar(ends: DataFrame, validation_start: str | date, test_start: str | date,
                 test_end: str | date | None = None) -> Calendar:
    """Resolve the default test end and check the order of the boundaries."""
    first_end = ends.agg(F.min("observation_end")).first()[0]
    if first_end is None:
        raise PartitionError("No observation end is known.")
    latest = first_end - timedelta(days=LABEL_HORIZON_DAYS)
    v, t = _as_day(validation_start), _as_day(test_start)
    e = latest if test_end is None else _as_day(test_end)
    if not v < t <= e:
        raise PartitionError("Need validation start < test start <= test end.")
    if e > latest:
        raise PartitionError("The test end lies after the last fully observed label window.")
    return Calendar(v, t, e)


def _rules(c: Calendar, held_out: Column | None) -> tuple[Column, Column]:
    d, repository = F.col("snapshot_date"), F.col("repository")
    label_end = F.date_add(d, LABEL_HORIZON_DAYS)
    v, t, e = F.lit(c.validation_start), F.lit(c.test_start), F.lit(c.test_end)
    source = F.lit(True) if held_out is None else repository != held_out
    target = F.lit(True) if held_out is None else repository == held_out
    early, middle, late = source & (d < v), source & (d >= v) & (d < t), target & (d >= t)
    observed = label_end <= F.col("observation_end")
    partition = (
        F.when(early & (label_end < v), "train")
        .when(middle & (label_end < t), "validation")
        .when(late & (d <= e) & observed, "test")
    )
    reason = (
        F.when(partition.isNotNull(), F.lit(None))
        .when(early, "immature_training_label")
        .when(middle, "immature_validation_label")
        .when(late & ~observed, "incomplete_test_label")
        .when(late, "after_test_end")
        .when(target & (d < t), "held_out_history")
        .otherwise("source_at_or_after_test_start")
    )
    return partition, reason


def partition_mature(features: DataFrame, ends: DataFrame, validation_start: str | date,
                     test_start: str | date, test_end: str | date | None = None,
                     held_out: str | None = None) -> DataFrame:
    """Add ``observation_end``, ``partition`` and ``exclusion_reason`` to every snapshot.

    A label must end before the next partition starts; test labels must be fully observed.
    """
    calendar = fix_calendar(ends, validation_start, test_start, test_end)
    return apply_calendar(features, ends, calendar, held_out)


def apply_calendar(features: DataFrame, ends: DataFrame, calendar: Calendar,
                   held_out: str | None = None) -> DataFrame:
    partition, reason = _rules(calendar, None if held_out is None else F.lit(held_out))
    return (
        features.drop("observation_end").join(lookup(ends), "repository")
        .withColumns({"partition": partition, "exclusion_reason": reason})
    )


def split_boundaries(features: DataFrame, train_fraction: float = 0.70,
                     validation_fraction: float = 0.15) -> DataFrame:
    """Candidate boundaries by distinct-date fractions: one row of two days.

    The distinct days of a calendar are few, so they fit one sorted array.
    """
    if train_fraction <= 0 or validation_fraction <= 0 or train_fraction + validation_fraction >= 1:
        raise PartitionError("Fractions must be positive and leave a test period.")
    days = features.select("snapshot_date").distinct().agg(
        F.sort_array(F.collect_set("snapshot_date")).alias("days"))
    n = F.size("days")
    train = F.greatest(F.lit(1), F.floor(n * F.lit(train_fraction)).cast("int"))
    both = F.floor(n * F.lit(train_fraction + validation_fraction)).cast("int")
    stop = F.least(F.greatest(train + 1, both), n - 1)
    return days.select(
        n.alias("distinct_dates"),
        F.try_element_at("days", train + 1).alias("validation_start"),
        F.try_element_at("days", stop + 1).alias("test_start"))


def chronological_split(features: DataFrame, ends: DataFrame, train_fraction: float = 0.70,
                        validation_fraction: float = 0.15,
                        validation_start: str | None = None, test_start: str | None = None,
                        test_end: str | None = None) -> tuple[DataFrame, Calendar]:
    """Explicit boundaries (both or neither), or candidates by date fraction; then purge."""
    if (validation_start is None) != (test_start is None):
        raise PartitionError("Give both validation_start and test_start, or neither.")
    if validation_start is None:
        row = split_boundaries(features, train_fraction, validation_fraction).first()
        if row["distinct_dates"] < 3:
            raise PartitionError("A split needs at least three distinct dates.")
        validation_start, test_start = row["validation_start"], row["test_start"]
    calendar = fix_calendar(ends, validation_start, test_start, test_end)
    return apply_calendar(features, ends, calendar), calendar


def partition_summary(parted: DataFrame) -> DataFrame:
    return (
        parted.where(F.col("partition").isNotNull()).groupBy("partition")
        .agg(F.min("snapshot_date").alias("start_date"), F.max("snapshot_date").alias("end_date"),
             F.count(F.lit(1)).alias("row_count"), F.sum(TARGET).alias("positives"))
        .withColumn("negatives", F.col("row_count") - F.col("positives"))
        .withColumn("positive_percentage", F.col("positives") * 100.0 / F.col("row_count"))
    )


def exclusion_ledger(parted: DataFrame) -> DataFrame:
    return (
        parted.where(F.col("exclusion_reason").isNotNull())
        .groupBy("repository", F.col("exclusion_reason").alias("reason"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.min("snapshot_date").alias("start_date"),
             F.max("snapshot_date").alias("end_date"))
    )


def coverage_gaps(parted: DataFrame, ends: DataFrame, held_out: str | None = None) -> DataFrame:
    """(partition, repository) pairs that a split must contain but does not, and the reverse."""
    wanted = ends.select("repository", F.explode(F.array(*map(F.lit, PARTITIONS))).alias("partition"))
    if held_out is not None:
        is_test = F.col("partition") == "test"
        wanted = wanted.where(is_test == (F.col("repository") == held_out))
    found = parted.where(F.col("partition").isNotNull()).select("repository", "partition").distinct()
    missing = wanted.select("repository", "partition").subtract(found)
    extra = found.subtract(wanted.select("repository", "partition"))
    return missing.withColumn("gap", F.lit("missing")).unionByName(
        extra.withColumn("gap", F.lit("unexpected")))


def overlapping_groups(parted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur in more than one partition."""
    return (
        parted.where(F.col("partition").isNotNull()).select("partition", *keys).distinct()
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("partitions")).where("partitions > 1")
    )


def _as_checks(row: DataFrame) -> DataFrame:
    """Turn a one-row frame of Booleans into (check, passed) rows."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(False)).alias("passed"))
        for c in row.columns])))


def _none(df: DataFrame, name: str) -> DataFrame:
    return _as_checks(df.agg((F.count(F.lit(1)) == 0).alias(name)))


def audit_partitions(parted: DataFrame, ends: DataFrame, calendar: Calendar,
                     held_out: str | None = None, provenance: DataFrame | None = None,
                     recorded: DataFrame | None = None) -> DataFrame:
    """Named checks (check, passed) over the live partitions.

    ``recorded`` holds (partition, row_count, digest) from the time of the split; ``provenance``
    adds the accounting against the recorded source rows.
    """
    from riskloom.operators.provenance import frame_digest

    label_end = F.date_add("snapshot_date", LABEL_HORIZON_DAYS)
    v, t, e = F.lit(calendar.validation_start), F.lit(calendar.test_start), F.lit(calendar.test_end)
    d, part, reason = F.col("snapshot_date"), F.col("partition"), F.col("exclusion_reason")
    eligible = {
        "train": label_end < v,
        "validation": (d >= v) & (label_end < t),
        "test": (d >= t) & (d <= e),
    }
    tests = []
    for name in PARTITIONS:
        mine = part == name
        tests += [
            (F.count_if(mine) > 0).alias(f"{name}_not_empty"),
            (F.count_if(mine & (label_end > F.col("observation_end"))) == 0).alias(f"{name}_labels_observed"),
            (F.count_if(mine & ~eligible[name]) == 0).alias(f"{name}_temporal_eligibility"),
        ]
    tests += [
        (F.count_if(part.isNotNull()) + F.count_if(reason.isNotNull())
         == F.count(F.lit(1))).alias("row_accounting"),
        (F.count_if(part.isNotNull() & reason.isNotNull()) == 0).alias("exclusion_accounting"),
    ]
    checks = [
        _as_checks(parted.agg(*tests)),
        _none(coverage_gaps(parted, ends, held_out), "repository_coverage"),
        _none(overlapping_groups(parted, SNAPSHOT_KEYS), "disjoint_sample_identities"),
        _none(overlapping_groups(parted, ["repository", "snapshot_date"]),
              "whole_repository_date_groups"),
        _as_checks(ends.agg(
            F.lit(calendar.validation_start < calendar.test_start <= calendar.test_end)
            .alias("ordered_calendar_boundaries"),
            (F.date_add(e, LABEL_HORIZON_DAYS) <= F.min("observation_end"))
            .alias("common_observation_coverage"))),
    ]
    if provenance is not None:
        live = parted.groupBy("repository").agg(F.count(F.lit(1)).alias("rows_now"))
        both = provenance.join(live, "repository", "full_outer")
        checks += [
            _none(both.where(~F.col("row_count").eqNullSafe(F.col("rows_now"))), "source_row_accounting"),
            _none(provenance.where(F.col("horizon_days") != LABEL_HORIZON_DAYS), "fixed_90_day_horizon"),
        ]
    if recorded is not None:
        now = frame_digest(parted.where(part.isNotNull()), ["partition"])
        changed = now.alias("a").join(recorded.alias("b"), "partition", "full_outer").where(
            ~(F.col("a.digest").eqNullSafe(F.col("b.digest"))
              & F.col("a.row_count").eqNullSafe(F.col("b.row_count"))))
        checks.append(_none(changed, "rows_unchanged"))
    return reduce(DataFrame.unionByName, checks)


def require_audit(audit: DataFrame) -> None:
    """Fail closed with the names of the failed checks."""
    failed = sorted(r["check"] for r in audit.where(~F.col("passed")).collect())
    if failed:
        raise PartitionError("Temporal audit failed: " + ", ".join(failed))


def repository_names(ends: DataFrame) -> list[str]:
    return [r["repository"] for r in ends.select("repository").distinct().orderBy("repository").collect()]


def lopo_fold_summary(features: DataFrame, ends: DataFrame, calendar: Calendar) -> DataFrame:
    """Rows and classes per (held-out repository, repository, partition or reason).

    A repository has two roles, held out or source, whatever the fold. Snapshots are counted once per
    role; the folds of a repository then only repeat the counts of its source role, as the result does.
    """
    roles = []
    for role, held_out in (("held", F.col("repository")), ("source", F.lit(None).cast("string"))):
        partition, reason = _rules(calendar, F.coalesce(held_out, F.concat("repository", F.lit("'"))))
        roles.append(F.struct(F.lit(role).alias("role"), F.coalesce(partition, F.lit("excluded")).alias("partition"),
                              reason.alias("reason")))
    counts = (
        features.drop("observation_end").join(lookup(ends), "repository")
        .select("repository", "snapshot_date", TARGET, F.explode(F.array(*roles)).alias("as"))
        .groupBy("repository", "as.role", "as.partition", "as.reason")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum(TARGET).alias("positives"),
             F.min("snapshot_date").alias("start_date"), F.max("snapshot_date").alias("end_date")))
    names = ends.agg(F.collect_set("repository").alias("names")).withColumn("role", F.lit("source"))
    others = F.filter("names", lambda n: n != F.col("repository"))
    return counts.join(F.broadcast(names), "role", "left").select(  # one row
        F.explode(F.when(F.col("role") == "held", F.array("repository")).otherwise(others)).alias("held_out"),
        "repository", "partition", "reason", "row_count", "positives", "start_date", "end_date")


def lopo_folds(features: DataFrame, ends: DataFrame, calendar: Calendar):
    """Yield (held-out repository, partitioned frame); one frame per fold, nothing fanned out."""
    repositories = repository_names(ends)
    if len(repositories) < 2:
        raise PartitionError("Leave-one-project-out needs at least two repositories.")
    for name in repositories:
        yield name, apply_calendar(features, ends, calendar, name)


def fold_audit(audit: DataFrame, parted: DataFrame, held_out: str, predictors: list[str],
               fitted_rows: int) -> DataFrame:
    """Leakage checks of one fold on top of the temporal audit."""
    part, repository = F.col("partition"), F.col("repository")
    mine = repository == held_out
    future = [c for c in parted.columns if c == TARGET or "future" in c.lower()]
    facts = parted.agg(
        (F.count_if(mine & (part == "train")) == 0).alias("held_out_absent_from_training"),
        (F.count_if(mine & (part == "validation")) == 0).alias("held_out_absent_from_validation"),
        (F.count_if(~mine & (part == "test")) == 0).alias("held_out_only_in_test"),
        (F.count_if(part == "train") == fitted_rows).alias("preprocessing_rows_match_training"),
        *[F.lit(passed).alias(name) for name, passed in {
            "repository_excluded": "repository" not in predictors,
            "file_path_excluded": "file_path" not in predictors,
            "snapshot_date_excluded": "snapshot_date" not in predictors,
            "target_excluded": TARGET not in predictors,
            "future_fields_excluded": not set(predictors) & set(future),
            "predictors_match_whitelist": list(predictors) == MODEL_FEATURES,
        }.items()],
    )
    return audit.unionByName(_as_checks(facts))
