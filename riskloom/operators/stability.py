"""Stability and shift across leave-one-project-out folds.

Fold tables hold a few rows per fold, model and feature; only ``dataset_shift`` reads snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import ratio
from riskloom.operators import radix
from riskloom.operators.partitions import Calendar
from riskloom.operators.scan import lookup
from riskloom.schemas import LABEL_HORIZON_DAYS, MODEL_FEATURES, MODEL_ORDER
from riskloom.staging import stage

SELECTED = "threshold_strategy = 'validation_selected'"


def aggregate_metrics(folds: DataFrame) -> DataFrame:
    """Per model over folds at the selected threshold; undefined areas are skipped."""
    area = "pr_auc"
    return folds.where(SELECTED).groupBy("model").agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.avg(area).alias("mean_pr_auc"), F.median(area).alias("median_pr_auc"),
        F.stddev_pop(area).alias("std_pr_auc"), F.min(area).alias("min_pr_auc"),
        F.max(area).alias("max_pr_auc"), F.avg("pr_auc_lift").alias("mean_pr_auc_lift"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("accuracy", "f1", "precision", "recall", "roc_auc")])


def coefficient_stability(coefficients: DataFrame) -> DataFrame:
    """(held_out, feature, coefficient) rows to mean, spread and sign consistency per feature."""
    c = F.col("coefficient")

    def share(condition):
        return F.avg(condition.cast("double"))

    return coefficients.groupBy("feature").agg(
        F.avg(c).alias("mean_coefficient"), F.stddev_pop(c).alias("std_coefficient"),
        share(c > 0).alias("positive_fraction"), share(c < 0).alias("negative_fraction"),
        share(c == 0).alias("_zero"), F.count(F.lit(1)).alias("fold_count"),
    ).select(
        "feature", "mean_coefficient", "std_coefficient", "positive_fraction", "negative_fraction",
        F.greatest("positive_fraction", "negative_fraction", "_zero").alias("sign_consistency"),
        F.when(F.col("positive_fraction") == 1, "consistently_positive")
        .when(F.col("negative_fraction") == 1, "consistently_negative").otherwise("mixed").alias("direction"),
        "fold_count").orderBy(F.desc("mean_coefficient"))


def importance_stability(importances: DataFrame) -> DataFrame:
    i = F.col("importance")
    return importances.groupBy("feature").agg(
        F.avg(i).alias("mean_importance"), F.stddev_pop(i).alias("std_importance"),
        F.min(i).alias("min_importance"), F.max(i).alias("max_importance"),
        F.count(F.lit(1)).alias("fold_count")).orderBy(F.desc("mean_importance"))


def cross_importance(importances: DataFrame) -> DataFrame:
    """Importance records of all folds combined per (model, feature, method), ranked per model."""
    from riskloom.operators.models import rank_importance

    words = F.collect_set("direction")

    def only(*allowed: str):
        return F.size(F.array_except(words, F.array(*map(F.lit, allowed)))) == 0

    combined = (
        F.when(only("positive"), "consistently_positive").when(only("negative"), "consistently_negative")
        .when(only("positive", "negative", "zero"), "mixed").otherwise("not_applicable"))
    rows = importances.groupBy("model", "feature", "method").agg(
        F.avg("importance").alias("importance"), F.avg("effect").alias("effect"),
        combined.alias("direction"), F.stddev_pop("importance").alias("standard_deviation"),
        F.count(F.lit(1)).alias("fold_count"))
    return rank_importance(rows, None)


def dataset_shift(features: DataFrame, ends: DataFrame, calendar: Calendar) -> DataFrame:
    """Median shift of every predictor between the sources and the held-out rows of each fold.

    Values are counted per repository once. The quartiles of a fold's sources are order statistics of the
    pooled counts less its own, so the folds copy neither snapshots nor counts, however many there are.
    """
    d = F.col("snapshot_date")
    label_end = F.date_add(d, LABEL_HORIZON_DAYS)
    v, t, e = F.lit(calendar.validation_start), F.lit(calendar.test_start), F.lit(calendar.test_end)
    side = (
        F.when((label_end < v) | ((d >= v) & (label_end < t)), "training")
        .when((d >= t) & (d <= e) & (label_end <= F.col("observation_end")), "held_out"))
    rows = features.join(lookup(ends), "repository").withColumn("side", side).where("side is not null")
    values = rows.select("repository", "side", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in MODEL_FEATURES])))
    counts = stage(radix.images(values, ["repository", "side", "feature"], "value"), "counts")
    own = counts.groupBy("repository", "side", "feature").agg(F.sum("n").alias("own"))
    pooled = counts.where("side = 'training'").groupBy("feature").agg(F.sum("n").alias("pooled"))
    # Every repository is held out once; without training rows of its own it is left out of nothing.
    names = ends.select("repository").distinct()
    sources = names.withColumn("feature", F.explode(F.array(*map(F.lit, MODEL_FEATURES)))).join(
        lookup(pooled), "feature").join(own.where("side = 'training'").drop("side"), ["repository", "feature"], "left")
    sizes = sources.select(
        "repository", "feature", F.lit("training").alias("side"), F.lit(radix.WITHOUT).alias("mode"),
        (F.col("pooled") - F.coalesce("own", F.lit(0))).alias("size")).unionByName(own.where("side = 'held_out'").select(
            "repository", "feature", "side", F.lit(radix.ONLY).alias("mode"), F.col("own").alias("size")))
    points = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    wanted = sizes.where("size > 0").select(
        "repository", "feature", "side", "mode", F.inline(radix.ranks(F.col("size"), points)))
    q = radix.interpolated(radix.order_statistics(counts, wanted, ["side", "feature"], "repository"),
                           ["repository", "feature", "side"], list(points))
    wide = q.groupBy(F.col("repository").alias("held_out_repository"), "feature").agg(*[
        F.max(F.when(F.col("side") == s, value)).alias(f"{s}_{name}")
        for s in ("training", "held_out")
        for name, value in (("median", F.col("q2")), ("iqr", F.col("q3") - F.col("q1")))])
    shift = F.when(F.col("training_iqr") > 0, ratio(
        F.col("held_out_median") - F.col("training_median"), F.col("training_iqr")))
    return wide.select("held_out_repository", "feature", "training_median", "training_iqr",
                       "held_out_median", "held_out_iqr",
                       shift.alias("standardized_median_shift"),
                       F.abs(shift).alias("absolute_standardized_median_shift"))


def largest_shift(shift: DataFrame) -> DataFrame:
    size = "absolute_standardized_median_shift"
    place = F.array_position(F.array(*map(F.lit, MODEL_FEATURES)), F.col("feature"))
    return shift.where(F.col(size).isNotNull()).groupBy("held_out_repository").agg(
        F.max_by("feature", F.struct(F.col(size), -place)).alias("feature"),
        F.max(size).alias("absolute_shift"))


def pooled_confusion(folds: DataFrame) -> DataFrame:
    """Confusion matrix summed over the selected model of every fold."""
    return folds.where(SELECTED).where("is_selected_model").agg(
        *[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def with_selected_counts(aggregate: DataFrame, folds: DataFrame) -> DataFrame:
    counts = folds.where(SELECTED).where("is_selected_model").groupBy("model").agg(
        F.count(F.lit(1)).alias("selected_fold_count"))
    return aggregate.join(counts, "model", "left").fillna(0, ["selected_fold_count"])


def same_project_comparison(same: DataFrame, cross: DataFrame) -> DataFrame:
    """Within-project against cross-project metrics of the same repository and test rows.

    Both sides carry repository, model, protocol, validation_start, test_start, test_end and
    test_digest; rows are only compared when all of these are equal.
    """
    guard = ["repository", "model", "protocol", "validation_start", "test_start", "test_end", "test_digest"]
    metrics = ["pr_auc", "f1", "roc_auc"]
    pairs = same.select(*guard, *[F.col(m).alias(f"same_{m}") for m in metrics]).join(
        cross.select(*guard, *[F.col(m).alias(f"cross_{m}") for m in metrics]), guard)
    return pairs.withColumns({
        **{f"delta_{m}": F.col(f"cross_{m}") - F.col(f"same_{m}") for m in metrics},
        "materially_worse_pr_auc": F.coalesce(
            (F.col("same_pr_auc") > 0) & (F.col("cross_pr_auc") < 0.8 * F.col("same_pr_auc")), F.lit(False))})


def generalization(folds: DataFrame, aggregate: DataFrame) -> DataFrame:
    """One row: repositories above prevalence, best and most stable model, spread of the best."""
    above = F.coalesce(F.col("pr_auc_lift") > 1.0, F.lit(False))
    repos = folds.where(SELECTED).where("is_selected_model").agg(
        F.sort_array(F.collect_set(F.when(above, F.col("held_out_repository")))).alias("repositories_above_prevalence"),
        F.sort_array(F.collect_set(F.when(~above, F.col("held_out_repository")))).alias("repositories_not_above_prevalence"))
    place = -F.array_position(F.array(*map(F.lit, MODEL_ORDER)), F.col("model"))
    trained = F.col("model") != "dummy"
    best = F.max_by(F.struct("model", (F.col("max_pr_auc") - F.col("min_pr_auc")).alias("spread")),
                    F.when(F.col("mean_pr_auc").isNotNull(), F.struct("mean_pr_auc", place)))
    stable = F.max_by(F.struct("model", "std_pr_auc"), F.when(
        trained & F.col("std_pr_auc").isNotNull(), F.struct(-F.col("std_pr_auc"), place)))
    models = aggregate.agg(best.alias("b"), stable.alias("s")).select(
        F.col("b.model").alias("best_mean_pr_auc_model"), F.col("b.spread").alias("best_model_pr_auc_range"),
        F.col("s.model").alias("most_stable_non_dummy_model"),
        F.col("s.std_pr_auc").alias("most_stable_non_dummy_pr_auc_std"))
    key = F.lit(1).alias("_one")
    return repos.select("*", key).join(models.select("*", key), "_one").drop("_one")
