"""Calibration bins, threshold sweeps and retrospective operating points per project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import bin_edges, edge_index, ratio
from riskloom.functions.text import clean_number, strip
from riskloom.schemas import ANALYSIS_THRESHOLDS, CALIBRATION_BINS, CALIBRATION_COLUMNS, THRESHOLD_COLUMNS


def check_options(bins: int, thresholds: Sequence[float] | None) -> list[float]:
    if isinstance(bins, bool) or not isinstance(bins, int) or bins <= 0:
        raise ValueError("bins must be a positive integer.")
    values = ANALYSIS_THRESHOLDS if thresholds is None else [float(t) for t in thresholds]
    if not values or any(not 0.0 <= t <= 1.0 for t in values):
        raise ValueError("thresholds must be a non-empty list of numbers in [0, 1].")
    return sorted(set(values))


def prepared(ranking: DataFrame, cross_project: bool) -> DataFrame:
    """(project, score, label, valid flags, method); unknown projects leave cross-project runs."""
    def known(column: str) -> Column:
        return F.when(strip(F.col(column)) != "", F.col(column))

    kinds = {c: ranking.schema[c].dataType for c in ("risk_score", "true_label")}
    score = clean_number(F.col("risk_score"), kinds["risk_score"])
    label = clean_number(F.col("true_label"), kinds["true_label"])
    rows = ranking.select(known("project").alias("project"), score.alias("score"),
                          label.alias("label"), known("score_method").alias("method"))
    rows = rows.withColumns({
        "valid_score": F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False)),
        "valid_label": F.coalesce(F.col("label").isin(0.0, 1.0), F.lit(False))})
    rows = rows.withColumn("valid", F.col("valid_score") & F.col("valid_label"))
    return rows.where(F.col("project").isNotNull()) if cross_project else rows


def excluded_projects(ranking: DataFrame) -> DataFrame:
    """How many rows a cross-project run leaves out for want of a project."""
    known = F.coalesce(strip(F.col("project")) != "", F.lit(False))
    return ranking.agg(F.count_if(~known).alias("excluded_unknown_project_samples"),
                       F.count(F.lit(1)).alias("total_samples"))


def calibration_bins(ranking: DataFrame, cross_project: bool = False,
                     bins: int = CALIBRATION_BINS) -> DataFrame:
    """Equal-width bins per project, [lower, upper) with a closed last bin; empty bins are kept."""
    check_options(bins, None)
    edges = bin_edges(bins)
    score = F.col("score")
    counts = prepared(ranking, cross_project).groupBy(
        "project", F.when(F.col("valid"), edge_index(score, edges)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(score).alias("mass"), F.sum("label").alias("positives"))
    # At most bins + 1 rows per project from here on.
    filled = counts.groupBy("project").agg(F.map_from_entries(F.collect_list(F.when(
        F.col("bin").isNotNull(),
        F.struct("bin", F.struct("n", "mass", "positives"))))).alias("found"))
    grid = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("bin_lower"),
                              F.lit(edges[i + 1]).alias("bin_upper")) for i in range(bins)])
    rows = filled.select("project", "found", F.inline(grid))
    hit = F.try_element_at("found", F.col("bin"))
    return rows.select(
        "project", "bin_lower", "bin_upper",
        F.coalesce(hit["n"], F.lit(0)).cast("long").alias("sample_count"),
        ratio(hit["mass"], hit["n"]).alias("mean_predicted_risk"),
        ratio(hit["positives"], hit["n"]).alias("observed_defect_rate")).select(*CALIBRATION_COLUMNS)


def threshold_sweep(ranking: DataFrame, cross_project: bool = False,
                    thresholds: Sequence[float] | None = None) -> DataFrame:
    """Metrics at every threshold from one histogram per project and suffix sums over it."""
    cuts = check_options(CALIBRATION_BINS, thresholds)
    passed = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: F.col("score") >= t))
    counts = prepared(ranking, cross_project).groupBy(
        "project", F.when(F.col("valid"), passed).otherwise(-1).alias("passed")).agg(
        F.count_if(F.col("valid") & (F.col("label") == 1)).alias("pos"),
        F.count_if(F.col("valid") & (F.col("label") == 0)).alias("neg"))
    cells = counts.groupBy("project").agg(
        F.collect_list(F.struct("passed", "pos", "neg")).alias("cells"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))

    def above(field: str) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(
            c["passed"] > F.col("at"), c[field]).otherwise(F.lit(0).cast("long")))

    rows = cells.select("*", F.posexplode(F.array(*map(F.lit, cuts))).alias("at", "threshold"))
    rows = rows.withColumns({"tp": above("pos"), "fp": above("neg")})
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "P", "N"))
    return rows.select(
        "project", "threshold",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, p).alias("recall"),
        ratio(2 * tp, tp + fp + p).alias("f1"), ratio(n - fp, n).alias("specificity"),
        ratio(fp, n).alias("false_positive_rate"), (tp + fp).alias("files_flagged"),
        ratio(100 * (tp + fp), p + n).alias("percentage_files_flagged")).select(*THRESHOLD_COLUMNS)


def recommended_thresholds(sweep: DataFrame) -> DataFrame:
    """Maximum F1, ties to the highest threshold; none without positives."""
    best = F.max_by(F.struct(*THRESHOLD_COLUMNS[1:]), F.struct("f1", "threshold"))
    # Recall is defined exactly where positives exist.
    return sweep.groupBy("project").agg(
        F.when(F.max("recall").isNotNull(), best).alias("best")
    ).select("project", F.col("best.threshold").alias("recommended_threshold"),
             *[F.col(f"best.{c}").alias(f"recommended_{c}") for c in THRESHOLD_COLUMNS[2:]])


def calibration_summary(ranking: DataFrame, cross_project: bool = False, bins: int = CALIBRATION_BINS,
                        thresholds: Sequence[float] | None = None) -> DataFrame:
    """Counts, Brier score, expected calibration error and recommendation per project.

    A within-project ranking without rows is one unnamed project of zero samples.
    """
    valid = F.col("valid")
    error = F.pow(F.col("score") - F.col("label"), F.lit(2.0))
    counts = prepared(ranking, cross_project).groupBy("project").agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if(valid).alias("valid_samples"),
        F.count_if(~F.col("valid_score")).alias("invalid_score_samples"),
        F.count_if(~F.col("valid_label")).alias("invalid_label_samples"),
        F.count_if(valid & (F.col("label") == 1)).alias("positive_labels"),
        F.avg(F.when(valid, error)).alias("brier_score"),
        F.sort_array(F.collect_set(F.when(valid, F.col("method")))).alias("score_methods"),
        F.count_if(valid & F.col("method").isNull()).alias("unknown_score_method_samples"))
    if not cross_project:
        zero = {f.name: F.lit(None if f.name in ("project", "brier_score") else 0).cast(f.dataType)
                for f in counts.schema if f.name != "score_methods"}
        nothing = counts.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(
            *[c.alias(n) for n, c in zero.items()], F.array().cast("array<string>").alias("score_methods"))
        counts = counts.unionByName(nothing)
    table = calibration_bins(ranking, cross_project, bins)
    gap = F.col("sample_count") * F.abs(F.col("mean_predicted_risk") - F.col("observed_defect_rate"))
    ece = table.groupBy("project").agg(
        F.count_if(F.col("sample_count") > 0).alias("populated_bins"),
        ratio(F.sum(gap), F.sum("sample_count")).alias("ece"))
    best = recommended_thresholds(threshold_sweep(ranking, cross_project, thresholds))

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        same = left["project"].eqNullSafe(right["project"])
        return left.join(right, same, "left").drop(right["project"])

    rows = attach(attach(counts, ece), best)
    return rows.select(
        "project", "total_samples", "valid_samples",
        (F.col("total_samples") - F.col("valid_samples")).alias("excluded_samples"),
        "invalid_score_samples", "invalid_label_samples", "positive_labels",
        (F.col("valid_samples") - F.col("positive_labels")).alias("negative_labels"),
        F.coalesce("populated_bins", F.lit(0).cast("long")).alias("populated_bins"), "brier_score", "ece",
        "recommended_threshold",
        F.when(F.col("recommended_threshold").isNotNull(), "available")
        .when(F.col("valid_samples") == 0, "no_valid_samples")
        .otherwise("no_positive_labels").alias("recommendation_status"),
        F.col("recommended_f1"), "score_methods", "unknown_score_method_samples")


def calibrate(ranking: DataFrame, cross_project: bool = False, bins: int = CALIBRATION_BINS,
              thresholds: Sequence[float] | None = None) -> dict[str, DataFrame]:
    """The three calibration tables of a stored or live ranking; needs no model."""
    cuts = check_options(bins, thresholds)
    return {
        "calibration": calibration_bins(ranking, cross_project, bins),
        "threshold_analysis": threshold_sweep(ranking, cross_project, cuts),
        "calibration_summary": calibration_summary(ranking, cross_project, bins, cuts),
    }
