"""End-to-end jobs: history to snapshots, within-project and cross-project evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import brief, calibration, diagnostics, explain, guidance, intelligence
from riskloom.operators import partitions, ranking, records, stability
from riskloom.operators.models import STRATEGIES, TrainingResult, train_baselines
from riskloom.operators.newton import fit_logistic
from riskloom.operators.provenance import build_provenance, frame_digest, provenance_ends, verify_provenance
from riskloom.operators.quality import clean_history, feature_report, partition_report, require
from riskloom.operators.snapshots import build_snapshots, repository_summary, snapshot_summary
from riskloom.schemas import (
    CROSS_MODE, DEFAULT_CUTOFF, FOREST_TREES, MODEL_FEATURES, PROTOCOL, SEED, TARGET, TOP_RISK, WITHIN_MODE,
)
from riskloom.staging import stage


@dataclass
class Dataset:
    """Snapshots and their provenance, which travel together."""

    features: DataFrame
    provenance: DataFrame

    @property
    def ends(self) -> DataFrame:
        return provenance_ends(self.provenance)


def run_snapshots(history: DataFrame) -> Dataset:
    """Validate a history and build its snapshots with provenance."""
    history = clean_history(history)
    features = stage(build_snapshots(history), "features")
    if features.isEmpty():
        raise partitions.PartitionError("No file has a complete 90-day label window.")
    return Dataset(features, stage(build_provenance(history, features), "provenance"))


def merge_datasets(datasets: Sequence[Dataset]) -> Dataset:
    from riskloom.sources.readers import combine_feature_sets

    return Dataset(combine_feature_sets([d.features for d in datasets]),
                   reduce(DataFrame.unionByName, [d.provenance for d in datasets]))


def _audited(parted: DataFrame, dataset: Dataset, calendar, held_out: str | None) -> tuple[DataFrame, DataFrame]:
    """Store the partitions, then audit the stored rows against the digests of the split."""
    rows = stage(parted, "partitions")
    require(partition_report(rows))
    recorded = stage(frame_digest(parted.where(F.col("partition").isNotNull()), ["partition"]), "digests")
    audit = stage(partitions.audit_partitions(
        rows, dataset.ends, calendar, held_out, dataset.provenance, recorded), "audit")
    partitions.require_audit(audit)
    return rows, audit


def _fold_audited(parted: DataFrame, dataset: Dataset, calendar, held_out: str) -> DataFrame:
    """Audit a fold that is only a filter over the stored snapshots; nothing but the checks is stored."""
    require(partition_report(parted))
    return stage(partitions.audit_partitions(parted, dataset.ends, calendar, held_out, dataset.provenance), "audit")


def dataset_summary(parted: DataFrame) -> DataFrame:
    """One row: snapshots, classes, repositories, date range, predictors and the size of each partition."""
    kept = parted.where(F.col("partition").isNotNull())
    days = kept.groupBy("repository").agg(F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi")).agg(
        F.count(F.lit(1)).alias("repositories"), F.min("lo").alias("start_date"), F.max("hi").alias("end_date"))
    split = partitions.partition_summary(kept)  # three rows at most
    parts = split.agg(F.sort_array(F.collect_list(F.struct(*split.columns))).alias("splits"))
    out = snapshot_summary(kept).withColumn("predictors", F.array(*map(F.lit, MODEL_FEATURES)))
    for one in (days, parts):
        out = out.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out


def pooled_scope(rows: DataFrame, cross_project: bool) -> DataFrame:
    """Rows of a single-project report under its one name, unnamed rows too; other rows as they are."""
    if intelligence.scope(rows, cross_project) == "per_project":
        return rows
    named = intelligence.normalize(rows).where("project != ''").select("project").first()
    return rows.withColumn("project", F.lit(named["project"] if named else ""))


def explained_samples(result: TrainingResult, test: DataFrame, mode: str) -> DataFrame:
    """Scored and explained test rows of the selected model, in the column names of a ranking."""
    best = result.best
    scored = best.explain(best.score(test), test)
    return scored.select(
        F.col("repository").alias("project"), "file_path",
        F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "risk_score",
        F.col(TARGET).alias("true_label"), F.lit(best.name).alias("model"),
        F.lit(mode).alias("evaluation_mode"), F.lit(best.method).alias("score_method"),
        F.lit(result.best_threshold).alias("decision_threshold"), "drivers", "explanation_method",
        "contribution_space")


def intelligence_tables(rows: DataFrame, samples: DataFrame, cutoff: float) -> dict[str, DataFrame]:
    trend = stage(intelligence.monthly_trend(rows, samples, cutoff), "trend")
    return {
        "project_summary": intelligence.project_summary(rows, cutoff),
        "risk_bands": intelligence.risk_bands(rows),
        "risk_concentration": intelligence.risk_concentration(rows),
        "repeated_concentration": intelligence.repeated_concentration(rows, cutoff),
        "hotspots": intelligence.hotspots(rows, samples, cutoff),
        "signal_profile": intelligence.signal_profile(samples),
        "monthly_trend": trend,
        "trend_direction": intelligence.trend_direction(trend),
        "unsupported_analyses": intelligence.unsupported_analyses(rows, samples),
    }


def explanation_tables(samples: DataFrame) -> dict[str, DataFrame]:
    return {
        "explanation_summary": explain.explanation_totals(samples),
        "common_directions": explain.common_directions(samples),
        "average_magnitudes": explain.average_magnitudes(samples),
        "method_usage": explain.method_usage(samples),
    }


def with_top(samples: DataFrame, top_k: int | None) -> DataFrame:
    """Samples with their ``top_k`` strongest drivers, or all."""
    return samples if top_k is None else samples.withColumn("drivers", F.slice("drivers", 1, top_k))


def insight_tables(samples: DataFrame) -> dict[str, DataFrame]:
    insights = guidance.build_insights(samples)
    return {
        "actionable_insights": insights,
        "insight_totals": guidance.insight_totals(insights),
        "common_signals": guidance.common_signals(samples),
        "unsupported_features": guidance.unsupported_features(samples),
    }


def stored(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables that are written as they are and read by a nested record as well."""
    return {name: stage(table, name) for name, table in tables.items()}


def intelligence_records(tables: dict[str, DataFrame], cutoff: float, cross_project: bool) -> dict[str, DataFrame]:
    nested = stage(records.project_records(tables, cutoff), "records")
    return {"project_intelligence": nested,
            "project_intelligence_summary": records.project_overview(nested, cross_project)}


def evaluation_records(tables: dict[str, DataFrame], cross_project: bool) -> dict[str, DataFrame]:
    nested = stage(records.evaluation_records(tables), "records")
    return {"explanation_action_evaluation": nested,
            "action_evaluation_summary": records.evaluation_overview(nested, cross_project)}


def report_tables(samples: DataFrame, cross_project: bool, cutoff: float = DEFAULT_CUTOFF,
                  top_risk: int = TOP_RISK, explain_top_k: int | None = None,
                  bins: int = calibration.CALIBRATION_BINS,
                  thresholds: Sequence[float] | None = None) -> dict[str, DataFrame]:
    """Every model-free table below a set of explained samples.

    Guidance, intelligence and brief read the full explanations; the explanation summary and the
    diagnostics read the retained (top-k) ones.
    """
    calibration.check_options(bins, thresholds)
    samples = stage(samples, "samples")
    rows = stage(ranking.build_ranking(samples), "ranking")
    scoped, named = pooled_scope(rows, cross_project), pooled_scope(samples, cross_project)
    retained = stage(explain.to_long(samples, explain_top_k), "explanations")
    queue = stage(intelligence.priority_queue(scoped, cutoff), "queue")
    tiered = stage(brief.assign_tiers(queue, cutoff), "tiers")
    actions = stage(brief.action_queue(tiered, named, cutoff), "actions")
    sections = stored(intelligence_tables(scoped, named, cutoff))
    evaluation = stored(diagnostics.evaluate_actions(
        rows, diagnostics.sample_contexts(samples, explain_top_k), actions, cutoff))
    return {
        "risk_ranking": rows,
        "risk_summary": ranking.risk_summary(rows, cutoff),
        "top_high_risk": ranking.top_high_risk(rows, cutoff, top_risk),
        "prediction_explanations": retained,
        **explanation_tables(with_top(samples, explain_top_k)),
        **insight_tables(samples),
        **sections,
        **intelligence_records(sections | {"developer_priority": queue}, cutoff, cross_project),
        "developer_priority": queue,
        "top_priorities": intelligence.top_priorities(queue),
        "developer_risk_brief": brief.executive_summary(scoped, named, tiered, cutoff),
        "developer_actions": actions,
        "top_actions": brief.top_actions(actions),
        **evaluation,
        **evaluation_records(evaluation, cross_project),
        **calibration.calibrate(rows, cross_project, bins, thresholds),
    }


def resume_report(tables: dict[str, DataFrame], cutoff: float = DEFAULT_CUTOFF,
                  cross_project: bool = False) -> dict[str, DataFrame]:
    """Derive missing downstream tables from a stored ranking and stored explanations."""
    out = dict(tables)
    rows, retained = out["risk_ranking"], out["prediction_explanations"]
    samples = stage(explain.from_long(retained), "samples")
    scoped, named = pooled_scope(rows, cross_project), pooled_scope(samples, cross_project)

    def missing(*names: str) -> bool:
        return any(n not in out for n in names)

    def fill(derived: dict[str, DataFrame]) -> None:
        for name, table in derived.items():
            out.setdefault(name, table)

    if missing("risk_summary"):
        fill({"risk_summary": ranking.risk_summary(rows, cutoff)})
    if missing("explanation_summary"):
        fill(explanation_tables(samples))
    if missing("actionable_insights"):
        fill(insight_tables(samples))
    if missing("project_summary", "hotspots"):
        fill(stored(intelligence_tables(scoped, named, cutoff)))
    if missing("developer_priority"):
        fill({"developer_priority": stage(intelligence.priority_queue(scoped, cutoff), "queue")})
    if missing("developer_risk_brief", "developer_actions"):
        tiered = stage(brief.assign_tiers(out["developer_priority"], cutoff), "tiers")
        fill({"developer_risk_brief": brief.executive_summary(scoped, named, tiered, cutoff),
              "developer_actions": stage(brief.action_queue(tiered, named, cutoff), "actions")})
    if missing("action_quality", "explanation_stability"):
        fill(stored(diagnostics.evaluate_actions(rows, retained, out["developer_actions"], cutoff)))
    if missing("project_intelligence"):
        fill(intelligence_records(out, cutoff, cross_project))
    if missing("explanation_action_evaluation"):
        fill(evaluation_records(out, cross_project))
    if missing("calibration", "threshold_analysis", "calibration_summary"):
        fill(calibration.calibrate(rows, cross_project))
    return out


def run_calibration(rows: DataFrame, cross_project: bool = False, bins: int = calibration.CALIBRATION_BINS,
                    thresholds: Sequence[float] | None = None) -> dict[str, DataFrame]:
    """Calibration of a stored ranking alone."""
    return calibration.calibrate(rows, cross_project, bins, thresholds)


def evaluate_within(dataset: Dataset, validation_start: str | None = None, test_start: str | None = None,
                    test_end: str | None = None, trees: int = FOREST_TREES, max_depth: int = 30,
                    seed: int = SEED, most_rows: int | None = None, **report_options) -> dict[str, DataFrame]:
    """Temporal split, baselines, locked selection and the whole report of the selected model."""
    require(feature_report(dataset.features))
    verify_provenance(dataset.provenance, dataset.features)
    parted, calendar = partitions.chronological_split(
        dataset.features, dataset.ends, validation_start=validation_start, test_start=test_start,
        test_end=test_end)
    parted, audit = _audited(parted, dataset, calendar, None)
    result = train_baselines(parted, trees, max_depth, seed, most_rows)
    test = parted.where(F.col("partition") == "test")
    metrics = stage(result.validation.withColumn("partition", F.lit("validation")).unionByName(
        result.test.withColumn("partition", F.lit("test"))), "metrics")
    comparison = metrics.where((F.col("partition") == "test") & (F.col("threshold_strategy") == STRATEGIES[1]))
    comparison = comparison.withColumn("selected_model", F.col("model") == result.selected_model)
    return {
        "metrics": metrics,
        "model_comparison": comparison,
        "feature_importance": result.importance.withColumn("fold_count", F.lit(1).cast("long")),
        "confusion_matrix": comparison.where("selected_model").select("tn", "fp", "fn", "tp"),
        "dataset_summary": dataset_summary(parted),
        "partition_summary": partitions.partition_summary(parted),
        "exclusion_ledger": partitions.exclusion_ledger(parted),
        "leakage_audit": audit,
        **report_tables(explained_samples(result, test, WITHIN_MODE), False, **report_options),
    }


def evaluate_cross(dataset: Dataset, validation_start: str, test_start: str, test_end: str | None = None,
                   trees: int = FOREST_TREES, max_depth: int = 30, seed: int = SEED, most_rows: int | None = None,
                   same_project: DataFrame | None = None, **report_options) -> dict[str, DataFrame]:
    """Leave-one-project-out folds, stability across folds and the report of the held-out rows.

    The folds share one stored snapshot table: a fold is a filter over it and stores no rows.
    """
    spark = dataset.features.sparkSession
    require(feature_report(dataset.features, multi_repository=True))
    verify_provenance(dataset.provenance, dataset.features)
    dataset = Dataset(stage(dataset.features, "snapshots"), dataset.provenance)
    calendar = partitions.fix_calendar(dataset.ends, validation_start, test_start, test_end)
    # A fold trains on the rows that are nobody's test, less those of its own repository: one scan a step fits them all.
    trained = partitions.apply_calendar(dataset.features, dataset.ends, calendar).where("partition = 'train'")
    fits = fit_logistic(stage(trained, "training"), MODEL_FEATURES, TARGET, "repository")
    folds, selections, samples, importances, audits, linear, forest, digests = ([] for _ in range(8))
    for held_out, parted in partitions.lopo_folds(dataset.features, dataset.ends, calendar):
        audit = _fold_audited(parted, dataset, calendar, held_out)
        result = train_baselines(parted, trees, max_depth, seed, most_rows, fits.get(held_out, fits[None]))
        audit = partitions.fold_audit(audit, parted, held_out, MODEL_FEATURES,
                                      result.models["logistic_regression"].fitted_rows)
        partitions.require_audit(audit)
        audits.append(audit.withColumn("held_out_repository", F.lit(held_out)))
        locked = result.validation.where(F.col("threshold_strategy") == STRATEGIES[1]).select(
            "model", F.col("threshold").alias("selected_validation_threshold"),
            F.col("pr_auc").alias("validation_pr_auc"), F.col("f1").alias("validation_f1"))
        folds.append(result.test.join(F.broadcast(locked), "model").withColumns({
            "held_out_repository": F.lit(held_out),
            "is_selected_model": F.col("model") == result.selected_model}))
        selections.append((held_out, result.selected_model, result.best_threshold))
        linear += [(held_out, f, c) for f, (c, _, _) in result.models["logistic_regression"].linear.items()]
        forest += [(held_out, f, float(v)) for f, v in zip(
            MODEL_FEATURES, result.models["random_forest"].forest.featureImportances.toArray())]
        importances.append(result.importance.withColumn("held_out_repository", F.lit(held_out)))
        test = parted.where(F.col("partition") == "test")
        digests.append(frame_digest(test, ["repository"]))
        samples.append(explained_samples(result, test, CROSS_MODE))

    def union(frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    fold_rows = stage(union(folds), "folds")
    aggregate = stage(stability.aggregate_metrics(fold_rows), "aggregate")
    selection = spark.createDataFrame(
        selections, "held_out_repository string, selected_model string, selected_threshold double")
    out = {
        "folds": fold_rows, "aggregate": aggregate, "model_selection": selection,
        "selected_thresholds": fold_rows.where(F.col("threshold_strategy") == STRATEGIES[1]).select(
            "held_out_repository", "model", "is_selected_model", "selected_validation_threshold",
            "validation_pr_auc", "validation_f1"),
        "coefficient_stability": stability.coefficient_stability(spark.createDataFrame(
            linear, "held_out_repository string, feature string, coefficient double")),
        "feature_importance_stability": stability.importance_stability(spark.createDataFrame(
            forest, "held_out_repository string, feature string, importance double")),
        "dataset_shift": stability.dataset_shift(dataset.features, dataset.ends, calendar),
        "generalization": stability.generalization(fold_rows, aggregate),
        "leakage_audit": union(audits),
        "metrics": fold_rows,
        "model_comparison": stability.with_selected_counts(aggregate, fold_rows),
        "feature_importance": stability.cross_importance(union(importances)),
        "confusion_matrix": stability.pooled_confusion(fold_rows),
        "dataset_summary": snapshot_summary(dataset.features),
        "repository_summary": repository_summary(dataset.features),
    }
    if same_project is not None:
        cross = comparison_rows(fold_rows, union(digests), calendar)
        out["same_project_comparison"] = stability.same_project_comparison(same_project, cross)
    out["report"] = cross_report(out, calendar)
    out.update(report_tables(union(samples), True, **report_options))
    return out


#: Sections of the cross-project record: each has a few rows a fold, model or predictor.
CROSS_SECTIONS = ("folds", "aggregate", "model_selection", "selected_thresholds", "coefficient_stability",
                  "feature_importance_stability", "dataset_shift", "generalization", "leakage_audit", "repository_summary")


def cross_report(tables: dict[str, DataFrame], calendar) -> DataFrame:
    """One nested record of a cross-project run: protocol, calendar, and each section as a sorted array of its rows."""
    row = tables["folds"].sparkSession.range(1).select(
        F.lit(1).alias("_one"), F.lit(PROTOCOL).alias("protocol"), F.lit(CROSS_MODE).alias("evaluation_mode"),
        *[F.lit(str(getattr(calendar, day))).alias(day) for day in ("validation_start", "test_start", "test_end")])
    for name in CROSS_SECTIONS:
        table = tables[name]
        row = row.join(table.agg(F.lit(1).alias("_one"), F.sort_array(F.collect_list(F.struct(*table.columns))).alias(name)), "_one")
    return row.drop("_one")


def comparison_rows(fold_rows: DataFrame, digests: DataFrame, calendar) -> DataFrame:
    """Fold metrics with the protocol, calendar and test digest that a comparison must share."""
    rows = fold_rows.where(F.col("threshold_strategy") == STRATEGIES[1]).withColumnRenamed(
        "held_out_repository", "repository")
    return rows.join(digests.select("repository", F.col("digest").alias("test_digest")), "repository").withColumns({
        "protocol": F.lit(PROTOCOL), "validation_start": F.lit(str(calendar.validation_start)),
        "test_start": F.lit(str(calendar.test_start)), "test_end": F.lit(str(calendar.test_end))})
