"""Risk tiers, the action queue and the executive summary of every project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import attention_level, ratio_or_zero
from riskloom.functions.registry import REGISTRY, supported
from riskloom.functions.text import blank, sample_id
from riskloom.operators.explain import strongest, total_magnitude
from riskloom.operators.guidance import with_guidance
from riskloom.operators.intelligence import (
    monthly_trend, normalize, project_summary, risk_concentration, signal_profile, top_hotspot,
    trend_direction,
)
from riskloom.operators.scan import lookup, ranked
from riskloom.schemas import ACTION_COLUMNS, CRITICAL_SHARE, DEFAULT_CUTOFF, HIGH_SHARE, RISK_TIERS

SAMPLE = ["project", "identifier", "snapshot_date"]


def priority_from_ranking(ranking: DataFrame) -> DataFrame:
    """A ranking standing in for a missing priority queue."""
    rows = normalize(ranking)
    return rows.select(
        "project", F.col("file_path").alias("identifier"),
        blank(F.col("snapshot_date")).alias("snapshot_date"),
        F.col("risk_score").alias("predicted_risk"), F.col("risk_score").alias("priority_score"),
        blank(F.col("primary_risk_reason")).alias("primary_risk_reason"),
        blank(F.col("recommended_action")).alias("recommended_action"),
        F.coalesce("risk_signal_count", F.lit(0)).cast("long").alias("risk_signal_count"),
        F.lit(0).cast("long").alias("recurring_high_risk_count"),
        F.lit(0.0).alias("recurring_high_risk_rate"))


def assign_tiers(queue: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """Project-local tiers: of the H rows at or above the cutoff the first max(1, ceil(10 % H))
    are CRITICAL, those through ceil(30 % H) HIGH, the rest MEDIUM; rows below are LOW, unranked.
    """
    if not 0.0 <= cutoff <= 1.0:
        raise ValueError("The cutoff must be between 0 and 1.")
    rows = queue.drop("rank").withColumn("project", blank(F.col("project")))
    eligible = rows.where(F.col("predicted_risk") >= cutoff)
    order = [
        F.desc("priority_score"), F.desc("predicted_risk"), F.desc("recurring_high_risk_count"),
        F.desc("recurring_high_risk_rate"), F.asc("identifier"), F.asc("snapshot_date"),
        F.asc("primary_risk_reason"), F.asc("recommended_action"), F.desc("risk_signal_count")]
    sizes = eligible.groupBy("project").agg(F.count(F.lit(1)).alias("_h"))
    critical = F.greatest(F.lit(1), F.ceil(F.lit(CRITICAL_SHARE) * F.col("_h")))
    high = F.greatest(critical, F.ceil(F.lit(HIGH_SHARE) * F.col("_h")))
    place = F.col("priority_rank")
    ranked_rows = (
        ranked(eligible, ["project"], order, "priority_rank").join(lookup(sizes), "project")
        .withColumn("risk_tier", F.when(place <= critical, "CRITICAL").when(place <= high, "HIGH")
                    .otherwise("MEDIUM")).drop("_h"))
    low = rows.where(F.col("predicted_risk") < cutoff).withColumns({
        "priority_rank": F.lit(None).cast("long"), "risk_tier": F.lit("LOW")})
    return ranked_rows.unionByName(low)


def tier_counts(tiered: DataFrame) -> DataFrame:
    """Rows per project and tier; tiers without rows count zero."""
    return tiered.groupBy("project").pivot("risk_tier", RISK_TIERS).count().fillna(0, RISK_TIERS)


def dominant_signal(drivers: Column, registry=REGISTRY) -> Column:
    """The strongest supported risk driver of a sample, or null."""
    return strongest(drivers, lambda d: supported(d["feature"], registry) & (d["contribution"] > 0))


def sample_evidence(samples: DataFrame, wanted: DataFrame, registry=REGISTRY) -> DataFrame:
    """One row per (project, file, date) of ``wanted``: dominant driver and first guidance.

    The semi join, the aggregation and the later join share one partitioning by that key, and
    guidance is only computed for rows that end up in the queue.
    """
    keyed = normalize(samples).withColumnRenamed("file_path", "identifier").withColumn(
        "snapshot_date", blank(F.col("snapshot_date"))).join(wanted.select(*SAMPLE), SAMPLE, "left_semi")
    total = total_magnitude(F.col("drivers"))
    d = F.col("_dominant")
    rows = with_guidance(keyed, registry).withColumn("_dominant", dominant_signal(F.col("drivers"), registry)).select(
        *SAMPLE, sample_id(*map(F.col, SAMPLE)).alias("_sample"),
        F.when(d.isNotNull(), F.struct(
            d["feature"].alias("feature"), d["feature_value"].alias("feature_value"),
            d["contribution"].alias("contribution"),
            ratio_or_zero(F.abs(d["contribution"]), total).alias("normalized_contribution"),
            "explanation_method", "contribution_space")).alias("dominant"),
        F.col("primary_risk_reason").alias("_reason"), F.col("recommended_action").alias("_action"))
    by_strength = F.when(F.col("dominant").isNotNull(), F.struct(
        -F.abs("dominant.contribution"), F.col("dominant.feature"), -F.col("dominant.contribution")))
    return rows.where((F.col("identifier") != "") & (F.col("snapshot_date") != "")).groupBy(*SAMPLE).agg(
        F.min_by("dominant", by_strength).alias("dominant"),
        F.min_by(F.struct("_reason", "_action"), F.struct("_sample", "_reason")).alias("_guide"))


def evidence_json(cutoff: float) -> Column:
    """Supporting evidence as JSON with sorted keys; unknown parts are left out."""
    d = F.col("dominant")
    return F.to_json(F.struct(
        d["contribution"].alias("contribution"), d["contribution_space"].alias("contribution_space"),
        d["feature"].alias("dominant_signal"), d["explanation_method"].alias("explanation_method"),
        d["feature_value"].alias("feature_value"),
        d["normalized_contribution"].alias("normalized_contribution"),
        F.col("recurring_high_risk_count"), F.col("recurring_high_risk_rate"),
        F.col("predicted_risk").alias("risk_score"), F.col("risk_signal_count"),
        F.lit(float(cutoff)).alias("risk_threshold")))


def action_queue(tiered: DataFrame, samples: DataFrame, cutoff: float = DEFAULT_CUTOFF,
                 registry=REGISTRY) -> DataFrame:
    """All tiered rows at or above the cutoff with their evidence.

    Rows without identifier or date match nothing: evidence only exists for complete keys.
    """
    actions = tiered.where(F.col("priority_rank").isNotNull())
    rows = actions.join(sample_evidence(samples, actions, registry), SAMPLE, "left")

    def text(*choices: Column) -> Column:
        return F.coalesce(*[F.nullif(blank(c), F.lit("")) for c in choices])

    identifier = F.nullif("identifier", F.lit(""))
    return rows.withColumn("supporting_evidence", evidence_json(cutoff)).select(
        F.nullif("project", F.lit("")).alias("project"), "priority_rank", "risk_tier",
        identifier.alias("identifier"), identifier.alias("file_path"),
        F.nullif("snapshot_date", F.lit("")).alias("snapshot_date"), "predicted_risk", "priority_score",
        text(F.col("_guide._reason"), F.col("primary_risk_reason")).alias("short_reason"),
        F.col("dominant.feature").alias("dominant_signal"),
        text(F.col("_guide._action"), F.col("recommended_action")).alias("recommended_action"),
        "supporting_evidence").select(*ACTION_COLUMNS)


def top_actions(actions: DataFrame, top: int = 5) -> DataFrame:
    return actions.where(F.col("priority_rank") <= top)


def models_used(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("project", blank(F.col("project"))).groupBy("project").agg(
        F.sort_array(F.collect_set("model")).alias("models_used"))


def executive_summary(ranking: DataFrame, samples: DataFrame, tiered: DataFrame,
                      cutoff: float = DEFAULT_CUTOFF, registry=REGISTRY) -> DataFrame:
    """One row per project; every joined table has one row per project as well."""
    summary = project_summary(ranking, cutoff)
    shares = risk_concentration(ranking)
    hot = top_hotspot(ranking, samples, cutoff, registry).select(
        "project", F.col("identifier").alias("top_hotspot"),
        F.col("high_risk_count").alias("top_hotspot_high_risk_count"),
        F.col("high_risk_rate").alias("top_hotspot_high_risk_rate"),
        F.col("mean_risk").alias("top_hotspot_mean_risk"),
        F.col("signal").alias("top_hotspot_signal"))
    signal = signal_profile(samples, registry).where(
        "direction = 'increases_risk' and strength_position = 1").select(
        "project", F.col("feature").alias("highest_risk_signal"),
        F.col("category").alias("highest_risk_signal_category"),
        F.col("occurrence_count").alias("highest_risk_signal_occurrences"),
        F.col("aggregate_contribution").alias("highest_risk_signal_contribution"))
    direction = trend_direction(monthly_trend(ranking, samples, cutoff, registry))
    rows = summary.join(shares, "project")
    for part in (hot, signal, direction, tier_counts(tiered), models_used(ranking)):
        rows = rows.join(part, "project", "left")
    high, total = F.col("high_risk_sample_count"), F.col("total_evaluated_samples")
    items = F.col("CRITICAL") + F.col("HIGH") + F.col("MEDIUM")
    return rows.select(
        "project", total.alias("total_samples"), high.alias("high_risk_count"),
        ratio_or_zero(high, total).alias("high_risk_rate"),
        F.col("mean_predicted_risk").alias("mean_risk"),
        "top_10_percent_risk_share", "top_20_percent_risk_share", "samples_for_half_of_risk",
        "top_hotspot", "top_hotspot_high_risk_count", "top_hotspot_high_risk_rate",
        "top_hotspot_mean_risk", "top_hotspot_signal",
        F.coalesce("direction", F.lit("not_available")).alias("temporal_direction"),
        "highest_risk_signal", "highest_risk_signal_category", "highest_risk_signal_occurrences",
        "highest_risk_signal_contribution",
        items.alias("number_of_priority_items"),
        attention_level(high, total).alias("overall_attention_level"),
        *[F.col(t).alias(f"tier_{t.lower()}") for t in RISK_TIERS], "models_used")
