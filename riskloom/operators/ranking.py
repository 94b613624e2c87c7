"""Risk ranking of scored samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import predicted
from riskloom.operators.explain import DRIVER_COLUMNS, canonical_order, plain, top_drivers_of
from riskloom.operators.guidance import guidance_facts_of, with_guidance_texts
from riskloom.operators.quality import require, score_report
from riskloom.operators.scan import ranked
from riskloom.schemas import DEFAULT_CUTOFF, RANKING_COLUMNS, TOP_RISK
from riskloom.staging import stage


def build_ranking(samples: DataFrame, check: bool = True) -> DataFrame:
    """Global rank by score, then project, file, date and model, with drivers and guidance.

    A range shuffle evaluates its input twice (once to sample the keys). So the driver arrays are
    reduced to a few stored columns first, and the texts follow after the rank is known. Samples that carry the
    columns of ``linear_facts`` are ranked as they are: these cost less than storing them.
    """
    if check:
        require(score_report(samples))
    given = [c for c in RANKING_COLUMNS if c in samples.columns and c not in ("predicted_label", *DRIVER_COLUMNS)]
    facts = [*given, *DRIVER_COLUMNS, "_g"]
    if set(facts) <= set(samples.columns):
        rows = with_guidance_texts(ranked(samples.select(*facts), [], canonical_order()))
    elif "drivers" in samples.columns:
        taken = guidance_facts_of(top_drivers_of(plain(samples).select(*given, "_c", "_f"))).select(*facts)
        rows = with_guidance_texts(ranked(stage(taken, "facts"), [], canonical_order()))
    else:
        rows = ranked(samples.select(*given), [], canonical_order()).withColumns({
            "top_risk_feature": F.lit(None).cast("string"),
            "top_risk_contribution": F.lit(None).cast("double"),
            "top_protective_feature": F.lit(None).cast("string"),
            "top_protective_contribution": F.lit(None).cast("double"),
            "primary_risk_reason": F.lit(None).cast("string"),
            "recommended_action": F.lit(None).cast("string"),
            "risk_signal_count": F.lit(0).cast("long")})
    return rows.withColumn(
        "predicted_label", predicted(F.col("risk_score"), F.col("decision_threshold"))
    ).select(*RANKING_COLUMNS)


def risk_summary(ranking: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """One row: counts, mean, maximum and the models, methods and thresholds in use."""
    return ranking.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("risk_score") >= cutoff).alias("high_risk_sample_count"),
        F.lit(float(cutoff)).alias("risk_threshold"),
        F.avg("risk_score").alias("mean_risk_score"),
        F.max("risk_score").alias("max_risk_score"),
        F.sort_array(F.collect_set("model")).alias("models_used"),
        F.sort_array(F.collect_set("score_method")).alias("score_methods"),
        F.sort_array(F.collect_set("decision_threshold")).alias("decision_thresholds"))


def top_high_risk(ranking: DataFrame, cutoff: float = DEFAULT_CUTOFF, top: int = TOP_RISK) -> DataFrame:
    if top <= 0:
        raise ValueError("top must be positive.")
    return (
        ranking.where(F.col("risk_score") >= cutoff).orderBy("rank").limit(top)
        .select("rank", "risk_score", "predicted_label", "true_label", "project", "file_path",
                "snapshot_date", "model", "score_method")
    )
