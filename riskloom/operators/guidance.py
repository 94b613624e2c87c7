"""Developer-facing guidance from local contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.labels import direction, predicted, ratio_or_zero
from riskloom.functions.registry import (
    MISSING_ACTION, MISSING_REASON, NEUTRAL_ACTION, NEUTRAL_REASON, NO_RISK_REASON, REGISTRY,
    supported, text_of,
)
from riskloom.functions.text import sample_id
from riskloom.operators.explain import driver_rows, place, plain, total_magnitude
from riskloom.schemas import SAMPLE_KEYS

MAX_INSIGHTS = 3


def _known(drivers: Column, registry) -> Column:
    """Supported drivers in rank order, each with its rank among all drivers."""
    placed = F.transform(drivers, lambda d, i: F.struct(
        d["feature"].alias("feature"), d["feature_value"].alias("feature_value"),
        d["contribution"].alias("contribution"), (i + 1).cast("long").alias("feature_rank")))
    return F.filter(placed, lambda d: supported(d["feature"], registry))


def with_guidance_facts(samples: DataFrame, registry=REGISTRY) -> DataFrame:
    """Add ``_g``: strongest supported features and signal counts."""
    return guidance_facts_of(plain(samples), registry).drop("_c", "_f")


def guidance_facts_of(rows: DataFrame, registry=REGISTRY) -> DataFrame:
    """``_g`` on rows of ``plain``. Foreign features are found once a sample; where there are none, nothing is looked up."""
    named = F.array_compact("_foreign")  # a driver without a name is not supported either
    sides = rows.withColumn("_foreign", F.array_except("_f", F.array(*map(F.lit, registry)))).withColumns({
        "_kc": F.when(F.size("_foreign") > 0, F.filter("_c", lambda x, i: ~F.array_contains(named, F.get("_f", i)))).otherwise(F.col("_c")),
        "_kf": F.when(F.size("_foreign") > 0, F.filter("_f", lambda f: ~F.array_contains(named, f))).otherwise(F.col("_f"))}).withColumns({
            "_ups": F.filter("_kc", lambda x: x > 0), "_downs": F.filter("_kc", lambda x: x < 0)})

    def first(side: str) -> Column:
        return F.try_element_at("_kf", place(F.col("_kc"), F.get(side, F.lit(0))))

    return sides.withColumn("_g", F.when(F.col("_f").isNotNull(), F.struct(
        first("_ups").alias("up"), first("_downs").alias("down"),
        F.size("_ups").cast("long").alias("ups"), F.size("_downs").cast("long").alias("downs")))).drop(
        "_foreign", "_kc", "_kf", "_ups", "_downs")


def with_guidance_texts(facts: DataFrame, registry=REGISTRY) -> DataFrame:
    """Replace ``_g`` by reason, action and signal counts."""
    up, down = F.col("_g.up"), F.col("_g.down")
    return facts.withColumns({
        "primary_risk_reason": F.when(up.isNotNull(), text_of(up, "risk_reason", registry))
        .when(down.isNotNull(), NO_RISK_REASON).otherwise(NEUTRAL_REASON),
        "recommended_action": F.when(up.isNotNull(), text_of(up, "risk_action", registry))
        .when(down.isNotNull(), text_of(down, "protective_action", registry)).otherwise(NEUTRAL_ACTION),
        "risk_signal_count": F.col("_g.ups"), "protective_signal_count": F.col("_g.downs"),
    }).drop("_g")


def with_guidance(samples: DataFrame, registry=REGISTRY) -> DataFrame:
    """Add reason, action and signal counts of every sample."""
    return with_guidance_texts(with_guidance_facts(samples, registry), registry)


def top_insights(drivers: Column, max_insights: int = MAX_INSIGHTS, registry=REGISTRY) -> Column:
    """The strongest supported, non-neutral drivers as insight structs."""
    if max_insights <= 0:
        raise ValueError("max_insights must be positive.")
    total = total_magnitude(drivers)

    def insight(d: Column) -> Column:
        is_risk = d["contribution"] > 0

        def pick(risk_field: str, protective_field: str) -> Column:
            return F.when(is_risk, text_of(d["feature"], risk_field, registry)).otherwise(
                text_of(d["feature"], protective_field, registry))

        return F.struct(
            d["feature"].alias("feature"),
            text_of(d["feature"], "category", registry).alias("category"),
            F.when(is_risk, "risk").otherwise("protective").alias("signal_type"),
            pick("risk_reason", "protective_reason").alias("interpretation"),
            pick("risk_action", "protective_action").alias("recommended_action"),
            d["feature_value"].alias("feature_value"),
            d["contribution"].alias("contribution"),
            ratio_or_zero(F.abs(d["contribution"]), total).alias("normalized_contribution"),
            d["feature_rank"].alias("feature_rank"))

    moving = F.filter(_known(drivers, registry), lambda d: d["contribution"] != 0)
    return F.transform(F.slice(moving, 1, max_insights), insight)


def build_insights(samples: DataFrame, max_insights: int = MAX_INSIGHTS,
                   registry=REGISTRY) -> DataFrame:
    """One row per sample with its reason, action, counts and nested insights."""
    label = (F.col("predicted_label") if "predicted_label" in samples.columns
             else predicted(F.col("risk_score"), F.col("decision_threshold")))
    return with_guidance(samples, registry).select(
        sample_id(F.col("project"), F.col("file_path"), F.col("snapshot_date")).alias("sample_id"),
        *SAMPLE_KEYS, "risk_score", label.alias("predicted_label"), "true_label",
        "primary_risk_reason", "recommended_action", "risk_signal_count", "protective_signal_count",
        top_insights(F.col("drivers"), max_insights, registry).alias("insights"))


def insight_totals(insights: DataFrame) -> DataFrame:
    return insights.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("risk_signal_count") > 0).alias("samples_with_risk_signals"),
        F.count_if(F.col("protective_signal_count") > 0).alias("samples_with_protective_signals"),
        F.sum("risk_signal_count").alias("total_risk_signals"),
        F.sum("protective_signal_count").alias("total_protective_signals"))


def common_signals(samples: DataFrame, limit: int = 10, registry=REGISTRY) -> DataFrame:
    """Most frequent supported features per signal type, by number of samples."""
    rows = driver_rows(samples).withColumnRenamed("_x", "x").where(
        supported(F.col("x.feature"), registry) & (F.col("x.contribution") != 0))
    counts = rows.groupBy(
        F.when(F.col("x.contribution") > 0, "risk").otherwise("protective").alias("signal_type"),
        F.col("x.feature").alias("feature")).agg(F.count(F.lit(1)).alias("sample_count"))
    order = Window.partitionBy("signal_type").orderBy(F.desc("sample_count"), "feature")
    reason = F.when(F.col("signal_type") == "risk", text_of(F.col("feature"), "risk_reason", registry)
                    ).otherwise(text_of(F.col("feature"), "protective_reason", registry))
    return counts.withColumns({
        "position": F.row_number().over(order).cast("long"),
        "category": text_of(F.col("feature"), "category", registry),
        "interpretation": reason}).where(F.col("position") <= limit)


def unsupported_features(samples: DataFrame, registry=REGISTRY) -> DataFrame:
    features = samples.select(F.explode("drivers.feature").alias("feature"))
    return features.where(~supported(F.col("feature"), registry)).distinct()


def sign_violations(explanations: DataFrame) -> DataFrame:
    """Rows of a long table whose direction does not match the sign of the contribution."""
    return explanations.where(F.col("direction") != direction(F.col("contribution")))


def enrich_ranking(ranking: DataFrame, insights: DataFrame) -> DataFrame:
    """Attach reason, action and signal count; samples without insights get fixed texts."""
    names = ["primary_risk_reason", "recommended_action", "risk_signal_count"]
    fallback = dict(zip(names, (F.lit(MISSING_REASON), F.lit(MISSING_ACTION), F.lit(0).cast("long"))))
    joined = ranking.drop(*names).join(insights.select(*SAMPLE_KEYS, *names), SAMPLE_KEYS, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), fallback[n]) for n in names})
