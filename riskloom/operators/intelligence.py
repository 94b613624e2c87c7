"""Per-project risk intelligence.

Every table is keyed by project and computed for all projects at once. Nothing puts a project in
one task: distributions and concentration work on counts per distinct score, file statistics
on counts per file, and the queue rank on an ordered scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.labels import percentage, ratio, risk_band, sign_word
from riskloom.functions.registry import (
    MISSING_ACTION, MISSING_REASON, REGISTRY, supported, text_of,
)
from riskloom.functions.text import blank, utc_timestamp
from riskloom.operators.explain import driver_rows
from riskloom.operators.radix import quantiles
from riskloom.operators.scan import lookup, ranked, running
from riskloom.schemas import (
    DEFAULT_CUTOFF, PRIORITY_COLUMNS, PRIORITY_HOTSPOT_WEIGHT, PRIORITY_RISK_WEIGHT,
    RISK_BAND_EDGES,
)

FILE = ["project", "file_path"]


def normalize(df: DataFrame) -> DataFrame:
    """Projects and paths as trimmed text, the empty string when unknown."""
    return df.withColumns({"project": blank(F.col("project")), "file_path": blank(F.col("file_path"))})


def file_counts(ranking: DataFrame, cutoff: float) -> DataFrame:
    """Additive totals per (project, file), including the unnamed file."""
    score = F.col("risk_score")
    return normalize(ranking).groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(score >= cutoff).alias("high_risk_count"),
        F.sum(score).alias("aggregate_predicted_risk"), F.max(score).alias("max_risk"))


def entity_statistics(ranking: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """Per named file: observations, high-risk count and rate, mean, maximum and total risk."""
    return file_counts(ranking, cutoff).where("file_path != ''").select(
        "project", F.col("file_path").alias("identifier"), "observation_count", "high_risk_count",
        ratio(F.col("high_risk_count"), F.col("observation_count")).alias("high_risk_rate"),
        (F.col("aggregate_predicted_risk") / F.col("observation_count")).alias("mean_risk"),
        "max_risk", "aggregate_predicted_risk")


def project_summary(ranking: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    named = F.col("file_path") != ""
    totals = file_counts(ranking, cutoff).groupBy("project").agg(
        F.sum("observation_count").alias("total_evaluated_samples"),
        F.sum("high_risk_count").alias("high_risk_sample_count"),
        F.sum("aggregate_predicted_risk").alias("_mass"),
        F.max("max_risk").alias("maximum_predicted_risk"),
        F.count_if(named & (F.col("high_risk_count") > 0)).alias("unique_risky_entities"),
        F.sum(F.when(named, F.col("observation_count")).otherwise(0)).alias("_named"))
    medians = quantiles(normalize(ranking), ["project"], "risk_score", {"median_predicted_risk": 0.5})
    n = F.col("total_evaluated_samples")
    return totals.join(medians, "project").select(
        "project", "total_evaluated_samples", "high_risk_sample_count",
        percentage(F.col("high_risk_sample_count"), n).alias("high_risk_percentage"),
        (F.col("_mass") / n).alias("mean_predicted_risk"), "median_predicted_risk",
        "maximum_predicted_risk", "unique_risky_entities",
        percentage(F.col("_named"), n).alias("identifier_coverage_percentage"))


def risk_bands(ranking: DataFrame) -> DataFrame:
    """Five-band histogram per project; empty bands are kept, the last band is closed."""
    band = risk_band(F.col("risk_score"))
    bands = list(zip(RISK_BAND_EDGES, RISK_BAND_EDGES[1:]))
    last = len(bands) - 1
    counts = normalize(ranking).groupBy("project").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(band == i).alias(f"b{i}") for i in range(len(bands))])
    rows = F.array(*[
        F.struct(F.lit(f"[{lo:.1f}, {hi:.1f}{']' if i == last else ')'}").alias("risk_range"),
                 F.lit(lo).alias("minimum"), F.lit(hi).alias("maximum"),
                 F.lit(i == last).alias("inclusive_maximum"), F.col(f"b{i}").alias("sample_count"),
                 percentage(F.col(f"b{i}"), F.col("_n")).alias("percentage_of_samples"))
        for i, (lo, hi) in enumerate(bands)])
    return counts.select("project", F.inline(rows))


def risk_concentration(ranking: DataFrame) -> DataFrame:
    """Share of the predicted risk held by the top rows, per project."""
    counts = normalize(ranking).groupBy("project", "risk_score").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("mass", F.col("n") * F.col("risk_score"))
    totals = counts.groupBy("project").agg(F.sum("n").alias("_n"), F.sum("mass").alias("_mass"))
    scan = running(counts, ["project"], [F.desc("risk_score")], ["n", "mass"]).join(
        lookup(totals), "project")
    before, score = F.col("running_n") - F.col("n"), F.col("risk_score")
    half = F.col("_mass") * 0.5

    def top(fraction: float) -> Column:
        rows = F.ceil(F.col("_n") * F.lit(fraction)).cast("long")
        return F.greatest(F.least(rows - before, F.col("n")), F.lit(0)) * score

    reach = F.when(F.col("running_mass") >= half, before + F.greatest(
        F.ceil(F.try_divide(half - (F.col("running_mass") - F.col("mass")), score)), F.lit(1)))
    out = scan.groupBy("project").agg(
        F.max("_mass").alias("aggregate_predicted_risk"), F.max("_n").alias("_n"),
        F.sum(top(0.1)).alias("_top10"), F.sum(top(0.2)).alias("_top20"), F.min(reach).alias("_half"))
    total = F.col("aggregate_predicted_risk")
    return out.select(
        "project", "aggregate_predicted_risk",
        F.ceil(F.col("_n") * F.lit(0.1)).cast("long").alias("top_10_percent_sample_count"),
        percentage(F.col("_top10"), total).alias("top_10_percent_risk_share"),
        F.ceil(F.col("_n") * F.lit(0.2)).cast("long").alias("top_20_percent_sample_count"),
        percentage(F.col("_top20"), total).alias("top_20_percent_risk_share"),
        F.when(total > 0, F.col("_half")).otherwise(0).cast("long").alias("samples_for_half_of_risk"))


def repeated_concentration(ranking: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """How much of the risk sits in files with at least two high-risk observations."""
    named = F.col("file_path") != ""
    repeated = named & (F.col("high_risk_count") >= 2)
    sums = file_counts(ranking, cutoff).groupBy("project").agg(
        F.count_if(repeated).alias("repeated_high_risk_entity_count"),
        F.sum(F.when(repeated, F.col("aggregate_predicted_risk")).otherwise(0.0)).alias("_mass"),
        F.sum("aggregate_predicted_risk").alias("_all_mass"),
        F.sum(F.when(repeated, F.col("high_risk_count")).otherwise(0)).alias("_high"),
        F.sum(F.when(named, F.col("high_risk_count")).otherwise(0)).alias("_all_high"))
    return sums.select(
        "project", "repeated_high_risk_entity_count",
        percentage(F.col("_mass"), F.col("_all_mass")).alias("repeated_entity_risk_percentage"),
        percentage(F.col("_high"), F.col("_all_high")).alias("repeated_entity_high_risk_percentage"))


def signal_records(samples: DataFrame, keys: Sequence[str], registry=REGISTRY) -> DataFrame:
    """Occurrences and contribution totals per (keys, direction, supported feature).

    A sample lists a feature at most once, so counting rows counts distinct samples and the
    aggregation combines on the map side.
    """
    x = F.col("x.contribution")
    return (
        driver_rows(samples, *keys, "explanation_method", "contribution_space").withColumnRenamed("_x", "x")
        .where(supported(F.col("x.feature"), registry) & (x != 0) & ~F.isnan(x)
               & (F.abs(x) != F.lit(float("inf"))))
        .groupBy(*keys, F.when(x > 0, "increases_risk").otherwise("decreases_risk").alias("direction"),
                 F.col("x.feature").alias("feature"))
        .agg(F.count(F.lit(1)).alias("occurrence_count"),
             F.sum(x).alias("aggregate_contribution"), F.avg(x).alias("mean_contribution"),
             F.sort_array(F.collect_set("contribution_space")).alias("contribution_spaces"),
             F.sort_array(F.collect_set("explanation_method")).alias("explanation_methods"))
        .withColumn("category", text_of(F.col("feature"), "category", registry))
    )


def _steady(total: str) -> Column:
    """A sum to nine places: orders must not depend on the order in which it was added up."""
    return F.round(F.col(total), 9)


def _common_first() -> list[Column]:
    return [F.desc("occurrence_count"), F.desc(F.abs(_steady("aggregate_contribution"))), F.asc("feature")]


def signal_profile(samples: DataFrame, registry=REGISTRY) -> DataFrame:
    """Signals of every project with their place among the most common and the strongest."""
    samples = normalize(samples)
    totals = samples.groupBy("project").agg(F.count(F.lit(1)).alias("_n"))
    # A project has at most one row per direction and predictor here.
    group = Window.partitionBy("project", "direction")
    total = _steady("aggregate_contribution")
    signed = F.when(F.col("direction") == "increases_risk", -total).otherwise(total)
    return (
        signal_records(samples, ["project"], registry).join(lookup(totals), "project")
        .withColumns({
            "percentage_of_samples": percentage(F.col("occurrence_count"), F.col("_n")),
            "common_position": F.row_number().over(group.orderBy(*_common_first())).cast("long"),
            "strength_position": F.row_number().over(
                group.orderBy(signed.asc(), F.asc("feature"))).cast("long")})
        .drop("_n")
    )


def top_signals(samples: DataFrame, keys: Sequence[str], top: int = 3, registry=REGISTRY) -> DataFrame:
    """The most common risk signals per key as an array, at most one entry per predictor."""
    risk = signal_records(samples, keys, registry).where("direction = 'increases_risk'")
    entry = F.struct(
        (-F.col("occurrence_count")).alias("a"), (-F.abs(_steady("aggregate_contribution"))).alias("b"),
        F.col("feature").alias("feature"), F.col("category").alias("category"),
        F.col("occurrence_count").alias("occurrence_count"),
        F.col("aggregate_contribution").alias("aggregate_contribution"))
    ordered = F.slice(F.array_sort(F.collect_list(entry)), 1, top)
    return risk.groupBy(*keys).agg(ordered.alias("_s")).select(*keys, F.transform("_s", lambda s: F.struct(
        s["feature"].alias("feature"), s["category"].alias("category"),
        s["occurrence_count"].alias("occurrence_count"),
        s["aggregate_contribution"].alias("aggregate_contribution"))).alias("signals"))


def _signals_of(samples: DataFrame, files: DataFrame, registry) -> DataFrame:
    """Dominant signals of the given files (project, identifier); contributions of others are not exploded."""
    wanted = files.select("project", F.col("identifier").alias("file_path"))
    mine = normalize(samples).join(wanted, FILE, "left_semi")
    return top_signals(mine, FILE, 3, registry).withColumnRenamed("file_path", "identifier")


def top_hotspot(ranking: DataFrame, samples: DataFrame, cutoff: float = DEFAULT_CUTOFF, registry=REGISTRY) -> DataFrame:
    """The first hotspot of every project with its first signal, without ranking the others."""
    hot = entity_statistics(ranking, cutoff).where("high_risk_count >= 2")
    place = F.struct(-F.col("high_risk_count"), -F.col("high_risk_rate"), -F.round("mean_risk", 12), -F.col("max_risk"),
                     F.col("identifier"))
    first = hot.groupBy("project").agg(F.min_by(F.struct(
        "identifier", "high_risk_count", "high_risk_rate", "mean_risk"), place).alias("h")).select("project", "h.*")
    first = lookup(first)
    return first.join(_signals_of(samples, first, registry), ["project", "identifier"], "left").withColumn(
        "signal", F.try_element_at("signals", F.lit(1))["feature"]).drop("signals")


def hotspots(ranking: DataFrame, samples: DataFrame, cutoff: float = DEFAULT_CUTOFF,
             registry=REGISTRY) -> DataFrame:
    """Files with at least two high-risk observations, with dominant signals and actions.

    ``hotspot_rank`` orders the hotspots of a project: count, rate, mean, maximum, identifier.
    The mean is compared to twelve places, so the order does not depend on the order of a sum.
    """
    hot = lookup(entity_statistics(ranking, cutoff).where("high_risk_count >= 2"))
    signals = _signals_of(samples, hot, registry)
    rows = hot.join(signals, ["project", "identifier"], "left").withColumns({
        "dominant_risk_signals": F.coalesce("signals", F.array().cast(
            "array<struct<feature:string,category:string,occurrence_count:bigint,aggregate_contribution:double>>")),
    }).drop("signals")
    rows = rows.withColumn("recommended_inspection_actions", F.transform(
        "dominant_risk_signals", lambda s: text_of(s["feature"], "risk_action", registry)))
    order = [F.desc("high_risk_count"), F.desc("high_risk_rate"), F.desc(F.round("mean_risk", 12)),
             F.desc("max_risk"), F.asc("identifier")]
    return ranked(rows, ["project"], order, "hotspot_rank")


def monthly_trend(ranking: DataFrame, samples: DataFrame, cutoff: float = DEFAULT_CUTOFF,
                  registry=REGISTRY) -> DataFrame:
    """Risk per calendar month; projects with an unreadable date are left out as unsupported."""
    def month(df: DataFrame) -> DataFrame:
        return normalize(df).withColumn("period", F.date_format(
            utc_timestamp(F.col("snapshot_date").cast("string")), "yyyy-MM"))

    score = F.col("risk_score")
    months = month(ranking).groupBy("project", "period").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg(score).alias("mean_risk"),
        F.count_if(score >= cutoff).alias("high_risk_count"))
    signals = top_signals(month(samples).where("period is not null"), ["project", "period"], 1, registry)
    first = F.try_element_at("signals", F.lit(1))
    # One row per month: a project window holds as many rows as the calendar has months.
    whole = Window.partitionBy("project")
    return (
        months.withColumn("_bad", F.bool_or(F.col("period").isNull()).over(whole)).where(~F.col("_bad"))
        .join(signals, ["project", "period"], "left")
        .select(
            "project", "period", "sample_count", "mean_risk", "high_risk_count",
            ratio(F.col("high_risk_count"), F.col("sample_count")).alias("high_risk_rate"),
            first["feature"].alias("dominant_risk_signal"),
            first["category"].alias("dominant_risk_signal_category"),
            (F.col("mean_risk") - F.lag("mean_risk").over(whole.orderBy("period")))
            .alias("change_in_mean_risk"))
    )


def trend_direction(trend: DataFrame) -> DataFrame:
    """Sign of the last minus the first monthly mean; one month alone says nothing."""
    change = F.max_by("mean_risk", "period") - F.min_by("mean_risk", "period")
    return trend.groupBy("project").agg(
        F.when(F.count(F.lit(1)) < 2, "not_available")
        .otherwise(sign_word(change, "increasing", "decreasing", "stable")).alias("direction"))


def priority_queue(ranking: DataFrame, cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """Every sample with its inspection priority; the rank restarts in each project.

    File statistics are aggregated first and joined back; rows without a path carry no recurrence
    evidence.
    """
    stats = entity_statistics(ranking, cutoff).select(
        "project", F.col("identifier").alias("file_path"),
        F.col("high_risk_count").alias("_count"), F.col("high_risk_rate").alias("_rate"))
    rows = normalize(ranking).join(stats, FILE, "left").withColumns({
        "recurring_high_risk_count": F.coalesce("_count", F.lit(0).cast("long")),
        "recurring_high_risk_rate": F.coalesce("_rate", F.lit(0.0))})
    evidence = F.col("recurring_high_risk_rate") * F.least(
        F.col("recurring_high_risk_count") / F.lit(2.0), F.lit(1.0))
    rows = rows.select(
        "project", F.col("file_path").alias("identifier"),
        F.coalesce(F.col("snapshot_date").cast("string"), F.lit("")).alias("snapshot_date"),
        F.col("risk_score").alias("predicted_risk"),
        F.coalesce("primary_risk_reason", F.lit(MISSING_REASON)).alias("primary_risk_reason"),
        F.coalesce("recommended_action", F.lit(MISSING_ACTION)).alias("recommended_action"),
        F.coalesce("risk_signal_count", F.lit(0)).cast("long").alias("risk_signal_count"),
        "recurring_high_risk_count", "recurring_high_risk_rate",
        evidence.alias("recurring_hotspot_evidence"),
        (F.lit(PRIORITY_RISK_WEIGHT) * F.col("risk_score")
         + F.lit(PRIORITY_HOTSPOT_WEIGHT) * evidence).alias("priority_score"), "model")
    order = [F.desc("priority_score"), F.desc("predicted_risk"), F.desc("recurring_high_risk_count"),
             F.asc("identifier"), F.asc("snapshot_date"), F.asc("model")]
    return ranked(rows, ["project"], order).select(*PRIORITY_COLUMNS)


def top_priorities(queue: DataFrame, top: int = 5) -> DataFrame:
    """The first rows of every project's queue."""
    return queue.where(F.col("rank") <= top)


def unsupported_analyses(ranking: DataFrame, samples: DataFrame) -> DataFrame:
    """Per project: which analyses lack dates, identifiers or signals."""
    dates = utc_timestamp(F.col("snapshot_date").cast("string"))
    facts = normalize(ranking).groupBy("project").agg(
        F.bool_or(dates.isNull()).alias("temporal_unsupported"),
        F.bool_and(F.col("file_path") == "").alias("hotspots_unsupported"))
    signals = normalize(samples).select("project", F.explode("drivers.feature").alias("feature")).where(
        supported(F.col("feature"))).select("project").distinct().withColumn("_has", F.lit(True))
    return facts.join(signals, "project", "left").select(
        "project", "temporal_unsupported", "hotspots_unsupported",
        F.col("_has").isNull().alias("signals_unsupported"))


def scope(ranking: DataFrame, cross_project: bool) -> str:
    """'per_project' for cross-project runs or several named projects, else 'single_project'."""
    if cross_project:
        return "per_project"
    names = normalize(ranking).where("project != ''").select("project").distinct().limit(2).count()
    return "per_project" if names > 1 else "single_project"

