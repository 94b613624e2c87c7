import math

import pytest
from pyspark.sql import functions as F

from support import DRIVERS, OBSERVATIONS, samples_frame
from riskloom.functions.registry import NEUTRAL_REASON, NO_RISK_REASON, REGISTRY
from riskloom.operators import brief, calibration, diagnostics, explain, guidance, intelligence, ranking
from riskloom.staging import stage


@pytest.fixture(scope="module")
def samples(spark):
    return stage(samples_frame(spark))


@pytest.fixture(scope="module")
def rows(samples):
    return stage(ranking.build_ranking(samples))


@pytest.fixture(scope="module")
def queue(rows):
    return stage(intelligence.priority_queue(rows))


def test_ranking_order_and_texts(rows):
    got = rows.orderBy("rank").collect()
    assert [r["risk_score"] for r in got] == [.91, .84, .78, .65, .55, .20, .05]
    assert [r["rank"] for r in got] == list(range(1, 8))
    assert got[0]["top_risk_feature"] == "code_churn" and got[0]["top_protective_feature"] == "file_age_days"
    assert got[0]["primary_risk_reason"] == REGISTRY["code_churn"].risk_reason
    assert got[6]["primary_risk_reason"] == NO_RISK_REASON
    assert got[6]["recommended_action"] == REGISTRY["lines_deleted"].protective_action


def test_ranking_rejects_bad_scores(samples):
    with pytest.raises(ValueError, match="unit_interval"):
        ranking.build_ranking(samples.withColumn("risk_score", F.lit(1.2)))


def test_row_order_does_not_matter(samples, rows):
    again = ranking.build_ranking(samples.orderBy(F.rand(3)).repartition(3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_long_form(samples):
    long = explain.to_long(samples)
    sums = long.groupBy("sample_id").agg(F.sum("normalized_contribution").alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0) for r in sums)
    top = explain.limit_explanations(long, 1)
    assert top.count() == 7 and top.agg(F.min("normalized_contribution")).first()[0] == 1.0
    back = explain.from_long(long)
    assert back.count() == 7 and sorted(map(str, back.select("drivers").collect())) == sorted(
        map(str, samples.select("drivers").collect()))
    assert guidance.sign_violations(long).count() == 0


def test_zero_vectors_normalize_to_zero(samples):
    zero = samples.withColumn("drivers", F.lit(None).cast(DRIVERS)).withColumn("drivers", F.array(F.struct(
        F.lit(0.0).alias("k"), F.lit("code_churn").alias("feature"), F.lit(1.0).alias("feature_value"),
        F.lit(1.0).alias("model_input_value"), F.lit(0.0).alias("contribution"))))
    row = explain.to_long(zero).first()
    assert (row["normalized_contribution"], row["direction"]) == (0.0, "neutral")
    assert guidance.build_insights(zero).first()["primary_risk_reason"] == NEUTRAL_REASON


def test_unsupported_features(samples):
    odd = samples.withColumn("drivers", F.transform("drivers", lambda d: d.withField("feature", F.lit("mystery"))))
    assert [r[0] for r in guidance.unsupported_features(odd).collect()] == ["mystery"]
    assert guidance.build_insights(odd).first()["risk_signal_count"] == 0


def test_project_summary_and_hotspots(rows, samples):
    s = intelligence.project_summary(rows).first()
    assert (s["high_risk_sample_count"], s["unique_risky_entities"], s["total_evaluated_samples"]) == (5, 3, 7)
    assert s["median_predicted_risk"] == pytest.approx(.65)
    hot = intelligence.hotspots(rows, samples).orderBy("hotspot_rank").collect()
    assert [h["identifier"] for h in hot] == ["lib/Parser.java"]
    assert [x["feature"] for x in hot[0]["dominant_risk_signals"]] == ["previous_bug_fixes", "lines_added"]
    assert hot[0]["recommended_inspection_actions"] == [
        REGISTRY[f].risk_action for f in ("previous_bug_fixes", "lines_added")]
    trend = intelligence.monthly_trend(rows, samples)
    assert intelligence.trend_direction(trend).first()["direction"] == "decreasing"
    assert trend.count() == 3


def test_priorities(queue):
    first = queue.where("rank = 1").first()
    assert first["identifier"] == "lib/Parser.java" and first["priority_score"] == pytest.approx(.8 * .84 + .2)


def test_bad_dates_make_the_trend_unsupported(rows, samples):
    bad = rows.withColumn("snapshot_date", F.when(F.col("rank") == 2, "someday").otherwise(F.col("snapshot_date")))
    assert intelligence.monthly_trend(bad, samples).count() == 0
    assert intelligence.unsupported_analyses(bad, samples).first()["temporal_unsupported"]


def scores_frame(spark, values):
    return spark.createDataFrame([("p", f"f{i}", v) for i, v in enumerate(values)],
                                 "project string, file_path string, risk_score double")


def test_concentration(spark):
    c = intelligence.risk_concentration(scores_frame(spark, [.4, .3, .2, .1])).first()
    assert c["top_10_percent_risk_share"] == pytest.approx(40) and c["samples_for_half_of_risk"] == 2
    z = intelligence.risk_concentration(scores_frame(spark, [0.0, 0.0])).first()
    assert (z["top_10_percent_risk_share"], z["samples_for_half_of_risk"]) == (0, 0)


def test_bands_keep_empty_ones(spark):
    bands = {r["minimum"]: r["sample_count"] for r in intelligence.risk_bands(scores_frame(spark, [0.0, .2, .8, 1.0])).collect()}
    assert bands == {0.0: 1, .2: 1, .4: 0, .6: 0, .8: 2}


def test_projects_are_isolated(spark, samples, rows):
    other = samples_frame(spark, "owner/other", [(p, d, 1 - s, f, -c) for p, d, s, f, c in OBSERVATIONS])
    both = ranking.build_ranking(samples.unionByName(other))
    mine = intelligence.priority_queue(both).where("project = 'owner/example'")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, intelligence.priority_queue(rows).collect()))
    assert intelligence.scope(both, False) == "per_project" and intelligence.scope(rows, False) == "single_project"


def test_tiers(spark):
    values = [.95, .9, .85, .8, .7, .6, .4, .3, .2, .1]
    queue = brief.priority_from_ranking(scores_frame(spark, values).withColumns({
        "snapshot_date": F.lit("2024-01-31"), "primary_risk_reason": F.lit("r"), "recommended_action": F.lit("a"),
        "risk_signal_count": F.lit(1)}))
    t = brief.tier_counts(brief.assign_tiers(queue)).first()
    assert (t["CRITICAL"], t["HIGH"], t["MEDIUM"], t["LOW"]) == (1, 1, 4, 4)
    assert brief.tier_counts(brief.assign_tiers(queue, 1.0)).first()["LOW"] == 10


def test_actions_and_summary(rows, samples, queue):
    tiered = stage(brief.assign_tiers(queue))
    actions = {(r["identifier"], r["snapshot_date"]): r for r in brief.action_queue(tiered, samples).collect()}
    assert len(actions) == 5
    a = actions[("lib/Parser.java", "2023-05-31")]
    assert a["dominant_signal"] == "previous_bug_fixes" and '"risk_threshold":0.5' in a["supporting_evidence"]
    assert actions[("lib/Cache.java", "2023-06-30")]["dominant_signal"] is None
    s = brief.executive_summary(rows, samples, tiered).first()
    assert (s["top_hotspot"], s["temporal_direction"], s["overall_attention_level"]) == ("lib/Parser.java", "decreasing", "HIGH")
    assert s["number_of_priority_items"] == 5 and s["models_used"] == ["example"]


def test_incomplete_keys_get_no_evidence(queue, samples):
    blank = queue.withColumn("snapshot_date", F.lit(""))
    row = brief.action_queue(brief.assign_tiers(blank), samples.withColumn("snapshot_date", F.lit(""))).first()
    assert row["dominant_signal"] is None and row["snapshot_date"] is None


# Diagnostics.

def pair(spark, second=(.6, -.2), days=("2024-01-31", "2024-02-29"), features=("code_churn", "commit_count"), **changes):
    rank, long = [], []
    for i, (day, weights) in enumerate(zip(days, ((.3, -.1), second))):
        base = {"project": "p", "file_path": "A.java", "snapshot_date": day, "model": "m", "evaluation_mode": "e"}
        rank.append({**base, "risk_score": .9 - i / 10})
        extra = changes if i == 1 else {}
        for name, w in zip(features if i == 1 else ("code_churn", "commit_count"), weights):
            long.append({**base, "explanation_method": "lin", "contribution_space": "log", "feature": name,
                         "contribution": w, **extra})
    schema = ("project string, file_path string, snapshot_date string, model string, evaluation_mode string, ")
    return (spark.createDataFrame(rank, schema + "risk_score double"), spark.createDataFrame(
        long, schema + "explanation_method string, contribution_space string, feature string, contribution double"))


def test_stable_pair(spark):
    vectors = stage(diagnostics.matched_vectors(*pair(spark)))
    s = diagnostics.stability(vectors).first()
    assert s["mean_explanation_similarity"] == pytest.approx(1.0)
    assert (s["stability_pair_count"], s["stability_sample_count"]) == (1, 2)
    a = diagnostics.alignment(vectors).first()
    assert a["mean_top_feature_share"] == pytest.approx(.75) and a["mean_explanation_strength"] == pytest.approx(.6)


@pytest.mark.parametrize("options", [
    {"file_path": "B.java"}, {"days": ("2024-01-31", "2024-04-30")}, {"model": "x"}, {"evaluation_mode": "x"},
    {"explanation_method": "x"}, {"contribution_space": "x"}, {"features": ("code_churn", "lines_added")}, {"second": (0.0, 0.0)},
    {"features": ("code_churn", "code_churn")}])
def test_incomparable_pairs(spark, options):
    s = diagnostics.stability(diagnostics.matched_vectors(*pair(spark, **options))).first()
    assert (s["stability_pair_count"], s["mean_explanation_similarity"]) == (0, None)


def test_unusable_middle_does_not_bridge(spark):
    rank, long = pair(spark, days=("2024-01-31", "2024-03-15"))
    middle = rank.limit(1).withColumn("snapshot_date", F.lit("2024-02-29"))
    s = diagnostics.stability(diagnostics.matched_vectors(rank.unionByName(middle), long)).first()
    assert s["stability_pair_count"] == 0
    twice = diagnostics.stability(diagnostics.matched_vectors(rank.unionByName(rank.limit(1)), long)).first()
    assert twice["stability_pair_count"] == 0


def test_missing_model_matches_any(spark):
    rank, long = pair(spark)
    s = diagnostics.stability(diagnostics.matched_vectors(rank.withColumn("model", F.lit("unknown")), long)).first()
    assert s["stability_pair_count"] == 1


def quality_of(spark, evidence, action="Inspect code churn before the next change.", dominant="code_churn"):
    rank, long = pair(spark)
    actions = spark.createDataFrame([("p", 1, "HIGH", "A.java", "A.java", "2024-01-31", .9, .9, "churn", dominant, action, evidence)], (
        "project string, priority_rank long, risk_tier string, identifier string, file_path string, snapshot_date string, "
        "predicted_risk double, priority_score double, short_reason string, dominant_signal string, recommended_action string, "
        "supporting_evidence string"))
    return diagnostics.action_quality(actions, diagnostics.matched_vectors(rank, long)).first()


def test_full_evidence(spark):
    q = quality_of(spark, '{"risk_signal_count":1,"recurring_high_risk_count":2,"dominant_signal":"code_churn","contribution":0.3}')
    assert q["evidence_coverage_score"] == 1.0 and q["specificity_label"] == "HIGH"
    assert (q["explanation_item_count"], q["signal_item_count"], q["evidence_item_count"]) == (2, 1, 6)


@pytest.mark.parametrize("count", ["0", "1", "1.5", "-2", '"many"'])
def test_no_hotspot_below_two(spark, count):
    assert not quality_of(spark, f'{{"recurring_high_risk_count":{count}}}')["has_hotspot_evidence"]


def test_generic_guidance(spark):
    q = quality_of(spark, "not json", "Review the code and be careful.", None)
    assert not q["has_concrete_recommendation"] and q["specificity_score"] == .25


# Calibration.

def labelled(spark, rows):
    return spark.createDataFrame([("p", str(s) if s is not None else None, str(y) if y is not None else None, "predict_proba")
                                  for s, y in rows], "project string, risk_score string, true_label string, score_method string")


def drawn(seed, n=70):
    import random
    rng = random.Random(seed)
    return [(round(rng.random(), 3), int(rng.random() < .4)) for _ in range(n)]


def by_bin(rows, bins):
    out = {}
    for score, label in rows:
        out.setdefault(min(int(score * bins), bins - 1), []).append((score, label))
    return out


@pytest.mark.parametrize("seed, bins", [(1, 7), (2, 16)])
def test_calibration_against_a_loop(spark, seed, bins):
    rows = drawn(seed)
    s = calibration.calibration_summary(labelled(spark, rows), bins=bins).first()
    assert s["brier_score"] == pytest.approx(sum((p - y) ** 2 for p, y in rows) / len(rows))
    assert s["ece"] == pytest.approx(sum(abs(sum(p - y for p, y in b)) for b in by_bin(rows, bins).values()) / len(rows))


def test_bins_against_a_loop(spark):
    rows = [*drawn(3, 25), (0, 1), (1, 0), (.375, 1), (.625, 0), (.5, 0)]
    found = calibration.calibration_bins(labelled(spark, rows), bins=8).orderBy("bin_lower").collect()
    want = by_bin(rows, 8)
    for i, b in enumerate(found):
        mine = want.get(i, [])
        assert (b["bin_lower"], b["sample_count"]) == (pytest.approx(i / 8), len(mine))
        assert b["observed_defect_rate"] == (pytest.approx(sum(y for _, y in mine) / len(mine)) if mine else None)
    assert len(found) == 8


def test_invalid_rows_are_left_out(spark):
    rows = [(.2, 0), ("0.8", 1), (-.1, 0), (1.1, 1), ("nan", 0), ("inf", 1), (None, 0), ("x", 1), (.5, 2), (.5, None), (.5, "x"), (.5, .5)]
    s = calibration.calibration_summary(labelled(spark, rows)).first()
    assert (s["valid_samples"], s["invalid_score_samples"], s["invalid_label_samples"], s["excluded_samples"]) == (2, 6, 4, 10)


def test_recommendation_against_a_loop(spark):
    rows, cuts = drawn(5, 40), [i / 9 for i in range(10)]

    def f1(cut):
        tp = sum(y for p, y in rows if p >= cut)
        return 2 * tp / (sum(p >= cut for p, _ in rows) + sum(y for _, y in rows))

    sweep = calibration.threshold_sweep(labelled(spark, rows), thresholds=cuts)
    best = calibration.recommended_thresholds(sweep).first()
    assert best["recommended_f1"] == pytest.approx(max(map(f1, cuts))) == pytest.approx(f1(best["recommended_threshold"]))
    assert sweep.where("threshold = 1").first()["precision"] is None
    # Of equal thresholds the highest is taken; without a positive label none is.
    equal = calibration.threshold_sweep(labelled(spark, [(.65, 1), (.05, 0)]), thresholds=[.2, .35, .6])
    assert calibration.recommended_thresholds(equal).first()["recommended_threshold"] == .6
    bare = calibration.calibration_summary(labelled(spark, [(.15, 0), (.7, 0)])).first()
    assert (bare["recommended_threshold"], bare["recommendation_status"]) == (None, "no_positive_labels")


def test_no_rows_at_all(spark):
    none = labelled(spark, [(.5, 1)]).limit(0)
    row = calibration.calibration_summary(none).first()
    assert (row["project"], row["total_samples"], row["valid_samples"], row["populated_bins"]) == (None, 0, 0, 0)
    assert (row["brier_score"], row["ece"], row["recommendation_status"]) == (None, None, "no_valid_samples")
    assert calibration.calibration_summary(none, cross_project=True).count() == 0


def test_unknown_projects(spark):
    df = labelled(spark, [(.5, 1)]).unionByName(labelled(spark, [(.4, 0)]).withColumn("project", F.lit(" ")))
    assert calibration.calibration_summary(df, cross_project=True).count() == 1
    within = {r["project"]: r for r in calibration.calibration_summary(df).collect()}
    assert within[None]["valid_samples"] == 1 and within[None]["populated_bins"] == 1
    assert calibration.excluded_projects(df).first()["excluded_unknown_project_samples"] == 1
    with pytest.raises(ValueError):
        calibration.check_options(True, None)
    with pytest.raises(ValueError):
        calibration.check_options(10, [1.5])
