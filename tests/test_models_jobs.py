import pytest
from pyspark.sql import functions as F

from support import ends_frame, feature_rows, features_frame
from riskloom.operators import explain, models, partitions, stability
from riskloom.operators.provenance import frame_digest
from riskloom.plans import jobs
from riskloom.schemas import MODEL_FEATURES, PROVENANCE_SCHEMA, TARGET
from riskloom.sources import readers, writers
from riskloom.staging import stage

V, T = "2021-07-01", "2022-07-01"
NAMES = ["alpha", "beta"]


def dataset(spark, names=NAMES):
    features = stage(features_frame(spark, [r for i, n in enumerate(names) for r in feature_rows(n, i)]))
    digests = {r["repository"]: r for r in frame_digest(features).collect()}
    rows = [(n, "2030-12-31", "a" * 64, digests[n]["digest"], digests[n]["row_count"], 1, "0.1.0", TARGET, 90,
             "UTC_calendar_day; features_through_day; label_(T,T+90d]") for n in names]
    return jobs.Dataset(features, spark.createDataFrame(rows, PROVENANCE_SCHEMA))


@pytest.fixture(scope="module")
def data(spark):
    return dataset(spark)


@pytest.fixture(scope="module")
def parted(spark, data):
    return stage(partitions.partition_mature(data.features, ends_frame(spark, NAMES), V, T))


@pytest.fixture(scope="module")
def fitted(parted):
    return models.fit_baselines(parted.where("partition = 'train'"), trees=4, max_depth=4)


@pytest.fixture(scope="module")
def within(spark):
    return jobs.evaluate_within(dataset(spark, NAMES[:1]), V, T, trees=3, max_depth=3, explain_top_k=4)


def test_scaler_uses_the_population_deviation(parted, fitted):
    train = parted.where("partition = 'train'")
    want = train.agg(F.avg("code_churn"), F.stddev_pop("code_churn")).first()
    _, centre, scale = fitted["logistic_regression"].linear["code_churn"]
    assert (centre, scale) == (pytest.approx(want[0]), pytest.approx(want[1]))


def test_prior(parted, fitted):
    rate = parted.where("partition = 'train'").agg(F.avg(TARGET)).first()[0]
    assert fitted["dummy"].prior == pytest.approx(rate)


def test_logistic_minimizes_the_balanced_objective(parted, fitted):
    """The gradient of weighted log loss plus |w|^2 / 2 vanishes at the fit."""
    import numpy as np
    train = parted.where("partition = 'train'").select(*MODEL_FEATURES, TARGET).toPandas()
    model = fitted["logistic_regression"]
    terms = [model.linear[f] for f in MODEL_FEATURES]
    x = np.column_stack([(train[f] - m) / s for f, (_, m, s) in zip(MODEL_FEATURES, terms)])
    y, w = train[TARGET].to_numpy(), np.array([t[0] for t in terms])
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    assert np.abs(x.T @ (weight * (p - y)) + w).max() < 0.05
    assert abs((weight * (p - y)).sum()) < 0.05


def test_linear_terms_rebuild_the_margin(parted, fitted):
    model = fitted["logistic_regression"]
    rows = model.explain(model.score(parted.where("partition = 'test'"))).select("risk_score", F.aggregate(
        "drivers", F.lit(model.intercept), lambda a, d: a + d["contribution"]).alias("margin"))
    assert rows.where(F.abs(1 / (1 + F.exp(-F.col("margin"))) - F.col("risk_score")) > 1e-9).count() == 0


def test_tree_paths_rebuild_the_probability(parted, fitted, spark, tmp_path):
    forest = fitted["random_forest"]
    nodes = explain.tree_nodes(forest.forest, str(tmp_path / "forest")).where("node = 0")
    root = nodes.agg(F.avg("p")).first()[0]
    rows = forest.explain(forest.score(parted.where("partition = 'test'")))
    gap = rows.select(F.abs(F.aggregate("drivers", F.lit(root), lambda a, d: a + d["contribution"]) - F.col("risk_score")).alias("g"))
    assert gap.agg(F.max("g")).first()[0] < 1e-9


def walked(table, x):
    """Path sums of one row by a plain walk of every tree."""
    out = dict.fromkeys(MODEL_FEATURES, 0.0)
    for tree in {t for t, _ in table}:
        node = table[tree, 0]
        while node["left"] >= 0:
            name = MODEL_FEATURES[node["feature"]]
            child = table[tree, node["left"] if x[name] <= node["threshold"] else node["right"]]
            out[name] += (child["p"] - node["p"]) / len({t for t, _ in table})
            node = child
    return out


@pytest.mark.parametrize("size, rows", [(1, 7), (3, 100_000), (4_096, 50)])
def test_pages_of_any_size_give_the_plain_paths(parted, fitted, tmp_path, monkeypatch, size, rows):
    monkeypatch.setattr(explain, "WALK_ROWS", rows)
    nodes = explain.tree_nodes(fitted["random_forest"].forest, str(tmp_path / "forest"))
    table = {(n["tree"], n["node"]): n for n in nodes.collect()}
    if size == 3:  # walks cross several pages
        assert max(n for _, n in table) // size >= 2
    test = parted.where("partition = 'test'").select("file_path", *MODEL_FEATURES)
    got = explain.forest_drivers(test, nodes, MODEL_FEATURES, size).collect()
    assert len(got) == test.count() > 0
    for row in got:
        want = walked(table, row)
        assert {d["feature"]: d["contribution"] for d in row["drivers"]} == pytest.approx(want, abs=1e-9)


def test_broken_trees_are_refused(spark, parted):
    columns = "tree int, node int, left int, right int, feature int, threshold double, p double"
    test = parted.limit(20).select("file_path", *MODEL_FEATURES)
    lost = spark.createDataFrame([(0, 0, 1, 2, 0, -1.0, 0.5), (0, 1, -1, -1, -1, None, 0.1)], columns)
    back = spark.createDataFrame([(0, 0, 1, 2, 0, 1.0, 0.5), (0, 1, 0, 2, 0, 1.0, 0.1), (0, 2, -1, -1, -1, None, 0.1)], columns)
    for nodes, size in ((lost, 1), (lost, 100), (back, 100)):
        with pytest.raises(Exception, match="names a node|higher number"):
            explain.forest_drivers(test, nodes, MODEL_FEATURES, size).collect()
    stump = spark.createDataFrame([(0, 0, -1, -1, -1, None, 0.5)], columns)
    for nodes in (stump, stump.limit(0)):
        assert all(d["contribution"] == 0 for r in explain.forest_drivers(test, nodes, MODEL_FEATURES).collect() for d in r["drivers"])


def test_median_fallback(parted, fitted):
    model = fitted["logistic_regression"]
    test = model.score(parted.where("partition = 'test'").select("repository", "file_path", "snapshot_date", *MODEL_FEATURES))
    medians = models.feature_medians(test)
    row = explain.median_drivers(test, model.score, medians, MODEL_FEATURES).first()
    moved = test.where((F.col("file_path") == row["file_path"]) & (F.col("repository") == row["repository"])
                       & (F.col("snapshot_date") == row["snapshot_date"])).withColumn("code_churn", F.lit(medians["code_churn"]))
    want = row["risk_score"] - model.score(moved.drop("risk_score")).first()["risk_score"]
    got = next(d["contribution"] for d in row["drivers"] if d["feature"] == "code_churn")
    assert got == pytest.approx(want)


def test_shuffling_does_not_move_a_constant(parted, fitted):
    rows = parted.where("partition = 'validation'")
    drops = models.shuffled_importance(fitted["dummy"], rows, repeats=2).collect()
    assert len(drops) == 8 and all(r["importance"] == 0 for r in drops)


def test_training_needs_both_classes(parted):
    with pytest.raises(partitions.PartitionError, match="both classes"):
        models.fit_baselines(parted.where(F.col(TARGET) == 0), trees=1)


def test_selection_ignores_test_rows(parted, fitted):
    before = models.lock_selection(fitted, parted.where("partition = 'validation'"))
    flipped = parted.withColumn(TARGET, F.when(F.col("partition") == "test", 1 - F.col(TARGET)).otherwise(F.col(TARGET)))
    after = models.lock_selection(fitted, flipped.where("partition = 'validation'"))
    assert before[:2] == after[:2]


def test_within_report(within, spark, tmp_path):
    assert within["risk_ranking"].count() == within["partition_summary"].where("partition = 'test'").first()["row_count"]
    facts = within["dataset_summary"].first()
    assert (facts["repositories"], facts["predictors"], len(facts["splits"])) == (1, MODEL_FEATURES, 3)
    assert within["metrics"].count() == 12 and within["feature_importance"].count() == 24
    assert within["prediction_explanations"].agg(F.max("feature_rank")).first()[0] == 4
    paths = writers.write_report(within, str(tmp_path / "report"))
    stored = readers.read_ranking(spark, paths["risk_ranking"])
    again = jobs.run_calibration(stored)["calibration_summary"].drop("score_methods").collect()
    assert again == within["calibration_summary"].drop("score_methods").collect()


def test_explanation_summary_counts_the_retained_rows(within):
    retained = within["prediction_explanations"].count()
    assert within["explanation_summary"].first()["contributions"] == retained < 8 * within["risk_ranking"].count()


def test_report_from_csv_equals_the_report(within, spark, tmp_path):
    kept = {k: within[k] for k in ("risk_ranking", "prediction_explanations", "developer_actions", "calibration_summary")}
    writers.write_tables(kept, str(tmp_path / "csv"), "csv")
    stored = readers.read_report(spark, str(tmp_path / "csv"), "csv")
    assert set(stored) == set(kept)
    assert stored["risk_ranking"].select("rank", "risk_score", "true_label").dtypes == \
        within["risk_ranking"].select("rank", "risk_score", "true_label").dtypes
    names = ("risk_ranking", "prediction_explanations")
    again, want = (jobs.resume_report({n: t[n] for n in names}) for t in (stored, kept))
    for name in ("project_summary", "developer_priority", "monthly_trend", "calibration_summary", "explanation_summary"):
        drop = [c for c in want[name].columns if c in ("score_methods",)]
        assert sorted(map(str, again[name].drop(*drop).collect())) == sorted(map(str, want[name].drop(*drop).collect()))


def test_bad_stored_scores_are_refused(spark, tmp_path):
    (tmp_path / "r.csv").write_text("rank,risk_score\n1,0.5\n2,0x1p-1\n")
    with pytest.raises(ValueError, match="risk_score"):
        readers.read_ranking(spark, str(tmp_path / "r.csv"))


def test_one_named_project_takes_the_unnamed_rows(spark):
    rows = spark.createDataFrame([("a", 1), (" ", 2), (None, 3)], "project string, file_path string".replace(
        "file_path string", "n long")).withColumn("file_path", F.lit("f"))
    assert {r["project"] for r in jobs.pooled_scope(rows, False).collect()} == {"a"}
    both = rows.unionByName(rows.limit(1).withColumn("project", F.lit("b")))
    assert {r["project"] for r in jobs.pooled_scope(both, False).collect()} == {"a", " ", None, "b"}
    assert {r["project"] for r in jobs.pooled_scope(rows, True).collect()} == {"a", " ", None}


def test_depth_beyond_spark_is_refused(parted):
    with pytest.raises(ValueError, match="depth"):
        models.fit_baselines(parted.where("partition = 'train'"), trees=1, max_depth=31)


def test_missing_tables_are_derived(within):
    kept = {k: within[k] for k in ("risk_ranking", "prediction_explanations")}
    full = jobs.resume_report(kept)
    for name in ("developer_priority", "developer_actions", "action_quality", "calibration", "hotspots"):
        assert full[name].count() == within[name].count()


def test_unverified_data_is_refused(spark, data):
    altered = jobs.Dataset(data.features.withColumn("code_churn", F.col("code_churn") + 1), data.provenance)
    with pytest.raises(partitions.PartitionError, match="digest_matches"):
        jobs.evaluate_within(altered, V, T)


def test_cross_report(spark, data, within, tmp_path):
    same = jobs.comparison_rows(
        within["metrics"].where("partition = 'test'").withColumn("held_out_repository", F.lit("alpha")),
        frame_digest(data.features.where("repository = 'alpha'")), partitions.fix_calendar(data.ends, V, T))
    out = jobs.evaluate_cross(data, V, T, trees=3, max_depth=3, same_project=same)
    assert out["folds"].count() == 12 and out["model_selection"].count() == 2
    assert {r["project"] for r in out["risk_ranking"].select("project").distinct().collect()} == set(NAMES)
    locked = out["selected_thresholds"]
    assert locked.count() == 6 and locked.where("is_selected_model").count() == 2
    assert set(locked.columns) == {"held_out_repository", "model", "is_selected_model", "selected_validation_threshold",
                                   "validation_pr_auc", "validation_f1"}
    assert out["coefficient_stability"].count() == 8 and out["dataset_shift"].count() == 16
    assert out["leakage_audit"].where(~F.col("passed")).count() == 0
    assert out["same_project_comparison"].count() == 0  # other test rows, so nothing is compared
    assert out["confusion_matrix"].select(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).first()[0] == 36
    paths = writers.write_cross_project(out, str(tmp_path / "cross"))
    assert set(paths) >= {"folds", "aggregate", "dataset_shift", "report"}
    record = spark.read.parquet(paths["report"]).collect()
    assert len(record) == 1 and record[0]["test_start"] == T
    assert len(record[0]["folds"]) == out["folds"].count() == 2 * 3 * 2  # folds, models, thresholds
    assert {r["held_out_repository"] for r in record[0]["model_selection"]} == set(NAMES)


def test_saved_model_documents_its_choice(spark, parted, tmp_path):
    import json

    result = models.train_baselines(parted, trees=2, max_depth=2)
    audit = spark.createDataFrame([("row_accounting", True)], "check string, passed boolean")
    writers.save_model(result, str(tmp_path / "m"), spark, audit, partitions.partition_summary(parted))
    row = spark.read.json(str(tmp_path / "m" / "metadata")).first()
    facts = json.loads(row["model"])
    assert facts["model_type"] == result.selected_model and facts["feature_columns"] == MODEL_FEATURES
    loaded = readers.load_model(spark, str(tmp_path / "m"))
    test = parted.where("partition = 'test'")
    old, new = (m.score(test).agg(F.sum("risk_score")).first()[0] for m in (result.best, loaded))
    assert loaded.name == result.selected_model and new == pytest.approx(old)
    assert len(json.loads(row["test"])) == 6 and len(json.loads(row["date_ranges"])) == 3


def test_stability_rules(spark):
    c = spark.createDataFrame([("x", "a", 1.0), ("y", "a", 3.0), ("x", "b", -1.0), ("y", "b", 1.0)],
                              "held_out string, feature string, coefficient double")
    got = {r["feature"]: r for r in stability.coefficient_stability(c).collect()}
    assert (got["a"]["direction"], got["a"]["std_coefficient"]) == ("consistently_positive", 1.0)
    assert (got["b"]["direction"], got["b"]["sign_consistency"]) == ("mixed", 0.5)
