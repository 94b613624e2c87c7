from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from support import ends_frame, feature_rows, features_frame
from riskloom.operators import metrics, partitions
from riskloom.operators.partitions import PartitionError
from riskloom.operators.provenance import frame_digest
from riskloom.staging import stage

V, T = "2021-07-01", "2022-07-01"


@pytest.fixture(scope="module")
def one(spark):
    return stage(features_frame(spark, feature_rows()))


@pytest.fixture(scope="module")
def three(spark):
    return stage(features_frame(spark, [r for i, n in enumerate(("alpha", "beta", "gamma")) for r in feature_rows(n, i)]))


def sizes(df):
    return {r["partition"]: r["n"] for r in df.groupBy("partition").agg(F.count("*").alias("n")).collect()}


def test_explicit_cuts(spark, one):
    parted = partitions.partition_mature(one, ends_frame(spark, ["alpha"]), V, T)
    assert sizes(parted) == {"train": 39, "validation": 27, "test": 18, None: 18}
    ledger = {r["reason"]: r["row_count"] for r in partitions.exclusion_ledger(parted).collect()}
    assert ledger == {"immature_training_label": 9, "immature_validation_label": 9}


def test_default_fractions(spark, one):
    parted, _ = partitions.chronological_split(one, ends_frame(spark, ["alpha"]))
    days = {r["partition"]: r["n"] for r in parted.groupBy("partition").agg(F.countDistinct("snapshot_date").alias("n")).collect()}
    assert (days["train"], days["validation"], days["test"]) == (20, 3, 6)


@pytest.mark.parametrize("gap,kept", [(90, False), (91, True)])
def test_maturity_is_strict(spark, one, gap, kept):
    day = date(2021, 3, 31)
    parted = partitions.partition_mature(one, ends_frame(spark, ["alpha"]), day + timedelta(days=gap), T)
    assert (parted.where((F.col("snapshot_date") == day) & (F.col("partition") == "train")).count() > 0) is kept


def test_test_labels_must_be_observed(spark, one):
    end = date(2022, 11, 30) + timedelta(days=90)
    parted = partitions.partition_mature(one, ends_frame(spark, ["alpha"], end), V, T)
    last = parted.where("partition = 'test'").agg(F.max("snapshot_date")).first()[0]
    assert last == date(2022, 11, 30)
    reasons = {r["reason"] for r in partitions.exclusion_ledger(parted).collect()}
    assert "incomplete_test_label" in reasons


def test_bad_calendars(spark, one):
    ends = ends_frame(spark, ["alpha"], date(2022, 12, 31))
    for args in ((T, V), (V, T, "2022-12-01"), (V, T, "2022-06-01")):
        with pytest.raises(PartitionError):
            partitions.partition_mature(one, ends, *args)
    with pytest.raises(PartitionError, match="both"):
        partitions.chronological_split(one, ends, validation_start=V)


def test_audit_passes_and_fails_closed(spark, one):
    ends = ends_frame(spark, ["alpha"])
    calendar = partitions.fix_calendar(ends, V, T)
    parted = stage(partitions.apply_calendar(one, ends, calendar))
    recorded = stage(frame_digest(parted.where("partition is not null"), ["partition"]))
    partitions.require_audit(partitions.audit_partitions(parted, ends, calendar, None, None, recorded))
    moved = parted.withColumn("partition", F.when(F.col("snapshot_date") == date(2021, 6, 30), "train").otherwise(F.col("partition")))
    with pytest.raises(PartitionError, match="train_temporal_eligibility"):
        partitions.require_audit(partitions.audit_partitions(moved, ends, calendar, None, None, recorded))
    changed = parted.withColumn("code_churn", F.col("code_churn") + 1)
    with pytest.raises(PartitionError, match="rows_unchanged"):
        partitions.require_audit(partitions.audit_partitions(changed, ends, calendar, None, None, recorded))
    leaked = parted.unionByName(parted.where("partition = 'test'").withColumn("partition", F.lit("train")))
    with pytest.raises(PartitionError, match="disjoint_sample_identities"):
        partitions.require_audit(partitions.audit_partitions(leaked, ends, calendar))


def test_leave_one_project_out(spark, three):
    ends = ends_frame(spark, ["alpha", "beta", "gamma"])
    calendar = partitions.fix_calendar(ends, V, T)
    folds = dict(partitions.lopo_folds(three, ends, calendar))
    assert list(folds) == ["alpha", "beta", "gamma"]
    days = folds["beta"].where("partition is not null").groupBy("repository", "partition").agg(
        F.countDistinct("snapshot_date").alias("n")).collect()
    assert {(r[0], r[1]): r[2] for r in days} == {
        ("alpha", "train"): 13, ("gamma", "train"): 13, ("alpha", "validation"): 9, ("gamma", "validation"): 9, ("beta", "test"): 6}
    summary = partitions.lopo_fold_summary(three, ends, calendar)
    direct = folds["beta"].where("partition = 'train'").count()
    assert summary.where("held_out = 'beta' and partition = 'train'").agg(F.sum("row_count")).first()[0] == direct
    with pytest.raises(PartitionError, match="two repositories"):
        list(partitions.lopo_folds(three, ends.where("repository = 'alpha'"), calendar))


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "true_label int, risk_score double")


def drawn(seed, n, digits=2):
    import random
    rng = random.Random(seed)
    return [int(rng.random() < .35) for _ in range(n)], [round(rng.random(), digits) for _ in range(n)]


def confusion(labels, scores, cut):
    flags = [(a, int(s >= cut)) for a, s in zip(labels, scores)]
    tn, fp, fn, tp = (flags.count(x) for x in ((0, 0), (0, 1), (1, 0), (1, 1)))
    return tn, fp, fn, tp, 2 * tp / (2 * tp + fp + fn) if tp else 0.0


@pytest.mark.parametrize("seed, cut", [(21, .5), (22, .07), (23, .93)])
def test_counts_and_rates_against_a_loop(spark, seed, cut):
    labels, scores = drawn(seed, 90)
    tn, fp, fn, tp, f1 = confusion(labels, scores, cut)
    m = metrics.binary_metrics(scored(spark, labels, scores), cut).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (tn, fp, fn, tp)
    assert (m["accuracy"], m["f1"]) == (pytest.approx((tn + tp) / 90), pytest.approx(f1))
    assert (m["precision"], m["recall"]) == (pytest.approx(tp / (tp + fp)), pytest.approx(tp / (tp + fn)))


def test_no_positives(spark):
    df = scored(spark, [0, 0], [.2, .9])
    m, r = metrics.binary_metrics(df, 0.5).first(), metrics.rank_metrics(metrics.score_curve(df)).first()
    assert (m["precision"], m["recall"], m["f1"]) == (0, 0, 0)
    assert (r["roc_auc"], r["pr_auc"], r["f1_threshold"]) == (None, None, 0.5)


def test_threshold_has_the_best_f1(spark):
    for seed in (31, 32):
        labels, scores = drawn(seed, 60)
        cut = metrics.rank_metrics(metrics.score_curve(scored(spark, labels, scores))).first()["f1_threshold"]
        best = max(confusion(labels, scores, c)[4] for c in scores)
        assert confusion(labels, scores, cut)[4] == pytest.approx(best)


def test_one_score_for_all(spark):
    r = metrics.rank_metrics(metrics.score_curve(scored(spark, [1, 0, 0, 1, 0], [2 / 7] * 5))).first()
    assert r["f1_threshold"] <= 2 / 7 and r["roc_auc"] == 0.5 and r["pr_auc"] == pytest.approx(2 / 5)


def test_areas_against_pair_counting(spark):
    import random
    rng = random.Random(5)
    labels = [int(rng.random() < .3) for _ in range(300)]
    scores = [round(rng.random(), 2) for _ in labels]
    r = metrics.rank_metrics(metrics.score_curve(scored(spark, labels, scores))).first()
    pairs = [(p > n) + .5 * (p == n) for p, a in zip(scores, labels) if a for n, b in zip(scores, labels) if not b]
    assert r["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    area, before = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp = sum(a for a, s in zip(labels, scores) if s >= t)
        flagged = sum(s >= t for s in scores)
        area += (tp / sum(labels) - before) * tp / flagged
        before = tp / sum(labels)
    assert r["pr_auc"] == pytest.approx(area)


def test_selection_order(spark):
    rows = [("dummy", None, .9, .9), ("logistic_regression", .3, .2, .1), ("random_forest", .3, .2, .1)]
    df = spark.createDataFrame(rows, "model string, pr_auc double, f1 double, recall double")
    assert metrics.select_model(df).first()["selected_model"] == "logistic_regression"


def test_permutation_pairs_are_permutations(spark):
    df = spark.createDataFrame([(f"r{i}", i) for i in range(50)], "k string, v long")
    rows = metrics.permutation_pairs(df, ["k"], 2, 42).collect()
    assert all(r["k"] == f"r{r['v']}" and r["donor_k"] == f"r{r['donor_v']}" for r in rows)
    for repeat in (0, 1):
        mine = [r for r in rows if r["repeat"] == repeat]
        assert len({r["k"] for r in mine}) == len({r["donor_k"] for r in mine}) == 50
        assert any(r["k"] != r["donor_k"] for r in mine)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 50, 101, 1000])
def test_keyed_permutations(spark, n):
    from riskloom.operators.shuffles import permuted
    rows = spark.range(n).select("id", *[permuted(F.col("id"), n, F.lit(k)).alias(k) for k in ("u", "v")]).collect()
    for k in ("u", "v"):
        assert sorted(r[k] for r in rows) == list(range(n))
    if n > 40:
        assert sum(r["u"] != r["v"] for r in rows) > n / 2 and sum(r["u"] != r["id"] for r in rows) > n / 2


def test_shuffled_scores_side_by_side_or_row_by_row(spark):
    """A model that gives its score as a column has the importances that scoring copies of the rows gives."""
    import random
    rng = random.Random(8)
    rows = [(i, x := rng.random(), rng.random(), int(x + .3 * rng.random() > .7)) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")

    def of(c):
        return c["a"] * 0.9 + c["b"] * 0.01

    def score(frame):
        return frame.withColumn("risk_score", of({f: F.col(f) for f in "ab"}))

    one, two = ({r["feature"]: tuple(r)[1:] for r in metrics.permutation_importance(
        df, ["k"], ["a", "b"], score, "y", 3, 1, column).collect()} for column in (of, None))
    assert one == {f: pytest.approx(v) for f, v in two.items()} and one["a"][0] > 0.1 > abs(one["b"][0])
