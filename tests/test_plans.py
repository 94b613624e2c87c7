"""What the plans of the shared steps must not do for every row."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.text import any_number
from riskloom.operators import diagnostics, explain, guidance, merkle, quality, radix, ranking
from riskloom.staging import stage


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_images_are_taken_per_value(spark):
    rows = spark.range(6).select((F.col("id") % 2).alias("g"), (F.col("id") % 3 - 1).alias("x"))
    counted = radix.images(rows, ["g"], "x")
    above, below = optimized(counted).split("\n", 1)
    assert above.startswith("Aggregate") and "LOG2" in above and "LOG2" not in below
    got = {(r["g"], r["x"]): r["n"] for r in counted.withColumn("x", radix.value(F.col("image"))).collect()}
    assert got == {(g, x): 1 for g in (0, 1) for x in (-1.0, 0.0, 1.0)}


def test_numbers_are_not_read_from_text(spark):
    values = [1.5, -0.0, 1e300, 5e-324, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v, 1.0) for v in values], "risk_score double, decision_threshold double")
    assert "RLIKE" not in optimized(quality.score_report(df))
    typed = [r[0] for r in df.select(any_number(F.col("risk_score"), T.DoubleType())).collect()]
    texts = [r[0] for r in df.select(any_number(F.col("risk_score").cast("string"), T.StringType())).collect()]
    assert typed == texts == [1.5, 0.0, 1e300, 5e-324, None, None, None]
    one = spark.range(1).select(F.lit(0.1).cast("float").alias("f"))  # other types keep their text
    assert one.select(any_number(F.col("f"), T.FloatType())).first()[0] == 0.1


def samples(spark):
    day = datetime.date(2024, 1, 31).isoformat()
    drivers = "array<struct<k double, feature string, feature_value double, model_input_value double, contribution double>>"
    lists = [[("other", 3.0), ("code_churn", 2.0), ("lines_added", -1.0), ("commit_count", 0.5)], [("other", 1.0)], [], None]
    rows = [("p", f"f{i}", day, "m", "e", "how", "space", x and [(-abs(c), f, 0.0, 0.0, c) for f, c in x])
            for i, x in enumerate(lists)]
    return spark.createDataFrame(rows, "project string, file_path string, snapshot_date string, model string, "
                                 f"evaluation_mode string, explanation_method string, contribution_space string, drivers {drivers}")


def test_a_driver_is_looked_up_once(spark):
    facts = guidance.with_guidance_facts(samples(spark))
    assert optimized(facts).count("code_churn") == 1
    got = {r["file_path"]: r["_g"] for r in facts.collect()}
    assert tuple(got["f0"]) == ("code_churn", "lines_added", 2, 1)
    assert tuple(got["f1"]) == tuple(got["f2"]) == (None, None, 0, 0) and got["f3"] is None


def test_contexts_of_samples_gather_nothing(spark):
    rows = samples(spark).where("file_path IN ('f0', 'f1')")
    twice = rows.unionByName(rows.where("file_path = 'f1'"))
    contexts = diagnostics.sample_contexts(twice)
    assert "Aggregate" not in optimized(contexts)
    ranking = rows.select("project", "file_path", "snapshot_date", "model", "evaluation_mode", F.lit(0.9).alias("risk_score"))
    got = {r["path"]: r["v"] for r in diagnostics.matched_vectors(ranking, contexts).collect()}
    assert len(got["f0"]["weights"]) == 4 and got["f1"] is None


def test_a_row_moves_once_to_its_bucket(spark, monkeypatch):
    plans = []

    def keep(df, *_):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(merkle, "stage", keep)
    merkle.tree(spark.range(3).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("string").alias("t")), F.col("t"), ["g"], 1)
    assert plans[0].count("Exchange hashpartitioning") == 1


def test_linear_facts_equal_those_of_the_lists(spark):
    nan, inf = float("nan"), float("inf")
    model = {"b": (1.0, 0.0, 1.0), "a": (1.0, 0.0, 1.0), "lines_added": (2.0, 1.0, 4.0), "code_churn": (-1.0, 0.0, 2.0)}
    values = [0.0, 1.0, -1.0, 2.0, nan, None, inf, -inf, 1e-13]
    rows = [(i, *(values[(i // 9 ** k) % 9] for k in range(4))) for i in range(0, 9 ** 4, 7)]
    frame = spark.createDataFrame(rows, "i int, b double, a double, lines_added double, code_churn double")
    lists = explain.top_drivers_of(explain.plain(explain.linear_drivers(frame, model)))
    for known in (["lines_added", "code_churn"], list(model), ["b"]):
        columns = ["i", *explain.DRIVER_COLUMNS, "_g"]
        want = guidance.guidance_facts_of(lists, {f: None for f in known}).select(*columns)
        got = explain.linear_facts(frame, model, known).select(*columns)
        assert {r["i"]: repr(r) for r in got.collect()} == {r["i"]: repr(r) for r in want.collect()}
        assert "sort_array" in optimized(want) and "sort_array" not in optimized(got)


def test_a_ranking_of_linear_facts_is_written_once(spark, monkeypatch):
    """Neither lists nor a second copy of the rows are stored on the way to the rank."""
    stored = []
    monkeypatch.setattr(ranking, "stage", lambda df, name="stage": stored.append(name) or stage(df, name))
    model = {"code_churn": (1.0, 2.0, 3.0), "commit_count": (-0.5, 1.0, 1.0)}
    rows = spark.createDataFrame(
        [("p", f"f{i % 4}", f"2024-0{1 + i // 4}-28", i % 3 / 4, i % 2, "m", "e", "s", 0.5, float(i), 2.0 - i) for i in range(12)],
        "project string, file_path string, snapshot_date string, risk_score double, true_label int, model string, evaluation_mode string, "
        "score_method string, decision_threshold double, code_churn double, commit_count double")
    samples = explain.linear_drivers(rows, model)
    plain = ranking.build_ranking(samples)
    assert stored == ["facts"]
    got = ranking.build_ranking(explain.linear_facts(samples, model, list(model)))
    assert stored == ["facts"] and got.schema == plain.schema and sorted(got.collect()) == sorted(plain.collect())


def test_contexts_keep_the_configured_partitions(spark):
    """Adaptive coalescing, by the compressed rows, would gather them in maps that do not fit in memory."""
    rows = samples(spark).where("file_path = 'f0'").select("*", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("i"))
    long = explain.to_long(rows.withColumns({
        "file_path": F.concat(F.lit("f"), F.col("i").cast("string")), "risk_score": F.lit(0.5), "true_label": F.lit(1),
        "decision_threshold": F.lit(0.5)}))
    contexts = diagnostics.explanation_contexts(long).withColumn("part", F.spark_partition_id()).collect()
    assert len(contexts) == 60 and {(r["size"], r["max_copies"], len(r["weights"])) for r in contexts} == {(4, 1, 4)}
    assert len({r["part"] for r in contexts}) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
