"""Plans of the steps that most queries share: what they must not write, read or compute twice."""

from datetime import date

from pyspark.sql import functions as F

from riskloom import staging
from riskloom.operators import explain, guidance, snapshots
from riskloom.plans import queries
from riskloom.schemas import MODEL_FEATURES
from riskloom.sources import tables

SF = "/root/testdata/sf0.001"


def test_scored_rows_are_stored_flat_and_expand_the_test_period_only(spark):
    staging.drop_staged(spark)
    scored = tables.scored_table(spark, SF)
    names = {name for _, name in staging._TABLES}
    assert f"features {SF}" not in names and f"scored {SF}" in names
    key = next(k for k in staging._TABLES if k[1] == f"scored {SF}")
    assert "drivers" not in staging._TABLES[key].columns and "drivers" in scored.columns
    parted = queries.parted_of(spark, SF).where("partition = 'test'")
    assert scored.count() == parted.count() > 0
    assert scored.select(F.col("project").alias("repository"), "file_path", F.to_date("snapshot_date")).exceptAll(
        parted.select("repository", "file_path", "snapshot_date")).isEmpty()


def test_ranking_is_not_stored_twice(spark):
    ranking = queries.ranking_of(spark, SF)
    assert any("/ranked-" in f for f in ranking.inputFiles())
    assert queries.ranking_of(spark, SF) is ranking


def test_late_expansion_gives_the_late_rows_of_the_whole_expansion(spark):
    history = tables.history_table(spark, SF)
    spans = snapshots.file_spans(history)
    whole = snapshots.expand_spans(spans)
    for first in ("1992-01-01", "1997-05-30", "1997-05-31", "1997-06-01", "2030-01-01"):
        late, wanted = snapshots.expand_spans(spans, first), whole.where(F.col("snapshot_date") >= date.fromisoformat(first))
        assert late.exceptAll(wanted).isEmpty() and wanted.exceptAll(late).isEmpty()


def test_strongest_drivers_and_facts_with_foreign_null_and_equal_drivers(spark):
    schema = "id int, drivers array<struct<k double, feature string, contribution double>>"
    rows = spark.createDataFrame([
        (1, [(-3.0, "foreign", 3.0), (-2.0, "code_churn", 2.0), (-2.0, "lines_added", 2.0), (-1.0, "commit_count", -1.0)]),
        (2, [(-1.0, "lines_added", -1.0), (0.0, "code_churn", 0.0)]), (3, []), (4, None),
        (5, [(-9.0, None, -9.0), (None, "code_churn", None), (-1.0, "foreign", 1.0)])], schema)
    got = {r["id"]: r for r in guidance.with_guidance_facts(explain.with_top_drivers(rows)).collect()}
    tops = {i: tuple(r[c] for c in explain.DRIVER_COLUMNS) for i, r in got.items()}
    assert tops == {1: ("foreign", 3.0, "commit_count", -1.0), 2: (None, None, "lines_added", -1.0),
                    3: (None,) * 4, 4: (None,) * 4, 5: ("foreign", 1.0, None, -9.0)}
    assert {i: r["_g"] and tuple(r["_g"]) for i, r in got.items()} == {
        1: ("code_churn", "commit_count", 2, 1), 2: (None, "lines_added", 0, 1), 3: (None, None, 0, 0), 4: None,
        5: (None, None, 0, 0)}


def test_rows_between_the_same_thresholds_walk_once(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    nodes = spark.createDataFrame(
        [(t, n, a, b, -1 if f is None else MODEL_FEATURES.index(f), c, p) for t, n, a, b, f, c, p in queries.FOREST],
        "tree int, node int, left int, right int, feature int, threshold double, p double")
    x = np.random.default_rng(1).integers(0, 300, (500, len(MODEL_FEATURES))).astype(float)
    x[:, 0], x[:, 7], x[3, 0] = x[:, 0] % 9, x[:, 7] % 2, np.nan
    batch = pa.RecordBatch.from_arrays([*map(pa.array, x.T), pa.array(range(500))], names=[*MODEL_FEATURES, "id"])
    seen = {}
    for most in (explain.MOST_CUTS, 0):
        for size in (2, 4_096):
            monkeypatch.setattr(explain, "MOST_CUTS", most)
            files = sorted(explain.node_pages(nodes, size).inputFiles(), key=lambda name: name.rsplit("/", 1)[-1])
            cells = explain._cuts(files, len(MODEL_FEATURES))
            assert (cells is None) == (most == 0) and (cells is None or sum(map(len, cells)) == 4)
            out = list(explain._page_walk(files, MODEL_FEATURES, size)(iter([batch.slice(0, 300), batch.slice(300)])))
            assert [b.num_rows for b in out] == [300, 200] and out[1].column(8).to_pylist() == list(range(300, 500))
            seen[most, size] = np.array([r for b in out for r in b.column(9).to_pylist()])
    first = seen.popitem()[1]
    assert len({tuple(r) for r in first}) <= 16 and all(np.allclose(first, other, atol=1e-12) for other in seen.values())


def test_numbers_that_land_on_a_row_are_not_walked(spark):
    from riskloom.operators.shuffles import permuted

    moved = spark.range(103).select(permuted(F.col("id"), 103, F.lit("a")).alias("x"))
    assert "ELSE aggregate(" in moved._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["x"] for r in moved.collect()) == list(range(103))


def test_cleaned_texts_are_those_of_the_expression(spark):
    from riskloom.functions.text import clean_text, with_clean_texts

    odd = ["", " ", "\x0b", "\x00", "a", " a", "a\t", "\x1fa", "a\x01 ", " a", "é ", " é", "NaN", " Unknown\n", "unKnown", "UNKNOWN",
           "Kunknown", "not_available", "not_available ", "not_availables", "İ", "none none", "漢 ", "\U0001f600 ", None, "< NA>", "<na>"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id int, t string").withColumn("n", F.col("id").cast("long"))
    wanted = rows.select("id", clean_text(F.col("t")).alias("t"), clean_text(F.col("n")).alias("n"))
    got = with_clean_texts(rows, ["t", "n"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_long_rows_move_once_and_are_cleaned_in_their_place(spark):
    from riskloom.operators import diagnostics

    long = explain.to_long(tables.scored_table(spark, SF))
    assert optimized_text(long).count("sort_array(") == 1
    contexts = diagnostics.explanation_contexts(long)
    assert contexts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    below = optimized_text(contexts).split("Generate inline")
    assert len(below) == 2 and "isnotnull(path" in below[0] and "Filter" in below[0] and "isnotnull(trim" not in below[1]


def test_long_table_is_not_stored_and_read_once_when_muddled(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(queries, "stage_once", lambda _, name, build: plans.setdefault(name, build()))
    queries.ranking_of(spark, SF)
    text = optimized_text(queries.muddled_of(spark, SF))
    assert f"retained {SF}" not in plans and text.count("posexplode") == 1 and "Union" not in text


def test_empty_and_missing_drivers_have_no_long_rows(spark):
    drivers = "array<struct<k double, feature string, feature_value double, model_input_value double, contribution double>>"
    rows = spark.createDataFrame([("a", [(-1.0, "f", 1.0, 1.0, 1.0), None]), ("b", []), ("c", None)], f"file_path string, drivers {drivers}")
    full = rows.select(F.lit("p").alias("project"), "file_path", F.lit("2000-01-31").alias("snapshot_date"), F.lit("m").alias("model"), F.lit(
        "e").alias("evaluation_mode"), F.lit(0.1).alias("risk_score"), F.lit(0).alias("true_label"), F.lit(0.5).alias("decision_threshold"),
        "drivers", F.lit("x").alias("explanation_method"), F.lit("y").alias("contribution_space"))
    assert [(r["file_path"], r["feature"], r["feature_rank"]) for r in explain.to_long(full).collect()] == [("a", "f", 1), ("a", None, 2)]


def optimized_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_driver_lists_are_taken_once_where_they_are_exploded(spark):
    from riskloom.operators import intelligence

    scored = tables.scored_table(spark, SF)
    for rows in (explain.average_magnitudes(scored), explain.common_directions(scored), guidance.common_signals(scored),
                 intelligence.top_signals(scored, ["project"])):
        text = optimized_text(rows)
        assert text.count("array(struct(k, ") == 1 and "size(" not in text


def test_driver_rows_keep_empty_entries_and_drop_empty_lists(spark):
    rows = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "id int, drivers array<string>")
    assert [tuple(r) for r in explain.driver_rows(rows, "id").collect()] == [(1, 0, "a"), (1, 1, None)]


def test_snapshots_are_not_stored_and_training_rows_without_keys(spark):
    features = tables.feature_table(spark, SF)
    assert set(features.inputFiles()) == set(tables.span_table(spark, SF).inputFiles())
    train = queries.train_of(spark, SF)
    assert train.columns == ["repository", *MODEL_FEATURES, "defect_next_90_days"]
    parted = queries.parted_of(spark, SF).where("partition = 'train'").select(*train.columns)
    assert train.exceptAll(parted).isEmpty() and parted.count() == train.count() > 0
