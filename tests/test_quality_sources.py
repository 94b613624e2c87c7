import json

import pytest
from pyspark.sql import functions as F

from support import HISTORY, feature_rows, features_frame, history_frame
from riskloom.operators.partitions import PartitionError
from riskloom.operators.provenance import build_provenance, frame_digest, verify_provenance
from riskloom.operators.quality import DataQualityError, clean_features, clean_history, history_report, require_columns
from riskloom.operators.snapshots import build_snapshots, repository_summary
from riskloom.sources import readers, writers
from test_snapshots import PAST


@pytest.mark.parametrize("column,value,rule", [
    ("author_name", " ", "blank_author_name"), ("file_path", "src/A.py", "not_java"), ("commit_date", "soon", "invalid_date"),
    ("lines_added", "1.5", "not_whole_lines_added"), ("lines_deleted", "-2", "not_whole_lines_deleted"),
])
def test_history_rules(spark, column, value, rule):
    bad = history_frame(spark, PAST).withColumn(column, F.when(
        F.col("commit_hash") == "p1", F.lit(value)).otherwise(F.col(column).cast("string")))
    with pytest.raises(DataQualityError, match=rule):
        clean_history(bad)


def test_duplicate_changes(spark):
    df = history_frame(spark, PAST + PAST[:1])
    report = {r["rule"]: r["violations"] for r in history_report(df).collect()}
    assert report["duplicate_key"] == 2
    with pytest.raises(DataQualityError, match="duplicate_key"):
        clean_history(df)


def test_empty_and_missing(spark):
    with pytest.raises(DataQualityError, match="no rows"):
        clean_history(spark.createDataFrame([], HISTORY))
    with pytest.raises(DataQualityError, match="file_path"):
        require_columns(spark.range(1), ["file_path"])


@pytest.mark.parametrize("column,value", [("code_churn", float("nan")), ("code_churn", float("inf")), ("commit_count", -1.0),
                                          ("repository", " "), ("snapshot_date", None)])
def test_feature_rules(spark, column, value):
    df = features_frame(spark, feature_rows())
    bad = df.withColumn(column, F.when(F.col("file_age_days") == 6, F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(DataQualityError):
        clean_features(bad)


def test_feature_label_duplicates_and_dates(spark):
    df = features_frame(spark, feature_rows())
    with pytest.raises(DataQualityError, match="not_binary"):
        clean_features(df.withColumn("defect_next_90_days", F.lit(2)))
    with pytest.raises(DataQualityError, match="duplicate_key"):
        clean_features(df.unionByName(df))
    with pytest.raises(DataQualityError, match="too_few_dates"):
        clean_features(features_frame(spark, feature_rows(months=2)))
    assert clean_features(df.withColumn("future_hint", F.lit(1))).count() == 102


def test_csv_round_trip_keeps_line_breaks(spark, tmp_path):
    rows = [(c[0], c[1], c[2], 'Fix "it"\nsecond, line', *c[4:]) if c[0] == "p3" else c for c in PAST]
    path = str(tmp_path / "history.csv")
    writers.write_history(history_frame(spark, rows), path, "csv")
    back = readers.read_history(spark, path)
    assert back.where("commit_hash = 'p3'").first()["commit_message"] == 'Fix "it"\nsecond, line'
    assert build_snapshots(back).count() == build_snapshots(history_frame(spark, rows)).count()


def test_commit_records(spark, tmp_path):
    record = {"repository": "o/r", "commit_hash": "x", "author_name": "a", "author_email": None,
              "commit_date": "2024-01-01T00:00:00Z", "commit_message": "  Fix\n",
              "files": {"A.java": {"insertions": 3}, "b.txt": {"insertions": 1, "deletions": 1}}}
    path = tmp_path / "commits.json"
    path.write_text(json.dumps(record) + "\n")
    rows = readers.explode_commit_changes(readers.read_commits(spark, str(path))).collect()
    assert [(r["file_path"], r["lines_added"], r["lines_deleted"], r["commit_message"]) for r in rows] == [("A.java", 3, 0, "Fix")]


def test_feature_sets(spark):
    one, two = (features_frame(spark, feature_rows(n)) for n in ("alpha", "beta"))
    assert readers.combine_feature_sets([one, two]).count() == 204
    named = repository_summary(readers.combine_feature_sets([one, two], ["a.parquet", "b.parquet"]))
    assert {(r["repository"], r["source"]) for r in named.collect()} == {("alpha", "a.parquet"), ("beta", "b.parquet")}
    assert "source" not in repository_summary(one).columns
    with pytest.raises(DataQualityError, match="several sources"):
        readers.combine_feature_sets([one, two, one])
    with pytest.raises(DataQualityError, match="two repositories"):
        readers.combine_feature_sets([one])


def test_digest_ignores_order_and_sees_changes(spark):
    df = features_frame(spark, feature_rows())
    digest = frame_digest(df).first()["digest"]
    assert frame_digest(df.orderBy(F.rand(1)).repartition(5)).first()["digest"] == digest
    assert frame_digest(df.withColumn("code_churn", F.when(F.col("file_age_days") == 6, F.col("code_churn") + 0.5)
                                      .otherwise(F.col("code_churn")))).first()["digest"] != digest
    assert frame_digest(df.unionByName(df.limit(1))).first()["digest"] != digest
    ints = df.withColumns({c: F.col(c).cast("long") for c in ("commit_count", "code_churn")})
    assert frame_digest(ints).first()["digest"] == digest


@pytest.mark.parametrize("column,value", [("target", "other"), ("horizon_days", 30), ("feature_digest", "xyz"),
                                          ("observation_end", "never"), ("row_count", 1), ("schema_version", 2)])
def test_tampered_provenance(spark, column, value):
    history = history_frame(spark, PAST)
    features = build_snapshots(history)
    made = build_provenance(history, features)
    verify_provenance(made, features)
    with pytest.raises(PartitionError):
        verify_provenance(made.withColumn(column, F.lit(value)), features)


def test_provenance_files(spark, tmp_path):
    history = history_frame(spark, PAST + [("end", "dev1", "2024-12-31T00:00:00+00:00", "End", "src/B.java", 1, 0)])
    features = build_snapshots(history)
    path = str(tmp_path / "features")
    writers.write_features(features, path, build_provenance(history, features))
    back = readers.read_provenance(spark, f"{path}.provenance.json", readers.read_features(spark, path))
    assert back.first()["repository"] == "owner/demo"
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"schema_version": 1, "sidecars": {"owner/demo": "features.provenance.json"}}))
    assert readers.read_provenance(spark, str(manifest), features).count() == 1
    assert readers.read_provenance(spark, str(tmp_path / "none.json"), required=False) is None
    with pytest.raises(PartitionError):
        readers.read_provenance(spark, str(tmp_path / "none.json"))
    with pytest.raises(PartitionError):
        verify_provenance(None, features)
    altered = features.withColumn("commit_count", F.col("commit_count") + 1)
    with pytest.raises(PartitionError, match="digest_matches"):
        readers.read_provenance(spark, f"{path}.provenance.json", altered)


def test_json_has_no_nan(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double"), path, "json")
    assert spark.read.text(path).first()[0] == '{"a":null,"b":1.0}'


