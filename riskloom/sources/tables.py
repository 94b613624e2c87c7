"""Adapters that read the star-schema tables as change history, scores and contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.partitions import partition_mature
from riskloom.operators.snapshots import expand_spans, file_spans
from riskloom.operators.explain import linear_drivers
from riskloom.schemas import MODEL_FEATURES, TARGET, WITHIN_MODE
from riskloom.staging import keep_once, stage_once

VALIDATION_START = "1998-07-01"
TEST_START = "2000-01-01"

# Literal model behind the deterministic contributions: coefficient, centre and scale.
LINEAR_MODEL = {
    "commit_count": (0.8, 6.0, 3.0),
    "developer_count": (0.3, 6.0, 3.0),
    "lines_added": (-0.4, 150.0, 80.0),
    "lines_deleted": (0.25, 15.0, 9.0),
    "code_churn": (0.5, 170.0, 90.0),
    "file_age_days": (-0.6, 900.0, 500.0),
    "days_since_last_change": (-0.7, 300.0, 250.0),
    "previous_bug_fixes": (0.9, 1.0, 1.5),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are commits, parts are files, supplier regions are repositories."""
    def read(name: str) -> DataFrame:
        return read_table(spark, sf_dir, name)

    regions = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = read("supplier").join(F.broadcast(regions), F.col("s_nationkey") == F.col("n_nationkey"))
    priority = F.substring("o_orderpriority", 1, 1)
    # Texts are written out after the changes are summed; what is grouped by here decides them one to one.
    changes = (
        read("lineitem")
        .join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "r_name", "o_orderkey", "c_name", (F.col("c_custkey") % 10 != 0).alias("has_email"), "o_orderdate",
            F.when(priority == "1", 1).when(priority == "2", 2).otherwise(3).alias("kind"), "l_partkey",
            "l_quantity", "l_linenumber",
        )
        .groupBy("r_name", "o_orderkey", "c_name", "has_email", "o_orderdate", "kind", "l_partkey")
        .agg(F.sum("l_quantity").cast("long").alias("lines_added"),
             F.sum("l_linenumber").cast("long").alias("lines_deleted"))
    )
    return changes.select(
        F.col("r_name").alias("repository"),
        F.col("o_orderkey").cast("string").alias("commit_hash"),
        F.col("c_name").alias("author_name"),
        F.when(F.col("has_email"), F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("author_email"),
        F.col("o_orderdate").alias("commit_date"),
        F.when(F.col("kind") == 1, "Fix crash").when(F.col("kind") == 2, "Add debug fixture")
        .otherwise("Refactor").alias("commit_message"),
        F.concat(F.lit("src/P"), F.col("l_partkey").cast("string"), F.lit(".java")).alias("file_path"),
        "lines_added", "lines_deleted")


def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, f"history {sf_dir}", lambda: change_history(spark, sf_dir))


def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, f"spans {sf_dir}", lambda: file_spans(history_table(spark, sf_dir)))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All snapshots, a row-local view of the stored spans: months multiply rows about tenfold, so they are not written."""
    return keep_once(spark, f"features {sf_dir}", lambda: expand_spans(span_table(spark, sf_dir)))


def with_score(features: DataFrame) -> DataFrame:
    """A deterministic score that any SQL engine reproduces bit for bit."""
    weight = (
        F.col("commit_count").cast("double") + F.lit(2.0) * F.col("previous_bug_fixes").cast("double")
        + F.col("code_churn").cast("double") / F.lit(256.0)
    )
    return features.withColumn("risk_score", weight / (weight + F.lit(12.0)))


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mature test partition with scores and per-feature contributions.

    Only snapshots from the test start on are expanded. Contributions follow from their row alone: taking them at
    each scan costs less than reading them back, and their arrays are not written.
    """
    def build() -> DataFrame:
        ends = stage_once(spark, f"ends {sf_dir}", lambda: history_ends(spark, sf_dir))
        test = partition_mature(
            expand_spans(span_table(spark, sf_dir), TEST_START), ends, VALIDATION_START, TEST_START
        ).where(F.col("partition") == "test")
        return with_score(test).select(
            F.col("repository").alias("project"), "file_path",
            F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"),
            "risk_score", F.col(TARGET).alias("true_label"),
            F.lit("logistic_regression").alias("model"),
            F.lit(WITHIN_MODE).alias("evaluation_mode"),
            F.lit("predict_proba").alias("score_method"),
            F.lit(0.45).alias("decision_threshold"), *MODEL_FEATURES)

    return linear_drivers(stage_once(spark, f"scored {sf_dir}", build), LINEAR_MODEL)


def history_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.operators.snapshots import observation_ends, prepare_history

    return observation_ends(prepare_history(history_table(spark, sf_dir)))


def commit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history folded into commit records; files whose number ends in 7 become Kotlin."""
    path = F.regexp_replace("file_path", r"7\.java$", "7.kt")
    return history_table(spark, sf_dir).groupBy(
        "repository", "commit_hash", "author_name", "author_email", "commit_date", "commit_message"
    ).agg(F.map_from_entries(F.collect_list(F.struct(path, F.struct(
        F.col("lines_added").alias("insertions"),
        F.when(F.col("lines_deleted") > 2, F.col("lines_deleted")).alias("deletions"))))).alias("files"))


def damaged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as text with faults planted by commit number, for the quality rules."""
    rows = history_table(spark, sf_dir).withColumn("_n", F.col("commit_hash").cast("long"))
    n = F.col("_n")
    damaged = rows.withColumns({
        "author_name": F.when(n % 97 == 0, "  ").otherwise(F.col("author_name")),
        "commit_date": F.when(n % 89 == 0, "not a date").otherwise(F.date_format("commit_date", "yyyy-MM-dd")),
        "file_path": F.when(n % 83 == 0, F.regexp_replace("file_path", "java$", "txt")).otherwise(F.col("file_path")),
        "lines_added": F.when(n % 79 == 0, "1.5").when(n % 73 == 0, "-1").otherwise(F.col("lines_added").cast("string")),
        "lines_deleted": F.col("lines_deleted").cast("string")})
    return damaged.unionByName(damaged.where(n % 71 == 0)).drop("_n")


def damaged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots with faults planted by their own values."""
    rows = feature_table(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in MODEL_FEATURES})
    age, churn = F.col("file_age_days"), F.col("code_churn")
    return rows.withColumns({
        "repository": F.when(age % 53 == 4, " ").otherwise(F.col("repository")),
        "snapshot_date": F.when(age % 47 != 3, F.col("snapshot_date")),
        "lines_added": F.when(churn % 43 == 2, F.lit(float("nan"))).otherwise(F.col("lines_added")),
        "lines_deleted": F.when(churn % 41 == 1, F.lit(-1.0)).otherwise(F.col("lines_deleted")),
        TARGET: F.when(churn % 37 == 5, F.lit(2)).otherwise(F.col(TARGET))})


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic scores per test snapshot under the names of the baselines."""
    from functools import reduce

    rows = scored_table(spark, sf_dir)
    scores = {
        "dummy": F.lit(0.05),
        "logistic_regression": F.col("risk_score"),
        "random_forest": F.lit(1.0) / (F.lit(1.0) + F.col("days_since_last_change").cast("double") / F.lit(120.0)),
    }
    return reduce(DataFrame.unionByName, [
        rows.select("project", F.lit(name).alias("model"), "true_label", score.alias("risk_score"))
        for name, score in scores.items()])
