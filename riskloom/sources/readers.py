"""Readers with explicit schemas; Parquet is preferred, CSV and JSON are supported."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.text import is_java_path, read_number, strip
from riskloom.operators.forest import load_forest
from riskloom.operators.models import FittedModel
from riskloom.operators.partitions import PartitionError
from riskloom.operators.provenance import verify_provenance
from riskloom.operators.quality import (
    DataQualityError, clean_features, clean_history, require, require_columns, unit_rule, violations,
)
from riskloom.schemas import (
    COMMIT_SCHEMA, FEATURE_SCHEMA, HISTORY_COLUMNS, HISTORY_SCHEMA, PROVENANCE_SCHEMA, RANKING_SCHEMA,
)


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema])


def read_tabular(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet as stored; CSV as text columns, so that the quality rules see bad values.

    CSV follows RFC 4180: quoted fields may hold line breaks and doubled quotes.
    """
    if path.rstrip("/").endswith(".csv"):
        return (
            spark.read.schema(_as_text(schema)).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path)
        )
    return spark.read.parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return clean_history(read_tabular(spark, path, HISTORY_SCHEMA))


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Commit records with a map from path to line counts, as JSON lines or Parquet."""
    if path.rstrip("/").endswith(".json"):
        return spark.read.schema(COMMIT_SCHEMA).json(path)
    return spark.read.parquet(path)


def explode_commit_changes(commits: DataFrame) -> DataFrame:
    """One row per (commit, Java file); missing counts are 0 and messages are trimmed."""
    def count(name: str):
        return F.coalesce(F.col(f"change.{name}"), F.lit(0)).cast("long")

    rows = commits.select("*", F.explode("files").alias("file_path", "change"))
    return rows.where(is_java_path(F.col("file_path"))).withColumns({
        "commit_message": strip(F.col("commit_message")),
        "lines_added": count("insertions"), "lines_deleted": count("deletions"),
    }).select(*HISTORY_COLUMNS)


def read_features(spark: SparkSession, path: str, provenance: DataFrame | None = None) -> DataFrame:
    """Validated snapshots; given provenance must match the rows."""
    features = clean_features(read_tabular(spark, path, FEATURE_SCHEMA))
    if provenance is not None:
        verify_provenance(provenance, features)
    return features


def source_collisions(tagged: DataFrame) -> DataFrame:
    """Repositories that occur in more than one source (column ``source``)."""
    return tagged.select("repository", "source").distinct().groupBy("repository").agg(
        F.count(F.lit(1)).alias("sources")).where("sources > 1")


def combine_feature_sets(frames: Sequence[DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """Union of snapshot tables; a repository may come from one table only, at least two exist.

    With ``names``, a column ``source`` says which table a row is from.
    """
    if not frames:
        raise DataQualityError("At least one snapshot table is needed.")
    tagged = [df.withColumn("source", F.lit(names[i] if names else str(i))) for i, df in enumerate(frames)]
    combined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    clash = source_collisions(combined).first()
    if clash:
        raise DataQualityError(f"Repository {clash['repository']} occurs in several sources.")
    if combined.select("repository").distinct().limit(2).count() < 2:
        raise DataQualityError("At least two repositories are needed.")
    return clean_features(combined if names else combined.drop("source"), multi_repository=True)


def read_feature_sets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return combine_feature_sets([read_tabular(spark, p, FEATURE_SCHEMA) for p in paths], paths)


# The columns of stored report tables that hold numbers.
_WHOLE = ("rank", "predicted_label", "true_label", "risk_signal_count", "feature_rank", "recurring_high_risk_count",
          "priority_rank")
_REAL = ("risk_score", "decision_threshold", "top_risk_contribution", "top_protective_contribution", "feature_value",
         "model_input_value", "contribution", "absolute_contribution", "normalized_contribution", "predicted_risk",
         "recurring_high_risk_rate", "recurring_hotspot_evidence", "priority_score")


def read_artifact(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A stored report table (parquet, csv or json) with numbers as numbers; texts that are none become null."""
    kind = kind or {"csv": "csv", "json": "json"}.get(path.rstrip("/").rsplit(".", 1)[-1], "parquet")
    if kind == "csv":
        rows = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
                .option("escape", '"').csv(path))
    else:
        rows = spark.read.format(kind).load(path)
    labels = {f.name: f.dataType.simpleString() for f in RANKING_SCHEMA if f.name.endswith("_label")}
    return rows.withColumns({
        c: read_number(F.col(c).cast("string")).cast("double" if c in _REAL else labels.get(c, "bigint"))
        for c in rows.columns if c in (*_WHOLE, *_REAL)})


def read_ranking(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A stored ranking for analyses that need no model; scores and thresholds must be in [0, 1]."""
    rows = read_artifact(spark, path, kind)
    require_columns(rows, ["risk_score"])
    require(violations(rows, [unit_rule(rows, "risk_score")]))
    return rows


def read_report(spark: SparkSession, root: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """The tables of a stored report by name, as ``write_tables`` laid them out; enough to resume it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = sorted(s.getPath().getName() for s in found if s.isDirectory())
    return {n: read_artifact(spark, f"{root.rstrip('/')}/{n}", stored_kind(n, kind)) for n in names}


#: Tables of a report whose rows are nested records.
NESTED_TABLES = ("report", "project_intelligence", "explanation_action_evaluation")


def stored_kind(name: str, kind: str) -> str:
    """Summaries and nested records of a CSV report are JSON."""
    return "json" if kind == "csv" and (name.endswith("summary") or name in NESTED_TABLES) else kind


def load_model(spark: SparkSession, root: str) -> FittedModel:
    """The model that ``save_model`` stored, ready to score and explain."""
    facts = json.loads(spark.read.json(f"{root}/metadata").first()["model"])
    forest = None
    if facts["model_type"] == "random_forest":
        forest = load_forest(spark, f"{root}/model")
    return FittedModel(
        facts["model_type"], prior=facts["prior"], intercept=facts["intercept"], forest=forest,
        linear={k: tuple(v) for k, v in facts["linear_terms"].items()})


def read_provenance(spark: SparkSession, path: str, features: DataFrame | None = None,
                    required: bool = True) -> DataFrame | None:
    """Provenance rows, or the rows named by a manifest that maps repositories to paths.

    Snapshots without provenance may be loaded (``required=False``) but not trained on.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        if required:
            raise PartitionError(f"No provenance at {path}.")
        return None
    manifest = spark.read.schema("sidecars map<string,string>").option("multiLine", True).json(path)
    entries = manifest.where(F.col("sidecars").isNotNull()).select(F.explode("sidecars").alias("r", "p"))
    if features is not None:
        entries = entries.join(features.select(F.col("repository").alias("r")).distinct(), "r")
    paths = [row["p"] for row in entries.select("p").distinct().limit(2).collect()]
    if len(paths) > 1:
        raise PartitionError("A manifest must name one provenance table per snapshot table.")
    if paths:
        base = path.rsplit("/", 1)[0]
        path = paths[0] if "/" in paths[0] else f"{base}/{paths[0]}"
    table = spark.read.schema(PROVENANCE_SCHEMA).json(path)
    if features is not None:
        verify_provenance(table, features)
    return table
