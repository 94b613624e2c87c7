"""Sinks: stable column orders, one directory per table, distributed writes."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.provenance import verify_provenance
from riskloom.sources.readers import stored_kind
from riskloom.schemas import FEATURE_COLUMNS, HISTORY_COLUMNS, MODEL_FEATURES, TARGET


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, as JSON has neither."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = {c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.col(c)) for c in floats}
    return df.withColumns(bad) if bad else df


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write as parquet, csv or json; nested columns of a CSV become JSON text."""
    if kind == "csv":
        nested = [f.name for f in df.schema
                  if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif kind == "json":
        finite_or_null(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"Unknown kind {kind}.")


def write_history(history: DataFrame, path: str, kind: str = "parquet") -> None:
    write_table(history.select(*HISTORY_COLUMNS), path, kind)


def write_features(features: DataFrame, path: str, provenance: DataFrame | None = None,
                   kind: str = "parquet") -> None:
    """Snapshots in contract order; with provenance, the verified rows go next to them."""
    write_table(features.select(*FEATURE_COLUMNS), path, kind)
    if provenance is not None:
        write_provenance(provenance, features, f"{path.rstrip('/')}.provenance.json")


def write_provenance(provenance: DataFrame, features: DataFrame, path: str) -> None:
    verify_provenance(provenance, features)
    write_table(provenance, path, "json")


def write_tables(tables: Mapping[str, DataFrame], root: str, kind: str = "parquet") -> dict[str, str]:
    """Write every table below one root; returns the path of each."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        write_table(df, paths[name], stored_kind(name, kind))
    return paths


def write_report(tables: Mapping[str, DataFrame], root: str, kind: str = "parquet") -> dict[str, str]:
    """The unified report; missing downstream tables are derived from the retained ones."""
    from riskloom.plans.jobs import resume_report

    return write_tables(resume_report(dict(tables)), root, kind)


def write_calibration(tables: Mapping[str, DataFrame], root: str, kind: str = "parquet") -> dict[str, str]:
    names = ("calibration", "threshold_analysis", "calibration_summary")
    return write_tables({n: tables[n] for n in names}, root, kind)


def write_cross_project(tables: Mapping[str, DataFrame], root: str, kind: str = "parquet") -> dict[str, str]:
    names = ("folds", "aggregate", "model_selection", "selected_thresholds", "coefficient_stability",
             "feature_importance_stability", "dataset_shift", "report")
    return write_tables({n: tables[n] for n in names if n in tables}, root, kind)


def save_model(result, root: str, spark, audit: DataFrame, ranges: DataFrame) -> None:
    """The selected model and one JSON row that documents how it was chosen."""
    best = result.best
    if best.forest is not None:
        best.forest.save(f"{root}/model")
    facts = {
        "model_type": best.name, "selection_metric": "validation_pr_auc",
        "feature_columns": MODEL_FEATURES, "target_column": TARGET,
        "selected_threshold": result.best_threshold, "prior": best.prior,
        "intercept": best.intercept, "linear_terms": {k: list(v) for k, v in best.linear.items()},
        "excluded_columns": [c for c in FEATURE_COLUMNS if c not in MODEL_FEATURES],
    }
    def as_json(table: DataFrame, name: str) -> DataFrame:
        packed = F.to_json(F.sort_array(F.collect_list(F.struct(*table.columns))))
        return finite_or_null(table).agg(F.lit(1).alias("_one"), packed.alias(name))

    row = spark.createDataFrame([(1, json.dumps(facts))], "_one int, model string")
    for name, table in (("validation", result.validation), ("test", result.test),
                        ("leakage_audit", audit), ("date_ranges", ranges)):
        row = row.join(as_json(table, name), "_one")
    write_table(row.drop("_one"), f"{root}/metadata", "json")
