"""Column contracts, Spark schemas and domain constants."""

from __future__ import annotations

from pyspark.sql import types as T

# The published column contracts and domain constants.
HISTORY_COLUMNS = [
    "repository", "commit_hash", "author_name", "author_email", "commit_date",
    "commit_message", "file_path", "lines_added", "lines_deleted",
]
SNAPSHOT_KEYS = ["repository", "file_path", "snapshot_date"]
MODEL_FEATURES = [
    "commit_count", "developer_count", "lines_added", "lines_deleted",
    "code_churn", "file_age_days", "days_since_last_change", "previous_bug_fixes",
]
TARGET = "defect_next_90_days"
FEATURE_COLUMNS = [*SNAPSHOT_KEYS, *MODEL_FEATURES, TARGET]

RANKING_COLUMNS = [
    "rank", "risk_score", "predicted_label", "true_label", "project", "file_path",
    "snapshot_date", "model", "evaluation_mode", "score_method",
    "decision_threshold", "top_risk_feature", "top_risk_contribution",
    "top_protective_feature", "top_protective_contribution",
    "primary_risk_reason", "recommended_action", "risk_signal_count",
]
SAMPLE_KEYS = ["project", "file_path", "snapshot_date", "model", "evaluation_mode"]
EXPLANATION_COLUMNS = [
    "sample_id", "project", "file_path", "snapshot_date", "risk_score",
    "predicted_label", "true_label", "model", "evaluation_mode",
    "explanation_method", "contribution_space", "feature", "feature_value",
    "model_input_value", "contribution", "absolute_contribution",
    "normalized_contribution", "direction", "feature_rank",
]
PRIORITY_COLUMNS = [
    "rank", "project", "identifier", "snapshot_date", "predicted_risk",
    "primary_risk_reason", "recommended_action", "risk_signal_count",
    "recurring_high_risk_count", "recurring_high_risk_rate",
    "recurring_hotspot_evidence", "priority_score",
]
ACTION_COLUMNS = [
    "project", "priority_rank", "risk_tier", "identifier", "file_path",
    "snapshot_date", "predicted_risk", "priority_score", "short_reason",
    "dominant_signal", "recommended_action", "supporting_evidence",
]
EVIDENCE_FLAGS = [
    "has_identifier", "has_timestamp", "has_hotspot_evidence",
    "has_explanation_evidence", "has_signal_evidence",
]
SPECIFICITY_FLAGS = [
    "references_identifier", "references_signal_or_feature",
    "has_concrete_recommendation", "avoids_generic_guidance",
]
QUALITY_COLUMNS = [
    "project", "rank", "tier", "identifier", "snapshot_date", "risk_score",
    "evidence_coverage_score", "specificity_score", "specificity_label",
    *EVIDENCE_FLAGS, "evidence_item_count", "explanation_item_count",
    "signal_item_count", *SPECIFICITY_FLAGS, "recurring_high_risk_count",
    "risk_signal_count", "dominant_signal", "short_reason",
    "recommended_action", "supporting_explanations", "supporting_signals",
    "supporting_evidence",
]
CALIBRATION_COLUMNS = [
    "project", "bin_lower", "bin_upper", "sample_count", "mean_predicted_risk",
    "observed_defect_rate",
]
THRESHOLD_COLUMNS = [
    "project", "threshold", "precision", "recall", "f1", "specificity",
    "false_positive_rate", "files_flagged", "percentage_files_flagged",
]

LABEL_HORIZON_DAYS = 90
DEFAULT_CUTOFF = 0.5
TOP_RISK = 10
MODEL_ORDER = ["dummy", "logistic_regression", "random_forest"]
SEED = 42
FOREST_TREES = 200
FIT_ROWS = 1_000  # rows of each class in the bounded sample of ``fit_sample``
CONTRIBUTION_EPSILON = 1e-12
RISK_BAND_EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
PRIORITY_RISK_WEIGHT = 0.80
PRIORITY_HOTSPOT_WEIGHT = 0.20
RISK_TIERS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
CRITICAL_SHARE = 0.10
HIGH_SHARE = 0.30
ATTENTION_RATES = (0.10, 0.25)
STABILITY_MAX_GAP_DAYS = 62
CALIBRATION_BINS = 10
ANALYSIS_THRESHOLDS = [i / 20 for i in range(21)]
PLACEHOLDERS = [
    "", "nan", "nat", "none", "null", "<na>", "unknown", "unavailable", "not_available",
]
PROTOCOL = "mature_labels_v1"
DATE_CONVENTION = "UTC_calendar_day; features_through_day; label_(T,T+90d]"
WITHIN_MODE = "within_project_temporal_test"
CROSS_MODE = "cross_project_held_out_folds"


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


HISTORY_SCHEMA = _struct(
    ("repository", T.StringType(), False),
    ("commit_hash", T.StringType(), False),
    ("author_name", T.StringType(), False),
    ("author_email", T.StringType(), True),
    ("commit_date", T.StringType(), False),
    ("commit_message", T.StringType(), True),
    ("file_path", T.StringType(), False),
    ("lines_added", T.LongType(), False),
    ("lines_deleted", T.LongType(), False),
)

COMMIT_SCHEMA = _struct(
    ("repository", T.StringType(), False),
    ("commit_hash", T.StringType(), False),
    ("author_name", T.StringType(), False),
    ("author_email", T.StringType(), True),
    ("commit_date", T.StringType(), False),
    ("commit_message", T.StringType(), True),
    ("files", T.MapType(T.StringType(), _struct(
        ("insertions", T.LongType(), True), ("deletions", T.LongType(), True))), True),
)

FEATURE_SCHEMA = _struct(
    ("repository", T.StringType(), False),
    ("file_path", T.StringType(), False),
    ("snapshot_date", T.DateType(), False),
    *[(name, T.DoubleType(), False) for name in MODEL_FEATURES],
    (TARGET, T.IntegerType(), False),
)

RANKING_SCHEMA = _struct(
    ("rank", T.LongType(), True),
    ("risk_score", T.DoubleType(), True),
    ("predicted_label", T.IntegerType(), True),
    ("true_label", T.IntegerType(), True),
    *[(name, T.StringType(), True) for name in
      ("project", "file_path", "snapshot_date", "model", "evaluation_mode", "score_method")],
    ("decision_threshold", T.DoubleType(), True),
    ("top_risk_feature", T.StringType(), True),
    ("top_risk_contribution", T.DoubleType(), True),
    ("top_protective_feature", T.StringType(), True),
    ("top_protective_contribution", T.DoubleType(), True),
    ("primary_risk_reason", T.StringType(), True),
    ("recommended_action", T.StringType(), True),
    ("risk_signal_count", T.LongType(), True),
)

PROVENANCE_SCHEMA = _struct(
    ("repository", T.StringType(), True),
    ("observation_end", T.StringType(), True),
    ("source_history_digest", T.StringType(), True),
    ("feature_digest", T.StringType(), True),
    ("row_count", T.LongType(), True),
    ("schema_version", T.LongType(), True),
    ("generator_version", T.StringType(), True),
    ("target", T.StringType(), True),
    ("horizon_days", T.LongType(), True),
    ("date_convention", T.StringType(), True),
)
