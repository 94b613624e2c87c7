import pytest
from pyspark.sql import functions as F

from support import OBSERVATIONS, samples_frame
from riskloom.operators import records
from riskloom.plans import jobs
from riskloom.sources import readers, writers
from riskloom.staging import stage


def rows_of(table):
    """Rows as sorted texts of their fields by name."""
    return sorted(str(sorted(r.asDict(recursive=True).items())) for r in table.collect())


@pytest.fixture(scope="module")
def samples(spark):
    twin = samples_frame(spark, "owner/twin", [(f"x{i}.java", f"2023-0{1 + m}-28", 0.5 + 0.02 * i + 0.01 * m, "code_churn", 0.2 + i)
                                               for i in range(7) for m in range(2)])
    quiet = samples_frame(spark, None, [("z.java", "no day", 0.1, "code_churn", -0.2)])
    return stage(samples_frame(spark).unionByName(twin).unionByName(quiet))


@pytest.fixture(scope="module")
def report(samples):
    return jobs.report_tables(samples, True)


def test_records_hold_the_sections(spark, report, tmp_path):
    paths = writers.write_tables({n: report[n] for n in ("project_intelligence", "explanation_action_evaluation")}, str(tmp_path))
    back = {n: spark.read.parquet(p) for n, p in paths.items()}
    assert back["project_intelligence"].count() == 3
    for name, table in records.project_sections(back["project_intelligence"]).items():
        assert rows_of(table) == rows_of(report[name]), name
    for name, table in records.evaluation_sections(back["explanation_action_evaluation"]).items():
        want = report[name]
        known = want.select(F.coalesce("project", F.lit("")).alias("k")).distinct()
        mine = table.withColumn("k", F.coalesce("project", F.lit(""))).join(known, "k", "left_semi").drop("k")
        assert rows_of(mine) == rows_of(want), name


def test_hotspots_go_on_in_parts(report):
    whole = report["project_intelligence"]
    paged = records.project_records(report, page=3)
    assert {(r["project"], r["part"]): len(r["hotspots"]) for r in paged.collect()} == {
        ("", 0): 0, ("owner/example", 0): 1, ("owner/twin", 0): 3, ("owner/twin", 1): 3, ("owner/twin", 2): 1}
    later = paged.where("part > 0").first()
    assert later["summary"] is None and later["temporal_analysis"] is None and later["developer_priority"] is None
    for name, table in records.project_sections(paged).items():
        assert rows_of(table) == rows_of(records.project_sections(whole)[name]), name
    with pytest.raises(ValueError, match="page"):
        records.project_records(report, page=0)


def test_a_record_against_the_observations(report):
    one = report["project_intelligence"].where("project = 'owner/example'").first()
    scores = sorted(o[2] for o in OBSERVATIONS)
    assert one["summary"]["median_predicted_risk"] == scores[len(scores) // 2]
    assert [b["sample_count"] for b in one["summary"]["risk_score_distribution"]] == [
        sum(lo <= s < lo + 0.2 or (lo == 0.8 and s == 1) for s in scores) for lo in (0.0, 0.2, 0.4, 0.6, 0.8)]
    assert one["summary"]["dominant_risk_signals"][0]["feature"] == "previous_bug_fixes"
    assert one["summary"]["dominant_protective_signals"][0]["feature"] == "file_age_days"
    assert [s["feature"] for s in one["risk_signal_profile"]["strongest_risk_contributors"]] == [
        "previous_bug_fixes", "code_churn", "lines_added"]
    assert [p["period"] for p in one["temporal_analysis"]["periods"]] == ["2023-05", "2023-06", "2023-07"]
    assert one["hotspots"][0]["identifier"] == "lib/Parser.java"
    assert one["developer_priority"]["queue_size"] == len(OBSERVATIONS)
    assert [p["rank"] for p in one["developer_priority"]["top_priorities"]] == [1, 2, 3, 4, 5]


def test_a_project_without_dates_or_actions(report):
    quiet = report["project_intelligence"].where("project = ''").first()
    assert not quiet["temporal_analysis"]["supported"] and quiet["temporal_analysis"]["periods"] == []
    assert quiet["temporal_analysis"]["direction"] == "not_available" and quiet["hotspots"] == []
    record = report["explanation_action_evaluation"].where("project is null").first()
    assert record["evidence_coverage"]["action_count"] == 0
    assert record["evidence_coverage"]["mean_evidence_coverage_score"] is None
    assert record["action_specificity"]["specificity_label_counts"].asDict() == {"LOW": 0, "MODERATE": 0, "HIGH": 0}


def test_overviews(report, samples):
    over = report["project_intelligence_summary"].first()
    assert (over["analysis_scope"], over["project_count"], over["total_evaluated_samples"]) == (
        "per_project", 3, samples.count())
    assert over["unsupported_analyses"] == ["temporal_analysis"] and over["hotspot_identifiers_available"]
    counts = report["action_evaluation_summary"].first()
    assert (counts["project_count"], counts["action_count"]) == (3, report["developer_actions"].count())


def test_empty_report(samples):
    out = jobs.report_tables(samples.limit(0), True)
    assert out["project_intelligence"].isEmpty() and out["explanation_action_evaluation"].isEmpty()
    over = out["project_intelligence_summary"].first()
    assert over["project_count"] == 0 and over["unsupported_analyses"] == ["temporal_analysis", "recurring_hotspots"]


def test_csv_reports_keep_records_nested(spark, report, tmp_path):
    names = ("project_intelligence", "explanation_action_evaluation")
    writers.write_tables({n: report[n] for n in names}, str(tmp_path), "csv")
    again = readers.read_report(spark, str(tmp_path), "csv")
    assert set(again) == set(names)
    assert again["project_intelligence"].where("project = 'owner/twin'").first()["summary"]["total_evaluated_samples"] == 14
