"""Independent SQL for the registered queries, run by DuckDB on the same Parquet tables.

The SQL is written from the definitions (joins, correlated counts, plain windows), not from the
Spark plans. Shared parts are common table expressions that a query pulls in by name.
"""

from __future__ import annotations

from riskloom.functions import text
from riskloom.functions.registry import (
    MISSING_ACTION, MISSING_REASON, NEUTRAL_ACTION, NEUTRAL_REASON, NO_RISK_REASON, REGISTRY,
)
from riskloom.schemas import FIT_ROWS, MODEL_FEATURES, SEED, TARGET
from riskloom.sources.tables import LINEAR_MODEL, TEST_START, VALIDATION_START

V, T = f"DATE '{VALIDATION_START}'", f"DATE '{TEST_START}'"
MODE = "within_project_temporal_test"


def r(expression: str, name: str | None = None) -> str:
    # The nudge keeps decimal ties from depending on the last bit of a sum.
    return f"(round(CAST({expression} AS DOUBLE) + '2.5e-10'::DOUBLE, 6) + 0) AS {name or expression}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def day(expression: str, name: str | None = None) -> str:
    return f"strftime({expression}, '%Y-%m-%d') AS {name or expression}"


def registry_case(feature: str, field: str) -> str:
    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    whens = " ".join(f"WHEN '{name}' THEN {quoted(getattr(g, field))}" for name, g in REGISTRY.items())
    return f"CASE {feature} {whens} END"


FEATURE_LIST = ", ".join(MODEL_FEATURES)
STACK = ", ".join(f"{{'feature': '{f}', 'value': CAST({f} AS DOUBLE)}}" for f in MODEL_FEATURES)
DRIVERS = ", ".join(
    f"{{'feature': '{f}', 'value': CAST({f} AS DOUBLE), "
    f"'z': (CAST({f} AS DOUBLE) - '{m}'::DOUBLE) / '{s}'::DOUBLE, 'w': '{c}'::DOUBLE}}"
    for f, (c, m, s) in LINEAR_MODEL.items())

CTES: dict[str, tuple[list[str], str]] = {
    "history": ([], """
        SELECT r_name AS repository, CAST(o_orderkey AS VARCHAR) AS commit_hash, c_name AS author_name,
               CASE WHEN c_custkey % 10 <> 0 THEN lower(c_name) || '@example.com' END AS author_email,
               o_orderdate AS commit_date,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Fix crash' WHEN '2' THEN 'Add debug fixture'
                    ELSE 'Refactor' END AS commit_message,
               'src/P' || l_partkey || '.java' AS file_path,
               CAST(sum(l_quantity) AS BIGINT) AS lines_added, CAST(sum(l_linenumber) AS BIGINT) AS lines_deleted
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2, 3, 4, 5, 6, 7"""),
    "changes": (["history"], rf"""
        SELECT *, CAST(commit_date AS DATE) AS d,
               regexp_matches(commit_message, '(?i)\b(?:{text.BUG_FIX_WORDS})\b') AS fix,
               CASE WHEN trim(coalesce(author_email, '')) <> '' THEN lower(trim(author_email))
                    ELSE 'name:' || lower(trim(author_name)) END AS developer
        FROM history"""),
    "ends": (["changes"], "SELECT repository, max(d) AS obs FROM changes GROUP BY 1"),
    "months": (["changes"], """
        SELECT last_day(CAST(m AS DATE)) AS s FROM (SELECT unnest(generate_series(
            CAST(date_trunc('month', (SELECT min(d) FROM changes)) AS TIMESTAMP),
            CAST((SELECT max(d) FROM changes) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m)"""),
    "grid": (["changes", "ends", "months"], """
        SELECT f.repository, f.file_path, f.first_day, s
        FROM (SELECT repository, file_path, min(d) AS first_day FROM changes GROUP BY 1, 2) f
             JOIN ends USING (repository) JOIN months ON s >= first_day AND s <= obs - 90"""),
    "feats": (["changes", "grid"], f"""
        SELECT g.repository, g.file_path, g.s AS snapshot_date,
               count(DISTINCT commit_hash) FILTER (d <= s) AS commit_count,
               count(DISTINCT developer) FILTER (d <= s) AS developer_count,
               CAST(sum(lines_added) FILTER (d <= s) AS BIGINT) AS lines_added,
               CAST(sum(lines_deleted) FILTER (d <= s) AS BIGINT) AS lines_deleted,
               CAST(sum(lines_added + lines_deleted) FILTER (d <= s) AS BIGINT) AS code_churn,
               CAST(s - min(d) AS BIGINT) AS file_age_days,
               CAST(s - max(d) FILTER (d <= s) AS BIGINT) AS days_since_last_change,
               count(DISTINCT commit_hash) FILTER (d <= s AND fix) AS previous_bug_fixes,
               CAST(max(CASE WHEN fix AND d > s AND d <= s + 90 THEN 1 ELSE 0 END) AS BIGINT) AS {TARGET}
        FROM grid g JOIN changes c ON g.repository = c.repository AND g.file_path = c.file_path
        GROUP BY 1, 2, 3"""),
    "parted": (["feats", "ends"], f"""
        SELECT *, CASE WHEN snapshot_date + 90 < {V} THEN 'train'
                       WHEN snapshot_date >= {V} AND snapshot_date + 90 < {T} THEN 'validation'
                       WHEN snapshot_date >= {T} AND snapshot_date <= (SELECT min(obs) - 90 FROM ends)
                            AND snapshot_date + 90 <= obs THEN 'test' END AS part,
               CASE WHEN snapshot_date + 90 < {V} THEN NULL
                    WHEN snapshot_date < {V} THEN 'immature_training_label'
                    WHEN snapshot_date < {T} THEN
                         CASE WHEN snapshot_date + 90 >= {T} THEN 'immature_validation_label' END
                    WHEN snapshot_date + 90 > obs THEN 'incomplete_test_label'
                    WHEN snapshot_date > (SELECT min(obs) - 90 FROM ends) THEN 'after_test_end' END AS reason
        FROM feats JOIN ends USING (repository)"""),
    "scored": (["parted"], f"""
        SELECT repository AS project, file_path, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date,
               repository || '|' || file_path || '|' || strftime(snapshot_date, '%Y-%m-%d') AS sample_id,
               w / (w + 12::DOUBLE) AS risk_score, {TARGET} AS true_label, {FEATURE_LIST}
        FROM (SELECT *, CAST(commit_count AS DOUBLE) + 2::DOUBLE * CAST(previous_bug_fixes AS DOUBLE)
                        + CAST(code_churn AS DOUBLE) / 256::DOUBLE AS w FROM parted WHERE part = 'test')"""),
    "expl": (["scored"], f"""
        SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(c) DESC, feature) AS feature_rank,
               CASE WHEN sum(abs(c)) OVER (PARTITION BY sample_id) > 0
                    THEN abs(c) / sum(abs(c)) OVER (PARTITION BY sample_id) ELSE 0 END AS share,
               CASE WHEN c > 0 THEN 'increases_risk' WHEN c < 0 THEN 'decreases_risk' ELSE 'neutral' END AS direction
        FROM (SELECT project, file_path, snapshot_date, sample_id, risk_score, x.feature AS feature, x.value AS value,
                     x.z AS z, CASE WHEN abs(x.w * x.z) <= '1e-12'::DOUBLE THEN 0 ELSE x.w * x.z END AS c
              FROM (SELECT *, unnest([{DRIVERS}]) AS x FROM scored))"""),
    "tops": (["expl"], """
        SELECT sample_id, arg_min(CASE WHEN c > 0 THEN feature END, CASE WHEN c > 0 THEN feature_rank END) AS up,
               max(CASE WHEN c > 0 THEN c END) AS up_c,
               arg_min(CASE WHEN c < 0 THEN feature END, CASE WHEN c < 0 THEN feature_rank END) AS down,
               min(CASE WHEN c < 0 THEN c END) AS down_c,
               count(*) FILTER (c > 0) AS ups, count(*) FILTER (c < 0) AS downs
        FROM expl GROUP BY 1"""),
    "guide": (["tops"], f"""
        SELECT *, CASE WHEN up IS NOT NULL THEN {registry_case('up', 'risk_reason')}
                       WHEN down IS NOT NULL THEN '{NO_RISK_REASON}' ELSE '{NEUTRAL_REASON}' END AS reason,
               CASE WHEN up IS NOT NULL THEN {registry_case('up', 'risk_action')}
                    WHEN down IS NOT NULL THEN {registry_case('down', 'protective_action')}
                    ELSE '{NEUTRAL_ACTION}' END AS act
        FROM tops"""),
    "ranked": (["scored", "guide"], """
        SELECT row_number() OVER (ORDER BY risk_score DESC, project, file_path, snapshot_date) AS rank, *
        FROM scored JOIN guide USING (sample_id)"""),
    "files": (["ranked"], """
        SELECT project, file_path, count(*) AS n, count(*) FILTER (risk_score >= 0.5::DOUBLE) AS high,
               sum(risk_score) AS mass, max(risk_score) AS top
        FROM ranked GROUP BY 1, 2"""),
    "queue": (["ranked", "files"], """
        SELECT *, row_number() OVER (PARTITION BY project ORDER BY priority_score DESC, risk_score DESC, high DESC,
                                     file_path, snapshot_date) AS queue_rank
        FROM (SELECT r.*, f.high, f.high / CAST(f.n AS DOUBLE) AS rate,
                     f.high / CAST(f.n AS DOUBLE) * least(f.high / 2::DOUBLE, 1::DOUBLE) AS evidence,
                     '0.8'::DOUBLE * risk_score + '0.2'::DOUBLE * (f.high / CAST(f.n AS DOUBLE)
                        * least(f.high / 2::DOUBLE, 1::DOUBLE)) AS priority_score
              FROM ranked r JOIN files f USING (project, file_path))"""),
    "tiers": (["queue"], """
        SELECT q.*, place, CASE WHEN place IS NULL THEN 'LOW'
               WHEN place <= greatest(1, ceil('0.1'::DOUBLE * h)) THEN 'CRITICAL'
               WHEN place <= greatest(greatest(1, ceil('0.1'::DOUBLE * h)), ceil('0.3'::DOUBLE * h)) THEN 'HIGH'
               ELSE 'MEDIUM' END AS tier
        FROM queue q LEFT JOIN (
            SELECT sample_id, count(*) OVER (PARTITION BY project) AS h,
                   row_number() OVER (PARTITION BY project ORDER BY priority_score DESC, risk_score DESC, high DESC,
                                      rate DESC, file_path, snapshot_date) AS place
            FROM queue WHERE risk_score >= 0.5::DOUBLE) USING (sample_id)"""),
    "actions": (["tiers", "expl"], """
        SELECT t.*, e.share AS up_share FROM tiers t LEFT JOIN expl e
               ON t.sample_id = e.sample_id AND t.up = e.feature WHERE place IS NOT NULL"""),
    "candidates": (["scored"], """
        SELECT project, 'dummy' AS model, true_label, '0.05'::DOUBLE AS score FROM scored
        UNION ALL SELECT project, 'logistic_regression', true_label, risk_score FROM scored
        UNION ALL SELECT project, 'random_forest', true_label,
                  1::DOUBLE / (1::DOUBLE + CAST(days_since_last_change AS DOUBLE) / 120::DOUBLE) FROM scored"""),
    "curves": (["candidates"], """
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
               sum(pos) OVER (PARTITION BY project, model) AS p, sum(neg) OVER (PARTITION BY project, model) AS n
        FROM (SELECT project, model, score, sum(true_label) AS pos, count(*) - sum(true_label) AS neg
              FROM candidates GROUP BY 1, 2, 3)
        WINDOW w AS (PARTITION BY project, model ORDER BY score DESC)"""),
    "f1s": (["curves"], """
        SELECT *, CASE WHEN pr + re > 0 THEN 2::DOUBLE * pr * re / (pr + re) ELSE 0 END AS f1
        FROM (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS pr,
                     CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) ELSE 0 END AS re FROM curves)"""),
    "areas": (["f1s"], """
        SELECT project, model, max(p) AS positives, max(n) AS negatives,
               sum(neg * (tp - pos + pos / 2::DOUBLE)) / nullif(max(p) * CAST(max(n) AS DOUBLE), 0) AS roc_auc,
               sum(pos * pr) / nullif(CAST(max(p) AS DOUBLE), 0) AS pr_auc
        FROM f1s GROUP BY 1, 2"""),
    "cuts": (["f1s"], """
        SELECT project, model, CASE WHEN p > 0 THEN floor(score * 1e14::DOUBLE) / 1e14::DOUBLE ELSE 0.5 END AS cut
        FROM (SELECT *, row_number() OVER (PARTITION BY project, model ORDER BY f1 DESC, score) AS i FROM f1s)
        WHERE i = 1"""),
    "confusion": (["candidates", "cuts"], """
        SELECT project, model, cut, count(*) FILTER (true_label = 0 AND score < cut) AS tn,
               count(*) FILTER (true_label = 0 AND score >= cut) AS fp,
               count(*) FILTER (true_label = 1 AND score < cut) AS fn,
               count(*) FILTER (true_label = 1 AND score >= cut) AS tp
        FROM candidates JOIN cuts USING (project, model) GROUP BY 1, 2, 3"""),
    "folds": (["confusion", "areas"], """
        SELECT *, model = first_value(model) OVER (PARTITION BY project
                  ORDER BY coalesce(pr_auc, '-inf'::DOUBLE) DESC, f1 DESC, recall DESC, model) AS is_selected_model
        FROM (SELECT project, model, cut AS threshold, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy,
                     coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS "precision",
                     coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
                     coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1, tn, fp, fn, tp,
                     (tp + fp) / CAST(tp + tn + fp + fn AS DOUBLE) AS positive_prediction_rate,
                     positives, negatives, roc_auc, pr_auc,
                     positives / CAST(positives + negatives AS DOUBLE) AS class_prevalence,
                     pr_auc / nullif(positives / CAST(positives + negatives AS DOUBLE), 0) AS pr_auc_lift
              FROM confusion JOIN areas USING (project, model))"""),
    "effects": (["parted"], f"""
        SELECT e.repository AS held_out, x.feature AS feature,
               (avg(x.value) FILTER ({TARGET} = 1) - avg(x.value) FILTER ({TARGET} = 0)) / stddev_pop(x.value) AS coefficient
        FROM (SELECT repository, {TARGET}, unnest([{STACK}]) AS x FROM parted WHERE part IS NOT NULL) p
             JOIN (SELECT DISTINCT repository FROM parted) e ON p.repository <> e.repository
        GROUP BY 1, 2"""),
    "shift": (["parted"], f"""
        SELECT repository AS held_out, feature, tm, ti, hm, hi,
               CASE WHEN ti > 0 THEN (hm - tm) / ti END AS shift
        FROM (
            SELECT e.repository, x.feature AS feature,
                   quantile_cont(x.value, 0.5) FILTER (part <> 'test' AND p.repository <> e.repository) AS tm,
                   quantile_cont(x.value, 0.75) FILTER (part <> 'test' AND p.repository <> e.repository)
                   - quantile_cont(x.value, 0.25) FILTER (part <> 'test' AND p.repository <> e.repository) AS ti,
                   quantile_cont(x.value, 0.5) FILTER (part = 'test' AND p.repository = e.repository) AS hm,
                   quantile_cont(x.value, 0.75) FILTER (part = 'test' AND p.repository = e.repository)
                   - quantile_cont(x.value, 0.25) FILTER (part = 'test' AND p.repository = e.repository) AS hi
            FROM (SELECT repository, part, unnest([{STACK}]) AS x FROM parted WHERE part IS NOT NULL) p
                 CROSS JOIN (SELECT DISTINCT repository FROM parted) e
            GROUP BY 1, 2)"""),
    "hot_signals": (["expl"], """
        SELECT project, file_path, feature, count(*) AS k, sum(c) AS total,
               row_number() OVER (PARTITION BY project, file_path ORDER BY count(*) DESC, round(abs(sum(c)), 9) DESC, feature) AS i
        FROM expl WHERE c > 0 GROUP BY 1, 2, 3"""),
    "hot": (["files"], """
        SELECT *, row_number() OVER (PARTITION BY project ORDER BY high DESC, high / CAST(n AS DOUBLE) DESC,
                  round(mass / n, 12) DESC, top DESC, file_path) AS i FROM files WHERE high >= 2"""),
    "profile": (["expl"], """
        SELECT project, direction, feature, count(*) AS k, sum(c) AS total, avg(c) AS mean_c,
               row_number() OVER (PARTITION BY project, direction ORDER BY count(*) DESC, round(abs(sum(c)), 9) DESC, feature) AS common,
               row_number() OVER (PARTITION BY project, direction ORDER BY round(abs(sum(c)), 9) DESC, feature) AS strong
        FROM expl WHERE c <> 0 GROUP BY 1, 2, 3"""),
    "shares": (["ranked"], """
        SELECT project, sum(risk_score) AS total, count(*) AS n,
               sum(risk_score) FILTER (i <= ceil(n_all * '0.1'::DOUBLE)) AS top10,
               sum(risk_score) FILTER (i <= ceil(n_all * '0.2'::DOUBLE)) AS top20,
               min(i) FILTER (running >= mass_all * 0.5::DOUBLE) AS half
        FROM (SELECT project, risk_score, row_number() OVER w AS i, sum(risk_score) OVER w AS running,
                     count(*) OVER (PARTITION BY project) AS n_all, sum(risk_score) OVER (PARTITION BY project) AS mass_all
              FROM ranked WINDOW w AS (PARTITION BY project ORDER BY risk_score DESC, file_path, snapshot_date
                                       ROWS UNBOUNDED PRECEDING))
        GROUP BY 1"""),
    "trend": (["ranked", "expl"], """
        SELECT m.*, s.feature AS signal, mean_risk - lag(mean_risk) OVER (PARTITION BY m.project ORDER BY m.period) AS delta
        FROM (SELECT project, substr(snapshot_date, 1, 7) AS period, count(*) AS n, avg(risk_score) AS mean_risk,
                     count(*) FILTER (risk_score >= 0.5::DOUBLE) AS high FROM ranked GROUP BY 1, 2) m
        LEFT JOIN (SELECT project, substr(snapshot_date, 1, 7) AS period, feature,
                          row_number() OVER (PARTITION BY project, substr(snapshot_date, 1, 7)
                                             ORDER BY count(*) DESC, round(abs(sum(c)), 9) DESC, feature) AS i
                   FROM expl WHERE c > 0 GROUP BY 1, 2, 3) s
        ON m.project = s.project AND m.period = s.period AND s.i = 1"""),
    "vectors": (["ranked", "expl"], f"""
        SELECT r.project, r.file_path, r.snapshot_date, r.risk_score, list(e.feature ORDER BY e.feature) AS names,
               list(e.c ORDER BY e.feature) AS weights, max(abs(e.c)) AS peak, sum(abs(e.c)) AS total,
               bool_or(e.c <> 0) AS nonzero
        FROM ranked r JOIN (SELECT * FROM expl) e USING (sample_id)
        GROUP BY 1, 2, 3, 4"""),
    "pairs": (["vectors"], """
        SELECT *, CASE WHEN gap > 0 AND gap <= 62 AND names = p_names AND nonzero AND p_nonzero THEN
                  least(1::DOUBLE, greatest(-1::DOUBLE, list_cosine_similarity(weights, p_weights))) END AS similarity
        FROM (SELECT *, date_diff('day', CAST(lag(snapshot_date) OVER w AS DATE), CAST(snapshot_date AS DATE)) AS gap,
                     lag(names) OVER w AS p_names, lag(weights) OVER w AS p_weights, lag(nonzero) OVER w AS p_nonzero
              FROM vectors WINDOW w AS (PARTITION BY project, file_path ORDER BY snapshot_date))"""),
    "quality": (["actions", "expl"], rf"""
        SELECT *, CAST(hotspot AS INT) + 2 + CAST(items > 0 AS INT) + CAST(signals > 0 AS INT) AS flags,
               CAST(1 AS INT) + CAST(refs AS INT) + CAST(concrete AS INT) + CAST(concrete AS INT) AS checks
        FROM (SELECT a.*, high >= 2 AS hotspot,
                     k + CASE WHEN up IS NOT NULL AND NOT list_contains(names, up) THEN 1 ELSE 0 END AS items,
                     greatest(CASE WHEN up IS NULL THEN 0 ELSE 1 END, ups) AS signals,
                     up IS NOT NULL OR len(list_filter(names, lambda f: contains(lower(act || ' ' || reason), f))) > 0 AS refs,
                     regexp_matches(act, '(?i)\b(?:{text.INSPECTION_VERBS})\b')
                     AND regexp_matches(act, '(?i)\b(?:{text.INSPECTION_TARGETS})\b')
                     AND NOT regexp_matches(act, '(?i)\b(?:{text.GENERIC_PHRASES})\b') AS concrete
              FROM actions a JOIN (SELECT sample_id, count(*) FILTER (c <> 0) AS k,
                                          list(feature) FILTER (c <> 0) AS names
                                   FROM expl GROUP BY 1) USING (sample_id))"""),
    "muddled": (["ranked", "expl"], """
        SELECT *, copies = 1 AND fit AS ok, copies = 1 AND fit AND complete_ AND nz AS usable
        FROM (SELECT project, file_path, snapshot_date, model, sum(n) AS copies, sum(n * high) AS high_copies,
                     bool_and(fit) AND project IS NOT NULL AS fit, any_value(kept) AS kept, any_value(k % 5 <> 0) AS complete_,
                     any_value(nz) AS nz, any_value(names) AS names, any_value(weights) AS weights, any_value(peak) AS peak,
                     any_value(total) AS total, any_value(space) AS space
              FROM (SELECT CASE WHEN k % 13 <> 0 THEN r.project END AS project, r.file_path, r.snapshot_date,
                           CASE WHEN k % 17 <> 0 THEN 'logistic_regression' END AS model, CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END AS n,
                           CAST(r.risk_score >= 0.5::DOUBLE AS INT) AS high, k % 7 <> 0 AND k % 19 <> 0 AS fit, v.*,
                           CASE WHEN r.project = 'AFRICA' AND k % 2 = 0 THEN 'probability' ELSE 'log_odds' END AS space
                    FROM ranked r JOIN (
                        SELECT sample_id, k, count(*) AS kept, bool_or(c <> 0) AS nz, list(feature ORDER BY feature) AS names,
                               list(c ORDER BY feature) AS weights, max(abs(c)) AS peak, sum(abs(c)) AS total
                        FROM (SELECT *, CAST(regexp_extract(file_path, '([0-9]+)', 1) AS INT) AS k FROM expl)
                        WHERE feature <> 'code_churn' OR k % 5 <> 0 GROUP BY 1, 2) v USING (sample_id))
              GROUP BY 1, 2, 3, 4)"""),
    "damaged": (["history"], """
        SELECT repository, commit_hash, CASE WHEN n % 97 = 0 THEN '  ' ELSE author_name END AS author_name,
               CASE WHEN n % 89 = 0 THEN 'not a date' ELSE strftime(commit_date, '%Y-%m-%d') END AS commit_date,
               CASE WHEN n % 83 = 0 THEN replace(file_path, '.java', '.txt') ELSE file_path END AS file_path,
               CASE WHEN n % 79 = 0 THEN '1.5' WHEN n % 73 = 0 THEN '-1' ELSE CAST(lines_added AS VARCHAR) END AS lines_added,
               CAST(lines_deleted AS VARCHAR) AS lines_deleted
        FROM (SELECT *, CAST(commit_hash AS BIGINT) AS n FROM history), (SELECT unnest([1, 2]) AS copy)
        WHERE copy = 1 OR n % 71 = 0"""),
    "bad_feats": (["feats"], f"""
        SELECT CASE WHEN file_age_days % 53 = 4 THEN ' ' ELSE repository END AS repository, file_path,
               CASE WHEN file_age_days % 47 <> 3 THEN snapshot_date END AS snapshot_date,
               CASE WHEN code_churn % 43 = 2 THEN 'NaN'::DOUBLE ELSE lines_added END AS lines_added,
               CASE WHEN code_churn % 41 = 1 THEN -1 ELSE lines_deleted END AS lines_deleted,
               CASE WHEN code_churn % 37 = 5 THEN 2 ELSE {TARGET} END AS {TARGET}
        FROM feats"""),
    "damaged_ranking": (["ranked"], """
        SELECT *, score BETWEEN 0 AND 1 AS ok_score, label IN (0, 1) AS ok_label
        FROM (SELECT project, try_cast(CASE WHEN rank % 19 = 0 THEN '1.5' WHEN rank % 23 = 0 THEN 'unknown'
                     ELSE CAST(CAST(round(risk_score, 4) AS DECIMAL(6, 4)) AS VARCHAR) END AS DOUBLE) AS score,
                     CASE WHEN rank % 29 = 0 THEN 2 ELSE true_label END AS label,
                     CASE WHEN rank % 31 <> 0 THEN 'predict_proba' END AS method FROM ranked)"""),
    "cal_bins": ([], """
        SELECT i, i * (1::DOUBLE / 10) AS lo, CASE WHEN i = 9 THEN 1 ELSE (i + 1) * (1::DOUBLE / 10) END AS hi
        FROM (SELECT unnest(range(10)) AS i)"""),
    "cal_cuts": ([], "SELECT i / 20::DOUBLE AS t FROM (SELECT unnest(range(21)) AS i)"),
    "cal_pop": (["ranked"], "SELECT project, risk_score AS score, true_label AS label FROM ranked"),
    "cal_bad": (["damaged_ranking"], "SELECT project, score, label FROM damaged_ranking WHERE ok_score AND ok_label"),
}


def _binned(population: str) -> str:
    return f"""
        SELECT g.project, lo, hi, count(score) AS k, avg(score) AS mean_score, avg(label) AS rate
        FROM (SELECT DISTINCT project FROM {population}) g CROSS JOIN cal_bins b
        LEFT JOIN {population} p ON p.project = g.project AND score >= lo AND (score < hi OR i = 9)
        GROUP BY 1, 2, 3"""


def _swept(population: str) -> str:
    return f"""
        SELECT project, t, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS pr, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS re,
               2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0) AS f1,
               tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS spec, fp / nullif(CAST(tn + fp AS DOUBLE), 0) AS fpr,
               tp + fp AS flagged, 100 * (tp + fp) / nullif(CAST(tp + fp + tn + fn AS DOUBLE), 0) AS pct
        FROM (SELECT project, t, count(*) FILTER (label = 1 AND score >= t) AS tp,
                     count(*) FILTER (label = 0 AND score >= t) AS fp, count(*) FILTER (label = 1 AND score < t) AS fn,
                     count(*) FILTER (label = 0 AND score < t) AS tn
              FROM {population} CROSS JOIN cal_cuts GROUP BY 1, 2)"""


CTES["bins"] = (["cal_pop", "cal_bins"], _binned("cal_pop"))
CTES["sweep"] = (["cal_pop", "cal_cuts"], _swept("cal_pop"))
CTES["bad_bins"] = (["cal_bad", "cal_bins"], _binned("cal_bad"))
CTES["bad_sweep"] = (["cal_bad", "cal_cuts"], _swept("cal_bad"))


def sql(needs: str, body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for dependency in CTES[name][0]:
            visit(dependency)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    parts = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in order)
    if body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return (f"WITH {parts}\n" if parts else "") + body


def _rules(rows: str, rules: list[tuple[str, str]], extra: list[str]) -> str:
    counts = [f"SELECT {i} AS position, '{name}' AS rule, count(*) FILTER ({bad}) AS violations FROM {rows}"
              for i, (name, bad) in enumerate(rules)]
    every = " UNION ALL ".join([*counts, *extra])
    return f"SELECT CAST(position AS BIGINT) AS position, rule, CAST(violations AS BIGINT) AS violations FROM ({every})"


def _number(column: str) -> str:
    return f"try_cast({column} AS DOUBLE)"


def _not_finite(column: str) -> str:
    n = _number(column)
    return f"{n} IS NULL OR NOT isfinite({n}) OR {n} < 0"


HISTORY_RULES = [
    *[(f"blank_{c}", f"{c} IS NULL OR trim({c}) = ''") for c in ("repository", "commit_hash", "author_name", "file_path")],
    ("not_java_file_path", "NOT ends_with(file_path, '.java')"),
    ("invalid_date_commit_date", "try_cast(commit_date AS DATE) IS NULL"),
    *[(f"not_whole_{c}", f"{_not_finite(c)} OR {_number(c)} % 1 <> 0") for c in ("lines_added", "lines_deleted")],
]
_DAMAGED_COLUMNS = {"lines_added", "lines_deleted"}
FEATURE_RULES = [
    *[(f"null_{c}", f"{c} IS NULL" if c in ("repository", "file_path", "snapshot_date", TARGET) else "false")
      for c in ["repository", "file_path", "snapshot_date", *MODEL_FEATURES, TARGET]],
    *[(f"blank_{c}", f"{c} IS NULL OR trim({c}) = ''") for c in ("repository", "file_path")],
    ("invalid_date_snapshot_date", "snapshot_date IS NULL"),
    *[(f"not_finite_non_negative_{c}", _not_finite(c) if c in _DAMAGED_COLUMNS else "false") for c in MODEL_FEATURES],
    (f"not_binary_{TARGET}", f"{TARGET} IS NULL OR {TARGET} NOT IN (0, 1)"),
]
_H, _F = len(HISTORY_RULES), len(FEATURE_RULES)


def _duplicates(rows: str, keys: str, position: int) -> str:
    return (f"SELECT {position}, 'duplicate_key', coalesce(sum(n), 0) FROM "
            f"(SELECT count(*) AS n FROM {rows} GROUP BY {keys} HAVING count(*) > 1)")


def _digest(rows: str, by: str) -> str:
    numbers = ", ".join(f"CAST({c} AS VARCHAR)" for c in (*MODEL_FEATURES, TARGET))
    words = ", ".join(
        f"CAST(sum(CAST('0x' || substr(h, {6 * i + 1}, 6) AS UBIGINT)) AS VARCHAR) AS w{i}" for i in range(6))
    joined = ", ".join(f"w{i}" for i in range(6))
    return f"""
        SELECT {by}, n AS row_count, sha256(concat_ws(':', CAST(n AS VARCHAR), {joined})) AS digest
        FROM (SELECT {by}, count(*) AS n, {words} FROM (
            SELECT {by}, sha256(concat_ws(chr(31), repository, file_path, strftime(snapshot_date, '%Y-%m-%d'), {numbers})) AS h
            FROM {rows}) GROUP BY 1)"""


def _leaves(rows: str, name: str) -> str:
    """Common table expressions of the leaves of a Merkle fold of two hex digits."""
    numbers = ", ".join(f"CAST({c} AS VARCHAR)" for c in (*MODEL_FEATURES, TARGET))
    return f"""
        {name}_rows AS (
            SELECT repository, sha256(concat_ws(chr(31), repository, file_path, strftime(snapshot_date, '%Y-%m-%d'), {numbers})) AS h
            FROM {rows}),
        {name}_counts AS (SELECT repository, h, count(*) AS n FROM {name}_rows GROUP BY 1, 2),
        {name} AS (SELECT repository, substr(h, 1, 2) AS prefix, sum(n)::BIGINT AS rows_,
                          sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS digest FROM {name}_counts GROUP BY 1, 2)"""


def _split_checks(rows: str) -> str:
    """The temporal checks over split rows (part, reason, obs), as tables of a WITH clause."""
    return f"""
        per_part AS (SELECT part, bool_and(snapshot_date + 90 <= obs) AS observed,
                            bool_and(CASE part WHEN 'train' THEN snapshot_date + 90 < {V}
                                     WHEN 'validation' THEN snapshot_date >= {V} AND snapshot_date + 90 < {T}
                                     ELSE snapshot_date >= {T} AND snapshot_date <= (SELECT min(obs) - 90 FROM ends) END) AS eligible
                     FROM {rows} WHERE part IS NOT NULL GROUP BY 1),
        checks AS (
            SELECT part || '_not_empty' AS "check", true AS passed FROM per_part
            UNION ALL SELECT part || '_labels_observed', observed FROM per_part
            UNION ALL SELECT part || '_temporal_eligibility', eligible FROM per_part
            UNION ALL SELECT 'row_accounting', count(part) + count(reason) = count(*) FROM {rows}
            UNION ALL SELECT 'exclusion_accounting', count(*) FILTER (part IS NOT NULL AND reason IS NOT NULL) = 0 FROM {rows}
            UNION ALL SELECT 'disjoint_sample_identities', count(*) = 0 FROM (SELECT 1 FROM {rows} WHERE part IS NOT NULL
                             GROUP BY repository, file_path, snapshot_date HAVING count(DISTINCT part) > 1)
            UNION ALL SELECT 'whole_repository_date_groups', count(*) = 0 FROM (SELECT 1 FROM {rows} WHERE part IS NOT NULL
                             GROUP BY repository, snapshot_date HAVING count(DISTINCT part) > 1)
            UNION ALL SELECT 'ordered_calendar_boundaries', {V} < {T} AND {T} <= min(obs) - 90 FROM ends
            UNION ALL SELECT 'common_observation_coverage', (min(obs) - 90) + 90 <= min(obs) FROM ends)"""


_RANGE = "CASE {0} WHEN 0 THEN '[0.0, 0.2)' WHEN 1 THEN '[0.2, 0.4)' WHEN 2 THEN '[0.4, 0.6)' WHEN 3 THEN '[0.6, 0.8)' ELSE '[0.8, 1.0]' END"
_FOLD_AVERAGES = ", ".join(r(f"avg(\"{c}\")", f"mean_{c}") for c in ("accuracy", "f1", "precision", "recall", "roc_auc"))
_AGGREGATE = f"""
    SELECT model, count(*) AS fold_count, {r('avg(pr_auc)', 'mean_pr_auc')}, {r('median(pr_auc)', 'median_pr_auc')},
           {r('stddev_pop(pr_auc)', 'std_pr_auc')}, {r('min(pr_auc)', 'min_pr_auc')}, {r('max(pr_auc)', 'max_pr_auc')},
           {r('avg(pr_auc_lift)', 'mean_pr_auc_lift')}, {_FOLD_AVERAGES}"""
_FOLD_COLUMNS = ", ".join([
    "project AS held_out_repository", "model", "'validation_selected' AS threshold_strategy", "is_selected_model",
    *[r(f'"{c}"', f'"{c}"') for c in ("threshold", "accuracy", "precision", "recall", "f1")],
    "tn", "fp", "fn", "tp", r("positive_prediction_rate"), big("positives", "positives"),
    big("negatives", "negatives"), r("roc_auc"), r("pr_auc"), r("class_prevalence"), r("pr_auc_lift")])
_QUEUE = f"""queue_rank AS rank, project, file_path AS identifier, snapshot_date, {r('risk_score', 'predicted_risk')},
    ups AS risk_signal_count, high AS recurring_high_risk_count, {r('rate', 'recurring_high_risk_rate')},
    {r('evidence', 'recurring_hotspot_evidence')}, {r('priority_score')}"""
_LOPO_REASON = f"""CASE WHEN partition_ IS NOT NULL THEN NULL
    WHEN src AND s < {V} THEN 'immature_training_label' WHEN src AND s < {T} THEN 'immature_validation_label'
    WHEN NOT src AND s >= {T} AND s + 90 > obs THEN 'incomplete_test_label' WHEN NOT src AND s >= {T} THEN 'after_test_end'
    WHEN NOT src THEN 'held_out_history' ELSE 'source_at_or_after_test_start' END"""



def _logistic(columns: dict[str, str]) -> str:
    """Score of the given linear model over columns by feature, summed in the order of the features."""
    terms = " + ".join(f"(CAST({columns[f]} AS DOUBLE) - '{m}'::DOUBLE) * '{c / s}'::DOUBLE"
                       for f, (c, m, s) in LINEAR_MODEL.items())
    return f"(1 / (1 + exp(-({terms}))))"


def _tree_term(feature: str) -> str:
    """What the given forest of two trees adds along its paths, by split feature."""
    return {
        "commit_count": "(CASE WHEN commit_count <= 5.5 THEN 0.1 - 0.25 ELSE 0.5 - 0.25 END)::DOUBLE / 2",
        "previous_bug_fixes": """(CASE WHEN commit_count <= 5.5 THEN 0 WHEN previous_bug_fixes <= 0.5 THEN 0.3 - 0.5
                                       ELSE 0.7 - 0.5 END)::DOUBLE / 2""",
        "code_churn": "(CASE WHEN code_churn <= 250.5 THEN 0.15 - 0.2 ELSE 0.35 - 0.2 END)::DOUBLE / 2",
        "days_since_last_change": """(CASE WHEN code_churn <= 250.5 THEN 0 WHEN days_since_last_change <= 60.5
                                           THEN 0.6 - 0.35 ELSE 0.2 - 0.35 END)::DOUBLE / 2""",
    }.get(feature, "0::DOUBLE")


def _network(x: str) -> str:
    """Four Feistel rounds over (x div b, x mod b), keyed by the seed and ``rpt``."""
    halves, sides = [f"(({x}) // b)", f"(({x}) % b)"], ("a", "b")
    for turn in range(4):
        i = turn % 2
        halves[i] = (f"(({halves[i]} + ('0x' || substr(md5(({halves[1 - i]}) || '|42|' || rpt || '|{turn}'), 1, 15))::BIGINT) "
                     f"% {sides[i]})")
    return f"{halves[0]} * b + {halves[1]}"


ORACLES: dict[str, str] = {
    "snapshots_monthly": sql("feats", f"SELECT repository, file_path, {day('snapshot_date')}, {FEATURE_LIST}, {TARGET} FROM feats"),
    "change_history": sql("history", "SELECT * FROM history"),
    "month_grid": sql("grid", f"SELECT repository, file_path, {day('s', 'snapshot_date')} FROM grid"),
    "label_window": sql("grid changes", f"""
        SELECT g.repository, {day('s', 'snapshot_date')}, count(*) AS snapshots,
               {big('sum(CASE WHEN f.file_path IS NULL THEN 0 ELSE 1 END)', 'positives')}
        FROM grid g LEFT JOIN (SELECT DISTINCT g.repository, g.file_path, g.s AS hit FROM grid g JOIN changes c
             ON g.repository = c.repository AND g.file_path = c.file_path AND fix AND d > s AND d <= s + 90) f
        ON g.repository = f.repository AND g.file_path = f.file_path AND g.s = f.hit GROUP BY 1, s"""),
    "observation_ends": sql("ends", f"SELECT repository, {day('obs', 'observation_end')} FROM ends"),
    "daily_changes": sql("changes", f"""
        SELECT c.repository, c.file_path, {day('c.d', 'change_day')}, count(*) AS commits,
               {big('sum(lines_added)', 'lines_added')}, {big('sum(lines_deleted)', 'lines_deleted')},
               count(*) FILTER (fix) AS fixes, count(DISTINCT c.developer) FILTER (c.d = f.d) AS new_developers
        FROM changes c JOIN (SELECT repository, file_path, developer, min(d) AS d FROM changes GROUP BY 1, 2, 3) f
             ON c.repository = f.repository AND c.file_path = f.file_path AND c.developer = f.developer
        GROUP BY 1, 2, c.d"""),
    "bug_fix_flags": sql("history", rf"""
        SELECT origin, coalesce(regexp_matches(t, '(?i)\b(?:{text.BUG_FIX_WORDS})\b'), false) AS is_fix, count(*) AS row_count
        FROM (SELECT 'commit' AS origin, commit_message AS t FROM history
              UNION ALL SELECT 'document', text FROM documents) GROUP BY 1, 2"""),
    "developer_identity": sql("changes", "SELECT repository, developer, count(*) AS changes FROM changes GROUP BY 1, 2"),
    "commit_changes": sql("history", """
        SELECT repository, commit_hash, author_name, author_email, commit_date, commit_message, file_path, lines_added,
               CASE WHEN lines_deleted > 2 THEN lines_deleted ELSE 0 END AS lines_deleted
        FROM history WHERE NOT ends_with(file_path, '7.java')"""),
    "repository_urls": r"""
        SELECT page_id, CAST(form AS BIGINT) AS form, owner, name, owner || '/' || name AS slug
        FROM (SELECT page_id, form, CASE WHEN ok THEN owner END AS owner, CASE WHEN ok THEN name END AS name
              FROM (SELECT *, form IN (1, 2) AND regexp_full_match(owner, '[A-Za-z0-9]([A-Za-z0-9-]{0,37}[A-Za-z0-9])?') AS ok,
                           CASE form WHEN 1 THEN 'repo-' || page_id WHEN 2 THEN 'r_' || page_id END AS name
                    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([A-Za-z0-9-]+)', 1) AS owner,
                                 unnest(range(6)) AS form FROM pages)))""",
    "clean_values": f"""
        SELECT event_id, CASE WHEN k IN (0, 1, 2, 6) THEN NULL WHEN k = 3 THEN 'inf' WHEN k = 4 THEN '1e3'
               WHEN k = 5 THEN CAST(user_id AS VARCHAR) WHEN k = 7 THEN strftime(ts, '%Y-%m-%d')
               WHEN k = 8 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-02:00'
               WHEN event_id % 30 = 9 THEN '1d' WHEN event_id % 30 = 19 THEN '0x1p3' ELSE event_type END AS clean_text,
               {r('CASE k WHEN 4 THEN 1000 WHEN 5 THEN user_id END', 'clean_number')},
               CASE k WHEN 7 THEN strftime(ts, '%Y-%m-%d') WHEN 8 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d') END AS utc_day
        FROM (SELECT *, event_id % 10 AS k FROM events)""",
    "history_quality": sql("damaged", _rules("damaged", HISTORY_RULES, [
        _duplicates("damaged", "repository, commit_hash, file_path", _H)])),
    "feature_quality": sql("bad_feats", _rules("bad_feats", FEATURE_RULES, [
        _duplicates("bad_feats", "repository, file_path, snapshot_date", _F),
        f"SELECT {_F + 1}, 'too_few_dates', CASE WHEN count(DISTINCT coalesce(CAST(snapshot_date AS VARCHAR), '')) < 3 THEN 1 ELSE 0 END FROM bad_feats",
        f"""SELECT {_F + 2}, 'too_few_dates_per_repository', count(*) FROM (SELECT repository FROM bad_feats GROUP BY 1
            HAVING count(DISTINCT coalesce(CAST(snapshot_date AS VARCHAR), '')) < 2)"""])),
    "duplicate_keys": """
        SELECT l_orderkey, l_partkey, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "score_quality": sql("scored", """
        SELECT CAST(0 AS BIGINT) AS position, 'not_in_unit_interval_risk_score' AS rule,
               count(*) FILTER (code_churn % 29 = 3 OR code_churn % 31 = 3) AS violations FROM scored
        UNION ALL SELECT 1, 'not_in_unit_interval_decision_threshold', 0"""),
    "snapshot_summary": sql("feats", f"""
        SELECT count(*) AS snapshots, count(DISTINCT repository || '|' || file_path) AS distinct_files,
               {big(f'sum({TARGET})', 'positives')}, {big(f'count(*) - sum({TARGET})', 'negatives')},
               {r(f'sum({TARGET}) * 100.0 / count(*)', 'positive_percentage')} FROM feats"""),
    "repository_summary": sql("feats", f"""
        SELECT repository, count(*) AS snapshots, count(DISTINCT file_path) AS distinct_files,
               {big(f'sum({TARGET})', 'positives')}, {big(f'count(*) - sum({TARGET})', 'negatives')},
               {r(f'sum({TARGET}) / CAST(count(*) AS DOUBLE)', 'positive_rate')},
               {day('min(snapshot_date)', 'start_date')}, {day('max(snapshot_date)', 'end_date')} FROM feats GROUP BY 1"""),
    "quarter_ends": sql("feats", f"""
        SELECT repository, file_path, {day('snapshot_date')}, {FEATURE_LIST}, {TARGET} FROM feats
        WHERE snapshot_date BETWEEN DATE '1999-03-31' AND DATE '2000-12-31' AND month(snapshot_date) % 3 = 0"""),
    "source_collisions": sql("feats", """
        SELECT repository, count(DISTINCT CASE WHEN repository = 'ASIA' AND year(snapshot_date) >= 2000 THEN 'late'
               ELSE repository END) AS sources FROM feats GROUP BY 1 HAVING sources > 1"""),
    "split_boundaries": sql("grid", f"""
        SELECT n AS distinct_dates, {day('max(s) FILTER (i = train)', 'validation_start')},
               {day('max(s) FILTER (i = least(greatest(train + 1, floor(n * 0.85::DOUBLE)), n - 1))', 'test_start')}
        FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n,
                     greatest(1, floor(count(*) OVER () * 0.7::DOUBLE)) AS train FROM (SELECT DISTINCT s FROM grid))
        GROUP BY n"""),
    "partition_summary": sql("parted", f"""
        SELECT part AS partition, {day('min(snapshot_date)', 'start_date')}, {day('max(snapshot_date)', 'end_date')},
               count(*) AS row_count, {big(f'sum({TARGET})', 'positives')}, {big(f'count(*) - sum({TARGET})', 'negatives')},
               {r(f'sum({TARGET}) * 100.0 / count(*)', 'positive_percentage')} FROM parted WHERE part IS NOT NULL GROUP BY 1"""),
    "exclusion_ledger": sql("parted", f"""
        SELECT repository, reason, count(*) AS row_count, {day('min(snapshot_date)', 'start_date')},
               {day('max(snapshot_date)', 'end_date')} FROM parted WHERE reason IS NOT NULL GROUP BY 1, 2"""),
    "partition_audit": sql("parted", f"""
        WITH p AS (SELECT part, count(*) AS n, bool_and(snapshot_date + 90 <= obs) AS observed,
                          count(DISTINCT repository) AS repositories,
                          bool_and(CASE part WHEN 'train' THEN snapshot_date + 90 < {V}
                                   WHEN 'validation' THEN snapshot_date >= {V} AND snapshot_date + 90 < {T}
                                   ELSE snapshot_date >= {T} END) AS eligible
                   FROM parted WHERE part IS NOT NULL GROUP BY 1)
        SELECT part || '_not_empty' AS "check", n > 0 AS passed FROM p
        UNION ALL SELECT part || '_labels_observed', observed FROM p
        UNION ALL SELECT part || '_temporal_eligibility', eligible FROM p
        UNION ALL SELECT 'row_accounting', count(part) + count(reason) = count(*) FROM parted
        UNION ALL SELECT 'exclusion_accounting', count(*) FILTER (part IS NOT NULL AND reason IS NOT NULL) = 0 FROM parted
        UNION ALL SELECT 'repository_coverage', bool_and(repositories = (SELECT count(*) FROM ends)) FROM p
        UNION ALL SELECT 'disjoint_sample_identities', count(*) = 0 FROM (SELECT 1 FROM parted WHERE part IS NOT NULL
                         GROUP BY repository, file_path, snapshot_date HAVING count(DISTINCT part) > 1)
        UNION ALL SELECT 'whole_repository_date_groups', count(*) = 0 FROM (SELECT 1 FROM parted WHERE part IS NOT NULL
                         GROUP BY repository, snapshot_date HAVING count(DISTINCT part) > 1)
        UNION ALL SELECT 'ordered_calendar_boundaries', {V} < {T} AND {T} <= min(obs) - 90 FROM ends
        UNION ALL SELECT 'common_observation_coverage', (min(obs) - 90) + 90 <= min(obs) FROM ends"""),
    "lopo_fold_summary": sql("feats ends", f"""
        SELECT held_out, repository, coalesce(partition_, 'excluded') AS partition, {_LOPO_REASON} AS reason,
               count(*) AS row_count, {big(f'sum({TARGET})', 'positives')}, {day('min(s)', 'start_date')}, {day('max(s)', 'end_date')}
        FROM (SELECT *, CASE WHEN src AND s + 90 < {V} THEN 'train' WHEN src AND s >= {V} AND s + 90 < {T} THEN 'validation'
                        WHEN NOT src AND s >= {T} AND s + 90 <= obs AND s <= (SELECT min(obs) - 90 FROM ends) THEN 'test' END AS partition_
              FROM (SELECT f.*, f.snapshot_date AS s, e.obs, h.repository AS held_out, f.repository <> h.repository AS src
                    FROM feats f JOIN ends e ON f.repository = e.repository CROSS JOIN ends h))
        GROUP BY 1, 2, 3, 4"""),
    "lopo_coverage_gaps": sql("parted", """
        WITH found AS (SELECT DISTINCT repository, part AS partition FROM parted WHERE part IS NOT NULL),
             wanted AS (SELECT repository, partition FROM ends, (SELECT unnest(['train', 'validation', 'test']) AS partition)
                        WHERE (partition = 'test') = (repository = 'ASIA'))
        SELECT *, 'missing' AS gap FROM (SELECT * FROM wanted EXCEPT SELECT * FROM found)
        UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM found EXCEPT SELECT * FROM wanted)"""),
    "frame_digest": sql("feats", _digest("feats", "repository")),
    "merkle_roots": sql("feats", f"""
        SELECT * FROM (WITH {_leaves('feats', 'leaves')},
            inner_ AS (SELECT repository, substr(prefix, 1, 1) AS p, sum(rows_) AS rows_,
                              sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest FROM leaves GROUP BY 1, 2)
            SELECT repository, sum(rows_)::BIGINT AS row_count, sha256(string_agg(p || ':' || digest, ',' ORDER BY p)) AS digest
            FROM inner_ GROUP BY 1)"""),
    "tampered_buckets": sql("feats", f"""
        SELECT * FROM (WITH tampered AS (
            SELECT * REPLACE (CASE WHEN ends_with(file_path, '13.java') THEN commit_count - 1 ELSE commit_count END AS commit_count)
            FROM feats WHERE NOT (file_path = 'src/P7.java' AND snapshot_date = DATE '1996-06-30')),
            {_leaves('feats', 'old')}, {_leaves('tampered', 'new')}
            SELECT coalesce(o.repository, n.repository) AS repository, coalesce(o.prefix, n.prefix) AS prefix,
                   o.rows_ AS rows_before, n.rows_ AS rows_after
            FROM old o FULL JOIN new n ON o.repository = n.repository AND o.prefix = n.prefix
            WHERE o.digest IS DISTINCT FROM n.digest)"""),
    "provenance_contract": sql("feats", """
        SELECT repository, true AS contract, true AS digest_format, true AS observation_end_valid,
               true AS positive_row_count, true AS row_count_matches,
               repository <> 'EUROPE' OR count(*) FILTER (file_age_days = 0) = 0 AS digest_matches
        FROM feats GROUP BY 1"""),
    "tampered_audit": sql("parted", f"""
        WITH d AS (SELECT * REPLACE (CASE WHEN repository = 'ASIA' AND part = 'test' AND starts_with(file_path, 'src/P1') THEN 'train'
                          WHEN repository = 'EUROPE' AND part = 'train' AND month(snapshot_date) % 3 = 0
                               AND ends_with(file_path, '7.java') THEN 'test' ELSE part END AS part)
                   FROM parted WHERE NOT (repository = 'AMERICA' AND coalesce(part, '') = 'validation')),
             {_split_checks('d')},
             now_ AS (SELECT repository, file_path, snapshot_date, part FROM d WHERE part IS NOT NULL),
             then_ AS (SELECT repository, file_path, snapshot_date, part FROM parted WHERE part IS NOT NULL)
        SELECT * FROM checks
        UNION ALL SELECT 'repository_coverage', count(DISTINCT (part, repository)) = 3 * (SELECT count(*) FROM ends) FROM d WHERE part IS NOT NULL
        UNION ALL SELECT 'source_row_accounting', bool_and(r.n + CAST(repository = 'AFRICA' AS INT) = l.n)
                  FROM (SELECT repository, count(*) AS n FROM parted GROUP BY 1) r
                  JOIN (SELECT repository, count(*) AS n FROM d GROUP BY 1) l USING (repository)
        UNION ALL SELECT 'fixed_90_day_horizon', bool_and(CASE WHEN repository = 'AFRICA' THEN 60 ELSE 90 END = 90) FROM ends
        UNION ALL SELECT 'rows_unchanged', count(*) = 0 FROM ((FROM now_ EXCEPT ALL FROM then_) UNION ALL (FROM then_ EXCEPT ALL FROM now_))"""),
    "fold_leakage": sql("feats ends", f"""
        WITH split AS (
            SELECT *, CASE WHEN src AND s + 90 < {V} THEN 'train' WHEN src AND s >= {V} AND s + 90 < {T} THEN 'validation'
                           WHEN NOT src AND s >= {T} AND s + 90 <= obs AND s <= (SELECT min(obs) - 90 FROM ends) THEN 'test' END AS own
            FROM (SELECT f.*, f.snapshot_date AS s, e.obs, f.repository <> 'ASIA' AS src FROM feats f JOIN ends e USING (repository))),
        d AS (SELECT *, CASE WHEN own IS NULL THEN 'some' END AS reason,
                     CASE WHEN NOT src AND strftime(s, '%Y-%m') = '1994-06' THEN 'train' ELSE own END AS part FROM split),
        {_split_checks('d')}
        SELECT * FROM checks
        UNION ALL SELECT 'repository_coverage', bool_and((part = 'test') <> src)
                         AND count(DISTINCT (part, repository)) = 2 * (SELECT count(*) FROM ends) - 1 FROM d WHERE part IS NOT NULL
        UNION ALL SELECT 'held_out_absent_from_training', count(*) = 0 FROM d WHERE NOT src AND part = 'train'
        UNION ALL SELECT 'held_out_absent_from_validation', count(*) = 0 FROM d WHERE NOT src AND part = 'validation'
        UNION ALL SELECT 'held_out_only_in_test', count(*) = 0 FROM d WHERE src AND part = 'test'
        UNION ALL SELECT 'preprocessing_rows_match_training', count(*) FILTER (part = 'train') = count(*) FILTER (own = 'train') FROM d
        UNION ALL SELECT unnest(['repository_excluded', 'file_path_excluded', 'snapshot_date_excluded', 'target_excluded',
                                 'future_fields_excluded', 'predictors_match_whitelist']), true"""),
    "damaged_provenance": sql("feats ends", """
        SELECT repository, horizon = 90 AS contract, length(digest) = 64 AS digest_format,
               try_cast(observed AS DATE) IS NOT NULL AS observation_end_valid, recorded > 0 AS positive_row_count,
               recorded = live AS row_count_matches, length(digest) = 64 AND live = made AS digest_matches
        FROM (SELECT repository, CASE WHEN repository = 'AFRICA' THEN 60 ELSE 90 END AS horizon,
                     substr(sha256(repository), 1, CASE WHEN repository = 'AMERICA' THEN 63 ELSE 64 END) AS digest,
                     CASE WHEN repository = 'ASIA' THEN '1998-02-30' ELSE CAST(obs AS VARCHAR) END AS observed,
                     CASE WHEN repository = 'EUROPE' THEN 0 ELSE made END AS recorded, made, live
              FROM (SELECT repository, count(*) AS made,
                           count(*) FILTER (repository <> 'MIDDLE EAST' OR file_age_days > 0) AS live FROM feats GROUP BY 1)
                   JOIN ends USING (repository))"""),
    "binary_metrics": sql("scored", f"""
        SELECT project, {r("'0.45'::DOUBLE", 'threshold')}, {r('(tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE)', 'accuracy')},
               {r('coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0)', '"precision"')},
               {r('coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0)', 'recall')},
               {r('coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0)', 'f1')}, tn, fp, fn, tp,
               {r('(tp + fp) / CAST(tp + tn + fp + fn AS DOUBLE)', 'positive_prediction_rate')}
        FROM (SELECT project, count(*) FILTER (true_label = 0 AND risk_score < '0.45'::DOUBLE) AS tn,
                     count(*) FILTER (true_label = 0 AND risk_score >= '0.45'::DOUBLE) AS fp,
                     count(*) FILTER (true_label = 1 AND risk_score < '0.45'::DOUBLE) AS fn,
                     count(*) FILTER (true_label = 1 AND risk_score >= '0.45'::DOUBLE) AS tp FROM scored GROUP BY 1)"""),
    "rank_metrics": sql("areas cuts", f"""
        SELECT project, {big('positives', 'positives')}, {big('negatives', 'negatives')}, {r('roc_auc')}, {r('pr_auc')},
               {r('cut', 'f1_threshold')} FROM areas JOIN cuts USING (project, model) WHERE model = 'logistic_regression'"""),
    "fold_metrics": sql("folds", f"SELECT {_FOLD_COLUMNS} FROM folds"),
    "model_selection": sql("folds", "SELECT project, model AS selected_model FROM folds WHERE is_selected_model"),
    "train_scaler": sql("parted", "SELECT count(*) AS n, " + big(f"sum({TARGET})", "positives") + ", "
                        + ", ".join([r(f"avg({f})", f"mean_{f}") for f in MODEL_FEATURES]
                                    + [r(f"stddev_pop({f})", f"std_{f}") for f in MODEL_FEATURES])
                        + " FROM parted WHERE part = 'train'"),
    "feature_medians": sql("parted", f"""
        SELECT part AS partition, x.feature AS feature, {r('median(x.value)', 'median')}
        FROM (SELECT part, unnest([{STACK}]) AS x FROM parted WHERE part IS NOT NULL) GROUP BY 1, 2"""),
    "aggregate_metrics": sql("folds", _AGGREGATE + " FROM folds GROUP BY 1"),
    "coefficient_stability": sql("effects", f"""
        SELECT feature, {r('avg(coefficient)', 'mean_coefficient')}, {r('stddev_pop(coefficient)', 'std_coefficient')},
               {r('up', 'positive_fraction')}, {r('down', 'negative_fraction')}, {r('greatest(up, down, 1 - up - down)', 'sign_consistency')},
               CASE WHEN up = 1 THEN 'consistently_positive' WHEN down = 1 THEN 'consistently_negative' ELSE 'mixed' END AS direction,
               count(*) AS fold_count
        FROM (SELECT *, avg(CAST(coefficient > 0 AS INT)) OVER (PARTITION BY feature) AS up,
                     avg(CAST(coefficient < 0 AS INT)) OVER (PARTITION BY feature) AS down FROM effects) GROUP BY feature, up, down"""),
    "importance_stability": sql("effects", f"""
        SELECT feature, {r('avg(abs(coefficient))', 'mean_importance')}, {r('stddev_pop(abs(coefficient))', 'std_importance')},
               {r('min(abs(coefficient))', 'min_importance')}, {r('max(abs(coefficient))', 'max_importance')}, count(*) AS fold_count
        FROM effects GROUP BY 1"""),
    "cross_importance": sql("effects", f"""
        SELECT 'logistic_regression' AS model, feature, 'native_coefficient' AS method, {r('avg(abs(coefficient))', 'importance')},
               {r('avg(coefficient)', 'effect')}, CASE WHEN min(coefficient) > 0 THEN 'consistently_positive'
               WHEN max(coefficient) < 0 THEN 'consistently_negative' ELSE 'mixed' END AS direction,
               {r('stddev_pop(abs(coefficient))', 'standard_deviation')}, count(*) AS fold_count,
               row_number() OVER (ORDER BY avg(abs(coefficient)) DESC, feature) AS importance_rank
        FROM effects GROUP BY feature"""),
    "dataset_shift": sql("shift", f"""
        SELECT held_out AS held_out_repository, feature, {r('tm', 'training_median')}, {r('ti', 'training_iqr')},
               {r('hm', 'held_out_median')}, {r('hi', 'held_out_iqr')}, {r('shift', 'standardized_median_shift')},
               {r('abs(shift)', 'absolute_standardized_median_shift')} FROM shift"""),
    "largest_shift": sql("shift", f"""
        SELECT held_out AS held_out_repository, feature, {r('abs(shift)', 'absolute_shift')}
        FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY abs(shift) DESC,
                     list_position([{', '.join(repr(f) for f in MODEL_FEATURES)}], feature)) AS i FROM shift WHERE shift IS NOT NULL)
        WHERE i = 1"""),
    "pooled_confusion": sql("folds", "SELECT " + ", ".join(big(f"sum({c})", c) for c in ("tn", "fp", "fn", "tp"))
                            + " FROM folds WHERE is_selected_model"),
    "selected_counts": sql("folds", _AGGREGATE + ", count(*) FILTER (is_selected_model) AS selected_fold_count FROM folds GROUP BY 1"),
    "generalization": sql("folds", f"""
        WITH a AS (SELECT model, avg(pr_auc) AS m, stddev_pop(pr_auc) AS s, max(pr_auc) - min(pr_auc) AS spread FROM folds GROUP BY 1),
             f AS (SELECT string_agg(project, '|' ORDER BY project) FILTER (pr_auc_lift > 1) AS well,
                          string_agg(project, '|' ORDER BY project) FILTER (pr_auc_lift IS NULL OR pr_auc_lift <= 1) AS poor
                   FROM folds WHERE is_selected_model)
        SELECT coalesce(well, '') AS repositories_above_prevalence, coalesce(poor, '') AS repositories_not_above_prevalence,
               b.model AS best_mean_pr_auc_model, {r('b.spread', 'best_model_pr_auc_range')},
               c.model AS most_stable_non_dummy_model, {r('c.s', 'most_stable_non_dummy_pr_auc_std')}
        FROM f, (SELECT * FROM a ORDER BY m DESC, model LIMIT 1) b,
             (SELECT * FROM a WHERE model <> 'dummy' ORDER BY s, model LIMIT 1) c"""),
    "same_project_comparison": sql("folds", f"""
        SELECT project AS repository, model, 'mature_labels_v1' AS protocol, '{VALIDATION_START}' AS validation_start,
               '{TEST_START}' AS test_start, 'common' AS test_end, project AS test_digest,
               {r('pr_auc', 'same_pr_auc')}, {r('f1', 'same_f1')}, {r('roc_auc', 'same_roc_auc')},
               {r('x', 'cross_pr_auc')}, {r('f1', 'cross_f1')}, {r('roc_auc', 'cross_roc_auc')},
               {r('x - pr_auc', 'delta_pr_auc')}, {r('f1 - f1', 'delta_f1')}, {r('roc_auc - roc_auc', 'delta_roc_auc')},
               coalesce(pr_auc > 0 AND x < 0.8::DOUBLE * pr_auc, false) AS materially_worse_pr_auc
        FROM (SELECT *, CASE WHEN project = 'ASIA' THEN pr_auc / 2 ELSE pr_auc END AS x FROM folds WHERE project <> 'EUROPE')"""),
    "linear_explanations": sql("expl", f"""
        SELECT sample_id, feature, {r('c', 'contribution')}, {r('share', 'normalized_contribution')}, direction, feature_rank FROM expl"""),
    "explanations_topk": sql("expl", f"""
        SELECT sample_id, feature, {r('value', 'feature_value')},
               {r('CASE WHEN sum(abs(c)) OVER (PARTITION BY sample_id) > 0 THEN abs(c) / sum(abs(c)) OVER (PARTITION BY sample_id) ELSE 0 END', 'normalized_contribution')},
               feature_rank FROM expl WHERE feature_rank <= 2"""),
    "top_drivers": sql("ranked expl", f"""
        SELECT rank, t.up AS top_risk_feature, {r('t.up_c', 'top_risk_contribution')}, t.down AS top_protective_feature,
               {r('t.down_c', 'top_protective_contribution')}
        FROM ranked r LEFT JOIN (
            SELECT sample_id, arg_min(CASE WHEN c > 0 THEN feature END, CASE WHEN c > 0 THEN feature_rank END) AS up,
                   max(CASE WHEN c > 0 THEN c END) AS up_c,
                   arg_min(CASE WHEN c < 0 THEN feature END, CASE WHEN c < 0 THEN feature_rank END) AS down,
                   min(CASE WHEN c < 0 THEN c END) AS down_c
            FROM expl GROUP BY 1) t ON r.sample_id = t.sample_id"""),
    "explanation_totals": sql("expl", "SELECT count(DISTINCT sample_id) AS explained_samples, count(*) AS contributions FROM expl"),
    "common_directions": sql("expl", """
        SELECT direction, feature, count(*) AS sample_count,
               row_number() OVER (PARTITION BY direction ORDER BY count(*) DESC, feature) AS position
        FROM expl WHERE direction <> 'neutral' GROUP BY 1, 2"""),
    "average_magnitudes": sql("expl", f"SELECT feature, {r('avg(abs(c))', 'average_absolute_contribution')} FROM expl GROUP BY 1"),
    "method_usage": sql("scored", """
        SELECT 'logistic_regression' AS model, 'linear_coefficient_transformed' AS explanation_method,
               'log_odds' AS contribution_space, count(*) AS explained_samples FROM scored"""),
    "insights": sql("guide expl", f"""
        SELECT sample_id, reason AS primary_risk_reason, act AS recommended_action, ups AS risk_signal_count,
               downs AS protective_signal_count, coalesce(list, '') AS insights
        FROM guide LEFT JOIN (
            SELECT sample_id, string_agg(feature || ':' || {registry_case('feature', 'category')} || ':' ||
                   CASE WHEN c > 0 THEN 'risk' ELSE 'protective' END || ':' || feature_rank, '|' ORDER BY feature_rank) AS list
            FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY feature_rank) AS i FROM expl WHERE c <> 0)
            WHERE i <= 3 GROUP BY 1) USING (sample_id)"""),
    "insight_totals": sql("guide", f"""
        SELECT count(*) AS total_samples, count(*) FILTER (ups > 0) AS samples_with_risk_signals,
               count(*) FILTER (downs > 0) AS samples_with_protective_signals, {big('sum(ups)', 'total_risk_signals')},
               {big('sum(downs)', 'total_protective_signals')} FROM guide"""),
    "common_signals": sql("expl", f"""
        SELECT *, CASE WHEN signal_type = 'risk' THEN {registry_case('feature', 'risk_reason')}
                  ELSE {registry_case('feature', 'protective_reason')} END AS interpretation
        FROM (SELECT CASE WHEN c > 0 THEN 'risk' ELSE 'protective' END AS signal_type, feature, count(*) AS sample_count,
                     row_number() OVER (PARTITION BY c > 0 ORDER BY count(*) DESC, feature) AS position,
                     {registry_case('feature', 'category')} AS category
              FROM expl WHERE c <> 0 GROUP BY c > 0, feature)"""),
    "sign_violations": sql("expl", "SELECT feature, count(*) AS violations FROM expl WHERE c < -2 GROUP BY 1"),
    "enriched_ranking": sql("ranked", f"""
        SELECT rank, CASE WHEN project = 'ASIA' THEN '{MISSING_REASON}' ELSE reason END AS primary_risk_reason,
               CASE WHEN project = 'ASIA' THEN '{MISSING_ACTION}' ELSE act END AS recommended_action,
               CASE WHEN project = 'ASIA' THEN 0 ELSE ups END AS risk_signal_count FROM ranked"""),
    "risk_ranking": sql("ranked", f"""
        SELECT rank, {r('risk_score')}, CAST(risk_score >= '0.45'::DOUBLE AS BIGINT) AS predicted_label, true_label, project,
               file_path, snapshot_date, 'logistic_regression' AS model, '{MODE}' AS evaluation_mode,
               'predict_proba' AS score_method, {r("'0.45'::DOUBLE", 'decision_threshold')}, up AS top_risk_feature,
               {r('up_c', 'top_risk_contribution')}, down AS top_protective_feature, {r('down_c', 'top_protective_contribution')},
               reason AS primary_risk_reason, act AS recommended_action, ups AS risk_signal_count FROM ranked"""),
    "risk_summary": sql("scored", f"""
        SELECT count(*) AS total_samples, count(*) FILTER (risk_score >= 0.5::DOUBLE) AS high_risk_sample_count,
               {r('0.5', 'risk_threshold')}, {r('avg(risk_score)', 'mean_risk_score')}, {r('max(risk_score)', 'max_risk_score')},
               'logistic_regression' AS models_used, 'predict_proba' AS score_methods, '0.45' AS decision_thresholds FROM scored"""),
    "top_high_risk": sql("ranked", f"""
        SELECT rank, {r('risk_score')}, CAST(risk_score >= '0.45'::DOUBLE AS BIGINT) AS predicted_label, true_label, project,
               file_path, snapshot_date, 'logistic_regression' AS model, 'predict_proba' AS score_method
        FROM ranked WHERE risk_score >= 0.5::DOUBLE ORDER BY rank LIMIT 10"""),
    "project_summary": sql("ranked", f"""
        SELECT project, count(*) AS total_evaluated_samples, count(*) FILTER (risk_score >= 0.5::DOUBLE) AS high_risk_sample_count,
               {r('count(*) FILTER (risk_score >= 0.5::DOUBLE) * 100.0 / count(*)', 'high_risk_percentage')},
               {r('avg(risk_score)', 'mean_predicted_risk')}, {r('median(risk_score)', 'median_predicted_risk')},
               {r('max(risk_score)', 'maximum_predicted_risk')},
               count(DISTINCT file_path) FILTER (risk_score >= 0.5::DOUBLE) AS unique_risky_entities,
               {r('100', 'identifier_coverage_percentage')} FROM ranked GROUP BY 1"""),
    "risk_bands": sql("ranked", f"""
        SELECT project, {_RANGE.format('b')} AS risk_range, {r('b / 5::DOUBLE', 'minimum')}, {r('(b + 1) / 5::DOUBLE', 'maximum')},
               b = 4 AS inclusive_maximum, {big('coalesce(k, 0)', 'sample_count')},
               {r('coalesce(k, 0) * 100.0 / n', 'percentage_of_samples')}
        FROM (SELECT project, count(*) AS n FROM ranked GROUP BY 1) g CROSS JOIN (SELECT unnest(range(5)) AS b)
        LEFT JOIN (SELECT project, CASE WHEN risk_score < '0.2'::DOUBLE THEN 0 WHEN risk_score < '0.4'::DOUBLE THEN 1
                          WHEN risk_score < '0.6'::DOUBLE THEN 2 WHEN risk_score < '0.8'::DOUBLE THEN 3 ELSE 4 END AS b,
                          count(*) AS k FROM ranked GROUP BY 1, 2) USING (project, b)"""),
    "risk_concentration": sql("shares", f"""
        SELECT project, {r('total', 'aggregate_predicted_risk')}, {big("ceil(n * '0.1'::DOUBLE)", 'top_10_percent_sample_count')},
               {r('top10 / total * 100', 'top_10_percent_risk_share')}, {big("ceil(n * '0.2'::DOUBLE)", 'top_20_percent_sample_count')},
               {r('top20 / total * 100', 'top_20_percent_risk_share')}, {big('half', 'samples_for_half_of_risk')} FROM shares"""),
    "entity_statistics": sql("files", f"""
        SELECT project, file_path AS identifier, n AS observation_count, high AS high_risk_count,
               {r('high / CAST(n AS DOUBLE)', 'high_risk_rate')}, {r('mass / n', 'mean_risk')}, {r('top', 'max_risk')},
               {r('mass', 'aggregate_predicted_risk')} FROM files"""),
    "hotspots": sql("hot hot_signals", f"""
        SELECT project, i AS hotspot_rank, file_path AS identifier, high AS high_risk_count,
               {r('high / CAST(n AS DOUBLE)', 'high_risk_rate')}, {r('mass / n', 'mean_risk')}, {r('top', 'max_risk')},
               coalesce(signals, '') AS signals, coalesce(k, 0) AS action_count
        FROM hot LEFT JOIN (SELECT project, file_path, string_agg(feature || ':' || k, '|' ORDER BY i) AS signals, count(*) AS k
                            FROM hot_signals WHERE i <= 3 GROUP BY 1, 2) USING (project, file_path)"""),
    "repeated_concentration": sql("files", f"""
        SELECT project, count(*) FILTER (high >= 2) AS repeated_high_risk_entity_count,
               {r('coalesce(sum(mass) FILTER (high >= 2), 0) / sum(mass) * 100', 'repeated_entity_risk_percentage')},
               {r('coalesce(sum(high) FILTER (high >= 2), 0) / nullif(CAST(sum(high) AS DOUBLE), 0) * 100', 'repeated_entity_high_risk_percentage')}
        FROM files GROUP BY 1"""),
    "signal_profile": sql("profile scored", f"""
        SELECT project, direction, feature, k AS occurrence_count, {r('total', 'aggregate_contribution')},
               {r('mean_c', 'mean_contribution')}, 'log_odds' AS contribution_spaces,
               'linear_coefficient_transformed' AS explanation_methods, {registry_case('feature', 'category')} AS category,
               {r('k * 100.0 / n', 'percentage_of_samples')}, common AS common_position, strong AS strength_position
        FROM profile JOIN (SELECT project, count(*) AS n FROM scored GROUP BY 1) USING (project)"""),
    "monthly_trend": sql("trend", f"""
        SELECT project, period, n AS sample_count, {r('mean_risk')}, high AS high_risk_count,
               {r('high / CAST(n AS DOUBLE)', 'high_risk_rate')}, signal AS dominant_risk_signal,
               {registry_case('signal', 'category')} AS dominant_risk_signal_category, {r('delta', 'change_in_mean_risk')} FROM trend"""),
    "trend_direction": sql("trend", """
        SELECT project, CASE WHEN count(*) < 2 THEN 'not_available' WHEN arg_max(mean_risk, period) > arg_min(mean_risk, period) THEN 'increasing'
               WHEN arg_max(mean_risk, period) < arg_min(mean_risk, period) THEN 'decreasing' ELSE 'stable' END AS direction
        FROM trend GROUP BY 1"""),
    "priority_queue": sql("queue", f"SELECT {_QUEUE} FROM queue"),
    "top_priorities": sql("queue", f"SELECT {_QUEUE} FROM queue WHERE queue_rank <= 3"),
    "unsupported_analyses": sql("ranked", """
        SELECT project, project = 'ASIA' AND count(*) FILTER (rank % 2 = 0) > 0 AS temporal_unsupported,
               false AS hotspots_unsupported, false AS signals_unsupported FROM ranked GROUP BY 1"""),
    "risk_tiers": sql("tiers", "SELECT project, file_path AS identifier, snapshot_date, place AS priority_rank, tier AS risk_tier FROM tiers"),
    "tier_counts": sql("tiers", "SELECT project, " + ", ".join(
        f"count(*) FILTER (tier = '{t}') AS \"{t}\"" for t in ("CRITICAL", "HIGH", "MEDIUM", "LOW")) + " FROM tiers GROUP BY 1"),
    "attention_levels": sql("files", """
        SELECT project, file_path AS identifier, CASE WHEN high = 0 THEN 'LOW' WHEN high / CAST(n AS DOUBLE) < '0.1'::DOUBLE THEN 'MODERATE'
               WHEN high / CAST(n AS DOUBLE) < '0.25'::DOUBLE THEN 'ELEVATED' ELSE 'HIGH' END AS attention_level FROM files"""),
    "action_queue": sql("actions", f"""
        SELECT project, place AS priority_rank, tier AS risk_tier, file_path AS identifier, snapshot_date,
               {r('risk_score', 'predicted_risk')}, {r('priority_score')}, reason AS short_reason, up AS dominant_signal,
               act AS recommended_action, ups AS risk_signal_count, {r('up_share', 'normalized_contribution')} FROM actions"""),
    "top_actions": sql("actions", """
        SELECT project, place AS priority_rank, tier AS risk_tier, file_path AS identifier, snapshot_date, up AS dominant_signal
        FROM actions WHERE place <= 5"""),
    "priority_fallback": sql("ranked", """
        SELECT project, CAST(greatest(1, ceil('0.1'::DOUBLE * h)) AS BIGINT) AS "CRITICAL",
               CAST(greatest(greatest(1, ceil('0.1'::DOUBLE * h)), ceil('0.3'::DOUBLE * h)) - greatest(1, ceil('0.1'::DOUBLE * h)) AS BIGINT) AS "HIGH",
               CAST(h - greatest(greatest(1, ceil('0.1'::DOUBLE * h)), ceil('0.3'::DOUBLE * h)) AS BIGINT) AS "MEDIUM", n - h AS "LOW"
        FROM (SELECT project, count(*) AS n, count(*) FILTER (risk_score >= '0.4'::DOUBLE) AS h FROM ranked GROUP BY 1)"""),
    "executive_summary": sql("tiers shares hot hot_signals profile trend", f"""
        SELECT g.project, g.n AS total_samples, g.high AS high_risk_count, {r('g.high / CAST(g.n AS DOUBLE)', 'high_risk_rate')},
               {r('g.mean_risk', 'mean_risk')}, {r('s.top10 / s.total * 100', 'top_10_percent_risk_share')},
               {r('s.top20 / s.total * 100', 'top_20_percent_risk_share')}, {big('s.half', 'samples_for_half_of_risk')},
               h.file_path AS top_hotspot, h.high AS top_hotspot_high_risk_count,
               {r('h.high / CAST(h.n AS DOUBLE)', 'top_hotspot_high_risk_rate')}, {r('h.mass / h.n', 'top_hotspot_mean_risk')},
               hs.feature AS top_hotspot_signal, d.direction AS temporal_direction, p.feature AS highest_risk_signal,
               {registry_case('p.feature', 'category')} AS highest_risk_signal_category, p.k AS highest_risk_signal_occurrences,
               {r('p.total', 'highest_risk_signal_contribution')}, g.high AS number_of_priority_items,
               CASE WHEN g.high = 0 THEN 'LOW' WHEN g.high / CAST(g.n AS DOUBLE) < '0.1'::DOUBLE THEN 'MODERATE'
                    WHEN g.high / CAST(g.n AS DOUBLE) < '0.25'::DOUBLE THEN 'ELEVATED' ELSE 'HIGH' END AS overall_attention_level,
               g.c AS tier_critical, g.hi AS tier_high, g.m AS tier_medium, g.l AS tier_low, 'logistic_regression' AS models_used
        FROM (SELECT project, count(*) AS n, count(place) AS high, avg(risk_score) AS mean_risk,
                     count(*) FILTER (tier = 'CRITICAL') AS c, count(*) FILTER (tier = 'HIGH') AS hi,
                     count(*) FILTER (tier = 'MEDIUM') AS m, count(*) FILTER (tier = 'LOW') AS l FROM tiers GROUP BY 1) g
        JOIN shares s ON g.project = s.project LEFT JOIN hot h ON g.project = h.project AND h.i = 1
        LEFT JOIN hot_signals hs ON hs.project = h.project AND hs.file_path = h.file_path AND hs.i = 1
        LEFT JOIN profile p ON p.project = g.project AND p.direction = 'increases_risk' AND p.strong = 1
        LEFT JOIN (SELECT project, CASE WHEN arg_max(mean_risk, period) > arg_min(mean_risk, period) THEN 'increasing'
                          WHEN arg_max(mean_risk, period) < arg_min(mean_risk, period) THEN 'decreasing' ELSE 'stable' END AS direction
                   FROM trend GROUP BY 1) d ON d.project = g.project"""),
    "vector_match": sql("vectors", f"""
        SELECT project, file_path AS path, snapshot_date, CAST(1 AS BIGINT) AS copies,
               CAST(risk_score >= 0.5::DOUBLE AS BIGINT) AS high_copies, {big('len(weights)', 'features')}, true AS complete, nonzero
        FROM vectors"""),
    "explanation_stability": sql("pairs", f"""
        SELECT project, {r('avg(similarity)', 'mean_explanation_similarity')}, {r('median(similarity)', 'median_explanation_similarity')},
               count(*) FILTER (similarity IS NOT NULL OR following IS NOT NULL) AS stability_sample_count,
               count(similarity) AS stability_pair_count
        FROM (SELECT *, lead(similarity) OVER (PARTITION BY project, file_path ORDER BY snapshot_date) AS following FROM pairs) GROUP BY 1"""),
    "action_quality": sql("quality", f"""
        SELECT project, {r('place', 'rank')}, tier, file_path AS identifier, snapshot_date, {r('flags / 5::DOUBLE', 'evidence_coverage_score')},
               {r('checks / 4::DOUBLE', 'specificity_score')}, CASE WHEN checks >= 3 THEN 'HIGH' WHEN checks >= 2 THEN 'MODERATE' ELSE 'LOW' END AS specificity_label,
               hotspot AS has_hotspot_evidence, items > 0 AS has_explanation_evidence, signals > 0 AS has_signal_evidence,
               2 + CAST(hotspot AS BIGINT) + items + signals AS evidence_item_count, items AS explanation_item_count,
               signals AS signal_item_count, refs AS references_signal_or_feature, concrete AS has_concrete_recommendation,
               concrete AS avoids_generic_guidance, CASE WHEN up IS NOT NULL THEN '["' || up || '"]' END AS supporting_signals FROM quality"""),
    "coverage_summary": sql("quality", f"""
        SELECT project, count(*) AS action_count, {r('avg(flags / 5::DOUBLE)', 'mean_evidence_coverage_score')},
               {r('median(flags / 5::DOUBLE)', 'median_evidence_coverage_score')},
               {big('sum(2 + CAST(hotspot AS BIGINT) + items + signals)', 'evidence_item_count')}, count(*) AS has_identifier_count,
               count(*) AS has_timestamp_count, count(*) FILTER (hotspot) AS has_hotspot_evidence_count,
               count(*) FILTER (items > 0) AS has_explanation_evidence_count, count(*) FILTER (signals > 0) AS has_signal_evidence_count
        FROM quality GROUP BY 1"""),
    "specificity_summary": sql("quality", f"""
        SELECT project, count(*) AS action_count, {r('avg(checks / 4::DOUBLE)', 'mean_specificity_score')},
               {r('median(checks / 4::DOUBLE)', 'median_specificity_score')}, count(*) FILTER (checks < 2) AS low_count,
               count(*) FILTER (checks = 2) AS moderate_count, count(*) FILTER (checks >= 3) AS high_count FROM quality GROUP BY 1"""),
    "explanation_alignment": sql("vectors", f"""
        SELECT project, count(*) FILTER (high) AS high_risk_sample_count, count(*) FILTER (high AND nonzero) AS explained_high_risk_count,
               {r('count(*) FILTER (high AND nonzero) / nullif(CAST(count(*) FILTER (high) AS DOUBLE), 0)', 'explanation_coverage_rate')},
               {r('avg(peak / total) FILTER (high AND nonzero)', 'mean_top_feature_share')},
               {r('avg(total) FILTER (high AND nonzero)', 'mean_explanation_strength')},
               count(*) FILTER (high AND nonzero) AS top_feature_share_sample_count,
               count(*) FILTER (high AND nonzero) AS explanation_strength_sample_count
        FROM (SELECT *, risk_score >= 0.5::DOUBLE AS high FROM vectors) GROUP BY 1"""),
    "evaluation_counts": sql("vectors quality", """
        SELECT v.project, evaluated_sample_count, coalesce(action_count, 0) AS action_count, explained_sample_count,
               CAST(0 AS BIGINT) AS samples_with_unknown_risk
        FROM (SELECT project, count(*) AS evaluated_sample_count, count(*) FILTER (nonzero) AS explained_sample_count FROM vectors GROUP BY 1) v
        LEFT JOIN (SELECT project, count(*) AS action_count FROM quality GROUP BY 1) q ON v.project = q.project"""),
    "muddled_match": sql("muddled", f"""
        SELECT project, file_path AS path, snapshot_date, model, {big('copies', 'copies')}, {big('high_copies', 'high_copies')},
               CASE WHEN ok THEN kept END AS features, CASE WHEN ok THEN complete_ END AS complete, ok AND nz AS nonzero FROM muddled"""),
    "muddled_stability": sql("muddled", f"""
        SELECT project, {r('avg(similarity)', 'mean_explanation_similarity')}, {r('median(similarity)', 'median_explanation_similarity')},
               count(*) FILTER (similarity IS NOT NULL OR following IS NOT NULL) AS stability_sample_count,
               count(similarity) AS stability_pair_count
        FROM (SELECT *, lead(similarity) OVER (PARTITION BY project, file_path ORDER BY snapshot_date) AS following
              FROM (SELECT *, CASE WHEN usable AND p_usable AND names = p_names AND gap <= 62 THEN
                           least(1::DOUBLE, greatest(-1::DOUBLE, list_cosine_similarity(weights, p_weights))) END AS similarity
                    FROM (SELECT *, lag(usable) OVER w AS p_usable, lag(names) OVER w AS p_names, lag(weights) OVER w AS p_weights,
                                 date_diff('day', CAST(lag(snapshot_date) OVER w AS DATE), CAST(snapshot_date AS DATE)) AS gap
                          FROM muddled WHERE project IS NOT NULL
                          WINDOW w AS (PARTITION BY project, file_path ORDER BY snapshot_date)))) GROUP BY 1"""),
    "muddled_alignment": sql("muddled", f"""
        SELECT project, {big('sum(high_copies)', 'high_risk_sample_count')}, count(*) FILTER (explained) AS explained_high_risk_count,
               {r('count(*) FILTER (explained) / nullif(CAST(sum(high_copies) AS DOUBLE), 0)', 'explanation_coverage_rate')},
               {r('avg(peak / total) FILTER (explained AND complete_)', 'mean_top_feature_share')},
               {r('CASE WHEN count(DISTINCT space) FILTER (explained) = 1 THEN avg(total) FILTER (explained AND complete_) END', 'mean_explanation_strength')},
               count(*) FILTER (explained AND complete_) AS top_feature_share_sample_count,
               CASE WHEN count(DISTINCT space) FILTER (explained) = 1 THEN count(*) FILTER (explained AND complete_) ELSE 0 END AS explanation_strength_sample_count
        FROM (SELECT *, ok AND nz AND high_copies > 0 AS explained FROM muddled) GROUP BY 1"""),
    "excluded_projects": sql("ranked", f"""
        SELECT count(*) FILTER (rank % 9 = 0 OR rank % 14 = 0) AS excluded_unknown_project_samples, count(*) AS total_samples,
               count(DISTINCT project) FILTER (rank % 9 <> 0 AND rank % 14 <> 0) AS projects,
               count(*) FILTER (rank % 9 <> 0 AND rank % 14 <> 0) AS calibrated_samples FROM ranked"""),
    "partition_quality": sql("parted", f"""
        WITH d AS (SELECT part, repository, file_path, {TARGET} AS y, code_churn AS c,
                          CASE WHEN file_age_days % 53 <> 4 THEN snapshot_date END AS s
                   FROM parted, (SELECT unnest([1, 2]) AS copy) WHERE part IS NOT NULL AND (copy = 1 OR file_age_days % 61 = 7))
        SELECT CAST(0 AS BIGINT) AS position, 'invalid_date_snapshot_date' AS rule, count(*) FILTER (s IS NULL) AS violations FROM d
        UNION ALL SELECT 1, 'not_binary_{TARGET}', count(*) FILTER (c % 37 = 5) FROM d
        UNION ALL SELECT 2, 'duplicate_key', CAST(coalesce(sum(n), 0) AS BIGINT)
                  FROM (SELECT count(*) AS n FROM d GROUP BY part, repository, file_path, s HAVING count(*) > 1)"""),
    "dataset_summary": sql("parted", f"""
        SELECT count(*) AS snapshots, count(DISTINCT repository || '|' || file_path) AS distinct_files,
               {big(f'sum({TARGET})', 'positives')}, {big(f'count(*) - sum({TARGET})', 'negatives')},
               {r(f'sum({TARGET}) * 100.0 / count(*)', 'positive_percentage')}, CAST(8 AS BIGINT) AS predictors,
               count(DISTINCT repository) AS repositories, {day('min(snapshot_date)', 'start_date')}, {day('max(snapshot_date)', 'end_date')},
               (SELECT string_agg(part || ':' || n || ':' || p, '|' ORDER BY part) FROM (
                    SELECT part, count(*) AS n, CAST(sum({TARGET}) AS BIGINT) AS p FROM parted WHERE part IS NOT NULL GROUP BY 1)) AS splits
        FROM parted WHERE part IS NOT NULL"""),
    "project_intelligence": sql("hot profile shares trend queue files", f"""
        SELECT g.project, CAST(g.part AS BIGINT) AS part, s.n AS total_evaluated_samples, {r('s.middle', 'median_predicted_risk')},
               CASE WHEN g.part = 0 THEN 'file_path' END AS identifier_type, s.top_band AS top_band_count,
               up.names AS dominant_risk_signals, down.names AS dominant_protective_signals,
               {big('c.half', 'samples_for_half_of_risk')}, f.repeated_entities, coalesce(h.k, 0) AS hotspot_count, h.first_hotspot,
               h.last_hotspot, up.strongest, t.periods, t.direction, {r('t.last_change', 'last_change')}, s.n AS queue_size, q.top_priorities
        FROM (SELECT project, 0 AS part FROM shares UNION SELECT project, (i - 1) // 500 FROM hot) g
        LEFT JOIN (SELECT project, 0 AS part, count(*) AS n, median(risk_score) AS middle,
                          count(*) FILTER (risk_score >= '0.8'::DOUBLE) AS top_band FROM ranked GROUP BY 1) s USING (project, part)
        LEFT JOIN (SELECT *, 0 AS part FROM shares) c USING (project, part)
        LEFT JOIN (SELECT project, 0 AS part, count(*) FILTER (high >= 2) AS repeated_entities FROM files GROUP BY 1) f USING (project, part)
        LEFT JOIN (SELECT project, 0 AS part, arg_min(feature, strong) AS strongest,
                          string_agg(feature || ':' || k, '|' ORDER BY common) FILTER (common <= 3) AS names
                   FROM profile WHERE direction = 'increases_risk' GROUP BY 1) up USING (project, part)
        LEFT JOIN (SELECT project, 0 AS part, string_agg(feature || ':' || k, '|' ORDER BY common) FILTER (common <= 3) AS names
                   FROM profile WHERE direction = 'decreases_risk' GROUP BY 1) down USING (project, part)
        LEFT JOIN (SELECT project, (i - 1) // 500 AS part, count(*) AS k, arg_min(file_path, i) AS first_hotspot,
                          arg_max(file_path, i) AS last_hotspot FROM hot GROUP BY 1, 2) h USING (project, part)
        LEFT JOIN (SELECT project, 0 AS part, count(*) AS periods, arg_max(delta, period) AS last_change,
                          CASE WHEN count(*) < 2 THEN 'not_available' WHEN arg_max(mean_risk, period) > arg_min(mean_risk, period)
                          THEN 'increasing' WHEN arg_max(mean_risk, period) < arg_min(mean_risk, period) THEN 'decreasing'
                          ELSE 'stable' END AS direction FROM trend GROUP BY 1) t USING (project, part)
        LEFT JOIN (SELECT project, 0 AS part, string_agg(file_path || '@' || snapshot_date, '|' ORDER BY queue_rank) AS top_priorities
                   FROM queue WHERE queue_rank <= 5 GROUP BY 1) q USING (project, part)"""),
    "record_hotspots": sql("hot", f"""
        SELECT project, i AS hotspot_rank, file_path AS identifier, high AS high_risk_count, {r('mass / n', 'mean_risk')} FROM hot"""),
    "action_evaluation": sql("vectors pairs quality", f"""
        SELECT v.project, v.n AS evaluated_sample_count, coalesce(a.n, 0) AS action_count, p.k AS stability_pair_count,
               {r('p.mean_s', 'mean_explanation_similarity')}, {r('a.coverage', 'mean_evidence_coverage_score')},
               coalesce(a.hot, 0) AS has_hotspot_evidence, coalesce(a.signalled, 0) AS has_signal_evidence,
               {r('a.specific', 'mean_specificity_score')}, coalesce(a.moderate, 0) AS moderate_count,
               coalesce(a.strong, 0) AS high_count, v.high AS high_risk_sample_count, {r('v.share', 'mean_top_feature_share')}
        FROM (SELECT project, count(*) AS n, count(*) FILTER (risk_score >= 0.5::DOUBLE) AS high,
                     avg(peak / total) FILTER (risk_score >= 0.5::DOUBLE AND nonzero) AS share FROM vectors GROUP BY 1) v
        JOIN (SELECT project, count(similarity) AS k, avg(similarity) AS mean_s FROM pairs GROUP BY 1) p USING (project)
        LEFT JOIN (SELECT project, count(*) AS n, avg(flags / 5::DOUBLE) AS coverage, count(*) FILTER (hotspot) AS hot,
                          count(*) FILTER (signals > 0) AS signalled, avg(checks / 4::DOUBLE) AS specific,
                          count(*) FILTER (checks = 2) AS moderate, count(*) FILTER (checks >= 3) AS strong
                   FROM quality GROUP BY 1) a USING (project)"""),
    "calibration_bins": sql("bins", f"""
        SELECT project, {r('lo', 'bin_lower')}, {r('hi', 'bin_upper')}, k AS sample_count, {r('mean_score', 'mean_predicted_risk')},
               {r('rate', 'observed_defect_rate')} FROM bins"""),
    "threshold_sweep": sql("sweep", f"""
        SELECT project, {r('t', 'threshold')}, {r('pr', '"precision"')}, {r('re', 'recall')}, {r('f1')}, {r('spec', 'specificity')},
               {r('fpr', 'false_positive_rate')}, {big('flagged', 'files_flagged')}, {r('pct', 'percentage_files_flagged')} FROM sweep"""),
    "calibration_summary": sql("damaged_ranking bad_bins bad_sweep", f"""
        SELECT t.*, populated_bins, {r('brier', 'brier_score')}, {r('ece')}, {r('b.t', 'recommended_threshold')},
               CASE WHEN b.t IS NOT NULL THEN 'available' WHEN valid_samples = 0 THEN 'no_valid_samples' ELSE 'no_positive_labels' END AS recommendation_status,
               {r('b.f1', 'recommended_f1')}, score_methods, unknown_score_method_samples
        FROM (SELECT project, count(*) AS total_samples, count(*) FILTER (ok_score AND ok_label) AS valid_samples,
                     count(*) - count(*) FILTER (ok_score AND ok_label) AS excluded_samples,
                     count(*) FILTER (NOT coalesce(ok_score, false)) AS invalid_score_samples, count(*) FILTER (NOT ok_label) AS invalid_label_samples,
                     count(*) FILTER (ok_score AND ok_label AND label = 1) AS positive_labels,
                     count(*) FILTER (ok_score AND ok_label AND label = 0) AS negative_labels FROM damaged_ranking GROUP BY 1) t
        JOIN (SELECT project, avg((score - label) * (score - label)) AS brier FROM cal_bad GROUP BY 1) USING (project)
        JOIN (SELECT project, 'predict_proba' AS score_methods, count(*) FILTER (ok_score AND ok_label AND method IS NULL) AS unknown_score_method_samples
              FROM damaged_ranking GROUP BY 1) USING (project)
        JOIN (SELECT project, count(*) FILTER (k > 0) AS populated_bins, sum(k * abs(mean_score - rate)) / sum(k) AS ece FROM bad_bins GROUP BY 1) USING (project)
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY project ORDER BY f1 DESC, t DESC) AS i FROM bad_sweep WHERE re IS NOT NULL) b
        ON b.project = t.project AND b.i = 1"""),
    "recommended_thresholds": sql("sweep", f"""
        SELECT project, {r('t', 'recommended_threshold')}, {r('pr', 'recommended_precision')}, {r('re', 'recommended_recall')},
               {r('f1', 'recommended_f1')}, {r('spec', 'recommended_specificity')}, {r('fpr', 'recommended_false_positive_rate')},
               {big('flagged', 'recommended_files_flagged')}, {r('pct', 'recommended_percentage_files_flagged')}
        FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY f1 DESC, t DESC) AS i FROM sweep WHERE re IS NOT NULL) WHERE i = 1"""),
    "fit_sample": sql("parted", f"""
        SELECT repository, file_path, {day('snapshot_date')}, {TARGET}, stratum_rows,
               least(stratum_rows, {FIT_ROWS}) AS sampled_rows, {r(f'all_rows / (2.0 * least(stratum_rows, {FIT_ROWS}))', 'w')}
        FROM (SELECT *, count(*) OVER () AS all_rows, count(*) OVER (PARTITION BY {TARGET}) AS stratum_rows,
                     row_number() OVER (PARTITION BY {TARGET} ORDER BY md5(concat_ws('|', repository, file_path,
                         strftime(snapshot_date, '%Y-%m-%d'), '{SEED}')), repository, file_path, snapshot_date) AS place
              FROM parted WHERE part = 'train') WHERE place <= {FIT_ROWS}"""),
    "forest_paths": sql("parted", """
        SELECT repository AS project, count(*) AS row_count, 0.0::DOUBLE AS largest_gap FROM parted WHERE part = 'test' GROUP BY 1"""),
    "lopo_gradients": sql("parted", f"""
        SELECT held_out AS held_out_repository, feature, count(*) AS training_rows, {big(f'sum({TARGET})', 'positives')},
               0.0::DOUBLE AS gradient, 0.0::DOUBLE AS scaler_gap
        FROM (SELECT DISTINCT repository AS held_out FROM parted WHERE part = 'train') h
        JOIN (SELECT * FROM parted WHERE part = 'train') p ON p.repository <> held_out,
             (SELECT unnest([{', '.join(repr(f) for f in ('intercept', *MODEL_FEATURES))}]) AS feature) GROUP BY 1, 2"""),
    "prior_baseline": sql("parted", f"""
        SELECT repository AS project, {r('max(prior)', 'prior')}, count(*) AS row_count,
               {r(f'avg((prior - {TARGET}) * (prior - {TARGET}))', 'squared_error')}
        FROM parted, (SELECT avg({TARGET}) AS prior FROM parted WHERE part = 'train') WHERE part = 'test' GROUP BY 1"""),
    "tree_explanations": sql("parted", f"""
        SELECT repository AS project, x.feature AS feature, {r('avg(x.c)', 'mean_contribution')},
               {r('avg(abs(x.c))', 'mean_size')}, count(*) FILTER (x.c > 0) AS raised, count(*) AS samples
        FROM (SELECT repository, unnest([{', '.join(f"{{'feature': '{f}', 'c': {_tree_term(f)}}}" for f in MODEL_FEATURES)}]) AS x
              FROM parted WHERE part = 'test') GROUP BY 1, 2"""),
    "median_perturbation": sql("parted", f"""
        SELECT repository AS project, x.feature AS feature, {r('avg(x.c)', 'mean_contribution')},
               {r('avg(abs(x.c))', 'mean_size')}, count(*) AS samples
        FROM (SELECT repository, unnest([{', '.join(
            f"{{'feature': '{f}', 'c': {_logistic({g: 'p.' + g for g in MODEL_FEATURES})} - {_logistic({g: ('m.' if g == f else 'p.') + g for g in MODEL_FEATURES})}}}"
            for f in MODEL_FEATURES)}]) AS x
              FROM parted p, (SELECT {', '.join(f'median(CAST({f} AS DOUBLE)) AS {f}' for f in MODEL_FEATURES)}
                              FROM parted WHERE part = 'test') m
              WHERE part = 'test') GROUP BY 1, 2"""),
    "permutation_importance": sql("parted", f"""
        SELECT 'logistic_regression' AS model, feature, {r('abs(avg(gap))', 'importance')}, {r('avg(gap)', 'effect')},
               'not_applicable' AS direction, 'permutation_average_precision' AS method, {r('stddev_pop(gap)', 'standard_deviation')}
        FROM (WITH RECURSIVE v AS (
                SELECT *, row_number() OVER (ORDER BY repository, file_path, snapshot_date) - 1 AS place
                FROM parted WHERE part = 'validation'),
            side AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b
                     FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM v)),
            walk AS (
                SELECT place, rpt, n, a, b, {_network('place')} AS x FROM v, side, range(5) t(rpt)
                UNION ALL SELECT place, rpt, n, a, b, {_network('x')} AS x FROM walk WHERE x >= n),
            o AS (SELECT v.*, rpt, x FROM v JOIN walk USING (place) WHERE x < n),
            s AS ({' UNION ALL '.join(
                f"SELECT o.rpt, '{f}' AS feature, o.{TARGET} AS y, {_logistic({g: ('q.' if g == f else 'o.') + g for g in MODEL_FEATURES})} AS score FROM o JOIN v q ON q.place = o.x"
                for f in MODEL_FEATURES)}
                UNION ALL SELECT -1, '', {TARGET}, {_logistic({g: g for g in MODEL_FEATURES})} FROM v),
            g AS (SELECT rpt, feature, score, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1, 2, 3),
            w AS (SELECT *, sum(pos) OVER k AS tp, sum(n) OVER k AS seen FROM g
                  WINDOW k AS (PARTITION BY rpt, feature ORDER BY score DESC)),
            areas_ AS (SELECT rpt, feature, sum(pos * (tp / CAST(seen AS DOUBLE))) / sum(pos) AS ap FROM w GROUP BY 1, 2)
            SELECT a.feature, b.ap - a.ap AS gap FROM areas_ a, areas_ b WHERE b.rpt = -1 AND a.rpt >= 0) GROUP BY 2"""),
}
ORACLES["paged_explanations"] = ORACLES["tree_explanations"]
