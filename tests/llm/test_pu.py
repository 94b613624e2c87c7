import zlib

import numpy as np
import pytest

from riskloom.llm import pu, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def risk(w, rows_p, rows_u, prior):
    def g(rows):
        return np.array([w[-1] + sum(w[c] for c in r) for r in rows])

    p, u = g(rows_p), g(rows_u)
    return prior * np.logaddexp(0, -p).mean() + max(0.0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())


def test_training_lowers_the_non_negative_risk_and_finds_the_signal():
    draw = np.random.default_rng(4)
    s = pu.PuSettings(folds=4, held=2)

    def rows(n, positive):
        return [sorted({c for c in range(6) if draw.random() < (0.7 if positive and c < 2 else 0.2)}) for _ in range(n)]

    rows_p, rows_u = rows(400, True), rows(240, True) + rows(960, False)
    w = pu.fit_nnpu(rows_p, rows_u, 6, 0.2, s)
    start = np.append(np.zeros(6), np.log(0.25))
    assert risk(w, rows_p, rows_u, 0.2) < risk(start, rows_p, rows_u, 0.2)
    assert min(w[:2]) > 1 > max(abs(w[2:6]))


@pytest.mark.parametrize("query, label, folds, held, recall, false_rate", [
    (queries.op3_toxicity, "toxic", 4, 2, 0.6, 0.03), (queries.op6_quality, "quality", 5, 0, 0.97, 0.1)])
def test_held_out_accuracy(spark, query, label, folds, held, recall, false_rate):
    rows = {r.doc_id: r for r in query(spark, SF).collect()}
    assert len(rows) == queries.table(spark, SF, "documents").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    truth = [(r[label], rows[r.doc_id].predicted) for r in queries.table(spark, SF, "labels").collect()
             if rows[r.doc_id].held_out]
    ones, zeros = [p for y, p in truth if y], [p for y, p in truth if not y]
    assert np.mean(ones) >= recall and np.mean(zeros) <= false_rate


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    s = quality.SETTINGS
    flipped = labels.selectExpr(
        "doc_id", f"IF(pmod(crc32(CAST(doc_id AS string)), {s.folds}) = {s.held}, 1 - quality, quality) AS quality")
    models = [pu.train(docs, x, "quality", quality.style_features, s) for x in (labels, flipped)]
    assert models[0] == models[1]


def test_style_ignores_words_and_sees_junk():
    a, b = quality.style_features("The old man went to sea."), quality.style_features("Der alte Hund kam in Rom.")
    assert a == b
    assert quality.style_features("a b a%%% b### c") != quality.style_features("a b a b c")


def test_stems_that_occur_twice():
    assert {"loser", "losing", "los-", "los-2"}.isdisjoint(toxicity.word_features("Loses"))
    found = toxicity.word_features("Losera loserb LOSERC")
    assert {"losera", "lose-", "lose-2", "loser-", "loser-2"} <= found


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, 1), (None, 1, 1), (5, 1, 1), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    for score in (toxicity.score_toxicity, quality.score_quality):
        rows = score(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert not any(r.held_out for r in rows if r.doc_id is None)
        assert score(no_docs, labels).count() == 0
        assert score(odd_docs, labels.limit(0)).count() == odd_docs.count()
    kept = quality.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()
