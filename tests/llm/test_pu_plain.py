"""Both classifiers against a version of selection, fit and score in plain loops, over all rows of the smallest tables."""

import math
import zlib

import pytest

from riskloom.llm import pu, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
#: The fit starts where the gradient of the bias is zero in exact arithmetic. Adam divides the rounding of its sum,
#: about 1e-15, by 1e-8, so two ways of adding up part by about 1e-8 in the first step and stay that far apart.
ROUNDING = 1e-6


def plain_fit(rows, prior, s):
    """rows: (names, positive, unlabelled). Weights by name and the bias, by the rules of the estimator and of Adam."""
    n_p, n_u = max(1, sum(p for _, p, _ in rows)), max(1, sum(u for _, _, u in rows))
    copies = [(names, True) for names, p, _ in rows if p] + [(names, False) for names, _, u in rows if u]
    w = {name: 0.0 for names, _, _ in rows for name in names} | {None: math.log(prior / (1 - prior))}
    first, second = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0)
    for step in range(1, s.rounds + 1):
        margins = [w[None] + sum(w[n] for n in names) for names, _ in copies]
        soft = [max(g, 0) + math.log1p(math.exp(-abs(g))) for g in margins]
        below = sum(-prior / n_p * x if p else x / n_u for x, (_, p) in zip(soft, copies)) < 0
        grad = {n: s.decay * w[n] if n is not None else 0.0 for n in w}
        for g, (names, p) in zip(margins, copies):
            chance = 1 / (1 + math.exp(-g))
            slope = (-prior / n_p if p else 1 / n_u) * chance
            if below:
                slope = -slope
            elif p:
                slope += prior / n_p * (chance - 1)
            for n in (*names, None):
                grad[n] += slope
        for n, d in grad.items():
            first[n] = 0.9 * first[n] + 0.1 * d
            second[n] = 0.999 * second[n] + 0.001 * d * d
            w[n] -= s.rate * (first[n] / (1 - 0.9 ** step)) / (math.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
    return w


def plain_model(docs, labels, extract, s):
    """docs: (id, text); labels: (id, 0, 1 or None). All learnable rows fit in the sample here."""
    def learnable(key):
        return zlib.crc32(str(key).encode()) % s.folds != s.held

    marks = {}
    for key, y in labels:
        if y is not None and learnable(key):
            marks[key] = max(marks.get(key, 0), y)
    rate = sum(y > 0 for y in marks.values()) / len(marks)
    prior = min(max(rate - math.sqrt(rate * (1 - rate) / len(marks)), 1e-3), 1 - 1e-3)
    texts = {}
    for key, text in docs:
        if learnable(key):
            texts[text or ""] = texts.get(text or "", False) or marks.get(key, 0) > 0
    n_p, n_u = sum(texts.values()), len(texts)
    counts = {}
    for text, p in texts.items():
        for name in extract(text):
            c = counts.setdefault(name, [0, 0])
            c[0] += p
            c[1] += 1
    chosen = []
    for name, (a, b) in counts.items():
        both = (a + b) / (n_p + n_u)
        spread = math.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
        z = abs(a / n_p - b / n_u) / spread if spread > 0 else 0
        if z >= s.z and a / n_p >= s.lift * b / n_u and max(a, b) >= s.least:
            chosen.append((-z, name))
    names = {name for _, name in sorted(chosen)[:s.features]}
    assert len(chosen) <= s.features
    w = plain_fit([([n for n in sorted(extract(t)) if n in names], p, True) for t, p in texts.items()], prior, s)
    return names, prior, w


@pytest.mark.parametrize("query, label, extract, s", [
    (queries.op3_toxicity, "toxic", toxicity.word_features, toxicity.SETTINGS),
    (queries.op6_quality, "quality", quality.style_features, quality.SETTINGS)])
def test_whole_query_against_loops(spark, query, label, extract, s):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    labels = [(r.doc_id, r[label]) for r in queries.table(spark, SF, "labels").select("doc_id", label).collect()]
    assert len(docs) <= min(s.positives, s.unlabelled)
    names, prior, w = plain_model(docs, labels, extract, s)
    model = pu.train(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"), label, extract, s)
    assert set(model.weights) == names and model.prior == pytest.approx(prior, abs=1e-12)
    assert model.bias == pytest.approx(w[None], abs=ROUNDING)
    for name in names:
        assert model.weights[name] == pytest.approx(w.get(name, 0.0), abs=ROUNDING)
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    assert len(got) == len(docs)
    for key, text in docs:
        margin = w[None] + sum(w.get(n, 0.0) for n in extract(text or "") if n in names)
        want = 1 / (1 + math.exp(-margin))
        assert got[key].score == pytest.approx(want, abs=ROUNDING)
        assert got[key].predicted == int(got[key].score >= 0.3)
        assert got[key].held_out == (zlib.crc32(str(key).encode()) % s.folds == s.held)
