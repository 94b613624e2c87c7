import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import language, queries


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def brute(docs, folds=7, held=2, tune=3):
    """The same model with plain dictionaries."""
    fold = {k: -1 if k is None else zlib.crc32(str(k).encode()) % folds for k, _ in docs}
    one, two, one_t, two_t = Counter(), Counter(), Counter(), Counter()
    for k, text in docs:
        words = tokens(text)
        for h, w in zip([""] + words, words):
            if fold[k] != held:
                one[w] += 1
                two[h, w] += 1
            if fold[k] == tune:
                one_t[w] += 1
                two_t[h, w] += 1
    n, v = sum(one.values()), len(one)
    cells = Counter()
    level = lambda p: round(-math.log2(p) * language.LEVELS) if p > 0 else -1
    bucket = lambda c: c.bit_length()
    for k, text in docs:
        words = tokens(text)
        for h, w in zip([""] + words, words) if fold[k] == tune else []:
            c = one[h] - one_t[h]
            cells[bucket(c), level((two[h, w] - two_t[h, w]) / max(c, 1)),
                  level((one[w] - one_t[w]) / max(1, n - sum(one_t.values())))] += 1
    weights = defaultdict(lambda: [0.3, 0.5, 0.2], language.learn_weights([(*c, m) for c, m in cells.items()], v))
    out = []
    for k, text in docs:
        words, base, score = tokens(text), 0.0, 0.0
        for h, w in zip([""] + words, words):
            a, b, c = weights[bucket(one[h])]
            score += math.log10(a * two[h, w] / max(one[h], 1) + b * one[w] / max(1, n) + c / (v + 1))
            base += math.log10((one[w] + 1) / (n + v + 1))
        out.append((k, fold[k] == held, len(words), sum(one[w] > 0 for w in words), n, base, score))
    return out


def agree(got, want):
    def order(rows):
        return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6)))

    got, want = order(got), order(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6, atol=1e-9)


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "BLOCK_BYTES", 40_000)  # many blocks
    docs = [(r.doc_id, r.text) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows = queries.op7_language_model(spark, "/root/testdata/sf0.001").collect()
    agree(rows, brute(docs))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd_docs, no_docs, spark):
    agree(language.score_texts(odd_docs).collect(), brute([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert language.score_texts(no_docs).count() == 0
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = language.score_texts(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


def test_packing():
    draw = np.random.default_rng(3)
    for high in (1, 200, 70_000, 1 << 40):
        counts = draw.integers(0, high, 1000)
        assert (language.unpack(language.pack(counts)) == counts).all()
    for keys in (np.unique(draw.integers(0, 1 << 63, 5000, dtype="uint64") * np.uint64(2)), np.empty(0, "uint64")):
        assert (language.unpack_keys(language.pack_keys(keys)) == keys).all()


def test_weights_are_the_likeliest():
    level = lambda p: round(-math.log2(p) * language.LEVELS)
    cells = [(4, level(0.5), level(0.01), 60), (4, -1, level(0.01), 30), (4, -1, -1, 10)]
    w = language.learn_weights(cells, 999, rounds=500)[4]
    assert w.sum() == pytest.approx(1)

    def likelihood(x):
        return 60 * math.log(x[0] * 0.5 + x[1] * 0.01 + x[2] / 1000) + 30 * math.log(x[1] * 0.01 + x[2] / 1000) + 10 * math.log(x[2] / 1000)

    for i in range(3):
        for j in range(3):
            other = w.copy()
            other[i], other[j] = other[i] - 0.02, other[j] + 0.02
            if i != j and other.min() > 0:
                assert likelihood(other) < likelihood(w)
