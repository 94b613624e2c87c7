import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from riskloom.llm import queries, repeats

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(words):
    """(start, length, period) of all runs, straight from the definition."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(24, 3 * q):
                found.setdefault((start, end + q - start), q)
            start = end + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_text(rnd):
    words = [str(rnd.randrange(rnd.choice([1, 2, 3, 10, 200]))) for _ in range(rnd.choice([0, 1, 5, 40, 200]))]
    for _ in range(rnd.randint(0, 4)):
        p = rnd.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64])
        period = [str(rnd.randrange(3)) for _ in range(p)]
        length = rnd.choice([23, 24, 25, 3 * p - 1, 3 * p, 3 * p + 1, 4 * p, 10 * p])
        words += (period * (length // p + 1))[:length]
        words += [str(rnd.randrange(50)) for _ in range(rnd.choice([0, 1, 9]))]
    return words


def found_in(texts):
    word, symbols, edges = repeats.numbered([[w.encode() for w in t] for t in texts])
    start, end, period = repeats.runs_of(word, symbols, edges)
    out = [[] for _ in texts]
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        i = int(np.searchsorted(edges, s, "right")) - 1
        out[i].append((s - int(edges[i]), e - s, q))
    return out


def test_random_texts():
    rnd = random.Random(11)
    for _ in range(60):
        texts = [random_text(rnd) for _ in range(rnd.randint(1, 5))]
        assert found_in(texts) == [plain(t) for t in texts]


def test_grammar_spells_its_text():
    rnd = random.Random(3)
    texts = [[w.encode() for w in random_text(rnd)] for _ in range(6)]
    word, symbols, edges = repeats.numbered(texts)
    grammar = repeats.Grammar(word, symbols)
    spelled = {}
    for rule, place, left, whole in zip(grammar.rule, grammar.place, grammar.left, grammar.whole):
        part = word[place:place + whole].tolist()
        assert spelled.setdefault(rule, (left, part)) == (left, part)
        assert not np.any((edges > place) & (edges < place + whole))
    assert len(spelled) == grammar.rules > 0


def test_few_candidates_at_once(monkeypatch):
    monkeypatch.setattr(repeats, "CANDIDATES", 7)
    texts = [["a"] * 300, ["a", "b", "a"] * 40, []]
    assert found_in(texts) == [plain(t) for t in texts] == [[(0, 300, 1)], [(0, 120, 3)], []]


def test_long_stretches():
    texts = [["a"] * 100_000 + ["b"], (["a"] * 30 + ["b"]) * 900]
    one, many = found_in(texts)
    assert one == [(0, 100_000, 1)]
    assert many == sorted([(31 * i, 30, 1) for i in range(900)] + [(0, 27_900, 31)], key=lambda x: (x[0], x[2]))


def test_failed_hashes(monkeypatch):
    """Hashes of single words that agree too often: the texts are searched again word by word."""
    thue = ["ab"[bin(i).count("1") & 1] for i in range(3000)]
    texts = [thue, thue * 3, ["a", "b"] * 40]
    want = [plain(t) for t in texts]
    assert found_in(texts) == want
    real = repeats.Hashes.equal
    monkeypatch.setattr(repeats.Hashes, "equal", lambda self, x, y, size: real(self, x, y, size) | (size > 50))
    assert found_in(texts) == want


def test_odd_documents(spark, odd_docs, no_docs):
    got = {}
    for row in repeats.collapse_runs(odd_docs).collect():
        got.setdefault(row["doc_id"], []).append((row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert len(got[4]) == len(got[None]) == 2
    assert got[8] == [(24_000, [(0, 24_000, 6)], "the cat sat on the mat")]
    assert got[10] == [(3, [], "é▁ﬁ😀\x00 　a b")] or got[10][0][1] == []
    assert repeats.collapse_runs(no_docs).count() == 0


def test_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    tailed = 0
    for key, text in texts.items():
        words = [w for w in SPACE.split(text or "") if w]
        h, n = zlib.crc32(str(key).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            tailed += 1
        runs = plain(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        row = rows[key]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(kept(words, runs).encode()).hexdigest()
    assert tailed > 5


@pytest.mark.parametrize("text", [None, "", " "])
def test_tails_of_empty_texts(spark, text):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = spark.createDataFrame([(i, text) for i in [*ids, None]], "doc_id long, text string")
    assert {r["text"] for r in queries.with_tails(docs).collect()} == {text}
