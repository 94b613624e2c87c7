import re

import duckdb
import pytest

from riskloom.llm import phrases, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=13):
    windows = set()
    for name, text in items:
        w = words(text)
        size = min(width, len(w))
        windows |= {(name, tuple(w[i:i + size])) for i in range(len(w) - size + 1) if size and name is not None}
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for name, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(name))
        out.append((key, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block, chunk, piece", [
    (phrases.BLOCK_BYTES, phrases.CHUNK_WORDS, phrases.PIECE_WORDS), (50_000, 300, phrases.PIECE_WORDS), (50_000, 300, 5)])
def test_query_against_sql(spark, monkeypatch, block, chunk, piece):
    monkeypatch.setattr(phrases, "PIECE_WORDS", piece)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "CHUNK_WORDS", chunk)
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op10_decontamination(spark, sf).collect()))
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
        assert got == sorted(db.execute(queries.ORACLES["op10_decontamination"]).fetchall())


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([
        (1, "one"), (2, None), (3, ""), (4, "The CAT sat, on the mat!"), (5, "sat on the mat the cat sat on the mat the cat sat on"),
        (None, "two"), (1, "one two"), (6, "no such words")], "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated)
           for r in phrases.contamination(odd_docs, items, item="item_id").collect()]
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id not in (8, 9)], [tuple(i) for i in items.collect()])
    assert sorted(map(repr, want)) == sorted(repr(g) for g in got if g[0] not in (8, 9))
    assert [g for g in got if g[0] == 8] == [(8, 24_000, 24_000, ["4", "5"], True)]
    assert phrases.contamination(no_docs, items).count() == 0
    clean = phrases.contamination(odd_docs, items.limit(0)).collect()
    assert len(clean) == odd_docs.count() and not any(r.contaminated or r.n_hit for r in clean)


def test_pieces_hold_every_window_once(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE_WORDS", 4)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(12)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    pieces = phrases.item_pieces(items, 3, "item_id", "text").collect()
    assert max(len(p["words"]) for p in pieces) <= 6
    for name, text in enumerate(texts):
        got = sorted(w for p in pieces if p["item"] == str(name) for w in phrases.windows_of(p["words"], 3))
        assert [tuple(map(bytes, w)) for w in got] == sorted(phrases.windows_of(phrases.words_of(text), 3))


def test_near_matches_in_any_order(spark):
    docs = spark.createDataFrame([(1, "x blue red y green"), (2, "green red"), (3, "blue"), (4, "green a a a a a red blue")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([("i", "red green blue")], "item_id string, text string")
    found = phrases.search(phrases.build_index(docs), items, span=3).collect()
    assert {r.key: [tuple(h) for h in r.hits] for r in found if r["items"]} == {1: [(0, 4)]}
