import math
import re
from collections import Counter

import duckdb
import pytest

from riskloom.llm import queries, ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def plain(docs, items, k=20):
    """Every document scored for every item."""
    bags = [(key, Counter(words(t))) for key, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (key, bag), n in zip(bags, sizes):
            score = 0
            for t in words(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 75 + 25 * n * n_docs // total
                    score += w * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, key is None, key))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(scored[:k])]
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("block, chunk, cells, items", [
    (ranked.BLOCK_BYTES, ranked.CHUNK_WORDS, ranked.CELLS, ranked.KEPT_ITEMS), (40_000, 150, 200, 3)])
def test_query_against_sql(spark, monkeypatch, block, chunk, cells, items):
    for name, value in (("BLOCK_BYTES", block), ("CHUNK_WORDS", chunk), ("CELLS", cells), ("KEPT_ITEMS", items)):
        monkeypatch.setattr(ranked, name, value)
    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in queries.op12_ranked_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()]
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = db.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLES['op12_ranked_search']})").fetchall()
    assert in_order(got) == in_order(want)


def test_odd_documents_and_items(spark, odd_docs, no_docs):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    items = [("a", "THE cat cat sat"), ("a", "one"), ("b", None), ("c", " .,"), (None, "one two"), ("d", "é ﬁ 😀"),
             ("e", "absent"), ("f", "one " * 30_000), ("g", " ".join(f"w{i}" for i in range(500)) + " one mat dog")]
    table = spark.createDataFrame(items, "item_id string, text string")
    got = ranked.rank_documents(odd_docs, table, k=4).select("item_id", "rank", "doc_id", "score").collect()
    assert in_order(map(tuple, got)) == in_order(plain(docs, items, 4))
    assert ranked.rank_documents(no_docs, table).count() == 0
    assert ranked.rank_documents(odd_docs, table.limit(0)).count() == 0


def test_equal_scores_take_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 300)
    docs = [(i, "red fox" if i % 3 else "blue") for i in range(200, 0, -1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(7, "blue fox")], "item_id long, text string")
    got = [tuple(r) for r in ranked.rank_documents(frame, items).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(plain(docs, [(7, "blue fox")]))


def test_only_masks_that_matter_are_scored(monkeypatch):
    """Thirty documents with a rare term fill the list, so those with frequent terms alone are never scored."""
    block = object.__new__(ranked.Block)
    block.docs, block.number = list(range(430)), {b"common": 0, b"rare": 1}
    block.places = ranked.np.array([*range(430), *range(400, 430)], "int32")
    block.bounds, block.most = ranked.np.array([0, 430, 460]), ranked.np.array([5, 9])
    block.impacts = ranked.np.array([5] * 430 + [9] * 30, "int64")
    joined, seen = ranked.np.concatenate, []
    monkeypatch.setattr(ranked.np, "concatenate", lambda parts: seen.append(sum(map(len, parts))) or joined(parts))
    assert sorted(block.best([(b"common", 1), (b"rare", 100)], 20, 6)) == [(905, p) for p in range(400, 430)]
    assert seen and max(seen) == 30


def test_the_stored_index_has_small_row_groups(spark, monkeypatch):
    """A task with many blocks neither writes nor reads them in one piece."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(ranked, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(ranked, "GROUP_BYTES", 20_000)
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{j}" for j in range(100))) for i in range(300)], "doc_id long, text string")
    index = ranked.stage_index(docs.coalesce(1))
    groups = []
    for name in index.inputFiles():
        found = pq.ParquetFile(name.removeprefix("file://")).metadata
        groups += [found.row_group(i).num_rows for i in range(found.num_row_groups)]
    assert sum(groups) == index.count() > 60 and max(groups) < 30
