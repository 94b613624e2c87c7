import random

import duckdb
import pytest

from riskloom.llm import owners, queries


def test_trie_with_and_without_spilling():
    draw = random.Random(2)
    strings = [bytes(draw.choices(b"ab", k=draw.randint(0, 12))) for _ in range(3000)]
    strings += [b"ab" * n + b"c" for n in range(200)]
    draw.shuffle(strings)
    want = {}
    for i, s in enumerate(strings):
        low, n = want.get(s, (i, 0))
        want[s] = (min(low, i), n + 1)
    for most in (1 << 40, 3000):
        trie = owners.OwnerTrie(lambda a, b: (min(a[0], b[0]), a[1] + b[1]), most)
        for i, s in enumerate(strings):
            trie.add(s, (i, 1))
        assert (trie.spills > 0) == (most == 3000)
        assert sorted(trie.items()) == sorted(want.items())


@pytest.mark.parametrize("most", [owners.TRIE_BYTES, 2000])
def test_query_against_sql(spark, most):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    got = sorted(map(tuple, owners.exact_owners(docs, trie_bytes=most).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        assert got == sorted(db.execute(queries.ORACLES["op9_exact_dedup"]).fetchall())


def test_odd_rows(odd_docs, no_docs):
    rows = owners.exact_owners(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by_id[1].keep_id, by_id[2].keep_id, by_id[1].group_size) == (1, 1, 3)  # with the null id
    assert by_id[4].group_size == 2 and all(r.kept for r in rows if r.doc_id == 4)
    assert (by_id[5].keep_id, by_id[7].keep_id, by_id[6].keep_id) == (5, 5, 6)
    assert not any(r.kept for r in rows if r.doc_id is None)
    assert owners.exact_owners(no_docs).count() == 0


def test_group_of_null_ids_alone(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [(r.keep_id, r.group_size, r.kept) for r in owners.exact_owners(docs).collect()] == [(None, 2, True)] * 2
