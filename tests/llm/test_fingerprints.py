import random
import re

import numpy as np
import pytest
import xxhash

from riskloom.llm import fingerprints as fp
from riskloom.llm import queries
from riskloom.llm.components import components


def slow_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(marks, distance=4):
    """marks: [(id, fingerprint)]; the smallest reachable id of each."""
    parent = list(range(len(marks)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = np.array([m for _, m in marks], "uint64")
    for i in range(len(marks)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= distance):
            parent[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, (key, _) in enumerate(marks):
        least[find(i)] = min(least.get(find(i), key), key)
    return [least[find(i)] for i in range(len(marks))]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, slow_fingerprint(r.text)) for r in queries.table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, sf).collect()}
    want = {k: (f"{m:016x}", c) for (k, m), c in zip(docs, slow_components(docs))}
    assert got == want


@pytest.mark.parametrize("block", [2048, 5])
def test_links_connect_what_all_pairs_connect(spark, block):
    draw = random.Random(3)
    values = set()
    for _ in range(12):  # chains of near fingerprints, and strangers
        x = draw.getrandbits(64)
        for _ in range(25):
            values.add(x)
            x ^= sum(1 << b for b in draw.sample(range(64), draw.randint(1, 6)))
    values |= {draw.getrandbits(64) for _ in range(200)} | {0, 1, 3, (1 << 64) - 1}
    marks = sorted(((v - (1 << 64) if v >> 63 else v), v) for v in values)
    frame = spark.createDataFrame([(s,) for s, _ in marks], "fingerprint long")
    found = {r.node: r.component for r in components(fp.near_links(frame, 4, block=block)).collect()}
    assert [found.get(s, s) for s, _ in marks] == slow_components(marks)


def test_manhattan_distance_bounds_hamming_distance():
    a, b = np.random.default_rng(1).integers(0, 1 << 63, (2, 5000), dtype="uint64")
    counts = lambda x: (x[:, None] >> np.arange(0, 64, 2, dtype="uint64") & np.uint64(3)).astype(int)
    ones = lambda x: (counts(x) & 1) + (counts(x) >> 1)
    bound = np.abs(ones(a) - ones(b)).sum(axis=1)
    assert (np.bitwise_count(fp.thermometer(a) ^ fp.thermometer(b)) == bound).all()
    assert (bound <= np.bitwise_count(a ^ b)).all()


def test_odd_rows(odd_docs, no_docs):
    rows = fp.near_components(fp.fingerprints(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[1].fingerprint == by_id[3].fingerprint == 0 and by_id[3].component_id == 1
    assert by_id[6].component_id == 5 and by_id[12].component_id == 11
    assert [r.component_id for r in rows if r.doc_id is None and r.fingerprint == 0] == [1]
    for r in odd_docs.collect():
        assert int.from_bytes(fp.fingerprint(r.text or ""), "big") == slow_fingerprint(r.text)
    assert fp.near_components(fp.fingerprints(no_docs)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(200).selectExpr("id * 7919 % 100003 AS a", "(id + 1) * 7919 % 100003 AS b")
    nodes = components(links).collect()
    assert len(nodes) == 200 and {r.component for r in nodes} == {0}
