import heapq
import zlib
from collections import Counter, defaultdict

from riskloom.llm import queries, sharding


def brute(texts, shards):
    """Every group a unit: largest first to the least-loaded shard."""
    sizes = Counter()
    for t in texts:
        sizes[t or ""] += len((t or "").encode()) + 16
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes.values(), reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def check(rows, texts, shards):
    slots, group, loads = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        group[texts[r.doc_id] or ""].add(r.shard)
        loads[r.shard] += r["size"]
        assert (r["size"], r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 16, zlib.crc32((texts[r.doc_id] or "").encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in group.values())
    return sorted(loads[s] for s in range(shards))


def test_schedule_takes_the_largest_first():
    placed = sharding.schedule([("a", 7), ("b", 6), ("c", 5), ("d", 4), ("e", 3), ("f", 3)], 2)
    loads = Counter()
    for name, size in (("a", 7), ("b", 6), ("c", 5), ("d", 4), ("e", 3), ("f", 3)):
        loads[placed[name]] += size
    assert sorted(loads.values()) == [14, 14]


def test_query_equals_brute_force_where_all_groups_are_units(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op2_sharding(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.law == "bytes" and r.grown_shard is None for r in rows)
    assert check(rows, texts, 40) == brute(texts.values(), 40)


def test_bundles_cost_little_balance(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fine = 16
    loads = check(sharding.shard_by_bytes(docs, 4, fine=fine).collect(), texts, 4)
    assert loads[-1] - loads[0] <= 2 * sum(loads) / (4 * fine)


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_by_bytes(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r["size"] == 16}) == 1  # null and empty texts are one group
    assert sharding.shard_by_bytes(no_docs, 3).count() == 0
