"""Exact duplicates: every distinct text has an owner, a terminal node of a compressed radix trie.

Texts are partitioned by byte length and content hash. A task inserts the whole byte strings
of its partition into a Patricia trie whose terminals keep the smallest id and the count, so
equality is decided by bytes and never by a hash. Before the shuffle each task merges its own
copies in a trie of the same kind, so a text with a third of all rows is sent once per task.
A trie that outgrows its bound spills its heaviest subtree: those strings, and later arrivals
below the same branch, go to an unnamed local file and are inserted afterwards in a trie of
their own. The file lives and dies with the task.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import keyed_text, portions
from riskloom.staging import stage

MAP_BYTES = 12_000_000
MAP_ROWS = 50_000
TRIE_BYTES = 200_000_000
BATCH_BYTES = 4_000_000
_BLANKS = b" \t\n\x0b\x0c\r"


def one_space(raw: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; ends are not trimmed."""
    words = b" ".join(raw.split())
    if not words:
        return b" " if raw else b""
    return (b" " if raw[0] in _BLANKS else b"") + words + (b" " if raw[-1] in _BLANKS else b"")


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    __slots__ = ("label", "kids", "value", "spilled")

    def __init__(self, label: bytes):
        self.label, self.kids, self.value, self.spilled = label, {}, None, None


def _stored(file) -> Iterator[tuple[bytes, object]]:
    file.seek(0)
    with file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


class OwnerTrie:
    """Map of byte strings to values that ``merge(old, new)`` combines; bounded by spilling subtrees."""

    def __init__(self, merge, most: int = TRIE_BYTES):
        self.merge, self.most = merge, most
        self.root, self.held, self.spills = Node(b""), 0, 0

    def add(self, text: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                pickle.dump((text, value), node.spilled)
                return
            if at == len(text):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                kid.value = value
                self.held += len(kid.label) + 200
                if self.held > self.most:
                    self._spill()
                return
            if not text.startswith(kid.label, at):
                cut = _shared(kid.label, text[at:at + len(kid.label)])
                upper = Node(kid.label[:cut])
                kid.label = kid.label[cut:]
                upper.kids[kid.label[0]] = kid
                node.kids[text[at]] = kid = upper
                self.held += 200
            node, at = kid, at + len(kid.label)

    def _items(self, node: Node, above: bytes) -> Iterator[tuple[bytes, object]]:
        """Strings held below ``node``, without those of spilled subtrees."""
        todo = [(node, above)]
        while todo:
            node, above = todo.pop()
            path = above + node.label
            if node.value is not None:
                yield path, node.value
            todo += [(kid, path) for kid in node.kids.values()]

    def _weigh(self, node: Node) -> int:
        todo, size = [node], 0
        while todo:
            at = todo.pop()
            size += len(at.label) + 200
            todo += at.kids.values()
        return size

    def _spill(self) -> None:
        """Write the heaviest subtree below the root to a file and drop it from memory."""
        heavy = max((k for k in self.root.kids.values() if k.spilled is None), key=self._weigh, default=None)
        if heavy is None:
            return
        size, file = self._weigh(heavy), tempfile.TemporaryFile()
        for item in self._items(heavy, b""):
            pickle.dump(item, file)
        todo = list(heavy.kids.values())
        while todo:  # what was spilled further down moves up
            node = todo.pop()
            todo += node.kids.values()
            if node.spilled is not None:
                for item in _stored(node.spilled):
                    pickle.dump(item, file)
        heavy.kids, heavy.value, heavy.spilled = {}, None, file
        self.held -= size - len(heavy.label) - 200
        self.spills += 1

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Every string with its value; spilled subtrees last, one at a time."""
        yield from self._items(self.root, b"")
        todo = [(self.root, b"")]
        while todo:
            node, above = todo.pop()
            path = above + node.label
            todo += [(kid, path) for kid in node.kids.values()]
            if node.spilled is not None:
                # What lies in a file begins with the path of its branch, so the next trie branches later.
                below = OwnerTrie(self.merge, self.most)
                for text, value in _stored(node.spilled):
                    below.add(text.removeprefix(path), value)
                for text, value in below.items():
                    yield path + text, value


def least(a, b):
    """The smaller id; a null is larger than any."""
    return b if a is None else a if b is None else min(a, b)


def exact_owners(docs: DataFrame, key: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Per row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are, after each run of white space became one space; a
    null text is empty. The row with the smallest id stays; rows that repeat both id and text
    count as that row each. Null ids come last. An empty table gives an empty one.
    """
    sent = "size int, hash long, sha string, text binary, least long, n long, ids array<long>"
    back = "sha string, ids array<long>, keep_id long, group_size long"

    def merge_ids(a, b):
        return (least(a[0], b[0]), a[1] + b[1], a[2])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(trie: OwnerTrie) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for string, ids in trie.items():
                digest = hashlib.sha256(string)
                known = [i for i in ids if i is not None]
                rows.append((len(string), int.from_bytes(digest.digest()[:8], "big", signed=True), digest.hexdigest(),
                             string, min(known, default=None), len(ids), ids))
                size += len(string)
                if size >= BATCH_BYTES:
                    yield _batch(rows, sent)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, sent)

        def extend(a: list, b: list) -> list:
            a.extend(b)
            return a

        trie, size, count = OwnerTrie(extend, 1 << 60), 0, 0
        for batch in portions(batches, BATCH_BYTES):
            for i, t in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                string = one_space(t)
                trie.add(string, [i])
                size, count = size + len(string), count + 1
                if size >= MAP_BYTES or count >= MAP_ROWS:
                    yield from out(trie)
                    trie, size, count = OwnerTrie(extend, 1 << 60), 0, 0
        yield from out(trie)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = OwnerTrie(merge_ids, trie_bytes)
        for batch in batches:
            cols = [batch.column(c) for c in ("sha", "text", "least", "n", "ids")]
            yield pa.RecordBatch.from_arrays(
                [cols[0], cols[4], pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64())],
                names=["sha", "ids", "keep_id", "group_size"])
            for sha, string, low, n in zip(*(c.to_pylist() for c in cols[:4])):
                trie.add(string, (low, n, sha))
        rows = []
        for _, (low, n, sha) in trie.items():
            rows.append((sha, None, low, n))
            if len(rows) == 10_000:
                yield _batch(rows, back)
                rows = []
        if rows:
            yield _batch(rows, back)

    texts = keyed_text(docs, key, text).mapInArrow(gather, sent).repartition("size", "hash")
    found = stage(texts.mapInArrow(own, back), "owners")
    owners = found.where(F.col("group_size").isNotNull()).select("sha", "keep_id", "group_size")
    rows = found.where(F.col("ids").isNotNull()).select("sha", F.explode("ids").alias("key"))
    return rows.join(owners, "sha").select(
        F.col("key").alias(key), "keep_id", "group_size",
        F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
             "array<long>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kinds[kind]) for column, (_, kind) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
