"""Ranked lexical search by groups of documents with the same matched terms.

The index is one row per block of documents: their ids and lengths, the distinct terms, and for each
term the documents that hold it with its occurrences. Blocks are cut inside scan tasks; nothing is
shuffled to build them.

A search weighs the terms of all items from the document counts of the index and packs the items into
chunks of bounded size, which Spark joins to the blocks. In a block an item's terms give every document a
bit mask. Documents are grouped by mask; the largest impact of each term in the block bounds the score
of a mask. Masks are evaluated by descending bound until the next one cannot reach the item's worst kept
score. A task keeps the best documents of an item across its blocks, so later blocks stop earlier.

Scores are whole numbers: the sum over the terms of an item, repeats included, of
weight * ((SCALE * tf) div (1000 * tf + 12 * m)), where m grows with the length of the document.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import gathered, keyed_text
from riskloom.llm.phrases import words_of
from riskloom.operators.scan import lookup
from riskloom.staging import stage

BLOCK_BYTES = 3_000_000
#: Bytes of a row group of the stored index. Blocks are large rows: a writer that first looks at its size after 100 of them,
#: and a reader that takes a row group at once, would hold hundreds of MB a task as soon as a task has so many blocks.
GROUP_BYTES = 4_000_000
CHUNK_WORDS = 100_000
#: Cells of a document by term table that an item fills at once, and items whose best are kept at once.
CELLS, KEPT_ITEMS = 4_000_000, 20_000
#: Fixed values of the contract.
SCALE, SLOPE_PERCENT = 1_000_000_000, 25
INDEX = ("n_docs long, n_terms long, docs array<long>, sizes array<int>, terms array<binary>, holders array<int>, "
         "places binary, counts binary")


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block; ``holders`` counts the documents of each term, ``places`` and ``counts`` hold int32 lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BLOCK_BYTES):
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            parts, sizes = [], []
            for t in batch.column("text").to_pylist():
                found = words_of(t)
                parts.append(np.fromiter(map(numbers.__getitem__, found), "int64", len(found)))
                sizes.append(len(found))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            pairs, counts = np.unique(np.concatenate(parts) * len(sizes) + doc, return_counts=True)
            term, place = np.divmod(pairs, len(sizes))
            yield pa.RecordBatch.from_arrays([
                pa.array([np.count_nonzero(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64()),
                pa.array([batch.column("key").to_pylist()], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int32())), pa.array([list(numbers)], pa.list_(pa.binary())),
                pa.array([np.bincount(term, minlength=len(numbers)).astype("int32")], pa.list_(pa.int32())),
                pa.array([place.astype("<i4").tobytes()], pa.binary()),
                pa.array([counts.astype("<i4").tobytes()], pa.binary()),
            ], names=["n_docs", "n_terms", "docs", "sizes", "terms", "holders", "places", "counts"])

    return keyed_text(docs, key, text).mapInArrow(run, INDEX)


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(row, item, term, repeats, words) per distinct term of every row of ``items``."""
    rows = stage(items.select(F.monotonically_increasing_id().alias("row"), F.col(item).cast("string").alias("item"),
                              F.col(text).cast("string").alias("text")), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, i, term, n) for r, i, t in zip(*(c.to_pylist() for c in batch.columns))
                     for term, n in Counter(words_of(t or "")).items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in found], kind)
                 for j, kind in enumerate((pa.int64(), pa.string(), pa.binary(), pa.int64()))],
                names=["row", "item", "term", "repeats"])

    return stage(rows.mapInArrow(run, "row long, item string, term binary, repeats long"), "terms")


class Block:
    """One row of the index with the impacts of its postings."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.docs = row["docs"].values.to_pylist()
        sizes = row["sizes"].values.to_numpy().astype("int64")
        self.places = np.frombuffer(row["places"].as_buffer(), "<i4")
        tf = np.frombuffer(row["counts"].as_buffer(), "<i4").astype("int64")
        self.bounds = np.concatenate([[0], np.cumsum(row["holders"].values.to_numpy(), dtype="int64")])
        length = 100 - SLOPE_PERCENT + (SLOPE_PERCENT * sizes * n_docs) // max(n_terms, 1)
        self.impacts = (SCALE * tf) // (1000 * tf + 12 * length[self.places])
        self.most = np.maximum.reduceat(self.impacts, self.bounds[:-1]) if len(tf) else tf
        self.number = {t: i for i, t in enumerate(row["terms"].values.to_pylist())}

    def best(self, terms: list[tuple[bytes, int]], k: int, least: int) -> list[tuple[int, int]]:
        """(score, place) of documents of which the ``k`` best are certain, none below ``least``."""
        found = [(self.number[t], w) for t, w in terms if t in self.number and w > 0]
        out: list[tuple[int, int]] = []
        if not found:
            return out
        step = max(1, CELLS // len(found))
        for low in range(0, len(self.docs), step):
            out += self._best(found, k, max(least, out[k - 1][0] if len(out) >= k else 1), low,
                              min(low + step, len(self.docs)))
            out = sorted(out, key=lambda x: -x[0])
        return out

    def _best(self, found: list[tuple[int, int]], k: int, least: int, low: int, high: int) -> list[tuple[int, int]]:
        weights = np.array([w for _, w in found], "int64")
        width = -(-len(found) // 64) * 8
        bits = np.zeros((high - low, width), "uint8")
        table = np.zeros((len(found), high - low), "int64")
        for j, (term, _) in enumerate(found):
            part = slice(self.bounds[term], self.bounds[term + 1])
            at, impact = self.places[part], self.impacts[part]
            if low or high < len(self.docs):
                inside = (at >= low) & (at < high)
                at, impact = at[inside] - low, impact[inside]
            bits[at, j >> 3] |= 1 << (j & 7)
            table[j, at] = impact
        masks, group = np.unique(bits.view("<u8" if width == 8 else f"V{width}").ravel(), return_inverse=True)
        matched = np.unpackbits(masks.view("uint8").reshape(-1, width), axis=1, count=len(found), bitorder="little")
        most = matched.astype("int64") @ (weights * self.most[[t for t, _ in found]])
        order = np.argsort(-most, kind="stable")
        members = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(masks)))
        kept = np.empty(0, "int64")
        places = np.empty(0, "int64")
        at, ahead = 0, 4
        while at < len(order) and most[order[at]] >= least:
            # Masks of one round: those that can still matter, more in every round.
            now = [m for m in order[at:at + ahead].tolist() if most[m] >= least]
            docs = np.concatenate([members[ends[m - 1] if m else 0:ends[m]] for m in now])
            scores = weights @ table[:, docs]
            kept, places = np.concatenate([kept, scores]), np.concatenate([places, docs])
            if len(kept) >= k:
                least = max(least, int(np.partition(kept, -k)[-k]))
            kept, places = kept[kept >= least], places[kept >= least]
            at, ahead = at + len(now), ahead * 2
        return list(zip(kept.tolist(), (places + low).tolist()))


def _first(found: list[tuple[int, int | None]], k: int) -> list[tuple[int, int | None]]:
    """The ``k`` best by score, then id; documents without an id come last among equal scores."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def search(index: DataFrame, items: DataFrame, k: int = 20, item: str = "item_id", text: str = "text") -> DataFrame:
    """Per row of ``items`` its ``k`` best documents: ``item``, ``rank``, ``doc`` and ``score``.

    ``index`` is read twice, so pass a stored table. Only documents with a score above 0 are returned; equal
    scores are ordered by id. Items that are null, empty or match nothing give no row; rows that repeat an item
    are ranked each. Repeated documents are ranked each; those without an id come last among equals. An
    empty index or an empty list of items gives an empty result.
    """
    kind = dict(items.dtypes)[item]
    asked = item_terms(items, item, text)
    totals = index.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    n_docs, n_terms = totals["d"] or 0, totals["t"] or 0
    words = asked.agg(F.sum("repeats")).first()[0] or 0
    chunks = max(1, -(-words // CHUNK_WORDS))
    # Counts of the asked terms only: the optimizer sends the distinct ones to the blocks, or shuffles, by their size.
    holders = index.select(F.inline(F.arrays_zip("terms", "holders"))).withColumnRenamed("terms", "term").join(
        lookup(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(
        F.sum(F.col("holders").cast("long")).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(lookup(holders.select("term", weight.alias("weight"))), "term")
    packed = weighed.groupBy(F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk"), "row", "item").agg(
        F.collect_list(F.struct("term", (F.col("weight") * F.col("repeats")).alias("weight"))).alias("terms")
    ).groupBy("chunk").agg(F.collect_list(F.struct("row", "item", "terms")).alias("items"))
    work = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).join(
        lookup(packed), "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[str | None, list]] = {}
        chunk, wanted = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at] for n in batch.schema.names}
                if row["chunk"].as_py() != chunk:
                    chunk, wanted = row["chunk"].as_py(), row["items"].as_py()
                    wanted = [(x["row"], x["item"], [(t["term"], t["weight"]) for t in x["terms"]]) for x in wanted]
                block = Block(row, n_docs, n_terms)
                for number, name, terms in wanted:
                    old = best[number][1] if number in best else []
                    found = block.best(terms, k, old[-1][0] if len(old) == k else 1)
                    if found:
                        best[number] = name, _first(old + [(s, block.docs[p]) for s, p in found], k)
                if len(best) > KEPT_ITEMS:
                    yield _rows(best)
                    best = {}
        yield _rows(best)

    found = work.mapInArrow(run, "row long, item string, doc long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("item").cast(kind).alias(item), "rank", "doc", "score")


def _rows(best: dict[int, tuple[str | None, list]]) -> pa.RecordBatch:
    flat = [(row, name, doc, score) for row, (name, found) in best.items() for score, doc in found]
    return pa.RecordBatch.from_arrays(
        [pa.array([x[j] for x in flat], kind)
         for j, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))],
        names=["row", "item", "doc", "score"])


def stage_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index, in row groups of about GROUP_BYTES; the size is looked at after every block."""
    return stage(build_index(docs, key, text), "ranked", **{
        "compression": "zstd", "parquet.block.size": str(GROUP_BYTES),
        "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"})


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
                   item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Index ``docs`` and search it for every row of ``items``; see ``search``. Null texts hold no terms."""
    index = stage_index(docs, key, text)
    return search(index, items, k, item, item_text).withColumnRenamed("doc", key)
