"""Benchmark decontamination with a positional inverted index of the training texts.

The index is stored as one row per block of documents: the distinct terms of the block, the
sorted positions of each, and where its documents begin. Positions run through the block with a
gap between documents, so no phrase crosses from one to the next. Blocks are cut inside scan
tasks; nothing is shuffled and no term, however frequent, gathers its postings in one place.

A search cuts the benchmark into pieces and deals these to chunks of bounded size. The frequency of
every test term is summed over the index and stored with the chunks in the shared folder. A task takes
some blocks at a time and reads one chunk after another for them. It only visits windows whose rarest
term the block holds, and intersects their lists from that term on, each shifted by the offset of the term.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import gathered, keyed_text
from riskloom.operators.scan import lookup
from riskloom.staging import stage

BLOCK_BYTES = 4_000_000
CHUNK_WORDS = 100_000
PIECE_WORDS = 2_000
HELD_BLOCKS = 2
#: Fixed value of the contract: A-Z becomes a-z; digits, a-z and all bytes from 80 hex on are word bytes.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = ("block long, docs array<long>, starts array<int>, sizes array<int>, terms array<binary>, bounds array<int>, "
         "positions binary")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block; ``positions`` holds int32 gaps, from term to term starting anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(gathered(batches, BLOCK_BYTES)):
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            parts, sizes = [], []
            for t in batch.column("text").to_pylist():
                found = words_of(t)
                parts.append(np.fromiter(map(numbers.__getitem__, found), "int32", len(found)))
                sizes.append(len(found))
            sizes = np.array(sizes, "int64")
            starts = np.cumsum(sizes + 1) - sizes - 1
            terms = np.concatenate(parts)
            at = np.arange(len(terms), dtype="int64") + np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(terms, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(numbers)))])
            places = at[order]
            gaps = np.diff(places, prepend=0)
            gaps[bounds[:-1]] = places[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                pa.array([batch.column("key").to_pylist()], pa.list_(pa.int64())),
                _row(starts), _row(sizes), pa.array([list(numbers)], pa.list_(pa.binary())), _row(bounds),
                pa.array([gaps.astype("<i4").tobytes()], pa.binary()),
            ], names=["block", "docs", "starts", "sizes", "terms", "bounds", "positions"])

    return keyed_text(docs, key, text).mapInArrow(run, INDEX)


def _row(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype("int32")))


#: The windows of a chunk by their rarest term: words, offsets from the rarest on, names of the items.
Chunk = dict[bytes, list[tuple[tuple[bytes, ...], list[int], list[str]]]]


class Postings:
    """One block of the index; the lists of terms are decoded when asked for, anew for every chunk."""

    def __init__(self, row: dict):
        self.block = row["block"].as_py()
        self.docs = row["docs"].values.to_pylist()
        self.starts = row["starts"].values.to_numpy().astype("int64")
        self.sizes = row["sizes"].values.to_numpy().astype("int64")
        self.bounds = row["bounds"].values.to_numpy()
        self.gaps = np.frombuffer(row["positions"].as_buffer(), "<i4")
        self.number = {term: i for i, term in enumerate(row["terms"].values.to_pylist())}
        length = int(self.starts[-1] + self.sizes[-1]) if self.docs else 0
        self.edges = np.zeros(length + 2, "int32")
        self.items: dict[int, set[str]] = defaultdict(set)
        self.forget()

    def forget(self) -> None:
        self.lists: dict[bytes, np.ndarray | None] = {}
        self.pairs: dict[tuple[bytes, bytes, int], np.ndarray] = {}

    def places(self, term: bytes) -> np.ndarray | None:
        """Sorted positions of a term, or None."""
        if term not in self.lists:
            i = self.number.get(term)
            self.lists[term] = None if i is None else np.cumsum(self.gaps[self.bounds[i]:self.bounds[i + 1]], dtype="int64")
        return self.lists[term]

    def phrase(self, window: tuple[bytes, ...], order: list[int]) -> np.ndarray:
        """First positions of the exact phrase; ``order`` lists the offsets, rarest term first."""
        found = self._pair(window, order) - order[0]
        for offset in order[2:]:
            if not len(found):
                break
            places = self.places(window[offset])
            found = found[_among(found + offset, places)] if places is not None else found[:0]
        return found

    def _pair(self, window: tuple[bytes, ...], order: list[int]) -> np.ndarray:
        """Positions of the rarest term with the second rarest at its distance; windows that overlap share them."""
        first, second = order[0], order[1] if len(order) > 1 else order[0]
        name = window[first], window[second], second - first
        if name not in self.pairs:
            rare, other = self.places(name[0]), self.places(name[1])
            self.pairs[name] = (np.empty(0, "int64") if rare is None or other is None
                                else rare[_among(rare + name[2], other)])
        return self.pairs[name]

    def near(self, window: tuple[bytes, ...], order: list[int], span: int) -> np.ndarray:
        """Positions of the rarest term with every other term of ``window`` within ``span`` words in its text."""
        places = self.places(window[order[0]])
        if places is None:
            return np.empty(0, "int64")
        doc = self.doc_of(places)
        low = np.maximum(places - span, self.starts[doc])
        high = np.minimum(places + span, self.starts[doc] + self.sizes[doc] - 1)
        ok = np.ones(len(places), bool)
        for term in set(window):
            other = self.places(term)
            if other is None:
                return np.empty(0, "int64")
            ok &= np.searchsorted(other, high, "right") > np.searchsorted(other, low, "left")
        return places[ok]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def mark(self, chunk: Chunk, span: int | None) -> None:
        """Note where the windows of a chunk occur."""
        self.forget()
        for term in chunk.keys() & self.number.keys():
            for window, order, names in chunk[term]:
                if span is None:
                    first = self.phrase(window, order)
                    last = first + len(window)
                else:
                    at = self.near(window, order, span)
                    doc = self.doc_of(at)
                    first = np.maximum(at - span, self.starts[doc])
                    last = np.minimum(at + span + 1, self.starts[doc] + self.sizes[doc])
                if len(first):
                    np.add.at(self.edges, first, 1)
                    np.add.at(self.edges, last, -1)
                    for doc in np.unique(self.doc_of(first)).tolist():
                        self.items[doc].update(names)

    def found(self) -> pa.RecordBatch:
        """One row per document with its covered runs and items."""
        # Matches never reach into the gap behind a document, so runs of two documents stay apart.
        covered = np.concatenate([[0], np.cumsum(self.edges) > 0, [0]]).astype("int8")
        turns = np.diff(covered)
        begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1) - 1
        doc = self.doc_of(begin)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(self.docs)))])
        runs = pa.StructArray.from_arrays(
            [pa.array((places - self.starts[doc]).astype("int32")) for places in (begin, end)], names=["first", "last"])
        return pa.RecordBatch.from_arrays([
            pa.array(self.docs, pa.int64()), pa.array(self.sizes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
            pa.array([sorted(self.items.get(i, ())) for i in range(len(self.docs))], pa.list_(pa.string())),
        ], names=["key", "n_words", "hits", "items"])


def _among(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted list ``places``, which is not empty."""
    at = np.searchsorted(places, values)
    return places[np.minimum(at, len(places) - 1)] == values


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """Runs of ``width`` words; a shorter text, unless empty, is one window."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return list(dict.fromkeys(tuple(words[i:i + width]) for i in range(len(words) - width + 1)))


def item_pieces(items: DataFrame, width: int, item: str, text: str) -> DataFrame:
    """Stored (item, words): the words of an item, a long one in pieces that share ``width`` - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = [], []
            for name, body in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(body or "")
                if words and name is not None:
                    for at in range(0, max(len(words) - width + 1, 1), PIECE_WORDS):
                        names.append(name)
                        parts.append(words[at:at + PIECE_WORDS + width - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(parts, pa.list_(pa.binary()))], names=["item", "words"])

    named = items.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return stage(named.mapInArrow(run, "item string, words array<binary>").withColumn(
        "piece", F.monotonically_increasing_id()), "pieces")


def window_chunks(index: DataFrame, pieces: DataFrame) -> DataFrame:
    """Stored chunks of about CHUNK_WORDS words: their pieces, and how often their terms occur in the corpus."""
    chunks = max(1, -(-(pieces.agg(F.sum(F.size("words"))).first()[0] or 0) // CHUNK_WORDS))
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("piece"), F.lit(chunks)))
    asked = dealt.select("chunk", F.explode("words").alias("term")).distinct()
    counts = F.zip_with(F.slice("bounds", 2, F.size("terms")), F.slice("bounds", 1, F.size("terms")), lambda b, a: b - a)
    totals = index.select(F.inline(F.arrays_zip("terms", counts.alias("n")))).toDF("term", "n").join(
        lookup(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    known = asked.join(lookup(totals), "term").groupBy("chunk").agg(F.collect_list(F.struct("term", "n")).alias("known"))
    packed = dealt.groupBy("chunk").agg(F.collect_list(F.struct("item", "words")).alias("pieces"))
    return stage(packed.join(known, "chunk"), "chunks")


def _read_chunks(files: list[str], width: int) -> Iterator[Chunk]:
    """The stored chunks, one held at a time; windows with a term that the corpus lacks are left out."""
    for name in files:
        store, path = fs.FileSystem.from_uri(name)
        with store.open_input_file(path) as source:
            for batch in parquet.ParquetFile(source).iter_batches(batch_size=1):
                for row in batch.to_pylist():
                    totals = {x["term"]: x["n"] for x in row["known"]}
                    owners: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
                    for piece in row["pieces"]:
                        for window in windows_of(piece["words"], width):
                            owners[window].append(piece["item"])
                    chunk: Chunk = defaultdict(list)
                    for window, names in owners.items():
                        if all(t in totals for t in window):
                            order = sorted(range(len(window)), key=lambda i, w=window: (totals[w[i]], i))
                            chunk[window[order[0]]].append((window, order, names))
                    yield chunk


def search(index: DataFrame, items: DataFrame, width: int = 13, item: str = "item_id", text: str = "text",
           span: int | None = None) -> DataFrame:
    """Per indexed document: ``key``, ``n_words``, ``hits`` (covered runs) and ``items`` found in it.

    ``index`` is read twice, so pass a stored table. ``hits`` is an array of (first, last) word numbers in its
    text, sorted and apart. With ``span``, a window is found where its terms stand within that many words of its
    rarest one, in any order, and the run is that span. Items without a word or without an id are never found.
    """
    chunks = window_chunks(index, item_pieces(items, width, item, text))
    files = sorted(chunks.inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({n: batch.column(n)[at] for n in batch.schema.names} for batch in batches for at in range(batch.num_rows))
        only: list[Chunk] = []
        while held := [Postings(row) for row in islice(rows, HELD_BLOCKS)]:
            seen = 0
            for chunk in only or _read_chunks(files, width):
                seen, last = seen + 1, chunk
                for postings in held:
                    postings.mark(chunk, span)
            if seen == 1:  # a single chunk need not be read again
                only = [last]
            for postings in held:
                yield postings.found()

    return index.mapInArrow(run, "key long, n_words long, hits array<struct<first:int,last:int>>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, key: str = "doc_id",
                  text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_words``, ``n_hit``, ``items`` and ``contaminated``.

    A word is hit inside any occurrence of a window; a document is contaminated with at least one hit
    word and one in ``share`` words hit. Null texts have no words; repeated rows are judged each; an
    empty benchmark finds nothing; an empty table gives an empty one.
    """
    found = search(stage(build_index(docs, key, text), "postings"), items, width, item, item_text)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["last"] - x["first"] + 1).cast("long"))
    return found.select(
        F.col("key").alias(key), "n_words", hit.alias("n_hit"), "items").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
