"""Word language model by deleted interpolation, and the scores of all texts under it.

P(w | h) = a * c(h,w)/c(h) + b * c(w)/N + c * 1/(V+1), with weights (a, b, c) that depend on the
frequency bucket of the context h (powers of two). The weights come from expectation-maximisation
on held-out counts: one part of the training texts is deleted from the counts, and its tokens are
counted by (bucket, level of the bigram estimate, level of the word estimate), levels of an eighth
of an octave, so what reaches the driver has a fixed bound however large the corpus is. The model
then uses the counts of all training texts.

Texts are tokenised once, to blocks of some MB that are written to the shared folder. A block
sends its distinct keys with its own counts to the slice of the key space they belong to, packed
in one binary value per (block, slice), and gets the corpus counts back in the same order. A
frequent word is thus sent once per block, not once per occurrence, and no task holds a word's
occurrences.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import gathered, keyed_text
from riskloom.staging import stage, staging_root

BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 64_000_000
BUCKETS_MOST = 100_000  # what Spark allows
LEVELS = 8  # a level is 2 ** (1 / LEVELS)
BLOCKS = "block long, docs array<long>, folds array<int>, ends array<int>, words binary, tokens binary"
SENT = "slice int, block long, keys binary, trained binary, tuned binary"
BACK = "block long, slice int, trained binary, tuned binary, fresh long"
#: What the exchange goes by; every key space is cut in a power of two slices.
SLICE_BITS_MOST = 30


def pack(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type, compressed; in front the type and the size."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    raw = counts.astype(kind).tobytes()
    return kind.char.encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(raw) -> np.ndarray:
    raw = memoryview(raw)
    size = int.from_bytes(raw[1:9], "little")
    plain = pa.decompress(raw[9:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.frombuffer(plain, np.dtype(bytes(raw[:1]).decode())).astype("int64")


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: gaps of their high halves, then their low halves."""
    high = np.diff(keys >> np.uint64(32), prepend=np.uint64(0))
    first = pack(high)
    return len(first).to_bytes(4, "little") + first + (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def unpack_keys(raw) -> np.ndarray:
    raw = memoryview(raw)
    size = 4 + int.from_bytes(raw[:4], "little")
    high = np.cumsum(unpack(raw[4:size])).astype("uint64")
    return (high << np.uint64(32)) | np.frombuffer(raw[size:], "<u4").astype("uint64")


def fold_of(key: int | None, folds: int) -> int:
    """crc32 of the id as decimal text; a null id is in no fold."""
    return -1 if key is None else zlib.crc32(str(key).encode()) % folds


def make_blocks(docs: DataFrame, key: str, text: str, folds: int) -> DataFrame:
    """Tokenised blocks: sorted word hashes, and per token its place among them. The end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(gathered(batches, BLOCK_BYTES)):
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            parts = []
            for t in batch.column("text").to_pylist():
                words = t.encode().lower().split()
                words.append(b"")
                parts.append(np.fromiter(map(numbers.__getitem__, words), "int32", len(words)))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), "uint64", len(numbers))
            order = np.argsort(hashes)
            rank = np.empty(len(order), "int32")
            rank[order] = np.arange(len(order), dtype="int32")
            keys = batch.column("key").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())),
                pa.array([[fold_of(k, folds) for k in keys]], pa.list_(pa.int32())),
                pa.array([np.cumsum([len(p) for p in parts])], pa.list_(pa.int32())),
                pa.array([pack_keys(hashes[order])], pa.binary()),
                pa.array([rank[np.concatenate(parts)].astype("<i4").tobytes()], pa.binary()),
            ], names=["block", "docs", "folds", "ends", "words", "tokens"])

    return keyed_text(docs, key, text).mapInArrow(run, BLOCKS)


class Block:
    """One block as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        at = {n: batch.column(n)[row] for n in batch.schema.names}
        self.block = at["block"].as_py()
        self.docs = at["docs"].values
        self.folds = at["folds"].values.to_numpy()
        self.ends = at["ends"].values.to_numpy().astype("int64")
        self.tokens = np.frombuffer(at["tokens"].as_buffer(), "<i4")
        self.at = at
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.fold = np.repeat(self.folds, np.diff(self.ends, prepend=0))

    def words(self) -> np.ndarray:
        return unpack_keys(self.at["words"].as_buffer())

    def contexts(self) -> np.ndarray:
        """The token before each; before the first of a text stands the end, as if of another text."""
        before = np.concatenate([self.tokens[-1:], self.tokens[:-1]])
        before[self.starts] = self.tokens[self.ends - 1]
        return before

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct bigram keys, and per token the place of its bigram."""
        words = self.words()
        mixed = words * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        keys = mixed[self.contexts()] * np.uint64(0xBF58476D1CE4E5B9) + words[self.tokens]
        keys ^= keys >> np.uint64(32)
        keys *= np.uint64(0x94D049BB133111EB)
        keys, place = np.unique(keys, return_inverse=True)
        return keys, place.astype("int32")


def _exchange(blocks: DataFrame, bigrams: bool, bits: int, held: int, tune: int) -> DataFrame:
    """Corpus counts of the keys of each block, per slice: in the training texts and in the tuning part."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                keys, place = block.bigrams() if bigrams else (block.words(), block.tokens)
                trained = np.bincount(place[block.fold != held], minlength=len(keys))
                tuned = np.bincount(place[block.fold == tune], minlength=len(keys))
                part = (keys >> np.uint64(64 - bits)).astype("int64") if bits else np.zeros(len(keys), "int64")
                edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]])
                rows = [(int(part[a]), block.block, pack_keys(keys[a:b]), pack(trained[a:b]), pack(tuned[a:b]))
                        for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (
                        pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["slice", "block", "keys", "trained", "tuned"])

    def total(table: pa.Table) -> pa.Table:
        parts = [unpack_keys(k.as_buffer()) for c in table.column("keys").chunks for k in c]
        sizes = np.cumsum([len(p) for p in parts])[:-1]
        keys, place = np.unique(np.concatenate(parts), return_inverse=True)
        sums = []
        for name in ("trained", "tuned"):
            own = np.concatenate([unpack(x.as_buffer()) for c in table.column(name).chunks for x in c])
            sums.append(np.bincount(place, weights=own, minlength=len(keys)).astype("int64"))
        fresh = [int((sums[0] > 0).sum())] + [0] * (len(parts) - 1)
        places = np.split(place, sizes)
        return pa.table([
            table.column("block"), table.column("slice"),
            pa.array([pack(sums[0][p]) for p in places], pa.binary()),
            pa.array([pack(sums[1][p]) for p in places], pa.binary()), pa.array(fresh, pa.int64()),
        ], names=["block", "slice", "trained", "tuned", "fresh"])

    return blocks.mapInArrow(send, SENT).groupBy("slice").applyInArrow(total, BACK)


def learn_weights(cells: list[tuple[int, int, int, int]], words: int, rounds: int = 40) -> dict[int, np.ndarray]:
    """Weights (bigram, word, uniform) per context bucket from (bucket, bigram level, word level, count)."""
    weights = {}
    by_bucket: dict[int, list] = defaultdict(list)
    for bucket, two, one, n in cells:
        by_bucket[bucket].append((two, one, n))
    for bucket, rows in by_bucket.items():
        two, one, n = np.array(rows, "float64").T
        parts = np.stack([np.where(two < 0, 0, 2.0 ** (-two / LEVELS)), np.where(one < 0, 0, 2.0 ** (-one / LEVELS)),
                          np.full(len(n), 1.0 / (words + 1))])
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = parts * w[:, None]
            w = (share / share.sum(axis=0) * n).sum(axis=1) + [1e-3, 1e-3, 1.0]
            w /= w.sum()
        weights[bucket] = w
    return weights


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two at or below its count."""
    return np.where(counts > 0, np.frexp(counts.astype("float64"))[1], 0)


def _level(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(-np.log2(p) * LEVELS), -1).astype("int64")


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2,
                tune: int = 3) -> DataFrame:
    """Per row of ``docs``: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Rows whose crc32(id) mod ``folds`` is ``held`` are scored but not learned from; those at ``tune``
    set the weights. Null texts are empty: one token, the end. Null ids are learned from. Repeated
    rows count and are scored each. Without a training text every word is unknown; an empty table
    gives an empty one.
    """
    blocks, buckets = _bucketed(make_blocks(docs, key, text, folds), docs, text)
    number = blocks.count()
    bits = min(SLICE_BITS_MOST, max(3, int(number * 1.5).bit_length()))
    ones = _compact(_exchange(blocks, False, bits, held, tune), "words")
    twos = _compact(_exchange(blocks, True, bits, held, tune), "bigrams")
    seen = ones.agg(F.sum("fresh")).first()[0] or 0
    sizes = blocks.select(F.posexplode("folds").alias("i", "fold"), "ends").select("fold", (
        F.element_at("ends", F.col("i") + 1)
        - F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(0)).cast("long").alias("n"))
    both = sizes.agg(F.sum(F.when(F.col("fold") != held, F.col("n"))), F.sum(F.when(F.col("fold") == tune, F.col("n")))).first()
    trained, tuned = both[0] or 0, both[1] or 0

    def back(counts: DataFrame, name: str) -> DataFrame:
        return counts.repartition(buckets, "block").groupBy("block").agg(
            F.array_sort(F.collect_list(F.struct("slice", "trained", "tuned"))).alias(name))

    joined = blocks.join(back(ones, "ones"), "block").join(back(twos, "twos"), "block")

    def arrays(batch: pa.RecordBatch, row: int):
        block = Block(batch, row)
        place = block.bigrams()[1]
        found = []
        for name in ("ones", "twos"):
            parts = block.at[name].values
            for field in ("trained", "tuned"):
                found.append(np.concatenate([unpack(x.as_buffer()) for x in parts.field(field)]))
        one, one_tuned, two, two_tuned = found
        return block, place, one, one_tuned, two, two_tuned

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Held-out counts: the tuning tokens by bucket and levels, under the counts without that part."""
        for batch in batches:
            for row in range(batch.num_rows):
                block, place, one, one_tuned, two, two_tuned = arrays(batch, row)
                mine = block.fold == tune
                one, two = one - one_tuned, two - two_tuned
                above, token, pair = one[block.contexts()[mine]], one[block.tokens[mine]], two[place[mine]]
                bucket = bucket_of(above)
                levels = _level(pair / np.maximum(above, 1)), _level(token / max(1, trained - tuned))
                cells, n = np.unique(np.stack([bucket, *levels]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype("int32")) for c in cells] + [pa.array(n)], names=["bucket", "two", "one", "n"])

    # At most 64 buckets by some hundred levels each way.
    cells = joined.mapInArrow(observe, "bucket int, two int, one int, n long").groupBy(
        "bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights([tuple(r) for r in cells], seen)
    table = np.tile(np.array([[0.3, 0.5, 0.2]]), (65, 1))  # buckets that no held-out token has
    for bucket, w in weights.items():
        table[bucket] = w

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, place, one, _, two, _ = arrays(batch, row)
                above, token, pair = one[block.contexts()], one[block.tokens], two[place]
                bucket = bucket_of(above)
                p = table[bucket, 0] * (pair / np.maximum(above, 1))
                p += table[bucket, 1] * (token / max(1, trained))
                p += table[bucket, 2] / (seen + 1)
                base = np.log10((token + 1) / (trained + seen + 1))
                n = len(block.ends)
                yield pa.RecordBatch.from_arrays([
                    block.docs, pa.array(block.folds == held), pa.array(block.ends - block.starts),
                    pa.array(np.add.reduceat((token > 0).astype("int64"), block.starts)),
                    pa.array(np.full(n, trained, "int64")), pa.array(np.add.reduceat(base, block.starts)),
                    pa.array(np.add.reduceat(np.log10(p), block.starts)),
                ], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(score, (f"`{key}` long, held_out boolean, n_tokens long, n_known long, "
                                     "train_tokens long, base_score double, score double"))


def _compact(df: DataFrame, name: str) -> DataFrame:
    return stage(df, name, compression="zstd")


def _bucketed(blocks: DataFrame, docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """The written blocks in buckets by their number: joins bring the small counts to them, not them to the counts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    buckets = min(BUCKETS_MOST, max(int(parts) if parts.isdigit() else 1, size // BUCKET_BYTES + 1))
    name = f"blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(buckets, "block").options(
        compression="zstd", path=f"{staging_root(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only: the files are outside the warehouse
    return found, buckets
