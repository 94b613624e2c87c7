"""SimHash fingerprints and their near-duplicate components.

Search by segment popcounts: a fingerprint is mapped to the bit counts of its 32 two-bit
segments. The Manhattan distance of two such points is at most the Hamming distance of the
fingerprints, so pairs within Hamming distance r are among those within Manhattan distance r.
The points are joined on a grid. The segments are dealt to ``panels`` panels; r differing
counts leave at least ``panels - r`` panels alike, so each point is sent to one unit cell per
choice of that many panels, and points in range always meet in a cell. Inside a cell the
Manhattan bound goes first and the exact XOR distance decides.

Counts are kept in thermometer code (0: 00, 1: 01, 2: 11), in which the Manhattan distance is
the popcount of an XOR and a cell is a bit mask. Equal fingerprints are one point. A cell gives
a spanning forest of its links, never all pairs; a crowded cell is dealt to pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import keyed_text, portions
from riskloom.llm.components import components
from riskloom.staging import stage

BATCH_BYTES = 2_000_000
BLOCK = 2048
PANELS = 7
SALTS = 64
LOW, HIGH = 0x5555555555555555, 0xAAAAAAAAAAAAAAAA


def fingerprint(text: str, width: int = 4) -> bytes:
    """Eight bytes, most significant first. Words are cut at ASCII white space after A-Z became a-z."""
    words = text.encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), "int64", len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_digest
    found = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[last:].tolist())]
    # Summed in runs, so that a very long text needs no bit matrix of its full length.
    ones = np.zeros(64, "int64")
    for at in range(0, len(found), 8192):
        part = found[at:at + 8192]
        bits = np.unpackbits(np.frombuffer(b"".join(part), "uint8").reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype="int32")
    return np.packbits(2 * ones > len(found)).tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """Per row: ``key`` and ``fingerprint``, a signed long. Null and empty texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, BATCH_BYTES):
            raw = b"".join(fingerprint(t, width) for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.frombuffer(raw, ">i8").astype("int64"))], names=[key, "fingerprint"])

    return keyed_text(docs, key, text).mapInArrow(run, f"`{key}` long, fingerprint long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def cells(points: DataFrame, distance: int, panels: int) -> DataFrame:
    """Grid cells of ``points`` (fingerprint): ``choice`` of panels and ``cell``, the counts in them."""
    cuts = [round(i * 32 / panels) for i in range(panels + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    # The masks of the chosen panels do not overlap.
    chosen = [_signed(sum(c)) for c in combinations(masks, panels - distance)]
    x = F.col("fingerprint")
    counts = (F.shiftrightunsigned(x, 1).bitwiseOR(x)).bitwiseAND(F.lit(LOW)).bitwiseOR(
        F.shiftleft(x, 1).bitwiseAND(x).bitwiseAND(F.lit(_signed(HIGH))))
    listed = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell"))
                       for i, m in enumerate(chosen)])
    return (points.select("fingerprint", counts.alias("counts"))
            .select("fingerprint", F.explode(listed).alias("at")).select("fingerprint", "at.choice", "at.cell"))


def thermometer(x: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return (((x >> one) | x) & np.uint64(LOW)) | ((x << one) & x & np.uint64(HIGH))


def forest(points: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links points at ``distance`` or less."""
    links: list[tuple[int, int]] = []
    rest, marks = points, thermometer(points)
    while len(rest):
        todo = [rest[0]]
        rest, marks = rest[1:], marks[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(marks ^ thermometer(at)) <= distance
            if near.any():
                near[near] = np.bitwise_count(rest[near] ^ at) <= distance
                found = rest[near]
                links += [(at, b) for b in found]
                todo += list(found)
                rest, marks = rest[~near], marks[~near]
    return links


def near_links(points: DataFrame, distance: int = 4, panels: int = PANELS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct ``fingerprint`` values whose graph connects all pairs in range."""
    if not 0 < distance < panels:
        raise ValueError("panels must be more than distance")
    placed = cells(points, distance, panels)
    crowds = placed.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(
        "choice", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    dealt = (
        placed.join(crowds, ["choice", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own)
        .select("fingerprint", "choice", "cell", "own",
                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("fingerprint", "choice", "cell",
                F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    keys = ["choice", "cell", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group may go on in the next batch
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "fingerprint")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            last = int(change[-1]) if len(change) else 0
            held = [c[last:].copy() for c in cols]
            if last:
                yield linked(cols[4][:last], change[:-1])
        if held is not None:
            yield linked(held[4], np.empty(0, "int64"))

    def linked(points: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        points = points.view("uint64")
        edges = np.concatenate([[0], starts, [len(points)]])
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        a, b = points[two], points[two + 1]
        near = np.bitwise_count(thermometer(a) ^ thermometer(b)) <= distance
        near[near] = np.bitwise_count(a[near] ^ b[near]) <= distance
        links = [np.stack([a[near], b[near]], 1)]
        for k in np.flatnonzero(sizes > 2):
            found = forest(points[edges[k]:edges[k + 1]], distance)
            if found:
                links.append(np.array(found, "uint64"))
        out = np.concatenate(links).view("int64")
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def near_components(marked: DataFrame, key: str = "doc_id", distance: int = 4, panels: int = PANELS) -> DataFrame:
    """Per row of ``marked`` (``key``, ``fingerprint``): both, and ``component_id``, the smallest reachable key.

    Null keys never name a component unless it has no other; repeated rows are returned as they
    are; an empty table gives an empty one.
    """
    marked = stage(marked.select(key, "fingerprint"), "fingerprints")
    points = stage(marked.groupBy("fingerprint").agg(F.min(key).alias("least")), "points")
    nodes = components(near_links(points.select("fingerprint"), distance, panels))
    whole = stage(points.join(nodes, points.fingerprint == nodes.node, "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")), "nodes")
    # A component may hold most points: its name is sent to SALTS places, and its points are dealt to them.
    named = whole.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("points")).where(
        "points > 1").select("component", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ids = whole.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)).cast("int")).join(
        named, ["component", "salt"], "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(ids, "fingerprint").select(key, "fingerprint", "component_id")
