"""Shards of nearly equal size by longest-processing-time scheduling.

Rows with equal text form a group that stays together. Groups are units, sorted by size and
put on the least-loaded shard through a heap. The schedule is made on the driver over a number
of units with a fixed bound: a group of at least one ``fine``-th of a mean shard is a unit of
its own, of which there are at most ``shards * fine``; all smaller groups are first gathered by
hash in ``shards * fine`` bundles, each a unit. A bundle is about one ``fine``-th of a shard, so
it costs at most that much balance. No text is shuffled, only digests and sizes.

Positions in a shard come from a prefix sum over (shard, piece) counts, so no task holds a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.staging import stage

FINE = 512
ROW_COST = 16
PIECE_ROWS = 20_000


def schedule(units: list[tuple], shards: int) -> dict:
    """Shard of every (name, size): largest first, to the least-loaded, lowest-numbered shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for name, size in sorted(units, key=lambda u: (-u[1], str(u[0]))):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[name] = shard
    return placed


def _bundle(digest: Column, bundles: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(bundles)).cast("int")


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                   fine: int = FINE) -> DataFrame:
    """Per row: ``key``, ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``shard`` and ``slot``.

    A null text counts as empty and shares its group. Repeated rows are one group and take a
    slot each. Slots of a shard run from 0 without gaps. An empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = stage(docs.select(
        F.col(key).cast("long").alias("key"), (F.octet_length(value) + F.lit(ROW_COST)).cast("long").alias("size"),
        F.crc32(value).alias("text_crc32"), F.sha2(value, 256).alias("digest")), "sizes")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    limit = (total[0] or 0) // (shards * fine) + 1
    bundles = shards * fine
    groups = stage(groups.withColumn("unit", F.when(F.col("size") < limit, _bundle(F.col("digest"), bundles))),
                   "groups")
    large = groups.where(F.col("unit").isNull()).select("digest", "size").collect()  # at most shards * fine
    small = groups.where(F.col("unit").isNotNull()).groupBy("unit").agg(F.sum("size").alias("size")).collect()
    placed = schedule([(r["digest"], r["size"]) for r in large] + [(r["unit"], r["size"]) for r in small], shards)

    def table(names: list, column: str, kind: str) -> DataFrame:
        # Both tables have at most shards * fine rows.
        return F.broadcast(spark.createDataFrame(
            [(n, placed[n]) for n in names], f"{column} {kind}, {column}_shard int").coalesce(1))

    put = stage(
        rows.withColumn("unit", _bundle(F.col("digest"), bundles))
        .join(table([r["digest"] for r in large], "digest", "string"), "digest", "left")
        .join(table([r["unit"] for r in small], "unit", "int"), "unit", "left")
        .select("key", "size", "text_crc32", F.coalesce("digest_shard", "unit_shard").alias("shard"),
                F.pmod(F.xxhash64("key", "digest"), F.lit((total[1] or 0) // PIECE_ROWS + 1)).alias("piece")),
        "placed")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = put.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "piece").orderBy("key", "text_crc32", "size")
    return (
        put.withColumn("at", F.row_number().over(inside))
        .join(bases, ["shard", "piece"])
        .select(F.col("key").alias(key), "size", "text_crc32", "shard",
                (F.col("base") + F.col("at") - 1).cast("long").alias("slot")))
