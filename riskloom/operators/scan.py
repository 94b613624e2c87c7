"""Skew-safe building blocks: ordered scans and stored lookups.

``Window.partitionBy(project)`` would send a whole project to one task, and a project may hold
a third of all rows. The operators here range-partition on (group, order keys) instead, so a
big group spreads over many tasks, and combine the pieces with one row per (group, piece).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.staging import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def lookup(small: DataFrame) -> DataFrame:
    """Store an aggregate that a join reads: it is computed once, and the optimizer sees its true size.

    Below the session's broadcast threshold Spark sends it to every task, above it shuffles both sides
    and splits skewed keys.
    """
    return stage(small, "lookup")


def _before(group: Sequence[str]):
    keys = list(group) or [F.lit(0)]
    # At most one row per range partition and group.
    return Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column],
           into: str = "rank") -> DataFrame:
    """Add the 1-based position of every row inside its group.

    ``group`` columns must not be null and ``order`` must be total within a group.
    """
    group = list(group)
    keys = [*map(F.col, group), *order]
    placed = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_piece", F.shiftright("_at", _ROW_BITS))
    runs = (
        placed.groupBy(*group, "_piece")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_base", F.coalesce(F.sum("_rows").over(_before(group)), F.lit(0)))
        .drop("_rows")
    )
    return (
        placed.join(lookup(runs), [*group, "_piece"])
        .withColumn(into, F.col("_at") - F.col("_first") + F.col("_base") + 1)
        .drop("_at", "_first", "_base", "_piece")
    )


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column],
            sums: Sequence[str], into: str = "position") -> DataFrame:
    """Add the position and, for each column of ``sums``, its inclusive running total."""
    group = list(group)
    keys = [*map(F.col, group), *order]
    placed = stage(
        df.repartitionByRange(*keys)
        .withColumn("_piece", F.spark_partition_id()),
        "running",
    )
    before = _before(group)
    pieces = placed.groupBy(*group, "_piece").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    bases = pieces.select(
        *group, "_piece",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums],
    )
    local = Window.partitionBy(*group, "_piece").orderBy(*order)
    inclusive = local.rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn(into, F.row_number().over(local).cast("long"))
        .withColumns({f"running_{c}": F.sum(c).over(inclusive) for c in sums})
        .join(lookup(bases), [*group, "_piece"])
        .withColumn(into, F.col(into) + F.col("_n"))
        .withColumns({f"running_{c}": F.col(f"running_{c}") + F.col(f"_s_{c}") for c in sums})
        .drop("_piece", "_n", *[f"_s_{c}" for c in sums])
    )
