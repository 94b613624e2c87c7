"""Helpers that the training-data operators share.

All operators take the names of their key and text columns and read no others, so further
columns of the input, whatever their names, neither clash nor travel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The two columns that an operator reads, as ``key`` and ``text``; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias("key"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def crc_of_id(key: str | Column) -> Column:
    """crc32 of an id written as decimal text; null for a null id."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string"))


def byte_sizes(values: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype("int64")


def portions(batches: Iterable[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most about ``most`` bytes of ``column``; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.cumsum(byte_sizes(batch.column(column))) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            yield batch.slice(low, high - low)


def gathered(batches: Iterable[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Join and cut Arrow batches to blocks of about ``most`` bytes of ``column``; rows stay whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in portions(batches, most, column):
        held.append(batch)
        size += int(byte_sizes(batch.column(column)).sum())
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
