"""Token counts of documents in flat token files that have no index.

A file is a run of fixed-width little-endian ids in which one id ends a document. Blocks of a file
are read by their offsets and searched for that id with numpy, whatever document they begin in.
What a block cannot know, the end before its first one and the number of documents before it,
comes from a prefix scan over block summaries: inside runs of blocks first, then over the runs.

Files are read and written through pyarrow's file systems, so their folder may be a local path of
a single machine or any shared store that pyarrow opens (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import keyed_text, portions
from riskloom.llm.pieces import BATCH_BYTES, PieceTable
from riskloom.staging import stage

BLOCK_TOKENS = 1 << 20
RUN_BLOCKS = 1024


def write_files(docs: DataFrame, model: str, folder: str, width: int = 2, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Encode ``docs`` into one flat file per task below ``folder``; the stored manifest of what is valid.

    Manifest rows: ``file``, ``doc`` (number in the file) and ``key``. A file has the name of the task
    attempt that wrote it, and only attempts that ended well are in the manifest, so what lost
    attempts left behind is never read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        number, pieces = 0, PieceTable(model)
        end = pieces.model.eos_id()
        with store.open_output_stream(f"{path}/{name}") as out:
            for batch in portions(batches, BATCH_BYTES):
                for ids in pieces.encode(batch.column("text").to_pylist()):
                    out.write(np.array([*ids, end], f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{name}"] * batch.num_rows),
                     pa.array(np.arange(number, number + batch.num_rows)), batch.column("key")],
                    names=["file", "doc", "key"])
                number += batch.num_rows

    return stage(keyed_text(docs, key, text).mapInArrow(run, "file string, doc long, key long"), "manifest")


def token_counts(files: DataFrame, end: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per document of ``files`` (``file``): ``file``, ``doc``, ``start``, ``n_tokens``, ``ended``.

    ``n_tokens`` leaves out the end id. Tokens behind the last end are a document that is not
    ``ended``. Repeated names are read once; null names and empty files have no documents. A file
    whose size is no multiple of ``width`` raises an error.
    """
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("file").to_pylist()
            found = []
            for name in names:
                store, path = fs.FileSystem.from_uri(name)
                size = store.get_file_info(path).size
                if size is None or size % width:
                    raise ValueError(f"{name} is no file of {width}-byte ids")
                found.append(size // width)
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(found, pa.int64())], names=["file", "tokens"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, tokens, block in zip(*(batch.column(c).to_pylist() for c in ("file", "tokens", "block"))):
                first = block * block_tokens
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as source:
                    raw = source.read_at(min(block_tokens, tokens - first) * width, first * width)
                ends = np.flatnonzero(np.frombuffer(raw, f"<u{width}") == end) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([tokens], pa.int64()), pa.array([block], pa.int64()),
                     pa.array([ends], pa.list_(pa.int64()))], names=["file", "tokens", "block", "ends"])

    sized = files.select("file").where(F.col("file").isNotNull()).distinct().mapInArrow(sizes, "file string, tokens long")
    blocks = sized.where(F.col("tokens") > 0).select(
        "file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block_tokens)))
        .alias("block"))
    found = stage(blocks.repartition("file", "block").mapInArrow(
        read, "file string, tokens long, block long, ends array<long>"), "ends")
    run = F.floor(F.col("block") / RUN_BLOCKS)
    heads = found.select("file", "block", run.alias("run"), F.size("ends").cast("long").alias("n"),
                         F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = heads.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last")).select(
        "file", "run", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("run_n"), F.max("last").over(over).alias("run_last"))
    carried = heads.select(
        "file", "block", "run", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("in_n"),
        F.max("last").over(inside).alias("in_last")).join(runs, ["file", "run"]).select(
        "file", "block", (F.col("in_n") + F.col("run_n")).alias("before"),
        (F.coalesce("in_last", "run_last", F.lit(-1)) + 1).alias("from"))
    whole = found.join(carried, ["file", "block"])
    at = F.col("at")
    ended = whole.select("file", "before", "from", "ends", F.posexplode("ends").alias("at", "stop")).select(
        "file", (F.col("before") + at).alias("doc"),
        F.when(at == 0, F.col("from")).otherwise(F.get("ends", at - 1) + 1).alias("start"), "stop",
        F.lit(True).alias("ended"))
    tail_start = F.coalesce(F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1), F.col("from"))
    tails = whole.where(F.col("block") == F.floor((F.col("tokens") - 1) / block_tokens)).select(
        "file", (F.col("before") + F.size("ends")).alias("doc"), tail_start.alias("start"), F.col("tokens").alias("stop"),
        F.lit(False).alias("ended")).where(F.col("start") < F.col("stop"))
    return ended.unionByName(tails).select("file", "doc", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")
