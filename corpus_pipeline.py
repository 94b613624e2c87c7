"""From raw documents to token ids: five stages over whole tables.

Each stage is a function of (spark, docs, sf_dir), where ``docs`` is what the stage before kept. All
but the last return the columns of ``documents``. Every stage decides by row: rows that share a ``doc_id``
do not decide for each other, and of rows that repeat id and text one stays. A row without an id is judged like any
other; it stays as the first of its copies only where none of them has an id. Null texts count as empty everywhere.
Columns beside ``doc_id`` and ``text`` travel along and are never read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import fingerprints, owners, phrases, pieces, quality
from riskloom.staging import stage


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number per row, and the name of that column. Written once, so a retry sees the same numbers."""
    row = "_row"
    while row.lower() in (c.lower() for c in docs.columns):
        row += "_"
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", compression="zstd"), row


def _without(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the numbers of ``dropped``. Few rows are dropped, so the optimizer may broadcast them."""
    return docs.join(dropped.select(row), row, "left_anti").drop(row)


def _copies(docs: DataFrame, row: str, found: DataFrame, group: str) -> DataFrame:
    """Numbers of the rows that are not the first of their group, by id, then by number; rows without an id come last."""
    named = stage(found.select(F.col(row), F.col(group).alias("_group")).join(
        docs.select(row, F.col("doc_id").cast("long").alias("_id")), row), "named")
    order = F.struct(F.isnull("_id").alias("_unnamed"), "_id", row)
    first = named.groupBy("_group").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = stage(first.where("_n > 1").select("_group", F.col(f"_first.{row}").alias("_kept")), "first")
    return stage(named.join(first, "_group").where(F.col(row) != F.col("_kept")).select(row), "copies")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_owners(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the row with the smallest id."""
    docs, row = _numbered(docs)
    found = stage(owners.exact_owners(docs, row).where("group_size > 1").select(row, "keep_id"), "exact")
    return _without(docs, row, _copies(docs, row, found, "keep_id"))


def near_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash, the row with the smallest id."""
    docs, row = _numbered(docs)
    found = stage(fingerprints.near_components(fingerprints.fingerprints(docs, row), row), "near")
    return _without(docs, row, _copies(docs, row, found, "component_id"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies in a benchmark window."""
    docs, row = _numbered(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = stage(phrases.contamination(docs, benchmark, key=row).where("contaminated").select(row), "phrases")
    return _without(docs, row, found)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids with their end, and the digest of the text they decode to."""
    coded = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("exact", exact_owners),
    ("near", near_representatives),
    ("benchmark", uncontaminated),
    ("pieces", token_ids),
]

#: Fitted classifiers, components and the tokenizer have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
