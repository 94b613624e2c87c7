"""Materialised intermediate tables that survive the loss of executors.

Results that several jobs read again are written once as Parquet below the shared folder
named by ``spark.checkpoint.dir``. Only a local session without that setting (tests) gets a
folder of its own; a cluster session without it is an error, because a machine-local folder
is not visible to the other executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_TABLES: dict[tuple[str, str], DataFrame] = {}


def staging_root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/riskloom-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOTS[app]


def stage(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` once, with the given Parquet options, and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_once(spark: SparkSession, name: str, build) -> DataFrame:
    """Stage ``build()`` under ``name`` the first time this session asks for it."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _TABLES:
        _TABLES[key] = stage(build(), "table")
    return _TABLES[key]


def keep_once(spark: SparkSession, name: str, build) -> DataFrame:
    """Keep ``build()``, a row-local view of tables that are stored already, under ``name`` without storing it again."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _TABLES:
        _TABLES[key] = build()
    return _TABLES[key]


def drop_staged(spark: SparkSession) -> None:
    """Delete everything this session staged."""
    app = spark.sparkContext.applicationId
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _LOCAL_ROOTS.pop(app, None)
    for key in [key for key in _TABLES if key[0] == app]:
        del _TABLES[key]
