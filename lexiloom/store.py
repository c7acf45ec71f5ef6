"""Intermediate tables and files in the folder that driver and executors share.

A written table cuts the lineage, is computed once however often it is read,
and survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: a temporary one, in local mode only, as other masters' executors could not read it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.get(sc.applicationId) or _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="lexiloom-"))
    top = f"{base.rstrip('/')}/lexiloom-{sc.applicationId}"
    if top not in _cleaned:
        _cleaned.add(top)
        atexit.register(_remove, spark, top)
    return top


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, top: str) -> None:
    try:
        at, files = _file_system(spark, top)
        files.delete(at, True)
    except Exception:  # the session has ended already; the folder belongs to a finished application
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_file(spark: SparkSession, name: str, parts: list[bytes]) -> str:
    """Writes one file into the shared folder; returns its path."""
    path = f"{shared_dir(spark)}/files/{name}"
    at, files = _file_system(spark, path)
    out = files.create(at, True)
    try:
        for part in parts:
            for k in range(0, len(part), 1 << 20):
                out.write(bytearray(part[k : k + (1 << 20)]))
    finally:
        out.close()
    return path


def small(table: DataFrame, rows: int) -> DataFrame:
    """A written table with the hint to broadcast it if it has at most so many rows; else the planner decides."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
