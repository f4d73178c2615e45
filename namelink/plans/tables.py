"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_base: list[str] = []
_paths: "weakref.WeakKeyDictionary[SparkSession, list[str]]" = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in local mode without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _base:
        folder = tempfile.mkdtemp(prefix="namelink-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _base.append(f"file://{folder}")
    return _base[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows neither recomputes it nor loses it with an executor."""
    path = os.path.join(shared_folder(df.sparkSession), "namelink", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _paths.setdefault(df.sparkSession, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this session wrote; nothing that reads them may run afterwards."""
    for path in _paths.pop(spark, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
