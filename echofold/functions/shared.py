"""Tables written to the folder that all executors share: they cut lineage, are read by many steps, and outlive any executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder in local mode only. It is deleted at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="echofold-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/echofold-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except OSError:
            pass


def written(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a count of the rows."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
