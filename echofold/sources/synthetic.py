"""Deterministic inventories of any size: each two files in a row have the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic(spark: SparkSession, files: int, shards: int = 128, size: int = 4096) -> DataFrame:
    """path, size_bytes, modified_ns and sha256, made in the executors; file i holds the content i // 2."""
    i = F.col("id")
    return spark.range(files).select(
        F.concat(F.lit("/shard"), (i % shards).cast("string"), F.lit("/file"), i.cast("string"), F.lit(".pdf")).alias("path"),
        F.lit(size).cast("long").alias("size_bytes"),
        (i * 37 % 19).alias("modified_ns"),
        F.sha2(F.floor(i / 2).cast("string"), 256).alias("sha256"),
    )
