"""Inventories: the rows that detection works on, from a table's content column or from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, size_bytes long, created_ns long, modified_ns long, volume_id string, file_id string, "
    "link_kind string, hardlink_count long, access_status string, content binary"
)


def from_table(table: DataFrame, path: Column, content: Column, modified_ns: Column | None = None, **more: Column) -> DataFrame:
    """A table's rows as files of known identity-less content. A null content can't be read."""
    data = content.cast("binary")
    columns = {
        "path": path.cast("string"),
        "size_bytes": F.octet_length(data).cast("long"),
        "modified_ns": F.lit(0).cast("long") if modified_ns is None else modified_ns.cast("long"),
        "volume_id": F.lit(None).cast("string"),
        "file_id": F.lit(None).cast("string"),
        "hardlink_count": F.lit(1).cast("long"),
        "access_status": F.when(data.isNull(), "denied").otherwise("readable"),
        "content": data,
    } | more
    return table.select(*[c.alias(k) for k, c in columns.items()])


def of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as an inventory: every attribute a file has is derived from a row, so that each rule has cases."""
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i, lang_size = F.col("doc_id"), F.concat(F.col("lang"), F.lit("_"), F.col("n_chars").cast("string"))
    leaf = F.when(i % 7 == 0, F.upper(lang_size)).when(i % 11 == 0, F.concat(F.lit("renamed_"), i.cast("string"))).otherwise(lang_size)
    end = F.when(i % 4 <= 1, ".pdf").when(i % 4 == 2, ".PDF").otherwise(".txt")
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.when(i % 23 == 0, "cache/").otherwise(""), F.lit("d"), i.cast("string"), F.lit("/"), F.when(i % 19 == 0, ".").otherwise(""), leaf, end)
    return from_table(
        t,
        path,
        F.col("text"),
        (i * 37) % 19,
        doc_id=i,
        source=F.col("source"),
        volume_id=F.when(i % 17 != 0, F.concat(F.lit("vol"), (i % 2).cast("string"))),
        file_id=F.when(i % 17 != 0, (i % 10).cast("string")),
        hardlink_count=F.when(i % 13 == 0, 2).otherwise(1).cast("long"),
        access_status=F.when(i % 41 == 0, "denied").otherwise("readable"),
        sha256=F.sha2(F.col("text").cast("binary"), 256),
        ascii_paths=F.lit(True),
    )
