"""Reports and table sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.errors import DurabilityError, InvalidInput

COLUMNS = ("group_id", "path", "size_bytes", "action", "reason", "blake3", "sha256", "verified")


def rows(recommended: DataFrame) -> DataFrame:
    """The report's eight columns, one row for each member. verified: both digests are there and were stable (columns blake3, and stable if any)."""
    has = lambda c: F.col(c) if c in recommended.columns else F.lit(None).cast("string")
    stable = F.coalesce(F.col("stable"), F.lit(False)) if "stable" in recommended.columns else F.lit(True)
    verified = has("blake3").isNotNull() & has("sha256").isNotNull() & stable
    return recommended.select("group_id", "path", "size_bytes", "action", "reason", has("blake3").alias("blake3"), has("sha256").alias("sha256"), verified.alias("verified"))


def nested(report: DataFrame) -> DataFrame:
    """One row for each group with its members as an array; groups of large files first."""
    member = F.struct("path", "action", "reason", "blake3", "sha256", "verified")
    return report.groupBy("group_id", "size_bytes").agg(F.array_sort(F.collect_list(member)).alias("members")).orderBy(F.col("size_bytes").desc(), "group_id")


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def html_rows(report: DataFrame) -> DataFrame:
    """(group_id, path, html): a table row each, its class the action."""
    cells = F.concat(*[F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in ("group_id", "path", "size_bytes", "reason")])
    return report.select("group_id", "path", F.concat(F.lit('<tr class="'), escaped(F.col("action")), F.lit('">'), cells, F.lit("</tr>")).alias("html"))


def humanized(size: Column) -> Column:
    """Bytes in units of 1024 with one decimal."""
    out = F.format_string("%d B", size)
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(size >= 1024**power, F.concat(F.format_string("%.1f", size / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


HEAD = "<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Duplicates</title><style>.keep{background:#dfd}.quarantine{background:#fdd}</style></head><body><table><tr><th>group</th><th>path</th><th>bytes</th><th>reason</th></tr>"


def _one_document(lines: DataFrame, path: str, head: str, between: str, tail: str, name: str) -> None:
    """Streams ordered lines, partition by partition, into one file of a new folder."""
    os.makedirs(path)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(head + "\n")
        for k, row in enumerate(lines.toLocalIterator(prefetchPartitions=True)):
            f.write((between if k else "") + row.value + "\n")
        f.write(tail + "\n")


def export(report: DataFrame, kind: str, path: str) -> None:
    """Writes a new folder: csv in parallel; json (one array of groups with their members) and html (one page) as one file each, streamed in order."""
    if kind == "csv":
        report.select(*COLUMNS).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        lines = nested(report).select(F.to_json(F.struct("group_id", "size_bytes", "members"), {"ignoreNullFields": "false"}).alias("value"))
        _one_document(lines, path, "[", ",", "]", "report.json")
    elif kind == "html":
        page = html_rows(report).orderBy("group_id", "path").select(F.col("html").alias("value"))
        _one_document(page, path, HEAD, "", "</table></body></html>", "report.html")
    else:
        raise InvalidInput(f"no report format {kind!r}")


def replace_session(rows_: DataFrame, path: str) -> None:
    """Replaces the sessions that rows_ has, and only those, so that a repeated write changes nothing."""
    rows_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def backup(spark: SparkSession, source: str, target: str) -> None:
    """Copies a table and never overwrites one."""
    spark.read.parquet(source).write.mode("errorifexists").parquet(target)


def _bytes(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def compact(spark: SparkSession, source: str, target: str, files: int) -> dict[str, int]:
    """Rewrites a table into fewer files: rows, files, and bytes before, after and reclaimed. Raises if a row went missing."""
    before = spark.read.parquet(source)
    before.coalesce(files).write.mode("errorifexists").parquet(target)
    after = spark.read.parquet(target)
    n = after.count()
    if n != before.count():
        raise DurabilityError("compaction changed the number of rows")
    old, new = _bytes(spark, source), _bytes(spark, target)
    return {"rows": n, "files": len(after.inputFiles()), "before": old, "after": new, "reclaimed": max(0, old - new)}


def constraint_violations(df: DataFrame, unique: list[list[str]] = (), allowed: dict[str, tuple] | None = None, required: tuple[str, ...] = (), nonnegative: tuple[str, ...] = ()) -> DataFrame:
    """(violation, n): what a schema's CHECK, UNIQUE and NOT NULL would refuse."""
    tests = [(f"{c} null", F.col(c).isNull()) for c in required]
    tests += [(f"{c} not allowed", ~F.col(c).isin(*v)) for c, v in (allowed or {}).items()]
    tests += [(f"{c} negative", F.col(c) < 0) for c in nonnegative]
    spark = df.sparkSession
    out = spark.createDataFrame([], "violation string, n long")
    if tests:
        counted = df.agg(*[F.count_if(t).alias(str(k)) for k, (_, t) in enumerate(tests)])
        pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("violation"), F.col(str(k)).alias("n")) for k, (name, _) in enumerate(tests)]))
        out = out.unionByName(counted.select(pairs.alias("x")).select("x.*"))
    for key in unique:
        again = df.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(again.select(F.lit(f"{'+'.join(key)} not unique").alias("violation"), "n"))
    return out.where("n > 0")
