"""File history over sessions: snapshots with what became of each, totals, search and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.functions.shared import written
from echofold.functions.text import ascii_lower

PROBLEMS = ("denied", "offline", "missing", "error")


def other_paths(members: DataFrame) -> DataFrame:
    """(group_id, path, others): the sorted paths of the rest of a group, one array a group and not a self-join."""
    paths = members.groupBy("group_id").agg(F.array_sort(F.collect_list("path")).alias("__all"))
    joined = members.select("group_id", "path").join(paths, "group_id")
    return joined.select("group_id", "path", F.array_join(F.filter("__all", lambda p: p != F.col("path")), "\n").alias("others"))


def history(snapshots: DataFrame, recommended: DataFrame) -> DataFrame:
    """Every snapshot, with group, action, reason and other places for those that are duplicates. What detection found is written once and read for both."""
    recommended = written(recommended.select("group_id", "path", "action", "reason"))
    facts = recommended.join(other_paths(recommended), ["group_id", "path"])
    return snapshots.join(facts, "path", "left")


def page_of(snapshots: DataFrame, recommended: DataFrame, number: int = 0, size: int = 50, stored: bool = False) -> DataFrame:
    """page(history()): the page is taken from the snapshots alone, and only its rows and their groups are joined.

    stored: recommended is a table already, and isn't written for being read twice.
    """
    rows = page(snapshots, number, size)
    own = F.broadcast(snapshots.sparkSession.createDataFrame(rows.collect(), rows.schema))  # 200 rows at most
    recommended = recommended.select("group_id", "path", "action", "reason")
    recommended = recommended if stored else written(recommended)
    hit = recommended.join(own.select("path"), "path", "left_semi")
    groups = F.broadcast(hit.select("group_id").distinct())
    facts = hit.join(other_paths(recommended.join(groups, "group_id", "left_semi")), ["group_id", "path"])
    return own.join(facts, "path", "left").orderBy(F.col("modified_ns").desc(), "path")


def duplicates(snapshots: DataFrame, recommended: DataFrame) -> DataFrame:
    return history(snapshots, recommended).where("group_id is not null")


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose path or group holds text, ASCII case aside; blank text means all."""
    text = text.strip()
    if not text:
        return rows
    needle = ascii_lower(F.lit(text))
    hit = lambda c: F.coalesce(F.contains(ascii_lower(F.col(c)), needle), F.lit(False))
    return rows.where(hit("path") | hit("group_id"))


def page(rows: DataFrame, number: int = 0, size: int = 50) -> DataFrame:
    """A page in the order newest, path; size is kept to 1 to 200."""
    size = max(1, min(200, size))
    return rows.orderBy(F.col("modified_ns").desc(), "path").offset(max(0, number) * size).limit(size)


def totals(rows: DataFrame) -> DataFrame:
    """One row: files seen, duplicates, groups and files with problems."""
    return rows.agg(
        F.count(F.lit(1)).alias("files"), F.count("group_id").alias("duplicate_files"), F.countDistinct("group_id").alias("groups"), F.count_if(F.col("access_status").isin(*PROBLEMS)).alias("problems")
    )


def storage(rows: DataFrame, total: int | None = None) -> DataFrame:
    """Bytes by class of extension, and with a total what no class accounts for, at least 0."""
    kind = F.when(F.col("extension") == "pdf", "document").when(F.col("extension") == "txt", "text").otherwise("other")
    found = rows.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    if total is None:
        return found
    rest = found.agg(F.lit("unaccounted").alias("class"), F.lit(0).cast("long").alias("files"), F.greatest(F.lit(0), F.lit(total) - F.coalesce(F.sum("bytes"), F.lit(0))).cast("long").alias("bytes"))
    return found.unionByName(rest)


def session_diff(before: DataFrame, after: DataFrame, key: str = "group_id") -> dict[str, DataFrame]:
    """Groups added, removed and common between two sessions."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return {"added": b.exceptAll(a), "removed": a.exceptAll(b), "common": a.intersect(b)}
