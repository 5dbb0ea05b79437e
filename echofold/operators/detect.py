"""Duplicate detection: candidates by size and name, digests of candidates only, physical aliases collapsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions import text as T
from echofold.functions.shared import written

STRICT, CONTENT = "strict", "content"
SAMPLE = 64 << 10


def eligible(inventory: DataFrame) -> DataFrame:
    """Rows that can be evidence: readable, not a link, of one name only."""
    test = (F.col("access_status") == "readable") & (F.coalesce("hardlink_count", F.lit(1)) == 1)
    if "link_kind" in inventory.columns:
        test &= F.col("link_kind") != "hardlink"
    return inventory.where(test).withColumn("name", T.normalized_name(F.col("path"), ascii_only="ascii_paths" in inventory.columns))


def keys(mode: str) -> list[str]:
    return ["size_bytes", "name"] if mode == STRICT else ["size_bytes"]


def candidate_groups(inventory: DataFrame, mode: str = STRICT) -> DataFrame:
    """(size_bytes[, name], files) of the keys that two or more files share."""
    return eligible(inventory).groupBy(*keys(mode)).agg(F.count(F.lit(1)).alias("files")).where("files >= 2")


def candidates(inventory: DataFrame, mode: str = STRICT) -> DataFrame:
    """The eligible files whose key another one shares; only they are read for digests."""
    return eligible(inventory).join(candidate_groups(inventory, mode).drop("files"), keys(mode), "left_semi")


def quick_signature(content: Column, size: Column) -> Column:
    """Digest of the size and up to three samples: the whole of a small content, else its head, middle and tail."""
    at = lambda offset: F.concat(offset.cast("string").cast("binary"), F.lit(":").cast("binary"), F.substring(content, offset.cast("int") + 1, F.lit(SAMPLE)))
    head, middle, tail = F.lit(0).cast("long"), F.floor(size / 2) - SAMPLE // 2, size - SAMPLE
    small = F.concat(size.cast("string").cast("binary"), F.lit("|").cast("binary"), content)
    large = F.concat(size.cast("string").cast("binary"), F.lit("|").cast("binary"), at(head), at(middle), at(tail))
    return F.sha2(F.when(size <= SAMPLE, small).otherwise(large), 256)


def sampled_bytes(size: Column) -> Column:
    return F.when(size <= SAMPLE, size).otherwise(F.least(size, F.lit(3 * SAMPLE)))


def group_id(mode: str) -> Column:
    name = F.col("name") if mode == STRICT else F.lit("")
    return F.sha2(F.concat_ws("|", F.lit(mode), F.col("size_bytes").cast("string"), name, F.col("sha256")), 256)


def one_per_identity(files: DataFrame, group: list[str]) -> DataFrame:
    """The first path (in normal form) of each physical file within a group; files of unknown identity are files of their own. One aggregate."""
    columns = [c for c in files.columns if c not in group]
    known = F.col("volume_id").isNotNull() & F.col("file_id").isNotNull()
    row = F.struct(F.lower("path").alias("__normal"), "path", *[c for c in columns if c != "path"])
    found = files.withColumn("__alone", F.when(~known, F.col("path"))).groupBy(*group, F.when(known, F.col("volume_id")).alias("__v"), F.when(known, F.col("file_id")).alias("__f"), "__alone").agg(F.min(row).alias("__row"))
    return found.select(*group, *[F.col(f"__row.{c}").alias(c) for c in columns])


def members(inventory: DataFrame, mode: str = STRICT, cascade: bool = False) -> DataFrame:
    """Proven duplicates: group_id, the group's key, sha256 (and blake3, if the inventory has it), path, modified_ns, identity and doc_id of each.

    The inventory is read once: keys and digests are projected before anything is shuffled, the files of a group are
    folded by identity and written, and a count of the groups picks those of two or more; no task gets a whole group.
    cascade: read no content whole whose quick signature no other has. It saves reading whole files from a file source;
    a table's content is read anyway, so that there it only costs a shuffle. The result is the same.
    """
    found = eligible(inventory)
    if cascade:
        found = candidates(inventory, mode)
        found = found.withColumn("quick", quick_signature(F.col("content"), F.col("size_bytes")))
        again = found.groupBy(*keys(mode), "quick").count().where("count >= 2").drop("count")
        found = found.join(again, [*keys(mode), "quick"], "left_semi")
    if "sha256" not in found.columns:
        found = found.withColumn("sha256", F.sha2("content", 256))
    proofs = [c for c in ("sha256", "blake3") if c in found.columns]
    kept = [c for c in ("doc_id", "path", "modified_ns", "volume_id", "file_id") if c in found.columns]
    group = [*keys(mode), *proofs]
    single = written(one_per_identity(found.where("sha256 is not null").select(*group, *kept), group))
    twice = single.groupBy(*[F.col(c).alias(f"__{c}") for c in group]).agg(F.count(F.lit(1)).alias("group_size")).where("group_size >= 2")
    same = F.lit(True)
    for c in group:
        same &= F.col(c) == F.col(f"__{c}")
    joined = single.join(twice, same).drop(*[f"__{c}" for c in group])  # broadcast at run time if it proves small
    return joined.withColumn("group_id", group_id(mode)).drop(*([] if mode == STRICT else ["name"]))


def double_proof_groups(inventory: DataFrame, mode: str = STRICT) -> DataFrame:
    """(the group's key, sha256, blake3, files) of files that agree in both digests; files of an unstable digest are no evidence."""
    found = members(inventory.where("stable"), mode)
    return found.groupBy(*[c for c in keys(mode)], "sha256", "blake3").agg(F.count(F.lit(1)).alias("files"))


def groups(inventory: DataFrame, mode: str = STRICT) -> DataFrame:
    """One row for each group with what removing all but one would free."""
    by = ["group_id", *keys(mode), "sha256"]
    found = members(inventory, mode).groupBy(*by).agg(F.count(F.lit(1)).alias("files"))
    return found.withColumn("reclaimable_bytes", reclaimable(F.col("size_bytes"), F.col("files")))


def reclaimable(size: Column, files: Column) -> Column:
    """size * (files - 1), at most the largest long."""
    return F.coalesce(F.try_multiply(size, F.greatest(files - 1, F.lit(0).cast("long"))), F.lit((1 << 63) - 1))


def telemetry(inventory: DataFrame, mode: str = STRICT) -> DataFrame:
    """One row: files seen, unreadable, linked, unstable (where that is known) and candidates, and the bytes their quick and full digests read."""
    unstable = F.count_if(~F.col("stable")) if "stable" in inventory.columns else F.lit(0).cast("long")
    seen = inventory.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("access_status") != "readable").alias("unreadable"), F.count_if(F.coalesce("hardlink_count", F.lit(1)) > 1).alias("linked"), unstable.alias("unstable"))
    read = candidates(inventory, mode).agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum(sampled_bytes(F.col("size_bytes"))), F.lit(0)).alias("quick_bytes"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("full_bytes"))
    return seen.crossJoin(read)


def stable(before: list[Column], after: list[Column]) -> Column:
    """Whether evidence taken before and after reading agrees, nulls included."""
    test = F.lit(True)
    for a, b in zip(before, after):
        test &= a.eqNullSafe(b)
    return test


def volume_key(volume: Column) -> Column:
    """Files of unknown volume share a bucket."""
    return F.coalesce(volume, F.lit("__unknown_volume__"))


def by_volume(files: DataFrame, tasks_per_volume: int, order: tuple[str, ...] = ("path",)) -> DataFrame:
    """files in at most so many tasks for each volume, so that no disk is read by more at once, whatever the other volumes; in order within each."""
    lane = F.pmod(F.xxhash64(*order), F.lit(tasks_per_volume))
    volumes = files.select(volume_key(F.col("volume_id")).alias("v")).distinct().count()
    return files.withColumns({"volume_key": volume_key(F.col("volume_id")), "lane": lane}).repartition(max(1, volumes * tasks_per_volume), "volume_key", "lane").sortWithinPartitions("volume_key", "lane", *order)
