"""Logs, manifests and caches, sizes, versions and counters: what keeps an installation in order."""

from __future__ import annotations

import json
import logging
import os
import re
import resource
import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from echofold.errors import DurabilityError, InvalidInput, SafetyError

KEEP_DAYS = (7, 3650)
MANIFEST = "version int, components array<struct<id:string,file:string,size_bytes:bigint,sha256:string,required:boolean>>"
DAY_NS = 86_400 * 10**9


# ------------------------------------------------------------------------------ logs


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds")
        return json.dumps({"at": at, "level": record.levelname.lower(), "target": record.name, "message": record.getMessage()} | getattr(record, "fields", {}), default=str)


def log_to(folder: str, day: str | None = None) -> logging.Logger:
    """A logger that writes one JSON-lines file and one text file a day."""
    os.makedirs(folder, exist_ok=True)
    day = day or datetime.now(timezone.utc).strftime("%Y-%m-%d")
    log = logging.getLogger(f"echofold.{os.path.abspath(folder)}.{day}")
    if not log.handlers:
        log.setLevel(logging.INFO)
        log.propagate = False
        for name, formatter in ((f"echofold-{day}.jsonl", _JsonLines()), (f"echofold-{day}.log", logging.Formatter("%(asctime)s %(levelname)s %(message)s"))):
            handler = logging.FileHandler(os.path.join(folder, name), encoding="utf-8")
            handler.setFormatter(formatter)
            log.addHandler(handler)
    return log


def expired(files: DataFrame, now_ns: int, days: int) -> DataFrame:
    """Files last modified before the cutoff; days must be 7 to 3650."""
    if not KEEP_DAYS[0] <= days <= KEEP_DAYS[1]:
        raise InvalidInput(f"logs are kept {KEEP_DAYS[0]} to {KEEP_DAYS[1]} days")
    return files.where(F.col("modified_ns") < now_ns - days * DAY_NS)


def cleanup_totals(files: DataFrame, now_ns: int, days: int) -> DataFrame:
    """One row: files and bytes that would go, and that stay."""
    gone = F.col("modified_ns") < now_ns - days * DAY_NS
    expired(files.limit(0), now_ns, days)
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("size_bytes"))), F.lit(0))
    return files.agg(F.count_if(gone).alias("removed_files"), total(gone).alias("removed_bytes"), F.count_if(~gone).alias("kept_files"), total(~gone).alias("kept_bytes"))


def clean_logs(folder: str, days: int, now: float | None = None) -> dict[str, int]:
    """Removes the folder's own log files older than so many days; others, links and folders stay."""
    if not KEEP_DAYS[0] <= days <= KEEP_DAYS[1]:
        raise InvalidInput(f"logs are kept {KEEP_DAYS[0]} to {KEEP_DAYS[1]} days")
    cutoff, out = (time.time() if now is None else now) - days * 86_400, {"removed_files": 0, "removed_bytes": 0}
    for e in os.scandir(folder) if os.path.isdir(folder) else ():
        if e.is_file(follow_symlinks=False) and re.fullmatch(r"echofold-.*\.(jsonl|log)", e.name) and e.stat().st_mtime < cutoff:
            out = {"removed_files": out["removed_files"] + 1, "removed_bytes": out["removed_bytes"] + e.stat().st_size}
            os.unlink(e.path)
    return out


# ------------------------------------------------------------------------------ manifests and caches


def parsed_manifest(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """Components of manifests in JSON, a row each: version, id, file, size_bytes, sha256, required. What isn't JSON has no rows."""
    parsed = manifests.select(F.from_json(column, MANIFEST).alias("m")).where("m is not null")
    return parsed.select(F.col("m.version").alias("version"), F.explode("m.components").alias("c")).select("version", "c.*")


def manifest_violations(components: DataFrame) -> DataFrame:
    """(id, violation) of components that may not be used: every test by itself."""
    plain = F.coalesce(F.col("file").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.contains("file", F.lit("..")), F.lit(False))
    tests = {
        "no id": F.coalesce(F.trim("id"), F.lit("")) == "",
        "unknown version": ~F.coalesce(F.col("version") == 1, F.lit(False)),
        "no plain file name": ~plain,
        "no size": ~F.coalesce(F.col("size_bytes") > 0, F.lit(False)),
        "no digest": ~F.coalesce(F.col("sha256").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False)),
    }
    found = components.select("id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))).alias("violation"))
    again = components.groupBy("id").count().where("count > 1 and id is not null").select("id", F.lit("id not unique").alias("violation"))
    return found.unionByName(again)


def preflight(components: DataFrame, installed: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, class, cached_bytes): installed, cached (whole and equal), partial (some bytes of it) or missing.

    installed: id. cache: file, size_bytes, sha256 (null for a download that isn't finished).
    """
    have = cache.select(F.col("file").alias("__file"), F.col("size_bytes").alias("__size"), F.col("sha256").alias("__sha"))
    joined = components.join(installed.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left").join(have, F.col("file") == F.col("__file"), "left")
    whole = promotable(F.col("__size"), F.col("__sha"), F.col("size_bytes"), F.col("sha256"))
    kind = F.when(F.col("__id").isNotNull(), "installed").when(whole, "cached").when((F.col("__size") > 0) & (F.col("__size") < F.col("size_bytes")), "partial").otherwise("missing")
    return joined.select("id", kind.alias("class"), F.when(kind.isin("cached", "partial"), F.col("__size")).otherwise(F.lit(0)).cast("long").alias("cached_bytes"))


def promotable(size: Column, sha256: Column, wanted_size: Column, wanted_sha256: Column) -> Column:
    """Whether a download is exactly what was announced."""
    return F.coalesce((size == wanted_size) & (F.upper(sha256) == F.upper(wanted_sha256)), F.lit(False))


def promote(part: str, final: str, size: int, sha256: str) -> None:
    """Renames a finished .part to its name, if it is exactly what was announced."""
    from echofold.operators.effect import sha256_of

    if not part.endswith(".part") or os.path.islink(part):
        raise InvalidInput("not a .part file")
    if os.path.getsize(part) != size or sha256_of(part).upper() != sha256.upper():
        raise SafetyError("the download is not what was announced")
    os.replace(part, final)


def download_progress(components: DataFrame) -> DataFrame:
    """One row: bytes required and received (at most what is required of each) of required components, and ten-thousandths done (nothing to do is done). Duplicate ids and sums beyond a long raise."""
    again = F.when(F.count("id") != F.countDistinct("id"), F.raise_error(F.lit("an id occurs twice")).cast("long")).otherwise(F.lit(0))
    own = components.where("required")
    sums = own.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("required_bytes"), F.coalesce(F.sum(F.least("received_bytes", "size_bytes")), F.lit(0)).alias("received_bytes"), again.alias("__ok"))
    done = F.when(F.col("required_bytes") == 0, F.lit(10_000)).otherwise(F.expr("received_bytes * 10000 div required_bytes"))
    return sums.select("required_bytes", "received_bytes", (done + F.col("__ok")).cast("long").alias("basis_points"))


def http_range(header: Column) -> Column:
    """(first, last, total) of a Content-Range header, nulls if it isn't one."""
    pattern = r"^bytes (\d+)-(\d+)/(\d+)$"
    part = lambda k: F.regexp_extract(header, pattern, k).try_cast("long")
    ok = header.rlike(pattern) & (part(1) <= part(2)) & (part(2) < part(3))
    return F.struct(*[F.when(ok, part(k)).alias(n) for k, n in ((1, "first"), (2, "last"), (3, "total"))])


# ------------------------------------------------------------------------------ settings, sizes, versions, counters


def container_settings(mode: str, mounted_read_only: bool, command: tuple[str, ...]) -> None:
    """Raises unless a container may run the command: a read-only one needs a read-only mount, a writing one a writable mount, and none deletes."""
    if mode not in ("read-only", "read-write"):
        raise InvalidInput("the mode is read-only or read-write")
    if mounted_read_only != (mode == "read-only"):
        raise SafetyError(f"the library is mounted {'read-only' if mounted_read_only else 'writable'}, the mode is {mode}")
    if any("delete" in c for c in command):
        raise SafetyError("a container never deletes")
    if mode == "read-only" and command[:1] in (("quarantine",), ("restore",), ("recover-reconcile",)):
        raise SafetyError(f"{command[0]} needs the mode read-write")


def benchmark_totals(files: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: files and bytes, and MiB a second if it took so long."""
    total = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return files.agg(F.count(F.lit(1)).alias("files"), total.alias("bytes"), (total / F.lit(float(1 << 20)) / F.lit(seconds) if seconds else F.lit(None)).cast("double").alias("mib_per_second"))


def peak_rss() -> int:
    """The largest resident size of this process so far, in bytes."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


def observed_counters(scan: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """scan, and its counters, which are there once an action on it has run; no second pass."""
    seen = Observation(name)
    one = lambda test: F.count_if(test)
    return scan.observe(
        seen, one(F.col("outcome") == "file").alias("files"), one(F.col("outcome") == "skipped").alias("skipped"), one((F.col("outcome") == "error") | F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    ), seen


def schema_version(applied: DataFrame) -> DataFrame:
    """One row: the newest applied version, 0 before any."""
    return applied.agg(F.coalesce(F.max("version"), F.lit(0)).cast("long").alias("version"))


def digest_prefix(digest: Column) -> Column:
    """What is shown of a digest: its first 8 bytes."""
    return F.substring(digest, 1, 16)


def check_tables(spark: SparkSession, folder: str) -> dict[str, int]:
    """Rows of every table below a folder, all read; raises if one can't be."""
    out = {}
    for here, _, names in os.walk(folder):
        if any(n.endswith(".parquet") for n in names):
            try:
                out[os.path.relpath(here, folder)] = spark.read.parquet(here).count()
            except Exception as e:
                raise DurabilityError(f"can't read {here}") from e
    return out
