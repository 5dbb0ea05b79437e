"""Plans: what would be removed, and the checks a plan passes before anything is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.errors import SafetyError
from echofold.functions.shared import written
from echofold.functions.text import contains


def seal_violations(items: DataFrame) -> DataFrame:
    """(group_id, violation): groups without a keeper, with a member that awaits a choice, or with nothing to remove."""
    by = items.groupBy("group_id").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("keep", "manual", "quarantine")])
    found = F.when(F.col("manual") > 0, "manual member").when(F.col("keep") != 1, "not one keeper").when(F.col("quarantine") == 0, "nothing to remove")
    return by.withColumn("violation", found).where("violation is not null").select("group_id", "violation")


def seal(items: DataFrame) -> DataFrame:
    """items with the plan's digest; raises if the plan can't be sealed."""
    if not seal_violations(items).isEmpty():
        raise SafetyError("the plan has groups that can't be sealed")
    return items.crossJoin(F.broadcast(items.agg(set_digest("group_id", "path", "action").alias("plan_digest"))))


def set_digest(*columns: str) -> Column:
    """A digest of rows in any order, as an aggregate of fixed size: sums and xors of parts of each row's SHA-256, and the number of rows."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = lambda k: F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(part(k)), F.lit(0)).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums, F.coalesce(F.bit_xor(F.xxhash64(row)), F.lit(0)).cast("string")), 256)


def summary(items: DataFrame) -> DataFrame:
    """One row: groups with something to remove, removable files and their bytes."""
    q = items.where("action = 'quarantine'")
    return q.agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def destination(path: Column, root: str, session: str, item: Column, roots: tuple[str, ...] | None = None) -> Column:
    """Where a file would be moved to; null for a path outside every root, if roots are given."""
    inside = F.lit(True)
    if roots is not None:
        inside = F.lit(False)
        for r in roots:
            inside |= contains(r, path)
    return F.when(inside, F.concat_ws("/", F.lit(root), F.lit(session), item, F.regexp_replace(path, "^/+", "")))


def dry_run(items: DataFrame, root: str = "/quarantine", session: str = "s1") -> DataFrame:
    """Every move the plan would make, with its group's keeper; groups without a keeper make none."""
    items = written(items.select("group_id", "path", "size_bytes", "action"))
    keepers = items.where("action = 'keep'").select("group_id", F.col("path").alias("keeper_path"))
    moves = items.where("action = 'quarantine'").join(keepers, "group_id")
    return moves.select("group_id", "path", "size_bytes", "keeper_path", destination(F.col("path"), root, session, F.substring("group_id", 1, 16)).alias("destination"))


def drift(sealed: DataFrame, current: DataFrame, evidence: tuple[str, ...] = ("size_bytes", "modified_ns", "volume_id", "file_id", "sha256")) -> DataFrame:
    """(group_id, path, drift) of sealed items that are missing now or differ in any evidence."""
    now = current.select(F.col("path").alias("__path"), *[F.col(c).alias(f"__{c}") for c in evidence])
    both = sealed.join(now, F.col("path") == F.col("__path"), "left")
    changed = [F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in evidence]
    what = F.when(F.col("__path").isNull(), "missing").otherwise(F.concat_ws(",", *changed))
    return both.withColumn("drift", what).where("drift <> ''").select("group_id", "path", "drift")


def newest_plans(plans: DataFrame, by: str = "session_id") -> DataFrame:
    """The newest plan of each session: by sealing, or else creation time, then id."""
    last = F.max_by(F.struct(*plans.columns), F.struct(F.coalesce("sealed_at", "created_at"), "plan_id")).alias("p")
    return plans.groupBy(by).agg(last).select("p.*")


def unfinished(items: DataFrame, transactions: DataFrame) -> DataFrame:
    """Items to remove that no verified transaction covers."""
    done = transactions.where("state = 'verified'").select("group_id", "path")
    return items.where("action = 'quarantine'").join(done, ["group_id", "path"], "left_anti")
