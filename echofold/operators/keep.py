"""One keeper for each duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.errors import InvalidInput, SafetyError
from echofold.functions import text as T

DEFAULT, OLDEST, NEWEST, SHORTEST, MANUAL = "default", "oldest", "newest", "shortest", "manual"
REASONS = {
    DEFAULT: "preferred root, then oldest, then shortest path",
    OLDEST: "oldest modification",
    NEWEST: "newest modification",
    SHORTEST: "shortest path",
    MANUAL: "chosen by hand",
}


def primary(path: Column, roots: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for r in roots:
        test |= T.contains(r, path)
    return test


def rank(policy: str, roots: tuple[str, ...] = ()) -> Column:
    """What the keeper has least of. Paths of one length compare by components; unknown times come last."""
    tail = [F.octet_length("path").alias("n"), F.split("path", "/").alias("parts"), F.col("path").alias("p")]
    last = F.lit((1 << 63) - 1)
    heads = {
        DEFAULT: [(~primary(F.col("path"), roots)).alias("other"), F.coalesce("modified_ns", last).alias("t")],
        OLDEST: [F.coalesce("modified_ns", last).alias("t")],
        NEWEST: [F.coalesce(-F.col("modified_ns"), last).alias("t")],
        SHORTEST: [],
    }
    if policy not in heads:
        raise InvalidInput(f"no policy {policy!r}")
    return F.struct(*heads[policy], *tail)


def recommend(members: DataFrame, policy: str = DEFAULT, roots: tuple[str, ...] = ()) -> DataFrame:
    """members with action (keep for one of each group, quarantine for the rest) and reason. The keeper is an aggregate, combined before it is shuffled; no task sorts a group."""
    keepers = members.groupBy(F.col("group_id").alias("__group")).agg(F.min_by("path", rank(policy, roots)).alias("__keeper"))
    own = F.col("path") == F.col("__keeper")
    found = members.join(keepers, F.col("group_id") == F.col("__group"))  # broadcast at run time if it proves small
    return found.withColumns({"action": F.when(own, "keep").otherwise("quarantine"), "reason": F.when(own, REASONS[policy]).otherwise("identical to the keeper")}).drop("__group", "__keeper")


def require_manual(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """recommend_manual(), but a chosen path that isn't the group's raises."""
    if not chosen.join(members.select("group_id", "path"), ["group_id", "path"], "left_anti").isEmpty():
        raise InvalidInput("a chosen path is not of its group")
    return recommend_manual(members, chosen)


def recommend_manual(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen: (group_id, path). Groups that chosen doesn't name, or names with a path that isn't theirs, are left 'manual'."""
    pick = chosen.select("group_id", F.col("path").alias("__chosen")).dropDuplicates(["group_id"])
    hit = F.col("path") == F.col("__chosen")
    known = F.bool_or(F.coalesce(hit, F.lit(False))).over(Window.partitionBy("group_id"))
    found = members.join(pick, "group_id", "left").withColumn("__known", known)
    action = F.when(~F.col("__known"), "manual").when(F.col("path") == F.col("__chosen"), "keep").otherwise("quarantine")
    return found.withColumn("action", action).withColumn("reason", F.when(F.col("action") == "keep", REASONS[MANUAL]).when(F.col("action") == "manual", "no keeper chosen").otherwise("identical to the keeper")).drop("__chosen", "__known")


def check_one_keeper(recommended: DataFrame) -> None:
    """Raises if a group has not exactly one keeper."""
    bad = recommended.groupBy("group_id").agg(F.count_if(F.col("action") == "keep").alias("keepers")).where("keepers <> 1")
    if not bad.isEmpty():
        raise SafetyError("a group has not exactly one keeper")
