"""The session catalogue: entries, snapshots, evidence, members, plans, transactions and registry, and how they join.

Tables and the columns that matter here:

- entries (entry_id, path, entry_key): a path's key is that of its normalized form; of spellings that share one, all
  but the first have the key of their exact spelling
- snapshots (snapshot_id, session_id, entry_id, size_bytes, modified_ns, observed_at, access_status, state)
- evidence (snapshot_id, stage, digest, stable); members (group_id, snapshot_id)
- plans (plan_id, session_id, status, created_at, sealed_at); items (plan_id, ordinal, group_id, snapshot_id, action, reason)
- transactions (transaction_id, plan_id, group_id, snapshot_id, state); registry (entry, transaction_id, ...)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.errors import InvalidInput, SafetyError, StateError
from echofold.functions import text as T
from echofold.functions.shared import small, written

STAGES = ("blake3", "sha256")
SESSION_STATES = ("created", "enumerating", "metadata", "quick_hashing", "blake3_hashing", "sha256_hashing", "grouping", "pausing", "paused", "completed", "cancelled", "failed", "interrupted")
PLAN_STATES = ("draft", "sealed", "executing", "completed", "cancelled")
PLAN_MOVES = {"draft": ("sealed", "cancelled"), "sealed": ("executing", "cancelled"), "executing": ("completed", "sealed")}


# ------------------------------------------------------------------------------ entries and snapshots


def keyed_entries(entries: DataFrame, order: str = "entry_id", ascii_only: bool = False) -> DataFrame:
    """entries with entry_key; the first of the spellings that share a normalized path has the normalized key."""
    e = entries.withColumn("__key", T.path_key(F.col("path"), ascii_only))
    first = e.groupBy("__key").agg(F.min(order).alias("__first"))
    return e.join(first, "__key").withColumn("entry_key", F.when(F.col(order) == F.col("__first"), F.col("__key")).otherwise(T.path_identity_key(F.col("path")))).drop("__key", "__first")


def observed(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert of entries: (path, first_session, last_session) by path; a known path keeps its first session."""
    both = old.select("path", "first_session", "last_session").unionByName(seen.select("path", F.col("session_id").alias("first_session"), F.col("session_id").alias("last_session")))
    return both.groupBy("path").agg(F.min("first_session").alias("first_session"), F.max("last_session").alias("last_session"))


def snapshot_entries(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    return snapshots.join(entries, "entry_id")


def member_rows(members: DataFrame, snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """Every member with its snapshot and entry."""
    return members.join(snapshots, "snapshot_id").join(entries, "entry_id")


def pivoted(evidence: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(snapshot_id, a digest for each stage, verified): verified if there is a stable digest of every stage."""
    of = lambda s, c: F.max(F.when(F.col("stage") == s, F.col(c)))
    found = evidence.groupBy("snapshot_id").agg(*[of(s, "digest").alias(s) for s in stages], *[F.coalesce(of(s, "stable"), F.lit(False)).alias(f"__{s}") for s in stages])
    verified = F.lit(True)
    for s in stages:
        verified &= F.col(s).isNotNull() & F.col(f"__{s}")
    return found.select("snapshot_id", *stages, verified.alias("verified"))


def missing_evidence(members: DataFrame, evidence: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(group_id, snapshot_id, stage) of members that lack a digest."""
    wanted = members.select("group_id", "snapshot_id", F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    return wanted.join(evidence.where("digest is not null").select("snapshot_id", "stage").distinct(), ["snapshot_id", "stage"], "left_anti").select("group_id", "snapshot_id", "stage")


def with_evidence(members: DataFrame, evidence: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """members with a digest of each stage; raises if one has none."""
    if not missing_evidence(members, evidence, stages).isEmpty():
        raise StateError("a member lacks evidence")
    return members.join(pivoted(evidence, stages), "snapshot_id")


def resolved(asked: DataFrame, entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """asked (path) with the entry of that exact spelling: under its normalized key, else under its spelling's key; null if neither is one."""
    e = entries.select("entry_id", "entry_key", F.col("path").alias("__path"))
    a = asked.withColumns({"__n": T.path_key(F.col("path"), ascii_only), "__i": T.path_identity_key(F.col("path"))})
    for key, name in (("__n", "normal"), ("__i", "exact")):
        one = e.select(F.col("entry_key").alias("__k"), F.col("entry_id").alias(name), F.col("__path").alias("__p"))
        a = a.join(one, (F.col(key) == F.col("__k")) & (F.col("path") == F.col("__p")), "left").drop("__k", "__p")
    return a.withColumn("entry_id", F.coalesce("normal", "exact")).drop("normal", "exact", "__n", "__i")


# ------------------------------------------------------------------------------ plans


def plan_item_rows(items: DataFrame, snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    return items.join(snapshots, "snapshot_id").join(entries, "entry_id")


def proven_items(items: DataFrame, members: DataFrame) -> DataFrame:
    """Items whose group and path are proven members, with what proved them."""
    return items.join(members, ["group_id", "path"])


def unproven_items(items: DataFrame, members: DataFrame) -> DataFrame:
    return items.join(members.select("group_id", "path"), ["group_id", "path"], "left_anti")


def plan_projects(plans: DataFrame, sessions: DataFrame) -> DataFrame:
    return plans.join(sessions.select("session_id", "project"), "session_id")


def newest_plan(plans: DataFrame, sealed_only: bool = True, session: str | None = None) -> DataFrame:
    """At most one row: the newest plan of all or of a session, by sealing, or else creation, then id."""
    rows = plans if session is None else plans.where(F.col("session_id") == session)
    rows = rows.where("status <> 'draft'") if sealed_only else rows
    last = rows.agg(F.max_by(F.struct(*plans.columns), F.struct(F.coalesce("sealed_at", "created_at"), "plan_id")).alias("p"))
    return last.where("p is not null").select("p.*")


def usable_items(items: DataFrame, plans: DataFrame) -> DataFrame:
    """Items of plans that are sealed or being carried out."""
    return items.join(plans.where(F.col("status").isin("sealed", "executing")).select("plan_id"), "plan_id", "left_semi")


def plan_moved(status: str, to: str) -> str:
    if to not in PLAN_MOVES.get(status, ()):
        raise StateError(f"a plan doesn't go from {status} to {to}")
    return to


# ------------------------------------------------------------------------------ history


def history(snapshots: DataFrame, entries: DataFrame, members: DataFrame, items: DataFrame, plans: DataFrame, transactions: DataFrame, registry: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Every snapshot with what became of it: 17 columns and, given others (group_id, snapshot_id, others), the group's other places.

    The item is that of the session's newest plan that isn't a draft; the transaction that of the item's plan and snapshot.
    """
    newest = plans.where("status <> 'draft'").groupBy("session_id").agg(F.max_by(F.struct("plan_id", "status"), F.struct(F.coalesce("sealed_at", "created_at"), "plan_id")).alias("p"))
    newest = newest.select("session_id", F.col("p.plan_id").alias("plan_id"), F.col("p.status").alias("plan_status"))
    chosen = items.join(newest.select("plan_id"), "plan_id", "left_semi").select("plan_id", "snapshot_id", "action", "reason")
    moves = transactions.select("transaction_id", "plan_id", "snapshot_id", F.col("state").alias("transaction_state"))
    kept = registry.select("transaction_id", "entry", "destination", "delete_state", "retain_until_ns")
    joined = snapshots.join(entries.select("entry_id", "path"), "entry_id").join(members.select("snapshot_id", "group_id"), "snapshot_id", "left").join(newest, "session_id", "left")
    joined = joined.join(chosen, ["plan_id", "snapshot_id"], "left").join(moves, ["plan_id", "snapshot_id"], "left").join(kept, "transaction_id", "left")
    if others is not None:
        joined = joined.join(others, ["group_id", "snapshot_id"], "left")
    shown = ["snapshot_id", "session_id", "path", "size_bytes", "modified_ns", "observed_at", "access_status", "state", "group_id", "action", "reason", "plan_id", "plan_status", "transaction_state", "entry", "destination"]
    final = F.when(F.col("entry").isNull(), None).when(F.col("delete_state") != "active", F.col("delete_state")).otherwise(F.col("transaction_state"))
    return joined.select(*shown, final.alias("effective_state"), *(["others"] if others is not None else []))


def history_duplicates(snapshots: DataFrame, entries: DataFrame, members: DataFrame, *rest: DataFrame) -> DataFrame:
    """The same of members alone: they lead, so that other snapshots are never joined."""
    own = snapshots.join(members.select("snapshot_id"), "snapshot_id", "left_semi")
    return history(own, entries, members, *rest)


def history_page(snapshots: DataFrame, entries: DataFrame, members: DataFrame, *rest: DataFrame, number: int = 0, size: int = 50) -> DataFrame:
    """A page of history(), newest first, then by path and id: the page is taken first, and only its rows are joined."""
    size = max(1, min(200, size))
    own = snapshots.join(entries.select("entry_id", F.col("path").alias("__path")), "entry_id")
    own = own.orderBy(F.col("observed_at").desc(), "__path", "snapshot_id").offset(max(0, number) * size).limit(size).drop("__path")
    own = F.broadcast(own)
    keys = own.select("snapshot_id")
    few = lambda df: df.join(F.broadcast(keys), "snapshot_id", "left_semi")
    items, plans, transactions, registry = rest[:4]
    return history(own, entries.join(F.broadcast(own.select("entry_id")), "entry_id", "left_semi"), few(members), few(items), plans, few(transactions), registry).orderBy(F.col("observed_at").desc(), "path", "snapshot_id")


def history_counts(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """One row: snapshots, and those that are duplicates."""
    return snapshots.agg(F.count(F.lit(1)).alias("all_rows")).crossJoin(F.broadcast(members.select("snapshot_id").distinct().join(snapshots, "snapshot_id", "left_semi").agg(F.count(F.lit(1)).alias("duplicate_rows"))))


def problems(snapshots: DataFrame) -> DataFrame:
    """Snapshots that failed, or whose file can't be read; a locked file is none."""
    return snapshots.where((F.col("state") == "error") | F.col("access_status").isin("denied", "offline", "missing", "error"))


# ------------------------------------------------------------------------------ restoring and deleting


def restorable(registry: DataFrame) -> DataFrame:
    return registry.where("state = 'verified' and delete_state = 'active'")


def scope_session(registry: DataFrame, transactions: DataFrame, session: str) -> DataFrame:
    """Entries to restore of a session, oldest first."""
    of = transactions.where(F.col("session_id") == session).select("transaction_id")
    return restorable(registry).join(of, "transaction_id", "left_semi").orderBy("at_ns", "entry")


def scope_group(registry: DataFrame, transactions: DataFrame, items: DataFrame, group: str) -> DataFrame:
    of = transactions.join(items.where(F.col("group_id") == group).select("plan_id", "snapshot_id"), ["plan_id", "snapshot_id"], "left_semi").select("transaction_id")
    return restorable(registry).join(of, "transaction_id", "left_semi").orderBy("at_ns", "entry")


def scope_project(registry: DataFrame, project: str) -> DataFrame:
    return restorable(registry).where(F.col("project") == project).orderBy("at_ns", "entry")


def missing_ids(asked: DataFrame, registry: DataFrame, key: str = "entry") -> DataFrame:
    """Asked ids that are no entry which can be restored or deleted."""
    return asked.select(key).distinct().join(restorable(registry).select(key), key, "left_anti")


def explicit(asked: DataFrame, registry: DataFrame, key: str = "entry") -> DataFrame:
    """The entries asked for; raises if an id is asked for twice or isn't there, or if they are of several projects."""
    if asked.count() != asked.distinct().count():
        raise InvalidInput("an entry is selected twice")
    if not missing_ids(asked, registry, key).isEmpty():
        raise SafetyError("an entry isn't there, or can't be taken")
    rows = restorable(registry).join(asked.select(key), key, "left_semi")
    if rows.select("project").distinct().limit(2).count() > 1:
        raise InvalidInput("the entries are of several projects")
    return rows


def registry_view(registry: DataFrame, text: str = "", state: str | None = None, since_ns: int | None = None) -> DataFrame:
    """Entries whose path or destination holds text, of one effective state and at or after a time; newest first."""
    rows = registry.withColumn("effective_state", F.when(F.col("delete_state") == "active", F.col("state")).otherwise(F.col("delete_state")))
    if text.strip():
        needle = T.ascii_lower(F.lit(text.strip()))
        rows = rows.where(F.contains(T.ascii_lower(F.col("path")), needle) | F.contains(T.ascii_lower(F.col("destination")), needle))
    rows = rows.where(F.col("effective_state") == state) if state else rows
    rows = rows.where(F.col("at_ns") >= since_ns) if since_ns is not None else rows
    return rows.orderBy(F.col("at_ns").desc(), "entry")


def retain_until(at_ns: Column, days: int) -> Column:
    return at_ns + F.lit(days * 86_400 * 10**9)


# ------------------------------------------------------------------------------ orders


def numbered(rows: DataFrame, *order: str, by: str | None = None, name: str = "ordinal") -> DataFrame:
    """rows with their place, from 0, in an order (columns, with a minus for a falling one) of all rows or of those of each value of by.

    Of all rows without a single task that sorts them: ranges are sorted and written, and start where those before end.
    """
    keys = [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]
    if by is not None:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(*keys)) - 1).cast("long"))
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small(sizes.withColumn("__before", before).select("__part", "__first", "__before"), 24)
    return placed.join(starts, "__part").withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).drop("__part", "__id", "__first", "__before")


def ordered_groups(members: DataFrame) -> DataFrame:
    """(group_id, size_bytes, members): paths in order, groups of large files first."""
    return members.groupBy("group_id", "size_bytes").agg(F.array_sort(F.collect_list(F.struct(F.lower("path").alias("key"), "path"))).alias("m")).select("group_id", "size_bytes", F.col("m.path").alias("members")).orderBy(F.col("size_bytes").desc(), "group_id")


def groups_page(groups: DataFrame, number: int = 0, size: int = 40) -> DataFrame:
    return groups.orderBy(F.col("size_bytes").desc(), "group_id").offset(max(0, number) * size).limit(size)


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n in an order."""
    return rows.orderBy(order).limit(max(0, n))


def decoded(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """rows whose values are all known; a value that isn't raises when it is read."""
    return rows.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null"))))))


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(violation, n) if the child has keys that aren't the parent's; nulls refer to nothing."""
    lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(f"{key} has no {parent_key}").alias("violation"), "n")
