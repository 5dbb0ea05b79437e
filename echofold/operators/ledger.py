"""Append-only event ledgers: states as folds over events, legality of steps, recovery, removals."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.errors import DurabilityError, InvalidInput, StateError

_AFTER_ANY = ("reconciled_source_only", "reconciled_both", "reconciled_missing")
STEPS: dict[str, tuple[str, ...]] = {
    "planned": ("preflight_validated", "preflight_failed", "cancelled"),
    "preflight_validated": ("moving", "cancelled"),
    "moving": ("moved_unverified", "move_failed", "recovery_required"),
    "moved_unverified": ("verified", "verify_failed", "recovery_required"),
    "move_failed": ("recovery_required",),
    "verify_failed": ("recovery_required",),
    "recovery_required": ("verified",),
}
TERMINAL = ("verified", "preflight_failed", "cancelled", *_AFTER_ANY)
PENDING = tuple(STEPS)
TRANSITIONS = frozenset((a, b) for a, after in STEPS.items() for b in (*after, *_AFTER_ANY))
BATCH_STEPS = frozenset({("prepared", "executing"), ("prepared", "expired"), ("executing", "completed"), ("executing", "recovery_required"), ("recovery_required", "executing"), ("recovery_required", "completed")})
ITEM_STEPS = frozenset({("planned", "deleting"), ("failed", "deleting"), ("deleting", "deleted"), ("deleting", "failed"), ("failed", "deleted")})
OF_EVENT = {"signup": "planned", "view": "preflight_validated", "click": "moving", "purchase": "verified", "error": "recovery_required"}


def of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ledger(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_ledger(t: DataFrame) -> DataFrame:
    """events as a ledger: entity, sequence, state, amount, at."""
    state = F.create_map(*[F.lit(x) for kv in OF_EVENT.items() for x in kv])[F.col("event_type")]
    return t.select(F.col("user_id").alias("entity"), F.col("event_id").alias("sequence"), state.alias("state"), F.col("value").alias("amount"), F.col("ts").alias("at"))


def transitions(spark: SparkSession, steps: frozenset = TRANSITIONS) -> DataFrame:
    return spark.createDataFrame(sorted(steps), "from_state string, to_state string")


def current_state(events: DataFrame) -> DataFrame:
    """(entity, state, sequence, steps) as of the last event; aggregated before it is shuffled."""
    last = F.max(F.struct("sequence", "state"))
    return events.groupBy("entity").agg(last.alias("l"), F.count(F.lit(1)).alias("steps")).select("entity", F.col("l.state").alias("state"), F.col("l.sequence").alias("sequence"), "steps")


def violations(events: DataFrame, steps: frozenset = TRANSITIONS, first: str = "planned") -> DataFrame:
    """(entity, sequence, from_state, to_state) of steps that aren't legal; an entity's first state must be first."""
    before = F.lag("state").over(Window.partitionBy("entity").orderBy("sequence"))
    rows = events.select("entity", "sequence", before.alias("from_state"), F.col("state").alias("to_state"))
    legal = F.broadcast(transitions(events.sparkSession, steps)).withColumnRenamed("from_state", "f").withColumnRenamed("to_state", "t")
    bad = rows.where("from_state is not null").join(legal, (F.col("from_state") == F.col("f")) & (F.col("to_state") == F.col("t")), "left_anti")
    return bad.unionByName(rows.where(F.col("from_state").isNull() & (F.col("to_state") != first)))


def pending(states: DataFrame) -> DataFrame:
    return states.where(F.col("state").isin(*PENDING))


def recovery(source_exists: Column, destination_exists: Column) -> Column:
    """What reconciling concludes from which of the two paths is there."""
    return (
        F.when(source_exists & destination_exists, "reconciled_both").when(source_exists, "reconciled_source_only").when(destination_exists, "destination_verified").otherwise("reconciled_missing")
    )


def reconciled_state(state: Column, outcome: Column) -> Column:
    """The state after reconciling: a destination alone makes a begun move verified, and leaves other states as they are."""
    begun = state.isin("moving", "moved_unverified", "recovery_required")
    legal = state.isin(*PENDING)
    return F.when(outcome == "destination_verified", F.when(begun, "verified").otherwise(state)).when(legal, outcome).otherwise(state)


def deletable(entries: DataFrame, now_ns: int, immediate: bool = False) -> DataFrame:
    """Verified, active quarantine entries whose retention is over."""
    test = (F.col("state") == "verified") & (F.col("delete_state") == "active")
    return entries.where(test if immediate else test & (F.col("retain_until_ns") <= now_ns))


def effective_state(state: Column, delete_state: Column) -> Column:
    return F.when(delete_state == "active", state).otherwise(delete_state)


def batch_totals(entries: DataFrame, by: str = "project") -> DataFrame:
    """A batch's count, bytes, selection digest and the phrase that confirms it. Sums that overflow are errors."""
    once = entries.groupBy(by, "entry").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("size_bytes"))
    part = F.conv(F.substring(F.sha2(F.col("entry").cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    found = once.groupBy(by).agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("distinct_items"), F.sum("size_bytes").alias("bytes"), F.sum(part * F.col("n")).cast("decimal(38,0)").cast("string").alias("selection"))
    return found.withColumn("phrase", phrase(F.col("items"), F.col("bytes")))


def phrase(items: Column, bytes_: Column, immediate: bool = False) -> Column:
    """What a user types to confirm a batch: count, bytes and whether retention is passed over."""
    return F.format_string(f"DELETE %d FILES %d BYTES{' NOW' if immediate else ''}", items, bytes_)


def outcome(items: DataFrame, by: str = "project") -> DataFrame:
    """Deleted files and bytes of each batch, what remains, and whether it may be completed."""
    gone = F.col("item_state") == "deleted"
    found = items.groupBy(by).agg(F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0)).alias("deleted_bytes"), F.count_if(~gone).alias("remaining"))
    return found.withColumn("complete", F.col("remaining") == 0)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert as a fold: the newest row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


class Ledger:
    """An append-only JSON-lines ledger with compare-and-set steps. One writer, on the driver; read it with frame()."""

    def __init__(self, folder: str, steps: frozenset = TRANSITIONS, first: str | tuple[str, ...] = "planned"):
        self.folder, self.steps, self.first = folder, steps, (first,) if isinstance(first, str) else first
        os.makedirs(folder, exist_ok=True)
        self.path, self.lock = os.path.join(folder, "events.jsonl"), os.path.join(folder, "writer.lock")
        try:
            os.close(os.open(self.lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError as e:
            raise DurabilityError("another writer holds this ledger") from e
        self.states: dict[str, str] = {}
        self.count = 0
        if os.path.exists(self.path):
            with open(self.path) as f:
                for line in f:
                    row = json.loads(line)
                    self.states[row["entity"]] = row["state"]
                    self.count += 1

    def append(self, entity: str | None, state: str, expected: str | None = None, **payload) -> str:
        """Writes and syncs the event before the state counts. expected: the state the caller believes is current."""
        entity = entity or uuid.uuid4().hex
        now = self.states.get(entity)
        if expected is not None and now != expected:
            raise StateError(f"{entity} is {now}, not {expected}")
        if now is None and state not in self.first or now is not None and (now, state) not in self.steps:
            raise StateError(f"no step from {now} to {state}")
        if {"entity", "state", "sequence"} & payload.keys():
            raise InvalidInput("reserved key in payload")
        with open(self.path, "a") as f:
            f.write(json.dumps({"sequence": self.count, "entity": entity, "state": state} | payload) + "\n")
            f.flush()
            os.fsync(f.fileno())
        self.states[entity] = state
        self.count += 1
        return entity

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("sequence long, entity string, state string").json(self.path)

    def close(self) -> None:
        os.unlink(self.lock)
