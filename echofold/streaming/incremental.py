"""Structured Streaming forms: duplicates found as files arrive, states and newest events kept up to date."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from echofold.errors import DurabilityError


def arriving_duplicates(files: DataFrame) -> DataFrame:
    """(sha256, size_bytes, path, keeper, ordinal) of every arriving file whose content came before; files: path, size_bytes, sha256.

    The first path of a content is its keeper. In a batch, paths come in order. State: a path and a count for each content.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keeper, n = state.get if state.exists else (None, 0)
        paths = sorted(p for b in batches for p in b["path"])
        rows = []
        for p in paths:
            n += 1
            if keeper is None:
                keeper = p
            else:
                rows.append((key[0], key[1], p, keeper, n))
        state.update((keeper, n))
        yield pd.DataFrame(rows, columns=["sha256", "size_bytes", "path", "keeper", "ordinal"])

    return files.groupBy("sha256", "size_bytes").applyInPandasWithState(
        step, "sha256 string, size_bytes long, path string, keeper string, ordinal long", "keeper string, n long", "append", GroupStateTimeout.NoTimeout
    )


def current_states(events: DataFrame) -> DataFrame:
    """(entity, sequence, state) of the newest event of each entity; write it in update or complete mode."""
    return events.groupBy("entity").agg(F.max(F.struct("sequence", "state")).alias("l")).select("entity", "l.sequence", "l.state")


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, int] | None:
    """The version of each bucket after a batch."""
    store, p = _store(spark, f"{path}/manifest-{number}.json")
    return {k: int(v) for k, v in json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest-{number}.json").collect())).items()} if store.exists(p) else None


def _bucket_paths(path: str, versions: dict[str, int]) -> list[str]:
    return [f"{path}/v{v}/bucket={k}" for k, v in sorted(versions.items())]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of upsert() after its last batch."""
    store, p = _store(spark, path)
    numbers = [int(f.getPath().getName()[9:-5]) for f in store.listStatus(p) if f.getPath().getName().startswith("manifest-")]
    if not numbers:
        raise DurabilityError(f"no table at {path}")
    return spark.read.parquet(*_bucket_paths(path, _manifest(spark, path, max(numbers))))


def upsert(updates: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, buckets: int = 64) -> StreamingQuery:
    """Keeps a table of the newest row of each key, in buckets of the keys' hash: a batch rewrites only those that it has rows for.

    A batch's buckets are written under its number, then a manifest that names each bucket's version; a repeated batch
    does the same again. A batch whose predecessor's manifest is missing fails. Versions that no manifest names any
    longer are removed after the next batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _manifest(spark, path, number - 1) if number else {}
        if old is None:
            raise DurabilityError(f"the table at {path} lacks batch {number - 1}")
        batch = batch.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(str(r[0]) for r in batch.select("__bucket").distinct().collect())  # at most so many
        known = [p for p in _bucket_paths(path, {k: old[k] for k in touched if k in old})]
        both = batch
        for p in known:
            both = both.unionByName(spark.read.parquet(p).withColumn("__bucket", F.lit(int(p.rsplit("=", 1)[1]))))
        rows = both.groupBy("__bucket", *keys).agg(F.max_by(F.struct(*[c for c in both.columns if c != "__bucket"]), order).alias("r")).select(F.col("__bucket").alias("bucket"), "r.*")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{number}")
        store, p = _store(spark, f"{path}/manifest-{number}.json")
        out = store.create(p, True)
        out.write(bytearray(json.dumps(old | {k: number for k in touched}).encode()))
        out.close()
        before = _manifest(spark, path, number - 2) if number > 1 else None
        for k, v in (before or {}).items():
            if old.get(k) != v:
                store.delete(_store(spark, f"{path}/v{v}/bucket={k}")[1], True)

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class NewestProgress(StreamingQueryListener):
    """Keeps the last progress of each query, of the newest queries up to a bound, and never blocks them."""

    def __init__(self, most: int = 32):
        self.most, self.last = most, {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.last.pop(key, None)
        self.last[key] = json.loads(event.progress.json)
        while len(self.last) > self.most:
            self.last.pop(next(iter(self.last)))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


class Control:
    """Pause, resume and cancel by a tag on a session's jobs; a paused scan stops between units and resumes by what is stored."""

    ACTIVE = ("enumerating", "metadata", "quick_hashing", "blake3_hashing", "sha256_hashing", "grouping")

    def __init__(self, spark: SparkSession, session: str):
        self.spark, self.tag, self.state, self.resume_state = spark, f"session-{session}", "created", None

    def begin(self, stage: str) -> None:
        """A stage change while paused is what resuming goes on with."""
        if self.state in ("pausing", "paused"):
            self.resume_state = stage
        else:
            self.state = stage
        self.spark.addTag(self.tag)

    def pause(self) -> bool:
        if self.state not in self.ACTIVE:
            return False
        self.resume_state, self.state = self.state, "paused"
        self.spark.interruptTag(self.tag)
        return True

    def resume(self) -> bool:
        if self.state not in ("pausing", "paused") or not self.resume_state:
            return False
        self.state, self.resume_state = self.resume_state, None
        return True

    def cancel(self) -> bool:
        if self.state in ("completed", "cancelled", "failed"):
            return False
        self.state = "cancelled"
        self.spark.interruptTag(self.tag)
        return True
