"""A Spark data source that lists files: one row of metadata each, links never followed."""

from __future__ import annotations

import hashlib
import json
import os
import stat
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from echofold.errors import InvalidInput
from echofold.functions.blake3 import Blake3
from echofold.functions.text import QUARANTINE

SAMPLE = 64 << 10

SCHEMA = (
    "path string, extension string, size_bytes long, created_ns long, modified_ns long, volume_id string, file_id string, "
    "link_kind string, hardlink_count long, access_status string, error string, token string, outcome string"
)
DIRECTORIES_PER_PARTITION = 64


def token(volume: str | None, file: str | None, size: int, modified_ns: int) -> str:
    """As functions.text.snapshot_token()."""
    identity = f"{volume}\0{file}\0" if volume is not None and file is not None else ""
    return hashlib.sha256(f"{identity}{size}\0{modified_ns}".encode()).hexdigest()


def snapshot(path: str) -> tuple:
    name = os.path.basename(path)
    stem, dot, ext = name.rpartition(".")
    ext = ext.lower() if dot and stem else None
    try:
        s = os.stat(path, follow_symlinks=False)
    except OSError as e:
        return path, ext, None, None, None, None, None, None, None, "missing" if isinstance(e, FileNotFoundError) else "error", str(e), None, "file"
    kind = "symlink" if stat.S_ISLNK(s.st_mode) else "hardlink" if s.st_nlink > 1 else "regular"
    access = "readable" if os.access(path, os.R_OK) else "denied"
    volume, file = f"{s.st_dev:016x}", f"{s.st_ino:016x}"
    return path, ext, s.st_size, s.st_ctime_ns, s.st_mtime_ns, volume, file, kind, s.st_nlink, access, None, token(volume, file, s.st_size, s.st_mtime_ns), "file"


def _other(path: str, outcome: str, access: str, error: str | None = None) -> tuple:
    """A row for what is no file of the inventory: a link that was passed over, or a directory that can't be read."""
    return path, None, None, None, None, None, None, "symlink" if outcome == "skipped" else "directory", None, access, error, None, outcome


def walk(top: str, deep: bool = True) -> Iterator[tuple[str, str, str | None]]:
    """(path, what, error) below top, what being directory, file, skipped or error. Links are passed over with all that is below them; quarantines are no part of the tree."""
    stack = [top]
    while stack:
        here = stack.pop()
        try:
            with os.scandir(here) as entries:
                found = sorted(entries, key=lambda e: e.name)
        except OSError as e:
            yield here, "error", str(e)
            continue
        for e in found:
            if e.name.lower() == QUARANTINE:
                continue
            try:
                if e.is_symlink():
                    yield e.path, "skipped", None
                elif e.is_dir(follow_symlinks=False):
                    yield e.path, "directory", None
                    if deep:
                        stack.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    yield e.path, "file", None
            except OSError as bad:
                yield e.path, "error", str(bad)


class _Directories(InputPartition):
    def __init__(self, whole: list[str], flat: list[str]):
        self.whole, self.flat = whole, flat


class _Reader(DataSourceReader):
    """Partitions are sets of directories two levels down, listed in the tasks."""

    def __init__(self, options: dict):
        self.root = options.get("path")
        if not self.root or not os.path.isdir(self.root) or os.path.islink(self.root):
            raise InvalidInput(f"not a directory: {self.root!r}")

    def partitions(self) -> list[_Directories]:
        below = lambda top: [p for p, what, _ in walk(top, deep=False) if what == "directory"]
        first = below(self.root)
        second = [p for top in first for p in below(top)]
        out = [_Directories([], [self.root, *first])]
        return out + [_Directories(second[i : i + DIRECTORIES_PER_PARTITION], []) for i in range(0, len(second), DIRECTORIES_PER_PARTITION)]

    def read(self, partition: _Directories) -> Iterator[pa.RecordBatch]:
        names, rows = [c.split()[0] for c in SCHEMA.split(", ")], []
        kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in SCHEMA.split(", ")]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for tops, deep in ((partition.whole, True), (partition.flat, False)):
            for top in tops:
                for path, what, error in walk(top, deep):
                    if what == "file":
                        rows.append(snapshot(path))
                    elif what != "directory":
                        rows.append(_other(path, what, "skipped" if what == "skipped" else "error", error))
                    if len(rows) == 4096:
                        yield batch()
                        rows = []
        if rows:
            yield batch()


class FileInventory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """All rows of a scan: files, links passed over (outcome skipped) and directories that can't be read (outcome error)."""
    spark.dataSource.register(FileInventory)
    return spark.read.format("file_inventory").load(root)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """The files of a scan."""
    return scan_files(spark, root).where("outcome = 'file'").drop("outcome")


CHUNK = 1 << 20
#: digests by name; each value makes an object with update() and hexdigest()
HASHERS: dict[str, Callable] = {"sha256": hashlib.sha256, "blake3": Blake3}


def quick_digest(path: str, size: int) -> tuple[str, int]:
    """As detect.quick_signature(): (digest, bytes read) of the size and of the whole of a small file, else of its head, middle and tail."""
    h = hashlib.sha256(f"{size}|".encode())
    with open(path, "rb") as f:
        if size <= SAMPLE:
            data = f.read(SAMPLE)
            h.update(data)
            return h.hexdigest(), len(data)
        read = 0
        for at in (0, size // 2 - SAMPLE // 2, size - SAMPLE):
            f.seek(at)
            data = f.read(SAMPLE)
            h.update(f"{at}:".encode() + data)
            read += len(data)
    return h.hexdigest(), read


def full_digests(path: str, hashers: dict[str, Callable]) -> tuple[dict[str, str], int]:
    """Digests of a file in one pass of CHUNK bytes at a time, and the bytes read."""
    made, read = {name: make() for name, make in hashers.items()}, 0
    with open(path, "rb") as f:
        while data := f.read(CHUNK):
            read += len(data)
            for h in made.values():
                h.update(data)
    return {name: h.hexdigest() for name, h in made.items()}, read


def with_digests(files: DataFrame, hashers: dict[str, Callable] | None = None, quick: bool = False) -> DataFrame:
    """files with a column for each digest (or quick), bytes_read, stable and read_error. Files are streamed in the tasks; only
    digests leave them. A file whose metadata changes while it is read is unstable; one that can't be read has null digests."""
    hashers = {} if quick else HASHERS if hashers is None else hashers
    names, made = files.columns, ["quick"] if quick else list(hashers)

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(names.index("path")).to_pylist():
                before = snapshot(path)
                try:
                    if quick:
                        digest, read = quick_digest(path, before[2] or 0)
                        found = {"quick": digest}
                    else:
                        found, read = full_digests(path, hashers)
                    rows.append((*[found[n] for n in made], read, snapshot(path) == before, None))
                except OSError as e:
                    rows.append((*[None] * len(made), 0, False, str(e)))
            columns = list(zip(*rows)) if rows else [()] * (len(made) + 3)
            kinds = [*[pa.string()] * len(made), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*names, *made, "bytes_read", "stable", "read_error"])

    schema = StructType([*files.schema.fields])
    for n in made:
        schema = schema.add(n, StringType())
    return files.mapInArrow(run, schema.add("bytes_read", LongType()).add("stable", BooleanType()).add("read_error", StringType()))


class FileScanSink(DataSource):
    """Writes scan rows as JSON lines, a file for each task; a job's files appear together, when it commits."""

    @classmethod
    def name(cls) -> str:
        return "scan_sink"

    def writer(self, schema, overwrite: bool) -> _SinkWriter:
        return _SinkWriter(self.options, schema.fieldNames())


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _SinkWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str]):
        self.folder, self.names = options.get("path"), names
        if not self.folder:
            raise InvalidInput("the sink needs a path")

    def write(self, rows: Iterator) -> _Written:
        os.makedirs(self.folder, exist_ok=True)
        path, n = os.path.join(self.folder, f".{uuid.uuid4().hex}.pending"), 0
        with open(path, "w", encoding="utf-8") as f:
            for row in rows:
                f.write(json.dumps(dict(zip(self.names, row)), default=str) + "\n")
                n += 1
            f.flush()
            os.fsync(f.fileno())
        return _Written(path, n)

    def commit(self, messages: list) -> None:
        for k, m in enumerate(x for x in messages if x is not None):
            os.replace(m.path, os.path.join(self.folder, f"part-{k:05d}-{os.path.basename(m.path)[1:9]}.jsonl"))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.unlink(m.path)
