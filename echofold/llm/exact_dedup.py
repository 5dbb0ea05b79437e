"""Exact duplicates by compressed radix tries (operator 2).

Texts are partitioned by length and content hash. A pair of both that occurs once is a partition of one string,
whose trie would have one terminal: its row owns itself and doesn't travel. Each other partition inserts the full
byte strings into a Patricia trie whose terminal nodes hold the smallest identifier, so hash collisions never merge
texts. A trie over its memory budget spills identifier lists, then its heaviest subtrees, to the shared folder and
finishes them afterwards, each in a trie of its own with fewer strings than the one it left.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, documents, drop_ids, free_names

TRIE_BYTES = 96 << 20
NODE_BYTES = 400


class Ids:
    """Identifiers of one string; those beyond memory lie in a file, which can be read once."""

    __slots__ = ("held", "count", "file")

    def __init__(self):
        self.held, self.count, self.file = array("q"), 0, None

    def extend(self, ids) -> None:
        self.held.extend(ids)
        self.count += len(ids)

    def unload(self, folder: str) -> int:
        """Moves what is held to the file; the bytes freed."""
        self.file = self.file or _Spill(folder)
        self.file.add(b"", self.held)
        freed, self.held = 8 * len(self.held), array("q")
        return freed

    def chunks(self) -> Iterator[array]:
        if self.file:
            yield from (ids for _, ids in self.file.read())
        yield self.held

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[int]:
        return (i for chunk in self.chunks() for i in chunk)


class _Node:
    __slots__ = ("edge", "children", "ids", "least", "spill")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.ids, self.least, self.spill = edge, {}, None, None, None


def common_prefix(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:], by halving over memory compares."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; terminals keep the ids of their string and the smallest one.

    folder: where lists and subtrees spill once the trie holds more than most bytes; without it nothing spills. A string
    is in memory with its row, so that the budget is at least four times the longest one.
    """

    def __init__(self, most: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.most, self.folder, self.held, self.spills = _Node(b""), most, folder, 0, []

    def insert(self, key: bytes, ids: list[int]) -> None:
        node, at = self.root, 0
        self.most = max(self.most, 4 * (len(key) + NODE_BYTES))
        while True:
            if node.spill is not None:
                node.spill.add(key, ids)
                return
            if at == len(key):
                break
            child = node.children.get(key[at])
            if child is None:
                child = _Node(key[at:])
                node.children[key[at]] = child
                self.held += len(child.edge) + NODE_BYTES
                node = child
                break
            edge = child.edge
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            n = common_prefix(edge, 0, key, at)
            middle = _Node(edge[:n])
            child.edge = edge[n:]
            middle.children[child.edge[0]] = child
            node.children[key[at]] = middle
            self.held += NODE_BYTES
            node, at = middle, at + n
        if node.ids is None:
            node.ids = Ids()
        node.ids.extend(ids)
        self.held += 8 * len(ids)
        least = min(ids)
        node.least = least if node.least is None else min(node.least, least)
        if self.folder and self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        """Leaves at most half of the budget in memory: long lists of ids go first, then the heaviest subtrees of at most half of it."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children.values())
            if node.ids is not None and 8 * len(node.ids.held) > self.most // 8:
                self.held -= node.ids.unload(self.folder)
        if self.held <= self.most // 2:
            return
        sizes: dict[int, int] = {}
        stubs: set[int] = set()  # nodes with a spilled one below; what left once doesn't come back, so that a string is in one file
        for node in reversed(order):
            sizes[id(node)] = len(node.edge) + NODE_BYTES + 8 * len(node.ids.held if node.ids else ()) + sum(sizes[id(c)] for c in node.children.values())
            if node.spill is not None or any(id(c) in stubs for c in node.children.values()):
                stubs.add(id(node))
        heavy, stack = [], [(self.root, b"")]
        while stack:
            node, path = stack.pop()
            for c in node.children.values():
                if c.spill is None:
                    divided = id(c) in stubs or c.children and sizes[id(c)] > self.most // 2
                    (stack if divided else heavy).append((c, path + c.edge))
        for child, path in sorted(heavy, key=lambda x: -sizes[id(x[0])]):
            if self.held <= self.most // 2:
                break
            spill = _Spill(self.folder)
            self.spills.append(spill)
            for key, ids in self._terminals(child, path[: len(path) - len(child.edge)]):
                for chunk in ids.chunks():
                    spill.add(key, chunk)
            self.held -= sizes[id(child)] - len(child.edge) - NODE_BYTES
            child.children, child.ids, child.least, child.spill = {}, None, None, spill
        if self.held > self.most:
            self.most = 2 * self.held  # only spilled stubs are left here

    @staticmethod
    def _terminals(top: _Node, prefix: bytes) -> Iterator[tuple[bytes, Ids]]:
        stack = [(top, prefix)]
        while stack:
            node, path = stack.pop()
            path += node.edge
            if node.ids is not None:
                yield path, node.ids
            stack.extend((c, path) for c in node.children.values())

    def owners(self) -> Iterator[tuple[int, Ids]]:
        """(smallest id, ids) of each distinct string."""
        yield from self._own()
        pending = self.spills
        while pending:
            again = PatriciaTrie(self.most, self.folder)
            for key, ids in pending.pop().read():
                again.insert(key, ids)
            yield from again._own()
            pending.extend(again.spills)

    def _own(self) -> Iterator[tuple[int, Ids]]:
        stack, self.root = [self.root], _Node(b"")
        while stack:
            node = stack.pop()
            if node.ids is not None:
                yield node.least, node.ids
            stack.extend(node.children.values())


class _Spill:
    """A subtree, or a list of ids, as (string, ids) in files of the shared folder; what comes later is added. It can be read once."""

    BUFFER = 1 << 17

    def __init__(self, folder: str):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.paths, self.buffer, self.size = [], [], 0

    def add(self, key: bytes, ids) -> None:
        ids = array("q", ids)
        self.buffer += [struct.pack("<qq", len(key), len(ids)), key, ids.tobytes()]
        self.size += 16 + len(key) + 8 * len(ids)
        if self.size > self.BUFFER:
            self._flush()

    def _flush(self) -> None:
        self.fs.create_dir(self.folder, recursive=True)
        self.paths.append(f"{self.folder}/{uuid.uuid4().hex}.trie")
        with self.fs.open_output_stream(self.paths[-1], compression=None) as out:
            for x in self.buffer:
                out.write(x)
        self.buffer, self.size = [], 0

    def read(self) -> Iterator[tuple[bytes, array]]:
        if self.buffer:
            self._flush()
        for path in self.paths:
            with self.fs.open_input_stream(path, compression=None, buffer_size=self.BUFFER) as f:
                while head := f.read(16):
                    n, m = struct.unpack("<qq", head)
                    key, ids = f.read(n), array("q")
                    ids.frombytes(f.read(8 * m))
                    yield key, ids
            self.fs.delete_file(path)


def _as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _tries(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(most, folder)
        for b in batches:
            for key, i in zip(b.column(1), b.column(0).to_pylist()):
                trie.insert(key.as_py(), (i,))
        docs, owners, copies = array("q"), array("q"), array("q")
        for least, ids in trie.owners():
            for chunk in ids.chunks():
                docs.extend(chunk)
                owners.extend([least] * len(chunk))
                copies.extend([len(ids)] * len(chunk))
                if len(docs) > 100_000:
                    yield _rows(docs, owners, copies)
                    docs, owners, copies = array("q"), array("q"), array("q")
        yield _rows(docs, owners, copies)

    return run


def _rows(*columns: array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(memoryview(c) if len(c) else [], pa.int64()) for c in columns], ["doc_id", "owner_id", "copies"])


def exact_owners(docs: DataFrame, most: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, owner_id, copies): the smallest doc_id with the same text, and how many rows have that text.

    One row for each row of docs with a doc_id, repeated rows included (their copies count). A null text is never
    a copy: owner is the row itself. Empty texts are equal to one another. Rows without a doc_id can neither own
    nor be owned and are left out. Other columns are ignored. An empty table gives an empty table. A task holds a
    row's text a few times over, whatever most. A job that finds the repeated keys runs while the plan is built.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null")
    keys = base.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))
    twice = keys.where("n is not null").groupBy("n", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("n").alias("tn"), F.col("h").alias("th"))
    twice = scratch.table(twice, "repeated-keys")
    small = broadcast_if_small(twice, 24)
    with_key = base.withColumn("n", F.octet_length("text")).withColumn("h", F.xxhash64("text"))
    on = (F.col("n") == F.col("tn")) & (F.col("h") == F.col("th"))
    together = with_key.join(small, on, "left_semi").repartition("n", "h").select("doc_id", F.col("text").cast("binary").alias("text"))
    found = together.mapInArrow(_tries(_as_uri(scratch.path("tries")), most), "doc_id long, owner_id long, copies long")
    alone = keys.join(small, on, "left_anti").select("doc_id", F.col("doc_id").alias("owner_id"), F.lit(1).cast("long").alias("copies"))
    return found.unionByName(alone)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows that another row owns: of rows with equal texts the one with the smallest doc_id stays.

    If rows repeat a doc_id with the same text, one of them stays. Rows with a null doc_id or text stay. An empty table
    stays empty, columns stay as they are whatever their names. Jobs run while the plan is built.
    """
    owners = Scratch(docs.sparkSession).table(exact_owners(docs).where("copies > 1"), "owners")
    kept = drop_ids(docs, owners.where("doc_id <> owner_id").select("doc_id"))
    again = owners.where("doc_id = owner_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    (name,) = free_names(docs, "__again")
    same = docs["doc_id"] == F.col(name)
    once = docs.join(broadcast_if_small(again.toDF(name), 16), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return drop_ids(kept, again).unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_owners(documents(spark, sf_dir))


SQL = """
select doc_id,
       case when text is null then doc_id else min(doc_id) over (partition by text) end as owner_id,
       case when text is null then 1 else count(*) over (partition by text) end as copies
from documents where doc_id is not null
"""
