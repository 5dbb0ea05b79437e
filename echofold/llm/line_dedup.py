"""Lines that different texts share, found by a sharded minimal perfect hash (operator 5).

Only 64-bit hashes of lines are counted. Each shard of the hash space puts all its distinct lines into a minimal
perfect hash (levels of bit arrays; a key lives in the first level where it is alone) that indexes a bit for each line:
whether different texts hold it. Those that do have fingerprints, counts and owners: the text of the smallest doc_id
with the line, which keeps it. As every line is there, none with a hash of its own can pass for another. Shards are
files in the shared folder; documents probe them, no line is joined.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, mix, raw, span_hashes, text_slices

GAMMA = 2.0
#: text for each shard of the index
SHARD_BYTES = 64 << 20
#: text held by a task between probes, and shards it keeps open
BUFFER_BYTES = 32 << 20
OPEN_BYTES = 64 << 20
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 11, 12, 13, 32]] = True


def _before(words: np.ndarray) -> np.ndarray:
    """How many bits are set before each word."""
    n = np.bitwise_count(words).astype(np.int64)
    return np.cumsum(n) - n


def _look(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each bit is set, and the ranks of those that are."""
    word, bit = words[at >> 6], (at & 63).astype(np.uint64)
    hit = (word >> bit) & np.uint64(1) == 1
    below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
    return hit, ranks[at[hit] >> 6] + np.bitwise_count(below).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: 0 to n - 1 for a key, anything or -1 for another."""

    def __init__(self, words: list[np.ndarray], sizes: list[int]):
        self.words, self.sizes, self.ranks, before = words, sizes, [], 0
        for w in words:
            self.ranks.append((before + _before(w)).astype(np.uint32))
            before += int(np.bitwise_count(w).sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        words, sizes = [], []
        while len(keys):
            size = max(64, int(GAMMA * len(keys)) + 63 & ~63)
            at = cls._place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(words, sizes)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(_ODD * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (w, r, size) in enumerate(zip(self.words, self.ranks, self.sizes)):
            hit, rank = _look(w, r, self._place(keys[rest], level, size))
            out[rest[hit]] = rank
            rest = rest[~hit]
        return out


class Shard:
    """A perfect hash of distinct keys with a bit by index, whether the key is shared (by default all are); 32-bit fingerprints,
    counts and owners of shared keys lie by rank. find() gives the counts and owners of shared keys, 0 for others (a key that isn't
    there at all passes for a shared one with probability 2**-32)."""

    _ARRAYS = ("words", "prints", "counts", "owners")

    def __init__(self, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray, shared: np.ndarray | None = None):
        shared = np.ones(len(keys), bool) if shared is None else shared
        self.hash = PerfectHash.build(keys)
        at = self.hash.find(keys)
        bits = np.zeros(len(keys) + 63 & ~63, bool)
        bits[at] = shared
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.ranks = _before(self.words).astype(np.uint32)
        order = np.flatnonzero(shared)[np.argsort(at[shared])]
        self.prints = (keys[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.counts, self.owners = np.minimum(counts[order], 0xFFFFFFFF).astype(np.uint32), owners[order].astype(np.uint64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, owners = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint64)
        at = self.hash.find(keys)
        there = np.flatnonzero(at >= 0)
        hit, rank = _look(self.words, self.ranks, at[there])
        there = there[hit]
        ok = self.prints[rank] == (keys[there] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        counts[there[ok]], owners[there[ok]] = self.counts[rank[ok]], self.owners[rank[ok]]
        return counts, owners

    def dump(self) -> bytes:
        out = io.BytesIO()
        levels = np.concatenate([np.zeros(0, np.uint64), *self.hash.words])
        np.savez(out, levels=levels, sizes=np.array(self.hash.sizes, np.int64), **{k: getattr(self, k) for k in self._ARRAYS})
        return out.getvalue()

    @classmethod
    def parse(cls, data: bytes) -> Shard:
        z, out = np.load(io.BytesIO(data)), cls.__new__(cls)
        ends = np.cumsum(z["sizes"] // 64)
        out.hash = PerfectHash(np.split(z["levels"], ends[:-1]) if len(ends) else [], z["sizes"].tolist())
        for k in cls._ARRAYS:
            setattr(out, k, z[k])
        out.ranks = _before(out.words).astype(np.uint32)
        return out


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each trimmed line, 0 if blank, its text, the first line of each text (n + 1), and the hash of each text. A null text is one blank line."""
    texts = pc.binary_join_element_wise(pc.fill_null(texts, ""), pa.scalar("\n", texts.type), pa.scalar("", texts.type))
    data, offsets = raw(texts)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    solid = np.flatnonzero(~_SPACE[data])  # newlines are among them
    first = np.minimum(solid[np.searchsorted(solid, starts)], ends) if len(ends) else ends
    last = solid[np.searchsorted(solid, ends) - 1] + 1 if len(ends) else ends
    full = first < ends
    h = np.zeros(len(ends), np.uint64)
    h[full] = np.maximum(span_hashes(data, first[full], last[full]), np.uint64(1))
    at = np.searchsorted(ends, offsets)
    return h, np.repeat(np.arange(len(texts)), np.diff(at)), at, span_hashes(data, offsets[:-1], offsets[1:])


#: what is known of a line: its hash, how many rows hold it, the smallest doc_id of them, the hash of that row's text, whether another text has it too
_LINE = ("<u8", "<u4", "<i8", "<u8", "?")
_LINE_BYTES = 29


def _summed(h, n, owner, text, shared) -> tuple[np.ndarray, ...]:
    """Each line once."""
    order = np.lexsort((text, owner, h))
    h, n, owner, text, shared = (x[order] for x in (h, n, owner, text, shared))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(h):
        return h, n, owner, text, shared
    shared = np.logical_or.reduceat(shared, first) | (np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first))
    return h[first], np.minimum(np.add.reduceat(n.astype(np.uint64), first), 0xFFFFFFFF).astype(np.uint32), owner[first], text[first], shared


def _once(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full lines, once for each text."""
    h, doc = h[h > 0], doc[h > 0]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _count(shards: int, most: int = 1_000_000):
    """Packed lines by shard, summed in the task."""

    def out(*columns):
        at = shard_of(columns[0], shards)
        order = np.argsort(at, kind="stable")
        edge = np.searchsorted(at[order], np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(edge)):
            o = order[edge[k] : edge[k + 1]]
            packed = b"".join(x[o].astype(kind).tobytes() for x, kind in zip(columns, _LINE))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["shard", "packed"])

    def run(batches):
        held, rows = [], 0
        joined = lambda: _summed(*(np.concatenate(x) for x in zip(*held)))
        for b in batches:
            ids = pc.fill_null(b.column(0), (1 << 63) - 1).to_numpy()
            for i, j in text_slices(b.column(1)):
                h, doc, _, text = lines(b.column(1).slice(i, j - i))
                h, doc = _once(h, doc)
                held.append((h, np.ones(len(h), np.uint32), ids[i:j][doc], text[doc], np.zeros(len(h), bool)))
                rows += len(h)
                if rows > most:
                    held = [joined()]
                    if len(held[0][0]) > most // 2:
                        yield from out(*held.pop())
                    rows = sum(len(x[0]) for x in held)
        if held:
            yield from out(*joined())

    return run


def _build(folder: str):
    """Sums up the lines of each shard and writes its file; a repeated task writes the same bytes again."""

    def opened(x: bytes) -> list[np.ndarray]:
        n, at, out = len(x) // _LINE_BYTES, 0, []
        for kind in _LINE:
            out.append(np.frombuffer(x, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return out

    def run(batches):
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(k, []).append(x)
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for k in sorted(by):
            h, n, _, text, shared = _summed(*(np.concatenate(x) for x in zip(*map(opened, by.pop(k)))))
            shard, own = Shard(h, n, text, shared).dump(), f"{path}/{uuid.uuid4().hex}.part"
            with store.open_output_stream(own) as f:
                f.write(shard)
            store.move(own, f"{path}/{k}.shard")
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(h)]), pa.array([int(shared.sum())]), pa.array([len(shard)])], ["shard", "distinct", "repeated", "bytes"])

    return run


class Index:
    """The shards' files, read when needed; the last used ones stay open within OPEN_BYTES."""

    def __init__(self, folder: str, shards: int, there: frozenset[int]):
        self.folder, self.shards, self.there, self.open = folder, shards, there, OrderedDict()

    def __getstate__(self):
        return self.folder, self.shards, self.there

    def __setstate__(self, state):
        self.__init__(*state)

    def _shard(self, k: int) -> Shard:
        if k in self.open:
            self.open.move_to_end(k)
            return self.open[k][0]
        store, path = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{path}/{k}.shard") as f:
            data = f.read()
        self.open[k] = Shard.parse(data), len(data)
        while len(self.open) > 1 and sum(n for _, n in self.open.values()) > OPEN_BYTES:
            self.open.popitem(last=False)
        return self.open[k][0]

    def owners(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many rows hold each line, if different texts do, else 0; and the hash of the text that keeps it."""
        own, inverse = np.unique(h, return_inverse=True)
        at, counts, owners = shard_of(own, self.shards), np.zeros(len(own), np.uint32), np.zeros(len(own), np.uint64)
        order = np.argsort(at, kind="stable")
        edge = np.searchsorted(at[order], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(edge)):
            if int(k) in self.there:
                o = order[edge[k] : edge[k + 1]]
                counts[o], owners[o] = self._shard(int(k)).find(own[o])
        return counts[inverse], owners[inverse]


def build_index(docs: DataFrame, shards: int | None = None) -> Index:
    spark = docs.sparkSession
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    folder = Scratch(spark).path("lines")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    counted = base.mapInArrow(_count(shards), "shard int, packed binary").repartition(shards, "shard")
    made = counted.mapInArrow(_build(folder), "shard int, distinct long, repeated long, bytes long").collect()  # a row for each shard
    return Index(folder, shards, frozenset(r["shard"] for r in made if r["repeated"]))


def _probe(index: Index):
    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_repeated, new = batch.column(1), [], [], []
        hashes, firsts, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, j in text_slices(texts):
            h, doc, first, text = lines(texts.slice(i, j - i))
            hashes.append(h)
            firsts.append(np.diff(first))
            own.append(text[doc])
        h, size = np.concatenate(hashes), np.concatenate(firsts)
        counts, owners = index.owners(h)
        repeated = (h > 0) & (counts > 0) & (owners != np.concatenate(own))
        edge = np.concatenate([[0], np.cumsum(size)])
        total = lambda x: np.concatenate([[0], np.cumsum(x)])[edge]
        n_lines, n_repeated = np.diff(total(h > 0)), np.diff(total(repeated))
        touched = np.flatnonzero(n_repeated)
        gone = {int(k): "\n".join(x for x, bad in zip(texts[int(k)].as_py().split("\n"), repeated[edge[k] : edge[k + 1]]) if not bad) for k in touched}
        if gone:
            mask = np.zeros(len(texts), bool)
            mask[touched] = True
            new = pc.replace_with_mask(texts, pa.array(mask), pa.array([gone[int(k)] for k in touched], texts.type))
        else:
            new = texts
        null = texts.is_null().to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines.astype(np.int32), mask=null), pa.array(n_repeated.astype(np.int32), mask=null), new], ["doc_id", "n_lines", "n_repeated", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > BUFFER_BYTES:
                yield from _joined(held, judged)
                held, size = [], 0
        yield from _joined(held, judged)

    return run


def _joined(held: list[pa.RecordBatch], f) -> Iterator[pa.RecordBatch]:
    if held:
        yield f(held[0] if len(held) == 1 else pa.concat_batches(held))


def line_dedup(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_repeated, text): text without the lines that another text holds too and keeps.

    Of different texts that share a line the one with the smallest doc_id keeps it, in all its copies; the lines that
    only copies of one text hold stay. Lines are compared without white space at their ends; blank ones stay and
    count nowhere. A null doc_id comes after all others; of different texts with one doc_id the one of the smaller
    hash keeps. One row for each row, repeated rows alike; a null text stays null, with null counts, an empty one has
    none. Other columns are ignored; an empty table gives none. A task holds some dozens of bytes for each byte of its
    longest text. The index is built while the plan is.
    """
    index = build_index(docs, shards)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_probe(index), "doc_id long, n_lines int, n_repeated int, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


SQL = """
with d as (
  select doc_id, text, string_split(text, chr(10)) as parts from documents
), l as (
  select doc_id, text, unnest(list_distinct(list_filter(list_transform(parts, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''))) as line from d
), r as (
  select line, arg_min(text, doc_id) as owner from l group by line having min(text) <> max(text)
), b as (
  select doc_id, list(line) as bad from l join r using (line) where text <> owner group by doc_id
), j as (
  select doc_id, parts, coalesce(bad, []) as bad from d left join b using (doc_id)
)
select doc_id,
  len(list_filter(parts, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''))::int as n_lines,
  len(list_filter(parts, lambda x: list_contains(bad, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))))::int as n_repeated,
  array_to_string(list_filter(parts, lambda x: not list_contains(bad, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))), chr(10)) as text
from j
"""
