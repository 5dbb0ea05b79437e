"""Shared pieces of the corpus operators: scratch tables, size-checked broadcasts, flat numpy text."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # large arrays go back to the system when freed; glibc else raises its threshold, and idle workers stay large
    ctypes.CDLL(None).mallopt(-3, 4 << 20)
    ctypes.CDLL(None).mallopt(-1, 8 << 20)
except (AttributeError, OSError):  # another C library
    pass

BROADCAST_BYTES = 32 << 20
SLICE_BYTES = 2 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="echofold-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder. They cut lineage and outlive any executor; all go at exit."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/echofold-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._echofold_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._echofold_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.root)
            except OSError:
                pass


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a count of the rows; a larger side stays an ordinary shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from all columns of docs (whatever the case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def drop_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs without the ids of a one-column table; rows with a null id stay."""
    (name,) = free_names(docs, "__drop_id")
    ids = ids.toDF(name).where(F.col(name).isNotNull()).distinct()
    return docs.join(broadcast_if_small(ids, 16), docs[column] == F.col(name), "left_anti")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------------------------- flat text

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer (a bijection)."""
    h = h ^ (h >> _S)
    h = h * _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


_BASE = 0x9E3779B97F4A7C15
#: ASCII letters and digits, and every byte of a non-ASCII character
WORD = np.zeros(256, bool)
WORD[128:] = True
for _a, _b in (("a", "z"), ("A", "Z"), ("0", "9")):
    WORD[ord(_a) : ord(_b) + 1] = True


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever it lies; the length is mixed in.

    Each block of 8 bytes is mixed, then mixed again with its place in the span, before blocks are added up: no sum of
    bytes times powers, in which structured texts (as Thue-Morse words) would meet whatever the base.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    blocks = np.maximum((size + 7) >> 3, 1)
    if int(blocks.max()) == 1:  # words mostly
        h = mix(mix(_masked(loads[starts], size)) + np.uint64(_BASE))
    else:
        first = np.cumsum(blocks) - blocks
        k = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        x = _masked(loads[np.repeat(starts, blocks) + 8 * k], np.repeat(size, blocks) - 8 * k)
        h = np.add.reduceat(mix(mix(x) + (k + 1).astype(np.uint64) * np.uint64(_BASE)), first)
    return mix(h + size.astype(np.uint64) * _M2)


def _masked(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Little-endian loads of which the first so many bytes count, 8 at most."""
    one = np.uint64(1)
    return x & np.where(size >= 8, ~np.uint64(0), (one << (8 * np.clip(size, 0, 7)).astype(np.uint64)) - one)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes; a longer text is a range of its own."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, begin = np.cumsum(n), 0
    while begin < len(n):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + most, "right")))
        yield begin, end
        begin = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array without nulls, from its first row on."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if off else np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - (off[0] if len(off) else 0)


class Words:
    """Words of many texts in flat arrays: a word is a run of ASCII letters, digits and non-ASCII characters, in lower case.

    hash (of the first prefix characters), full (of the whole word), doc, start and end (byte offsets in data) by word; first: the first word of each text (n + 1).
    """

    def __init__(self, texts: pa.Array, prefix: int | None = None):
        texts = pc.fill_null(texts, "")
        texts = pc.binary_join_element_wise(pc.utf8_lower(texts), pa.scalar("\n", texts.type), pa.scalar("", texts.type))
        self.data, off = raw(texts)
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[1:] = WORD[self.data]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        end = self.end
        if prefix is not None:
            end = prefix_ends(self.data, self.start, self.end, prefix)
        self.hash = span_hashes(self.data, self.start, end)
        self.full = self.hash if prefix is None else span_hashes(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.offsets = off


def prefix_ends(data: np.ndarray, start: np.ndarray, end: np.ndarray, characters: int) -> np.ndarray:
    """Where the first so many characters of each word end."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(begins, start) + characters
    return np.minimum(end, np.append(begins, len(data))[np.minimum(at, len(begins))])


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words and the text of each, in order. A text of fewer words has one gram of them all."""
    h, first = words.hash, words.first
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = len(h) - n + 1
    if whole > 0:
        g = h[:whole] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(1, n):
            g = mix(g) + h[i : whole + i]
        ok = words.doc[:whole] == words.doc[n - 1 :]
        g, doc = mix(g)[ok], words.doc[:whole][ok]
    else:
        g, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(short):
        extra = np.array([mix(np.bitwise_xor.accumulate(mix(h[first[i] : first[i + 1]] * (np.arange(count[i], dtype=np.uint64) + np.uint64(3))))[-1:])[0] for i in short], np.uint64)
        g, doc = np.concatenate([g, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def per_doc_sets(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, sorted."""
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[keep], doc[keep]
