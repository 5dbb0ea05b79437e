"""Language-model scoring by a hierarchical Pitman-Yor model (operator 3).

Each preceding word is a context with a restaurant of its own; all of them share the unigram restaurant as
parent, whose parent is uniform over the corpus's words. Words are told apart by 40 bits of their hashes (of a
billion words one in a thousand shares a hash), 0 is the start of a text. Customers and tables of a dish in a
restaurant are counts (c, t): which table a customer leaves is integrated out, as a random customer sits alone with
probability S(c - 1, t - 1) / S(c, t), S the generalized Stirling numbers. A Gibbs sweep reseats about every
customer of every dish. Contexts are seated in parallel given their parent's predictive; the tables they open are
the customers of the parent, which is seated next, and so on.

Dishes are partitioned by context; contexts with more tokens than a part should have go to as many parts as they
need, and their tables add up over these. Parts and the parent's buckets exchange, for the words that a part has,
tables one way and predictive probabilities the other: nothing is held for all words in one place. Each row of
the exchange of tokens has about ROW_TOKENS of them for up to MOST_TOKENS / ROW_TOKENS parts, so that there rows grow
with the input and not with its square; with more parts, rows have fewer.

A text's tokens are scored by the probability of each one given all others (the one scored has left its table),
averaged over the last sweeps; the perplexity is exp(-mean log probability).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, documents, mix, text_slices

TYPE_BITS = 40
CONCENTRATION = 1.0
#: passes over the restaurants; in each, sweeps before and sweeps that are averaged
PASSES, BURN_IN, SAMPLES = 2, 4, 4
SEED = 5
#: dishes up to so many customers have exact Stirling ratios; beyond, the limit of the share of single tables
STIRLING = 400
#: steps of a sweep: of a dish with more customers, as many move together in each step as let all move once
STEPS = 16
SLICE_BYTES = 1 << 20
PART_BYTES = 12 << 20
#: tokens of a part, about
PART_TOKENS = PART_BYTES // 6
#: tokens that a task gathers before it deals them out to the parts: so many for each part, within these bounds
ROW_TOKENS, LEAST_TOKENS, MOST_TOKENS = 2048, 1 << 20, 1 << 22
#: (document, part) pairs whose sums a task adds up, about
GROUP_PAIRS = 500_000
BATCH_BYTES = 4 << 20
CHUNK = 1 << 14


def stirling_ratios(d: float, most: int = STIRLING) -> np.ndarray:
    """S(c - 1, t - 1) / S(c, t) for c, t up to most: the chance that a random one of c customers at t tables sits alone."""
    log, out = np.full(most + 1, -np.inf), np.zeros((most + 1, most + 1), np.float32)
    log[0] = 0.0  # S(0, 0)
    for c in range(1, most + 1):
        before, t = log, np.arange(1, most + 1)
        log = np.full(most + 1, -np.inf)
        stay = c - 1 - t * d
        with np.errstate(divide="ignore", invalid="ignore"):
            log[1:] = np.logaddexp(before[:-1], np.where(stay > 0, before[1:] + np.log(np.maximum(stay, 1e-300)), -np.inf))
            out[c, 1:] = np.where(np.isfinite(log[1:]), np.exp(before[:-1] - log[1:]), 0)
    return out


def alone(c: np.ndarray, t: np.ndarray, ratios: np.ndarray, d: float) -> np.ndarray:
    """Chance that a random customer of each dish sits alone."""
    small = c < len(ratios)
    if small.all():
        return ratios.ravel().take(c * ratios.shape[1] + t)
    exact = ratios[np.where(small, c, 0), np.where(small, t, 0)]
    return np.where(small, exact, np.where(t > 1, np.minimum(1.0, d * t / np.maximum(c, 1)), 0.0))


def first_seating(c: np.ndarray, base: np.ndarray, start: np.ndarray, d: float, random: np.random.Generator) -> np.ndarray:
    """Tables after the customers of each dish came one by one. base: weight of a new table over the parent's predictive, (theta + d T) P0.

    Beyond 64 customers they come in groups of a 64th of those present, at one price.
    """
    t = start.copy()
    live, i = np.flatnonzero(c > 1), 1
    while len(live):
        step = max(1, i // 64)
        group = np.minimum(step, c[live] - i)
        new = base[live]
        p = new / (new + np.maximum(i - d * t[live], 1e-9))
        t[live] += random.binomial(group, p) if step > 1 else (random.random(len(live)) < p)
        i += step
        live = live[c[live] > i]
    return t


def reseat(c: np.ndarray, t: np.ndarray, base: np.ndarray, ratios: np.ndarray, d: float, random: np.random.Generator) -> None:
    """A sweep, in place: each customer leaves and comes back about once. Up to STEPS customers of a dish move one by one.

    Dishes with most customers come first, so that those which still move are a slice; others are put in that order.
    """
    if (c[1:] > c[:-1]).any():
        order = np.argsort(-c, kind="stable")
        some = t[order]
        reseat(c[order], some, base[order], ratios, d, random)
        t[order] = some
        return
    large = int(np.searchsorted(-c, -2 * STEPS, "right"))
    if large:
        n, weight, now = c[:large], base[:large], t[:large]
        m = n // STEPS
        for _ in range(STEPS):
            left = np.maximum(now - random.binomial(m, np.clip(alone(n, now, ratios, d), 0, 1)), 1)
            p = weight / (weight + np.maximum(n - m - d * left, 1e-12))
            now[:] = np.clip(left + random.binomial(m, p), 1, n)
    for begin in range(large, len(c), CHUNK):  # a chunk stays in the processor's cache
        n = c[begin : begin + CHUNK]
        for step in range(min(STEPS, int(n[0]))):
            live = int(np.searchsorted(-n, -max(step, 1), "left"))
            if not live:
                break
            of, weight, now = n[:live], base[begin : begin + live], t[begin : begin + live]
            left = now - (random.random(live, np.float32) < alone(of, now, ratios, d))
            p = weight / (weight + np.maximum(of - 1 - d * left, 1e-12))
            now[:] = np.clip(left + (random.random(live) < p), 1, of)


# ---------------------------------------------------------------------------------- tokens by context


@dataclass
class Hot:
    """Contexts with more tokens than a part should have: sorted hashes, into how many parts each goes, customers and tables."""

    u: np.ndarray
    spread: np.ndarray
    customers: np.ndarray | None = None
    opened: np.ndarray | None = None

    def find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in u, which context)"""
        if not len(self.u):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.u, u), len(self.u) - 1)
        here = np.flatnonzero(self.u[at] == u)
        return here, at[here]


def _part(names: np.ndarray, context: np.ndarray, at: np.ndarray, parts: int, hot: Hot) -> np.ndarray:
    """The part of each token; its context and word are places in names."""
    mixed, parts = mix(names.astype(np.uint64)), np.uint64(parts)
    out = (mixed % parts)[context]
    hot_names, which = hot.find(names)
    if len(which):
        hot_of = np.full(len(names), -1)
        hot_of[hot_names] = which
        here = np.flatnonzero(hot_of[context] >= 0)
        spread = np.minimum(hot.spread, int(parts)).astype(np.uint64)[hot_of[context[here]]]
        out[here] = (out[here] + mixed[at[here]] % spread * (parts // spread)) % parts
    return out.astype(np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text) of the words of texts without nulls."""
    words = Words(texts)
    w = (words.hash >> np.uint64(64 - TYPE_BITS)).astype(np.int64)
    w[w == 0] = 1
    u = np.concatenate([[0], w[:-1]]) if len(w) else w
    begins = words.first[:-1][np.diff(words.first) > 0]
    u[begins] = 0
    return u, w, words.doc


def _bits(x: np.ndarray) -> int:
    return int(x.max(initial=0)).bit_length() if int(x.min(initial=0)) >= 0 else 64


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place there of each; value and place in one number, where that has room."""
    low = len(x).bit_length()
    if _bits(x) + low > 63:
        found, rank = np.unique(x, return_inverse=True)
        return found, rank.astype(np.int32)
    key = x.astype(np.int64) << low
    key |= np.arange(len(x))
    key.sort()
    at = key & ((1 << low) - 1)
    key >>= low
    new = _changes(key)
    rank = np.empty(len(x), np.int32)
    rank[at] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return key[new], rank


def _sorted(*columns: np.ndarray) -> list[np.ndarray]:
    """The columns' rows in order; of numbers not below 0 all in one number, where that has room."""
    widths = [_bits(x) for x in columns]
    if sum(widths) > 63:
        order = np.lexsort(columns[::-1])
        return [x[order] for x in columns]
    key = columns[0].astype(np.int64)
    for x, width in zip(columns[1:], widths[1:]):
        key <<= width
        key |= x
    key.sort()
    out = []
    for width in widths[:0:-1]:
        out.append((key & ((1 << width) - 1)).astype(np.int32 if width < 32 else np.int64))
        key >>= width
    return [key, *out[::-1]]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _summed_counts(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = _ranks(np.concatenate([k for k, _ in held]))
    return key, np.bincount(inverse, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)


def _batched(rows: Iterator[tuple], fields: dict[str, pa.DataType], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so many bytes."""
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held), fields.values())], list(fields))

    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _survey(buckets: int, most: int = 1_000_000):
    """Tokens by context, summed in the task, by bucket of the contexts."""

    def out(key, n):
        bucket = key * buckets >> TYPE_BITS
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edge)):
            s = slice(edge[k], edge[k + 1])
            yield int(k), _pack((np.diff(key[s], prepend=0), "<i8"), (n[s], "<i8"))

    def rows(batches):
        held, size = [], 0
        for b in batches:
            for i, j in text_slices(b.column(0)):
                key, n = np.unique(tokens(b.column(0).slice(i, j - i))[0], return_counts=True)
                held.append((key, n))
                size += len(key)
                if size > most:
                    held = [_summed_counts(held)]
                    if len(held[0][0]) > most // 2:
                        yield from out(*held.pop())
                    size = sum(len(k) for k, _ in held)
        if held:
            yield from out(*_summed_counts(held))

    return lambda batches: _batched(rows(batches), {"bucket": pa.int32(), "packed": pa.binary()}, BATCH_BYTES)


def _frequent(limit: int):
    def run(batches):
        by: dict[int, list] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, n = _unpack(x, "<i8", "<i8")
                by.setdefault(k, []).append((np.cumsum(key), n))
        for held in by.values():
            key, n = _summed_counts(held)
            yield pa.RecordBatch.from_arrays([pa.array(key[n > limit]), pa.array(n[n > limit])], ["u", "n"])

    return run


def hot_contexts(texts: DataFrame, limit: int) -> Hot:
    """Contexts of over limit tokens, counted over all texts; there can't be more of them than parts."""
    buckets = max(12, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = texts.select("text").mapInArrow(_survey(buckets), "bucket int, packed binary").repartitionById(buckets, "bucket")
    rows = sorted(map(tuple, counted.mapInArrow(_frequent(limit), "u long, n long").collect()))
    return Hot(np.array([u for u, _ in rows], np.int64), np.array([-(-n // limit) for _, n in rows], np.int64))


def _pack(*columns: tuple[np.ndarray, str]) -> bytes:
    """Columns of one length as planes of their bytes, as many as the largest number has, compressed."""
    sizes, planes = [], []
    for x, kind in columns:
        x = np.ascontiguousarray(x, kind)
        bits = _bits(x) if x.dtype.kind in "iu" else 64
        sizes.append(min(x.dtype.itemsize, max(1, -(-bits // 8))))
        planes.append(x.view(np.uint8).reshape(len(x), -1)[:, : sizes[-1]].T.tobytes() if len(x) else b"")
    return np.array([len(columns[0][0]), *sizes], "<i8").tobytes() + pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    head = 8 * (1 + len(kinds))
    n, *sizes = np.frombuffer(data, "<i8", head // 8).tolist()
    if not n:
        return [np.zeros(0, kind) for kind in kinds]
    planes, at, out = pa.Codec("zstd").decompress(memoryview(data)[head:], decompressed_size=n * sum(sizes)), 0, []
    for kind, size in zip(kinds, sizes):
        x = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        x[:, :size] = np.frombuffer(planes, np.uint8, n * size, at).reshape(size, n).T
        out.append(x.view(kind).ravel())
        at += n * size
    return out


def _join(*packed: bytes) -> bytes:
    return b"".join([np.array([len(x) for x in packed], "<i8").tobytes(), *packed])


def _split(data: bytes, pieces: int) -> Iterator[bytes]:
    at = 8 * pieces
    for size in np.frombuffer(data, "<i8", pieces).tolist():
        yield data[at : at + size]
        at += size


def _distinct(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place there of each; values are below most."""
    if most > 4 * len(x):
        return _ranks(x)
    there = np.zeros(most, bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[x]


def _dealt(held: list[tuple], parts: int, hot: Hot) -> Iterator[tuple[int, bytes]]:
    """Tokens by part: the documents there; contexts and their tokens; (word, document) by context, word and document."""
    count = [len(ids) for *_, ids in held]
    doc = np.concatenate([doc + before for (_, _, doc, _), before in zip(held, np.cumsum([0, *count]))])
    w, begins, _, ids = (np.concatenate(x) for x in zip(*held))
    held.clear()
    word, at = _ranks(w)
    names, at = np.concatenate([[0], word]), at + 1
    context = np.concatenate([np.zeros(1, np.int32), at[:-1]])
    context[begins] = 0
    part, context, at, doc = _sorted(_part(names, context, at, parts, hot), context, at, doc)
    runs = np.flatnonzero(_changes(part, context))
    names_of, size, w = names[context[runs]], np.diff(np.append(runs, len(part))), names[at]
    edge = np.append(np.flatnonzero(_changes(part)), len(part))
    run_edge = np.searchsorted(runs, edge)
    for k, a, z, first, last in zip(part[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), run_edge[:-1].tolist(), run_edge[1:].tolist()):
        there, local = _distinct(doc[a:z], len(ids))
        yield k, _join(_pack((np.diff(ids[there], prepend=0), "<i8")), _pack((np.diff(names_of[first:last], prepend=0), "<i8"), (size[first:last], "<u4")), _pack((w[a:z], "<i8"), (local, "<u4")))


def _spread(parts: int, hot: Hot, most: int = 1):
    """The tokens by part, in batches of about so many bytes."""

    def rows(batches):
        held, size, limit = [], 0, min(MOST_TOKENS, max(LEAST_TOKENS, ROW_TOKENS * parts))
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in text_slices(b.column(1), SLICE_BYTES):
                u, w, doc = tokens(b.column(1).slice(i, j - i))
                held.append((w, u == 0, doc.astype(np.int32), ids[i:j]))
                size += len(w)
                if size >= limit:
                    yield from _dealt(held, parts, hot)
                    size = 0
        if size:
            yield from _dealt(held, parts, hot)

    return lambda batches: _batched(rows(batches), {"part": pa.int32(), "packed": pa.binary()}, most)


@dataclass
class Part:
    """Contexts and words, sorted; dishes (their context, word and customers) sorted, and the tokens' dish and document."""

    context: np.ndarray
    ctx: np.ndarray
    word: np.ndarray
    at: np.ndarray
    c: np.ndarray
    dish: np.ndarray
    doc: np.ndarray
    ids: np.ndarray

    @property
    def u(self) -> np.ndarray:
        return self.context[self.ctx]

    @property
    def w(self) -> np.ndarray:
        return self.word[self.at]

    @classmethod
    def of(cls, blobs: list[bytes]) -> Part:
        ids, context, size, w, doc, before = [], [], [], [], [], 0
        while blobs:  # arrays of a part are large: none is held longer or wider than it must be
            a, b, c = _split(blobs.pop(), 3)
            ids.append(np.cumsum(_unpack(a, "<i8")[0]))
            u, n = _unpack(b, "<i8", "<u4")
            context.append(np.cumsum(u)), size.append(n)
            x, local = _unpack(c, "<i8", "<i4")
            w.append(x), doc.append(local + np.int32(before))
            before += len(ids[-1])
        ids, rank = _ranks(np.concatenate(ids))
        doc = rank[np.concatenate(doc)]
        context, rank = _ranks(np.concatenate(context))
        of = np.repeat(rank, np.concatenate(size))
        w = np.concatenate(w)
        word, at = _ranks(w)
        del w, rank
        of, at, doc = _sorted(of, at, doc)
        new = _changes(of, at)
        first = np.flatnonzero(new)
        return cls(context, of[first].astype(np.int32), word, at[first], np.diff(np.append(first, len(doc))), np.cumsum(new, dtype=np.int32) - np.int32(1), doc, ids)

    def dump(self) -> bytes:
        own = _pack((np.diff(self.context, prepend=0), "<i8"), (np.bincount(self.ctx), "<u4"))
        return _join(own, _pack((np.diff(self.word, prepend=0), "<i8")), _pack((self.at, "<i4"), (self.c, "<i8")), _pack((self.doc, "<i4")), _pack((np.diff(self.ids, prepend=0), "<i8")))

    @classmethod
    def parse(cls, x: bytes) -> Part:
        own, word, dishes, doc, ids = _split(x, 5)
        context, n = _unpack(own, "<i8", "<u4")
        at, c = _unpack(dishes, "<i4", "<i8")
        of, dish = np.repeat(np.arange(len(context), dtype=np.int32), n), np.repeat(np.arange(len(c), dtype=np.int32), c)
        return cls(np.cumsum(context), of, np.cumsum(_unpack(word, "<i8")[0]), at, c, dish, _unpack(doc, "<i4")[0], np.cumsum(_unpack(ids, "<i8")[0]))


_STATE = "part int, kind string, bucket int, packed binary, u array<long>, n array<long>"


_FIELDS = {"part": pa.int32(), "kind": pa.string(), "bucket": pa.int32(), "packed": pa.binary(), "u": pa.list_(pa.int64()), "n": pa.list_(pa.int64())}


def _asked(part: int, p: Part, t: np.ndarray, buckets: int) -> Iterator[tuple]:
    """What a part asks of the parent: its words by bucket of the words, with the tables it has of each."""
    tables = np.bincount(p.at, t, len(p.word)).astype(np.int64)
    edge = np.searchsorted(p.word * buckets >> TYPE_BITS, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        s = slice(edge[k], edge[k + 1])
        yield part, "asked", k, _pack((np.diff(p.word[s], prepend=0), "<i8"), (tables[s], "<i8")), [], []


def _shared(part: int, p: Part, t: np.ndarray, hot: Hot) -> Iterator[tuple]:
    """Customers and tables of the part's hot contexts."""
    here, which = hot.find(p.context)
    if len(here):
        for kind, n in (("customers", p.c), ("opened", t)):
            yield part, kind, 0, None, which.tolist(), np.bincount(p.ctx, n, len(p.context))[here].astype(np.int64).tolist()


def _gather(hot: Hot, buckets: int):
    """After the shuffle: the parts as self-contained rows, and what starts the model (one table for each dish)."""

    def rows(batches):
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(k, []).append(x)
        for k in sorted(by):
            p = Part.of(by.pop(k))
            yield k, "part", 0, p.dump(), [], []
            one = np.ones(len(p.c), np.int64)
            yield from _shared(k, p, one, hot)
            yield from _asked(k, p, one, buckets)
            yield k, "counts", 0, None, [], [len(p.c), int((p.c == 1).sum()), int((p.c == 2).sum()), len(p.ids)]

    return lambda batches: _batched(rows(batches), _FIELDS, BATCH_BYTES)


def _hot_sums(rows: DataFrame, kind: str, size: int) -> np.ndarray:
    """By hot context; at most one row for each of its parts."""
    out = np.zeros(size, np.int64)
    found = rows.where(F.col("kind") == kind).select(F.explode(F.arrays_zip("u", "n")).alias("x")).groupBy("x.u").agg(F.sum("x.n").alias("n"))
    for r in found.collect():
        out[r[0]] = r[1]
    return out


def seat_parent(c: np.ndarray, base: float, d: float, ratios: np.ndarray, random: np.random.Generator, rounds: int = BURN_IN) -> np.ndarray:
    """Mean tables of the unigram restaurant's dishes, whose customers are the contexts' tables, over as many sweeps as went before."""
    order = np.argsort(-c, kind="stable")
    c, weight = c[order], np.full(len(c), base)
    t = first_seating(c, weight, np.ones(len(c), np.int64), d, random)
    mean = np.zeros(len(c))
    for r in range(2 * rounds):
        reseat(c, t, weight, ratios, d, random)
        if r >= rounds:
            mean[order] += t / rounds
    return mean


def _seated(base: float, d: float, table, seed: int, rounds: int):
    """The parent's dishes of each bucket are seated; to each part goes c - d t of the words it asked for, in their order."""

    def rows(batches):
        by: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for part, bucket, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                by.setdefault(bucket, []).append((part, x))
        for bucket in sorted(by):
            asked = sorted(by.pop(bucket))
            words, opened = [], []
            for _, x in asked:
                du, n = _unpack(x, "<i8", "<i8")
                words.append(np.cumsum(du)), opened.append(n)
            edge = np.cumsum([0, *map(len, words)])
            key, inverse = _ranks(np.concatenate(words))
            c = np.bincount(inverse, np.concatenate(opened), len(key)).astype(np.int64)
            t = seat_parent(c, base, d, table.value, np.random.default_rng([SEED, 1, seed, bucket]), rounds)
            rest = (c - d * t).astype(np.float32)
            for (part, _), a, z in zip(asked, edge, edge[1:]):
                yield part, bucket, _pack((rest[inverse[a:z]], "<f4")), 0.0, 0.0, 0
            yield -1, bucket, b"", float(c.sum()), float(t.sum()), len(c)

    fields = {"part": pa.int32(), "bucket": pa.int32(), "packed": pa.binary(), "customers": pa.float64(), "tables": pa.float64(), "words": pa.int64()}
    return lambda batches: _batched(rows(batches), fields, BATCH_BYTES)


_SEATED = "part int, bucket int, packed binary, customers double, tables double, words long"


def _answers(folder: str):
    """Writes the answers to each part as a file of its own, buckets in order; a repeated task writes the same bytes again."""

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        by: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for part, bucket, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                by.setdefault(part, []).append((bucket, x))
        for part, found in by.items():
            own = f"{path}/{uuid.uuid4().hex}.tmp"
            values = b"".join(_unpack(x, "<f4")[0].tobytes() for _, x in sorted(found))
            with store.open_output_stream(own) as f:
                f.write(values)
            store.move(own, f"{path}/{part}.answers")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

    return run


@dataclass
class Parents:
    """What the contexts share: where the parent's c - d t lie by part, the weight of its new tables over the words, what all is divided by; hot contexts; discount and concentration."""

    folder: str
    fresh: float
    total: float
    hot: Hot
    discount: float
    theta: float

    def predictive(self, part: int, p: Part) -> np.ndarray:
        """The parent's probability of each dish's word."""
        store, path = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{path}/{part}.answers") as f:
            rest = np.frombuffer(f.read(), "<f4").astype(np.float64)
        return ((rest + self.fresh) / self.total)[p.at]


def _sizes(p: Part, parents: Parents) -> tuple[np.ndarray, np.ndarray]:
    """By context of the part: customers everywhere, and tables in other parts as of the last pass."""
    customers, others = np.bincount(p.ctx, p.c, len(p.context)), np.zeros(len(p.context))
    here, which = parents.hot.find(p.context)
    own = np.bincount(p.ctx, minlength=len(p.context))
    customers[here] = parents.hot.customers[which]
    others[here] = np.maximum(parents.hot.opened[which] - own[here], 0)
    return customers, others


def _repeated(p: Part) -> np.ndarray:
    """The dishes of more than one customer, most customers first."""
    many = np.flatnonzero(p.c > 1)
    return many[np.argsort(-p.c[many], kind="stable")]


def _seatings(p: Part, p0: np.ndarray, parents: Parents, ratios: np.ndarray, seed: int, burn_in: int, samples: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tables by dish of _repeated, tables by context) after each sampled sweep, given the parent. Other dishes have one table."""
    random = np.random.default_rng([SEED, 2, seed])
    d, theta, many = parents.discount, parents.theta, _repeated(p)
    c, of, prior = p.c[many], p.ctx[many], p0[many]
    rest = _sizes(p, parents)[1] + np.bincount(p.ctx, p.c == 1, len(p.context))
    tables = lambda t: rest + np.bincount(of, t, len(rest))
    t = np.ones(len(c), np.int64)
    t = first_seating(c, (theta + d * tables(t)[of]) * prior, t, d, random)
    for r in range(burn_in + samples):
        reseat(c, t, (theta + d * tables(t)[of]) * prior, ratios, d, random)
        if r >= burn_in:
            yield t.copy(), tables(t)


def token_probabilities(p: Part, p0: np.ndarray, parents: Parents, ratios: np.ndarray, seed: int, burn_in: int = BURN_IN, samples: int = SAMPLES) -> np.ndarray:
    """By dish, the probability of one of its tokens given all other tokens, averaged over the sampled seatings."""
    d, theta, many = parents.discount, parents.theta, _repeated(p)
    c, of, prior = p.c[many], p.ctx[many], p0[many]
    some, mean = np.zeros(len(c)), np.zeros(len(p.context))
    for t, opened in _seatings(p, p0, parents, ratios, seed, burn_in, samples):
        gone = alone(c, t, ratios, d)
        some += (np.maximum(c - 1 - d * (t - gone), 0.0) + (theta + d * (opened[of] - gone)) * prior) / samples
        mean += opened / samples
    out = (theta + d * (mean - 1))[p.ctx] * p0  # an only customer leaves with its table
    out[many] = some
    return out / (theta + _sizes(p, parents)[0] - 1)[p.ctx]


def _parts_of(batches) -> Iterator[tuple[int, Part]]:
    for b in batches:
        for k, x in zip(b.column(0), b.column(1)):
            yield k.as_py(), Part.parse(x.as_py())


def lm_scores(docs: DataFrame, passes: int = PASSES, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity): the natural log of a text's probability, of each word given all other words of the corpus.

    A row for each doc_id; rows that repeat one are one document. Null, empty and wordless texts and rows whose
    doc_id is null: the former have 0 tokens, log_prob 0 and no perplexity (null); the latter are read into the
    model, and are scored together under the null doc_id. Other columns are ignored; an empty table gives none. A task
    holds a part of about PART_BYTES of text, some dozens of bytes for each byte of its longest text, and all tokens of
    the commonest pair of words. The model is fitted while the plan is built.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    none = -(1 << 63)
    texts = base.where("text is not null").select(F.coalesce("doc_id", F.lit(none)).alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(12, math.ceil(size / PART_BYTES))
    buckets = max(12, parts // 4)
    hot = hot_contexts(texts, PART_TOKENS)
    spread = texts.mapInArrow(_spread(parts, hot, BATCH_BYTES), "part int, packed binary").repartitionById(parts, "part")
    state = scratch.table(spread.mapInArrow(_gather(hot, buckets), _STATE), "parts")
    counts = state.where("kind = 'counts'").agg(*[F.sum(F.col("n")[k]) for k in range(4)]).first()
    d = float(np.clip((counts[1] or 0) / max(1, (counts[1] or 0) + 2 * (counts[2] or 0)), 0.1, 0.95))
    ratios = stirling_ratios(d)
    table = spark.sparkContext.broadcast(ratios)
    hot.customers, hot.opened = (_hot_sums(state, k, len(hot.u)) for k in ("customers", "opened"))
    rows, found, words, tables = state.where("kind = 'part'").select("part", "packed"), state, None, 0.0
    for k in range(passes):
        asked = found.where("kind = 'asked'").select("part", "bucket", "packed")
        if words is None:  # of one table for each word
            words = tables = max(1.0, float(_distinct_words(asked, buckets)))
        fresh = (CONCENTRATION + d * tables) / words
        seated = scratch.table(asked.repartitionById(buckets, "bucket").mapInArrow(_seated(fresh, d, table, k, burn_in), _SEATED), "seated")
        sums = seated.where("part < 0").agg(F.sum("customers"), F.sum("tables")).first()
        customers, tables = (float(x or 0) for x in sums)
        folder = scratch.path("answers")
        folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        seated.where("part >= 0").select("part", "bucket", "packed").repartitionById(parts, "part").mapInArrow(_answers(folder), "part int").write.format("noop").mode("overwrite").save()
        parents = Parents(folder, (CONCENTRATION + d * tables) / words, CONCENTRATION + customers, hot, d, CONCENTRATION)
        if k + 1 == passes:
            break
        found = scratch.table(rows.mapInArrow(_one_pass(parents, table, k, burn_in, buckets), _STATE), "pass")
        hot = Hot(hot.u, hot.spread, hot.customers, _hot_sums(found, "opened", len(hot.u)))
    groups = max(12, math.ceil((counts[3] or 0) / GROUP_PAIRS))
    scored = rows.mapInArrow(_score(parents, table, passes, burn_in, samples, groups), "g int, packed binary").repartitionById(groups, "g")
    sums = scored.mapInArrow(_summed, "doc_id long, n long, lp double")
    every = base.select(F.coalesce("doc_id", F.lit(none)).alias("doc_id")).distinct()
    joined = every.join(sums, "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        F.when(F.col("doc_id") != none, F.col("doc_id")).alias("doc_id"), n.alias("n_tokens"), F.coalesce("lp", F.lit(0.0)).alias("log_prob"), F.when(n > 0, F.exp(-F.col("lp") / n)).alias("perplexity")
    )


def _distinct_words(asked: DataFrame, buckets: int) -> int:
    def run(batches):
        by: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for bucket, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(bucket, []).append(np.cumsum(_unpack(x, "<i8", "<i8")[0]))
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(np.unique(np.concatenate(x))) for x in by.values())])], ["n"])

    return asked.select("bucket", "packed").repartitionById(buckets, "bucket").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _one_pass(parents: Parents, table, seed: int, burn_in: int, buckets: int):
    def rows(batches):
        for k, p in _parts_of(batches):
            tables = np.ones(len(p.c), np.int64)
            for t, _ in _seatings(p, parents.predictive(k, p), parents, table.value, (seed << 32) + k, burn_in, 1):
                tables[_repeated(p)] = t
                yield from _shared(k, p, tables, parents.hot)
                yield from _asked(k, p, tables, buckets)

    return lambda batches: _batched(rows(batches), _FIELDS, BATCH_BYTES)


def _score(parents: Parents, table, seed: int, burn_in: int, samples: int, out: int):
    """Tokens and log probability of each part's documents, packed by the group of documents that sums them."""

    def rows(batches):
        for k, p in _parts_of(batches):
            lp = np.log(token_probabilities(p, parents.predictive(k, p), parents, table.value, (seed << 32) + k, burn_in, samples))[p.dish]
            n, total = np.bincount(p.doc, minlength=len(p.ids)), np.bincount(p.doc, lp, len(p.ids))
            group = (mix(p.ids.astype(np.uint64)) % np.uint64(out)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            edge = np.searchsorted(group[order], np.arange(out + 1))
            for g in np.flatnonzero(np.diff(edge)).tolist():
                o = order[edge[g] : edge[g + 1]]
                yield g, _pack((np.diff(p.ids[o], prepend=0), "<i8"), (n[o], "<i8"), (total[o], "<f4"))

    return lambda batches: _batched(rows(batches), {"g": pa.int32(), "packed": pa.binary()}, BATCH_BYTES)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[int, list[bytes]] = {}
    for b in batches:
        for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(g, []).append(x)
    for g in sorted(by):
        ids, n, total = [], [], []
        for x in by.pop(g):
            di, k, lp = _unpack(x, "<i8", "<i8", "<f4")
            ids.append(np.cumsum(di)), n.append(k), total.append(lp)
        own, inverse = np.unique(np.concatenate(ids), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(inverse, np.concatenate(n)).astype(np.int64)), pa.array(np.bincount(inverse, np.concatenate(total)))], ["doc_id", "n", "lp"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
