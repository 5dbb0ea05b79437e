"""Byte-level BPE encoding and decoding in batched numpy (operator 10).

Texts of a slice become one array of characters, cut into words by the vocabulary's public pattern as class
changes; distinct words become one flat array of symbols. Each round looks all adjacent pairs up by binary
search over the sorted pair keys and merges every word's lowest-rank pair.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from .common import documents, raw, span_hashes, text_slices

VOCABULARY = os.environ.get("ECHOFOLD_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: bytes encoded at once; a task holds some hundred times as much
SLICE = 2 << 20
NO = np.int64(1 << 40)


@dataclass
class Vocabulary:
    """byte_ids: the id of each byte; keys: sorted left << 32 | right; merged: the id, which is the rank, of each pair; data, start: the bytes of each id."""

    byte_ids: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    data: np.ndarray
    start: np.ndarray


def load(path: str = VOCABULARY) -> Vocabulary:
    """A vocabulary of base64 tokens and ranks, one to a line, ranks without gaps."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    keys, merged = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                merged.append(rank)
    keys, merged = np.array(keys, np.int64), np.array(merged, np.int64)
    order = np.argsort(keys)
    by_rank = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_rank[rank] = token
    start = np.concatenate([[0], np.cumsum([len(t) for t in by_rank])])
    return Vocabulary(np.array([ranks[bytes([b])] for b in range(256)], np.int64), keys[order], merged[order], np.frombuffer(b"".join(by_rank), np.uint8), start)


@cache
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, by code point."""
    out = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = 1
        elif kind == "N":
            out[c] = 2
        elif kind == "Z":
            out[c] = 0
    out[[9, 10, 11, 12, 13, 32, 0x85]] = 0
    return out


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the words of '(?:[sdmt]|ll|ve|re)| ?letters| ?numbers| ?others| spaces(?!non-space)| spaces start."""
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _classes()[cp]
    text = np.zeros(n + 1, bool)  # where texts start
    text[np.searchsorted(at, offsets)] = True
    text[n] = True
    new = text[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    space = (kind[runs] == 0) & ~text[ends]  # white space before something of the same text
    end = ends[space]
    plain = cp[end - 1] == 32
    new[end - 1] = True
    new[end[plain]] = False
    quote = (kind[runs] == 3) & (ends - runs == 1) & (cp[runs] == 39) & ~text[ends] & new[runs]
    e = ends[quote]
    e = e[kind[e] == 1]
    stop = np.append(runs, n)[np.searchsorted(runs, e) + 1]
    one = np.isin(cp[e], np.array([ord(c) for c in "sdmt"], np.uint32))
    second = np.where(e + 1 < stop, cp[np.minimum(e + 1, n - 1)], 0)
    two = np.zeros(len(e), bool)
    for a, b in ("ll", "ve", "re"):
        two |= (cp[e] == ord(a)) & (second == ord(b))
    for hit, width in ((one, 1), (two & ~one, 2)):
        new[e[hit]] = False
        after = e[hit] + width
        new[after[after < stop[hit]]] = True
    return at[new]


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of words in one flat array, and their number by word."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    done_w, done_s = [], []
    while len(symbols):
        same = np.append(word[1:] == word[:-1], False)
        key = symbols << 32
        key[:-1] |= symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        rank = np.where(same & (v.keys[at] == key), v.merged[at], NO)
        first = np.flatnonzero(np.concatenate([[True], ~same[:-1]]))
        count = np.diff(np.append(first, len(symbols)))
        least = np.repeat(np.minimum.reduceat(rank, first), count)
        ready = least == NO
        if ready.any():
            done_w.append(word[ready])
            done_s.append(symbols[ready])
        hit = (rank == least) & ~ready
        if hit.any():  # of overlapping pairs (aaa) every other one, from the left
            p = np.flatnonzero(hit)
            begin = np.concatenate([[True], p[1:] != p[:-1] + 1])
            order = np.arange(len(p)) - np.maximum.accumulate(np.where(begin, np.arange(len(p)), 0))
            p = p[order % 2 == 0]
            symbols[p] = rank[p]
            ready[p + 1] = True
        keep = ~ready
        symbols, word = symbols[keep], word[keep]
    w, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_w, done_s))
    order = np.argsort(w, kind="stable")
    return s[order], np.bincount(w, minlength=len(lengths))


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the spans one after another."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


def encode_flat(data: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of texts in one array, and their offsets by text (n + 1)."""
    start = word_starts(data, offsets)
    end = np.append(start[1:], len(data))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    _, first, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    for distinct in (True, False):  # if two words of a slice should share a hash, encode word by word
        if not distinct:
            first = inverse = np.arange(len(start))
        size = (end - start)[first]
        tokens, count = merge_rounds(v.byte_ids[data[_gather(start[first], size)]], size, v)
        per_word = count[inverse]
        out = tokens[_gather((np.cumsum(count) - count)[inverse], per_word)]
        if not distinct or np.array_equal(decode_flat(out, v), data):
            break
    ends = np.concatenate([[0], np.cumsum(per_word)])
    return out, ends[np.searchsorted(start, offsets)]


def decode_flat(tokens: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Bytes of the tokens."""
    return v.data[_gather(v.start[tokens], v.start[tokens + 1] - v.start[tokens])]


def _valid(texts: pa.Array) -> pa.Array:
    try:
        raw(texts)[0].tobytes().decode("utf-8")
        return texts
    except UnicodeDecodeError:
        return pa.array([x if x is None else x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())


def _encoded(texts: pa.Array, v: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, token ids, offsets, whether decoding gives the text) by slice."""
    for i, j in text_slices(texts, SLICE):
        data, offsets = raw(_valid(pc.fill_null(texts.slice(i, j - i), "")))
        tokens, ends = encode_flat(data, offsets, v)
        back = decode_flat(tokens, v)
        same = np.ones(j - i, bool)
        if not np.array_equal(back, data):
            bytes_at = np.concatenate([[0], np.cumsum(v.start[tokens + 1] - v.start[tokens])])[ends]
            same = np.array([back[bytes_at[k] : bytes_at[k + 1]].tobytes() == data[offsets[k] : offsets[k + 1]].tobytes() for k in range(j - i)])
        yield i, j, tokens, ends, same


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """The kept columns with token_ids, n_tokens and round_trip (whether the ids decode to the text again).

    One row for each row, in one pass without a shuffle. A null text has null ids and no round trip (null), an
    empty one no ids. Bytes that aren't UTF-8 are encoded as U+FFFD. Special tokens' strings are ordinary text. Repeated
    rows give repeated rows, an empty table gives none; other columns are left out, whatever their names. A text longer
    than SLICE is encoded whole, and takes memory in proportion.
    """
    v = docs.sparkSession.sparkContext.broadcast(load(path))
    names = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[k].alias(n) for k, n in zip(keep, names)], docs["text"].alias("__text"))
    schema = rows.drop("__text").schema.add("token_ids", ArrayType(IntegerType())).add("n_tokens", IntegerType()).add("round_trip", BooleanType())

    def run(batches):
        for b in batches:
            texts = b.column(len(names))
            for i, j, tokens, ends, same in _encoded(texts, v.value):
                null = texts.slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens.astype(np.int32)), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(i, j - i) for k in range(len(names))], ids, pa.array(np.diff(ends).astype(np.int32), mask=null), pa.array(same, mask=null)], [*names, "token_ids", "n_tokens", "round_trip"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], "token_ids", "n_tokens", "round_trip")


def decode(tokens: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """The kept columns with text, from token_ids. Null ids give a null text, no ids an empty one; a null or unknown id among them is an error.

    One row for each row, repeated rows alike; an empty table gives none; other columns are left out.
    """
    v = tokens.sparkSession.sparkContext.broadcast(load(path))
    names = [f"__k{i}" for i in range(len(keep))]
    rows = tokens.select(*[tokens[k].alias(n) for k, n in zip(keep, names)], tokens["token_ids"].alias("__ids"))
    schema = rows.drop("__ids").schema.add("text", StringType())

    def run(batches):
        for b in batches:
            lists = b.column(len(names))
            ids = lists.flatten().to_numpy(zero_copy_only=True).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(v.value.start) - 1):
                raise ValueError("a token id is not in the vocabulary")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = np.concatenate([[0], np.cumsum(v.value.start[ids + 1] - v.value.start[ids])])[ends]
            data = decode_flat(ids, v.value).tobytes()
            texts = [None if gone else data[at[k] : at[k + 1]].decode("utf-8", "replace") for k, gone in enumerate(lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(names))], pa.array(texts, pa.string())], [*names, "text"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
