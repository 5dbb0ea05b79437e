from collections import Counter

import numpy as np
import pyarrow as pa

from echofold.llm import line_dedup as L
from echofold.llm.common import _BASE, _M1, _M2, _S


def brute(rows):
    trim = lambda x: x.strip(" \t\r\v\f")
    texts = {}
    for i, t in rows:
        for k in {trim(x) for x in (t or "").split("\n")} - {""}:
            texts.setdefault(k, []).append((i is None, i, t))
    owner = {k: min(v)[2] for k, v in texts.items() if len({t for *_, t in v}) > 1}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, None, None))
        else:
            parts = t.split("\n")
            bad = [owner.get(trim(x), t) != t for x in parts]
            out.append((i, sum(trim(x) != "" for x in parts), sum(bad), "\n".join(x for x, gone in zip(parts, bad) if not gone)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_repeated, r.text) for r in df.collect()), key=str)


def test_perfect_hash():
    random = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 200_000):
        keys = np.unique(random.integers(0, 1 << 63, n).astype(np.uint64))
        found = L.PerfectHash.build(keys).find(keys)
        assert sorted(found) == list(range(len(keys)))
        counts, owners = np.arange(len(keys)) + 1, random.integers(1, 1 << 63, len(keys)).astype(np.uint64)
        shard = L.Shard.parse(L.Shard(keys, counts, owners).dump())
        found = shard.find(keys)
        assert (found[0] == counts).all() and (found[1] == owners).all()
        others = np.setdiff1d(random.integers(0, 1 << 63, 1000).astype(np.uint64), keys)
        assert not shard.find(others)[0].any()


def test_hard_rows(spark, hard):
    rows = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    more = [(20, "x y\n a b c d e f g \nline two\n"), (21, "line two\t"), (None, "line two"), (22, "x y\n\nx y"), (23, "x y\n\nx y")]
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = result(L.line_dedup(docs.withColumn("shard", docs["text"]), shards=3))
    assert got == brute(rows + more) == result(L.line_dedup(docs))
    assert [n for i, _, n, _ in got if i in (1, 20, 21, 22, 23)] == [0, 2, 1, 2, 2]
    assert L.line_dedup(hard.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = result(L.line_dedup(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(n for _, _, n, _ in got) > 0


def test_structured_lines_are_told_apart(spark):
    """Thue-Morse words meet under any sum of bytes times powers modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other)], "doc_id long, text string")
    assert [r.text for r in L.line_dedup(docs).orderBy("doc_id").collect()] == [word, other]


def test_lines_of_one_text_are_indexed(spark):
    """Lines that would lie where a shared line lies, with its fingerprint, were only shared lines in the index, are not removed."""

    def unmixed(h):
        for factor in (_M2, _M1):
            h = (h ^ (h >> _S)) * np.uint64(pow(int(factor), -1, 1 << 64))
        return h ^ (h >> _S)

    hashed = lambda *x: L.lines(pa.array(x))[0]
    key = hashed("line two")
    like = (np.arange(1 << 20, dtype=np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
    like = like[(L.PerfectHash.build(key).find(like) == 0) & (like != key)]
    size = np.uint64(8 * int(_M2) & 0xFFFFFFFFFFFFFFFF)
    spelt = unmixed(unmixed(unmixed(like) - size) - np.uint64(_BASE)).view(np.uint8).reshape(-1, 8)
    spelt = [bytes(x).decode() for x in spelt[((spelt > 32) & (spelt < 127)).all(1)]]
    assert spelt and set(hashed(*spelt)) <= set(like)
    rows = [(1, "line two"), (2, "line two\nb"), *((3 + i, f"{x}\nc{i}") for i, x in enumerate(spelt))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(L.line_dedup(docs, shards=1)) == brute(rows)

    keys = np.arange(1, 5001, dtype=np.uint64)
    shared = keys % np.uint64(50) == 0
    counts, owners = L.Shard.parse(L.Shard(keys, keys, keys + np.uint64(9), shared).dump()).find(keys)
    assert (counts == np.where(shared, keys, 0)).all() and (owners == np.where(shared, keys + np.uint64(9), 0)).all()
    assert not L.Shard(keys, keys, keys, keys == 0).find(keys)[0].any()
