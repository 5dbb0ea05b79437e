import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofold.errors import InvalidInput
from echofold.functions import text as T
from echofold.functions.blake3 import blake3, digests


def values(spark, column, rows, **kw):
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    return [r[0] for r in df.select(column(F.col("path"), **kw)).collect()]


def test_paths(spark):
    assert values(spark, T.lexical_path, ["/a/./b/../c", "/..", "/", "a//b/", None]) == ["/a/c", None, "/", "/a/b", None]
    assert values(spark, T.extension, ["/a/b.PDF", "/a/.hidden", "/x.y/none", "/a.tar.gz", "/a.", None]) == ["pdf", None, None, "gz", "", None]
    assert values(spark, T.leaf, ["/a/b", "/a/b/", "b", "/"]) == ["b", "b", "b", ""]
    nfc, nfd = "/café.pdf", "/café.pdf"
    a, b = values(spark, T.path_key, [nfc, nfd])
    assert a == b and len(set(values(spark, T.path_identity_key, [nfc, nfd]))) == 2
    assert values(spark, T.normalized_name, ["/X/CAFÉ.Pdf", None]) == ["café.pdf", None]
    df = spark.createDataFrame([("/books", "/books/pdf"), ("/books", "/books-old"), ("/books/", "/books"), ("/", "/a")], "r string, p string")
    assert [x[0] for x in df.select(T.contains(F.col("r"), F.col("p"))).collect()] == [True, False, True, True]
    assert values(spark, T.in_quarantine, ["/a/.EchoFold-Quarantine/b", "/a/b"]) == [True, False]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("**/cache/**", ["/a/cache/b", "cache/b"], ["/a/cached/b"]),
        ("*.pdf", ["a.pdf", "/x/a.pdf"], ["a.pdfx"]),
        ("a?[0-9].{txt,md}", ["ab1.txt", "ac2.md"], ["abx.txt", "ab1.pdf"]),
        ("[!a]b", ["cb"], ["ab"]),
        ("x.y+z", ["x.y+z"], ["xay+z"]),
    ],
)
def test_globs(spark, glob, yes, no):
    for rows, hit in ((yes, True), (no, False)):
        assert values(spark, lambda c: c.rlike(T.glob_regex(glob)), rows) == [hit] * len(rows)
    assert all(re.search(T.glob_regex(glob), x) for x in yes)


@pytest.mark.parametrize("glob", ["[a", "{a,b"])
def test_bad_globs(glob):
    with pytest.raises(InvalidInput):
        T.glob_regex(glob)


def slow_blake3(data):
    """The published algorithm on one block at a time, with Python integers."""
    iv = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
    order = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
    turn = lambda x, n: (x >> n | x << 32 - n) & 0xFFFFFFFF

    def compress(chain, block, counter, length, flags):
        m = [int.from_bytes(block.ljust(64, b"\0")[4 * i : 4 * i + 4], "little") for i in range(16)]
        v = [*chain, *iv[:4], counter & 0xFFFFFFFF, counter >> 32, length, flags]
        for _ in range(7):
            for k, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
                for x, r, s in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                    v[a] = (v[a] + v[b] + x) & 0xFFFFFFFF
                    v[d] = turn(v[d] ^ v[a], r)
                    v[c] = (v[c] + v[d]) & 0xFFFFFFFF
                    v[b] = turn(v[b] ^ v[c], s)
            m = [m[i] for i in order]
        return [v[i] ^ v[i + 8] for i in range(8)]

    def tree(part, first, root):
        if len(part) <= 1024:
            blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
            chain = iv
            for i, x in enumerate(blocks):
                chain = compress(chain, x, first, len(x), (i == 0) | (i == len(blocks) - 1) << 1 | (root and i == len(blocks) - 1) << 3)
            return chain
        half = 1024
        while half * 2 < len(part):
            half *= 2
        both = b"".join(x.to_bytes(4, "little") for x in [*tree(part[:half], first, False), *tree(part[half:], first + half // 1024, False)])
        return compress(iv, both, 0, 64, 4 | root << 3)

    return b"".join(x.to_bytes(4, "little") for x in tree(data, 0, True))


def test_blake3(spark):
    assert digests([b""])[0].hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    texts = [bytes(i % 251 for i in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5120, 9217)]
    assert digests(texts) == [slow_blake3(x) for x in texts]
    df = spark.createDataFrame([(b"abc",), (None,)], "x binary").select(blake3("x"))
    assert [r[0] and bytes(r[0]) for r in df.collect()] == [slow_blake3(b"abc"), None]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=5000), max_size=4))
def test_blake3_of_any_bytes(texts):
    assert digests(texts) == [slow_blake3(x) for x in texts]
