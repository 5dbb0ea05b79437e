import base64
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.llm import bpe
from echofold.llm.common import raw

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
V = bpe.load(P.path("byte_bpe_50k.tiktoken"))


def ours(texts):
    tokens, ends = bpe.encode_flat(*raw(pa.array(texts, pa.string())), V)
    return [tokens[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_cases():
    texts = ["", "don't we'll I've 'tis 's 'sss ''s !'s  's\n's they're 'RE 'r", "  a  b \n c \n\n", "aaaaaaa aaaa", " ", "\n\n x", "x1y22 3_#é中文 ñandú z q", "'", " '", "it's", "a'll'd", "<|endoftext|>", "🙂🙂 ok 🙂"]
    assert ours(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abst'lvre dm1é!\n\t 中🙂")) | st.characters(exclude_categories=["Cs", "Cn"]), max_size=40), max_size=5))
def test_any_text(texts):
    got = ours(texts)
    assert [REFERENCE.decode_bytes(t) for t in got] == [t.encode() for t in texts]
    plain = [t for t in texts if all(ord(c) < 0x3000 or c in "中🙂" for c in t)]
    assert ours(plain) == [REFERENCE.encode_ordinary(t) for t in plain]


def test_documents():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    assert ours(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_frames(spark):
    rows = [(1, "it's a test", "x"), (2, None, "y"), (3, "", "z"), (None, "null id", "w"), (1, "it's a test", "x"), (5, "long " * 100_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = bpe.encode(docs)
    got = out.collect()
    assert len(got) == 6 and all(r.round_trip for r in got if r.token_ids is not None)
    assert [r.token_ids for r in got if r.doc_id == 2] == [None] and [r.token_ids for r in got if r.doc_id == 3] == [[]]
    back = sorted(((r.doc_id or 0), r.text or "") for r in bpe.decode(out).collect())
    assert back == sorted((a or 0, b or "") for a, b, _ in rows)
    assert bpe.encode(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, token_ids array<int>")).collect()
