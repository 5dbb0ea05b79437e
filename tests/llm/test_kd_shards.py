import numpy as np

from echofold.llm import kd_shards as K


def brute(values, size, target):
    scale = [max(1, v.max() - v.min()) for v in values]
    out, leaves = np.full(values.shape[1], -1), 0

    def split(at):
        nonlocal leaves
        wide = [(v[at].max() - v[at].min()) / s for v, s in zip(values, scale)]
        d = int(np.argmax(wide))
        if size[at].sum() <= target or wide[d] == 0:
            out[at], leaves = leaves, leaves + 1
            return
        v = values[d][at]
        distinct = np.unique(v)
        total = np.cumsum([size[at][v == x].sum() for x in distinct])
        cut = min(distinct[np.searchsorted(total, size[at].sum() // 2)], distinct[-1] - 1)
        split(at[v <= cut])
        split(at[v > cut])

    split(np.arange(values.shape[1]))
    return out


def test_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for cells, local in ((K.CELLS, 0), (64, 0), (64, 300), (K.CELLS, None)):  # few bins: several passes for each median; none, some or all splits within tasks
        monkeypatch.setattr(K, "CELLS", cells)
        rows = K.kd_shards(docs, target=300_000, local_rows=local).toPandas()
        code = lambda c: rows[c].map({x: i for i, x in enumerate(sorted(rows[c].unique()))})
        values = np.stack([code("lang"), code("source"), rows.n_chars, rows.doc_id]).astype(np.int64)
        assert (brute(values, rows.bytes.to_numpy(), 300_000) == rows["shard"]).all()
        assert len(rows) == docs.count() and rows.groupby("shard").bytes.sum().max() <= 300_000


def test_nulls_are_just_below_the_least_value(spark):
    """One null must not widen its dimension: the splits stay those of the brute force with least - 1 in its place."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("if(doc_id = 7, null, n_chars) as n_chars", "if(doc_id % 50 = 3, null, lang) as lang", "source", "doc_id", "text", "1 as __s0", "2 as __r0", "3 as bytes", "4 as d0", "5 as node")
    rows = K.kd_shards(docs, target=300_000, local_rows=200).toPandas()
    code = lambda c: rows[c].map({x: i for i, x in enumerate(sorted(rows[c].dropna().unique()))}).fillna(-1)
    values = np.stack([code("lang"), code("source"), rows.n_chars.fillna(rows.n_chars.min() - 1), rows.doc_id]).astype(np.int64)
    assert (brute(values, rows.bytes.to_numpy(), 300_000) == rows["shard"]).all()


def test_hard_rows(hard):
    rows = K.kd_shards(hard, target=20).collect()
    assert len(rows) == hard.count()
    alike = [r["shard"] for r in rows if r.doc_id == 2]
    assert len(alike) == 2 and len(set(alike)) == 1
    assert {r.bytes for r in rows if r.doc_id in (3, 4)} == {0}
    assert K.kd_shards(hard.limit(0)).count() == 0
    assert {r["shard"] for r in K.kd_shards(hard, target=1 << 40).collect()} == {0}
