import numpy as np

from echofold.llm import nn_descent as D


def frame(spark, vectors, ids=None):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(range(len(vectors)) if ids is None else ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def brute(vectors, t):
    m = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    s = m @ m.T
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s >= t, 1)))}


def planted(random, n, d, pairs, cluster):
    base = random.normal(size=(n, d))
    twins = base[:pairs] + 0.15 * random.normal(size=(pairs, d))
    dense = random.normal(size=d) + 0.05 * random.normal(size=(cluster, d))
    return np.concatenate([base, twins, dense]).astype(np.float32)


def classes(n, pairs):
    label, links = list(range(n)), [0] * n
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return [(i, label[i], links[i]) for i in range(n)]


def found(df):
    return sorted((r.id, r.class_id, r.n_links) for r in df.collect())


def test_recall_with_a_saturated_cluster(spark):
    """The cluster has far more members than a list has entries; copies count each."""
    v = planted(np.random.default_rng(5), 1500, 24, 120, 60)
    v = np.concatenate([v, v[1500:1510], v[-5:]])
    true = brute(v, 0.95)
    want, got = classes(len(v), true), found(D.near_classes(frame(spark, v)))
    assert [i for i, _, _ in got] == [i for i, _, _ in want] and len(true) > 1700
    assert all(a[2] <= b[2] for a, b in zip(got, want))
    assert sum(a[2] for a in got) >= 0.95 * sum(b[2] for b in want)
    alone = [(a, b) for a, b in zip(got, want) if b[0] < 1620 and b[2]]
    assert sum(a == b for a, b in alone) >= 0.9 * len(alone) > 100


def test_tiles_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    v = planted(np.random.default_rng(6), 50, 8, 0, 50)
    assert found(D.near_classes(frame(spark, v))) == classes(len(v), brute(v, 0.95))


def test_audit_sees_what_is_lost(spark):
    v = planted(np.random.default_rng(7), 200, 16, 50, 0)
    units = D.unit_vectors(frame(spark, v), "vec_id", "embedding")
    rows = [(i, n) for i, _, n in classes(len(v), brute(v, 0.95))]
    whole = spark.createDataFrame(rows, "doc long, pairs long")
    assert D.audit(units, whole, 0.95) == 1.0
    half = spark.createDataFrame([(i, n if i % 2 else 0) for i, n in rows], "doc long, pairs long")
    assert D.audit(units, half, 0.95) < 0.9


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, None, "x"), (None, [1.0, 0.0], "x"), (4, [0.0, 0.0], "x"), (5, [], "x"), (6, [1.0, None], "x"), (7, [nan, 1.0], "x"), (8, [inf, 1.0], "x"), (9, [1.0, 0.01], "x"), (10, [1.0, 0.0, 0.0], "x"), (11, [3.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, half string")
    df = df.selectExpr("*", "1 as weight", "2 as class_id")
    want = [(1, 1, 3), (2, 1, 3), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 1, 3), (10, 10, 0), (11, 1, 3)]
    assert found(D.near_classes(df)) == want
    assert D.near_classes(df.limit(0)).count() == 0
