import time

import numpy as np

from echofold.llm import toxicity as T


def slow_segments(scores):
    """Maximal segments by definition: the best segment of the whole, then of what lies left and right of it."""
    best, found = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, found = total, (i, j)
    if found is None:
        return []
    i, j = found
    left, right = slow_segments(scores[:i]), slow_segments(scores[j + 1 :])
    return left + [(i, j, best)] + [(a + j + 1, b + j + 1, s) for a, b, s in right]


def test_maximal_segments():
    random = np.random.default_rng(2)
    for _ in range(200):
        scores = random.normal(-0.3, 1, random.integers(0, 14))
        got = T.maximal_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow_segments(scores)]
        assert np.allclose([s for _, _, s in got], [s for _, _, s in slow_segments(scores)])


def test_segments_in_linear_time():
    """A falling sum of many positive scores: each must look back past all candidates, or along one link."""
    took = []
    for n in (20_000, 160_000):
        scores = np.tile([-2.0, 1.0], n)
        begin = time.perf_counter()
        assert len(T.maximal_segments(scores)) == n
        took.append(time.perf_counter() - begin)
    assert took[1] < 40 * max(took[0], 0.01)


def test_held_out(spark):
    """Fitted on half of the labels, judged on the other."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    found = {r.doc_id for r in T.toxic_passages(docs, model).select("doc_id").collect()}
    held = labels.where("pmod(xxhash64(doc_id), 2) = 1").collect()
    toxic, clean = [r.doc_id for r in held if r.toxic == 1], [r.doc_id for r in held if r.toxic == 0]
    assert sum(i in found for i in toxic) > 0.85 * len(toxic)
    assert sum(i in found for i in clean) < 0.005 * len(clean)
    kept = {r.doc_id for r in T.drop_toxic(docs, model).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - found


def test_hard_rows(spark, hard):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (7, None), (7, 0), (99, 1)], "doc_id long, toxic int")
    model = T.fit(hard, labels)
    assert T.drop_toxic(hard, model).columns == hard.columns
    kept = T.drop_toxic(hard, model).collect()
    assert {3, 4, 5, 6} <= {r.doc_id for r in kept}
    nothing = T.fit(hard, labels.limit(0))
    assert T.toxic_passages(hard, nothing).count() == 0 and T.drop_toxic(hard, nothing).count() == hard.count()
    assert T.drop_toxic(hard.limit(0), nothing).count() == 0


def test_many_weak_passages_together():
    def tail(r, mean):  # P(Poisson >= r)
        return sum(np.exp(k * np.log(mean) - mean - sum(np.log(np.arange(1, k + 1)))) for k in range(r, r + 80))

    for r in (20, 60):
        assert np.isclose(T.poisson_p_value([0.0] * r, 1, 1.0, 1.5), tail(r, 1.5) * 2.0**r, rtol=1e-6)
    assert np.isclose(T.poisson_p_value([2.0], 100, 1.0, 0.01), 2 * -np.expm1(-np.exp(-2.0)))
    assert T.poisson_p_value([], 5, 1.0, 1.0) == 1.0 == T.poisson_p_value([0.1], 50, 1.0, 1.0)
