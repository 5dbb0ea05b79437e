import numpy as np
import pyarrow as pa
import pytest

from echofold.llm import pitman_yor as P


def slow_tables(c, base, d, random, rounds):
    """Mean tables of one dish by seating customers one at a time at real tables."""
    tables, total = [], 0
    for _ in range(c):
        place(tables, base, d, random)
    for r in range(rounds):
        k = random.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
        place(tables, base, d, random)
        total += len(tables) if r >= rounds // 5 else 0
    return total / (rounds - rounds // 5)


def place(tables, base, d, random):
    weights = np.array([n - d for n in tables] + [base])
    k = random.choice(len(weights), p=weights / weights.sum())
    if k == len(tables):
        tables.append(1)
    else:
        tables[k] += 1


def stationary_tables(c, base, d):
    """Mean tables of one dish in the long run, from the chain's own transition matrix."""
    r, step = P.stirling_ratios(d, c), np.zeros((c + 1, c + 1))
    for t in range(1, c + 1):
        for left, chance in ((t - 1, float(r[c, t])), (t, 1 - float(r[c, t]))):
            again = base / (base + c - 1 - d * left)
            step[t, max(1, min(c, left + 1))] += chance * again
            step[t, max(1, left)] += chance * (1 - again)
    state = np.eye(c + 1)[1]
    for _ in range(3000):
        state = state @ step
    return state @ np.arange(c + 1)


def test_reseating_agrees_with_real_tables():
    random, d, base = np.random.default_rng(1), 0.6, 0.8
    ratios = P.stirling_ratios(d, 60)
    for c in (2, 5, 30, 50):
        many = np.full(4000, c)
        t = P.first_seating(many, np.full(4000, base), np.ones(4000, np.int64), d, random)
        for _ in range(15):
            P.reseat(many, t, np.full(4000, base), ratios, d, random)
        assert t.mean() == pytest.approx(stationary_tables(c, base, d), rel=0.04)
        if c <= 5:
            assert t.mean() == pytest.approx(slow_tables(c, base, d, random, 40_000), rel=0.05)
        assert t.min() >= 1 and t.max() <= c


def test_stirling_ratios():
    d, s = 0.4, {(0, 0): 1.0}
    for c in range(1, 12):
        for t in range(1, c + 1):
            s[c, t] = s.get((c - 1, t - 1), 0) + (c - 1 - t * d) * s.get((c - 1, t), 0)
    r = P.stirling_ratios(d, 20)
    for (c, t), x in s.items():
        if c:
            assert r[c, t] == pytest.approx(s.get((c - 1, t - 1), 0) / x, rel=1e-4)


def test_predictive_sums_to_one():
    random = np.random.default_rng(2)
    c, d = random.integers(1, 50, 1000), 0.7
    t = P.seat_parent(c, (1 + d * 1000) / 1000, d, P.stirling_ratios(d), random)
    p = (c - d * t + (1 + d * t.sum()) / 1000) / (1 + c.sum())
    assert p.sum() == pytest.approx(1) and p.min() > 0 and (t >= 1).all() and (t <= c).all()


def test_parts_survive_packing():
    texts = pa.array(["a b a b a c", "", "b a b", "x"])
    ids = pa.array([5, 6, 7, -3])
    blobs = {}
    for b in P._spread(3, P.Hot(np.zeros(0, np.int64), np.zeros(0, np.int64)))(iter([pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])])):
        blobs.setdefault(b.column(0)[0].as_py(), []).append(b.column(1)[0].as_py())
    seen = []
    for x in blobs.values():
        p = P.Part.parse(P.Part.of(x).dump())
        seen += [(int(p.ids[d]), int(p.u[k]), int(p.w[k])) for k, d in zip(p.dish, p.doc)]
        assert (np.bincount(p.dish) == p.c).all()
    want = []
    u, w, doc = P.tokens(texts)
    for a, b, d in zip(u, w, doc):
        want.append((ids[int(d)].as_py(), int(a), int(b)))
    assert sorted(seen) == sorted(want) and (u[[0, 6, 9]] == 0).all()


def spread(batches, parts, hot):
    return [(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in P._spread(parts, hot)(iter(batches))]


def test_rows_of_the_exchange_grow_with_the_input_not_its_square(monkeypatch):
    """A task of many slices gives each part one row, not one for each slice; smaller gatherings give the same tokens."""
    random = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in random.zipf(1.3, 200) % 500) for _ in range(150)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 50)), pa.array(texts[i : i + 50])], ["doc_id", "text"]) for i in (0, 50, 100)]
    monkeypatch.setattr(P, "SLICE_BYTES", 2000)
    u = np.sort(P.tokens(pa.array(texts))[0])
    common = np.unique(u[np.searchsorted(u, u, "right") - np.searchsorted(u, u) > 1000])
    hot = P.Hot(common, np.full(len(common), 7))
    assert len(common)
    whole = spread(batches, 40, hot)
    assert len(whole) == len({k for k, _ in whole}) <= 40
    monkeypatch.setattr(P, "LEAST_TOKENS", 1000)
    monkeypatch.setattr(P, "ROW_TOKENS", 20)
    pieces = spread(batches, 40, hot)
    assert len(pieces) > 2 * len(whole)
    for k in {k for k, _ in whole}:
        a, b = (P.Part.of([x for part, x in rows if part == k]) for rows in (whole, pieces))
        for x in ("u", "w", "c", "dish", "doc", "ids"):
            assert (getattr(a, x) == getattr(b, x)).all()


def test_wide_columns_sort_and_survive_packing():
    random = np.random.default_rng(6)
    for most in ((3, 5, 7), (1 << 30, 1 << 20, 1 << 30), (10, 1 << 40, 9)):
        columns = [random.integers(0, n, 2000) for n in most]
        order = np.lexsort(columns[::-1])
        assert all((a == b[order]).all() for a, b in zip(P._sorted(*columns), columns))
    for x in (random.integers(-(1 << 63), (1 << 63) - 1, 2000), random.integers(0, 50, 2000), np.zeros(0, np.int64)):
        found, rank = P._ranks(x)
        assert (found == np.unique(x)).all() and (found[rank] == x).all()
        assert (P._unpack(P._pack((x, "<i8")), "<i8")[0] == x).all()


def test_a_sweep_takes_dishes_in_any_order():
    random, d, ratios = np.random.default_rng(7), 0.5, P.stirling_ratios(0.5, 60)
    c = random.permutation(np.repeat([1, 2, 9, 31, 32, 55], 4000))
    base = np.where(c % 2, 0.8, 0.3)
    t = P.first_seating(c, base, np.ones(len(c), np.int64), d, random)
    for _ in range(15):
        P.reseat(c, t, base, ratios, d, random)
    for n in (2, 9, 31, 32, 55):
        assert t[c == n].mean() == pytest.approx(stationary_tables(n, 0.8 if n % 2 else 0.3, d), rel=0.04)
    assert (t[c == 1] == 1).all()


def brute(rows, passes, burn_in, samples):
    """The same model held whole, with its own sums and probabilities: one part, every context and word in one array."""
    rows = [(i, t) for i, t in rows if t is not None]
    u, w, doc = P.tokens(pa.array([t for _, t in rows]))
    (us, u), (ws, w) = np.unique(u, return_inverse=True), np.unique(w, return_inverse=True)
    key, dish, c = np.unique(u * len(ws) + w, return_inverse=True, return_counts=True)
    du, dw, random = key // len(ws), key % len(ws), np.random.default_rng(9)
    d, theta = float(np.clip((c == 1).sum() / max(1, (c == 1).sum() + 2 * (c == 2).sum()), 0.1, 0.95)), P.CONCENTRATION
    ratios, n = P.stirling_ratios(d), np.bincount(du, c)
    t, tables, many = np.ones(len(c), np.int64), float(len(ws)), c > 1

    def sweep():
        some = t[many]
        P.reseat(c[many], some, ((theta + d * np.bincount(du, t)[du]) * p0)[many], ratios, d, random)
        t[many] = some

    for k in range(passes):
        wanted = np.bincount(dw, t).astype(np.int64)
        mean = P.seat_parent(wanted, (theta + d * tables) / len(ws), d, ratios, random, burn_in)
        tables = mean.sum()
        p0 = ((wanted - d * mean + (theta + d * tables) / len(ws)) / (theta + wanted.sum()))[dw]
        t = P.first_seating(c, (theta + d * np.bincount(du)[du]) * p0, np.ones(len(c), np.int64), d, random)
        for _ in range(burn_in + 1 if k + 1 < passes else burn_in):
            sweep()
    out = np.zeros(len(c))
    for _ in range(samples):
        sweep()
        gone = np.where(c == 1, 1.0, [min(1.0, d * y / x) if x > P.STIRLING and y > 1 else 0.0 if x > P.STIRLING else ratios[x, y] for x, y in zip(c, t)])
        out += (np.maximum(c - 1 - d * (t - gone), 0) + (theta + d * (np.bincount(du, t)[du] - gone)) * p0) / (theta + n[du] - 1) / samples
    return {rows[k][0]: x for k, x in enumerate(np.bincount(doc, np.log(out)[dish], len(rows)))}


def test_scores_agree_with_one_whole_model(spark, monkeypatch):
    """Parts of a few documents, the frequent contexts spread over several."""
    monkeypatch.setattr(P, "PART_BYTES", 40_000)
    monkeypatch.setattr(P, "PART_TOKENS", 1000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert P.hot_contexts(docs, 1000).spread.max() > 1
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 2, 6, 6)
    got = {r.doc_id: r for r in P.lm_scores(docs, 2, 6, 6).collect()}
    assert got.keys() == want.keys()
    a, b = np.array([got[i].log_prob for i in want]), np.array([want[i] for i in want])
    assert np.corrcoef(a, b)[0, 1] > 0.999 and abs(a.sum() / b.sum() - 1) < 0.01


def test_an_order_of_words_that_no_text_has_is_less_likely(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = docs.orderBy("doc_id").first().text.split()
    more = [(10**6 + k, " ".join(x)) for k, x in enumerate((words, np.random.default_rng(3).permutation(words).tolist()))]
    got = {r.doc_id: r.perplexity for r in P.lm_scores(docs.unionByName(spark.createDataFrame(more, docs.schema))).collect()}
    assert got[10**6 + 1] > 2 * got[10**6]


def test_hard_rows(hard):
    got = {r.doc_id: r for r in P.lm_scores(hard).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}
    for i in (3, 4, 5, 6):
        assert (got[i].n_tokens, got[i].log_prob, got[i].perplexity) == (0, 0.0, None)
    assert got[2].n_tokens == 14 and got[None].n_tokens == 7 and got[7].n_tokens == 120_000
    assert got[7].perplexity < 1.1 < got[9].perplexity
    assert P.lm_scores(hard.limit(0)).count() == 0
