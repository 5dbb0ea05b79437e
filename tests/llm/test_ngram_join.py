import re

from echofold.llm import ngram_join as J


def sets(rows, n=4):
    out = {}
    for i, t in rows:
        words = [x for x in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if x]
        if i is not None and words:
            out[i] = {tuple(words)} if len(words) < n else {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    return out


def brute(rows, t):
    s = sets(rows)
    rep = {}
    for i in sorted(s):
        rep.setdefault(frozenset(s[i]), i)
    out = [(rep[frozenset(x)], i, 1.0) for i, x in s.items() if rep[frozenset(x)] != i]
    ids = sorted(rep.values())
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(s[a] & s[b])
            if both >= t * (len(s[a]) + len(s[b]) - both):
                out.append((a, b, both / (len(s[a]) + len(s[b]) - both)))
    return sorted((a, b, round(j, 9)) for a, b, j in out)


def brute_classes(rows, t):
    """(doc_id, class_id, n_links) by all pairs of documents."""
    s = sets(rows)
    ids = sorted({i for i, _ in rows if i is not None})
    label, links = {i: i for i in ids}, dict.fromkeys(ids, 0)
    full = sorted((len(s[i]), i) for i in s)
    near = []
    for k, (n, a) in enumerate(full):
        for m, b in full[k + 1 :]:
            if n < t * m:
                break
            both = len(s[a] & s[b])
            if both >= t * (n + m - both):
                near.append((a, b))
    for a, b in near:
        links[a] += 1
        links[b] += 1
    moved = True
    while moved:
        moved = False
        for a, b in near:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return sorted((i, label[i], links[i]) for i in ids)


def pairs(df):
    return sorted((r.doc_a, r.doc_b, round(r.jaccard, 9)) for r in df.collect())


def test_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, J.THRESHOLD)
    assert len(want) > 50 and pairs(J.similar_pairs(docs)) == want
    monkeypatch.setattr(J, "VERIFY_COST", 0.0)  # other prefixes, same pairs
    monkeypatch.setattr(J, "HELD_PAIRS", 10)
    monkeypatch.setattr(J, "FLUSH_GRAMS", 1000)
    assert pairs(J.similar_pairs(docs, bits=8)) == want
    assert pairs(J.similar_pairs(docs, t=0.8)) == brute(rows, 0.8)


def test_classes(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id < 400")
    docs = docs.unionByName(docs.where("doc_id < 40").selectExpr("doc_id + 100000 as doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_classes(rows, J.THRESHOLD)
    assert sum(n > 1 for _, _, n in want) > 10
    assert sorted(map(tuple, J.near_classes(docs).collect())) == want
    monkeypatch.setattr(J, "BLOCK_CANDIDATES", 5)  # clusters are cut into tiles
    monkeypatch.setattr(J, "BUCKET_GRAMS", 10_000)
    assert sorted(map(tuple, J.near_classes(docs).collect())) == want


def test_shuffled_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J, "broadcast_if_small", lambda df, n: df)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert pairs(J.similar_pairs(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], J.THRESHOLD)


def test_hard_rows(hard):
    got = pairs(J.similar_pairs(hard, t=0.5))
    assert got == brute([(r.doc_id, r.text) for r in hard.collect()], 0.5) == [(1, 2, 1.0), (1, 8, 0.6)]
    kept = [r.doc_id for r in J.drop_near_copies(hard, t=0.5).select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 4, 5, 6, 7, 9] and kept.count(None) == 2
    assert sorted(map(tuple, J.near_classes(hard, t=0.5).collect())) == brute_classes([(r.doc_id, r.text) for r in hard.collect()], 0.5)
    assert J.similar_pairs(hard.limit(0)).count() == 0 == J.near_classes(hard.limit(0)).count() and J.drop_near_copies(hard.limit(0)).count() == 0


def test_components(spark):
    pairs_ = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)], "doc_a long, doc_b long")
    assert sorted(map(tuple, J.components(pairs_).collect())) == [(2, 1), (3, 1), (6, 5), (9, 1)]
