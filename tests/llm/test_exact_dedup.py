import os
import random
from collections import defaultdict

from echofold.llm import exact_dedup as X


def brute(rows):
    least, copies = {}, defaultdict(int)
    for i, t in rows:
        if i is not None and t is not None:
            least[t] = min(i, least.get(t, i))
            copies[t] += 1
    return sorted((i, i if t is None else least[t], 1 if t is None else copies[t]) for i, t in rows if i is not None)


def test_trie_is_exact_and_spills(tmp_path):
    random.seed(1)
    keys = [bytes(random.choice(b"ab") for _ in range(random.randrange(12))) * random.randrange(1, 4) for _ in range(3000)]
    want = defaultdict(list)
    for i, k in enumerate(keys):
        want[k].append(i)
    for most in (1 << 30, 40_000):
        trie = X.PatriciaTrie(most, f"file://{tmp_path}")
        for i, k in enumerate(keys):
            trie.insert(k, [i])
        assert bool(trie.spills) == (most < 1 << 30)
        assert sorted((least, sorted(ids)) for least, ids in trie.owners()) == sorted((min(v), v) for v in want.values())
    assert not os.listdir(tmp_path)


def test_heavy_terminals_end(tmp_path):
    """One string longer than the budget, and more ids of one string than it holds."""
    for key, ids in ((b"x" * 5000, [3, 1]), (b"ab", list(range(2000))), (b"", list(range(2000)))):
        trie = X.PatriciaTrie(1000, f"file://{tmp_path}")
        for i in ids:
            trie.insert(key, [i])
            trie.insert(b"abcd%d" % (i % 50), [10_000 + i])
        got = {least: sorted(found) for least, found in trie.owners()}
        assert got[min(ids)] == sorted(ids) and sum(map(len, got.values())) == 2 * len(ids)
    assert not os.listdir(tmp_path)


def test_names_of_its_own(hard):
    docs = hard.withColumnRenamed("times", "__drop_id").withColumnRenamed("tokens", "__again")
    assert X.exact_dedup(docs).columns == docs.columns
    assert X.exact_dedup(docs).count() == X.exact_dedup(hard).count()


def test_hard_rows(hard):
    rows = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    assert sorted(map(tuple, X.exact_owners(hard).collect())) == brute(rows)
    kept = X.exact_dedup(hard).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5, 7, 8, 9]
    assert sum(r.doc_id is None for r in kept) == 2
    assert X.exact_dedup(hard).columns == hard.columns
    assert X.exact_owners(hard.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(map(tuple, X.exact_owners(docs, most=50_000).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])
