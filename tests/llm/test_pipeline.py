import sys
from collections import Counter
from functools import reduce
from pathlib import Path

import corpus_pipeline
from echofold.llm import bpe, mixing, ngram_join, toxicity
from echofold.llm.common import Scratch

sys.path.insert(0, str(Path(__file__).parent))
from test_ngram_join import brute_classes  # noqa: E402


def test_stages_on_hard_rows(spark, hard, tmp_path):
    spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    base = hard.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (base, base.limit(0)):
        scratch = Scratch(spark)
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = scratch.table(stage(spark, docs, str(tmp_path)), "stage")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == before
        docs.count()


def test_run(spark):
    """Each stage by brute force on what the one before kept."""
    sf = "/root/testdata/sf0.001"
    first, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    extra = first.limit(5).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars")
    near = first.where("n_chars > 400").limit(5).selectExpr("doc_id + 2000 as doc_id", "concat(text, ' tail') as text", "lang", "source", "n_chars")
    docs = reduce(lambda a, b: a.unionByName(b), (first, extra, near))
    kept = {r.doc_id: r for r in docs.collect()}
    scratch, at = Scratch(spark), {name: stage for name, stage in corpus_pipeline.STAGES}

    def stage(name):
        nonlocal docs
        docs = scratch.table(at[name](spark, docs, sf), "stage")
        return Counter(r.doc_id for r in docs.collect())

    model = toxicity.fit(docs, labels)
    bad = {r.doc_id for r in toxicity.toxic_passages(docs, model).collect()}
    kept = {i: r for i, r in kept.items() if i not in bad}
    assert bad and stage("toxicity") == Counter(list(kept))
    least = {}
    for i, r in kept.items():
        least[r.text] = min(i, least.get(r.text, i))
    kept = {i: r for i, r in kept.items() if least[r.text] == i}
    assert stage("exact dedup") == Counter(list(kept))
    group = {i: g for i, g, _ in brute_classes([(i, r.text) for i, r in kept.items()], ngram_join.THRESHOLD)}
    assert sum(g != i for i, g in group.items()) >= 5
    kept = {i: r for i, r in kept.items() if group[i] == i}
    assert stage("n-gram Jaccard join") == Counter(list(kept))
    rows, plan = mixing.mix(docs)
    want = Counter({r.doc_id: r[plan.columns[0]] for r in rows.collect()})
    assert stage("mixing sources") == want and want.keys() == kept.keys() and sum(want.values()) > len(want)
    encoded = at["BPE"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in encoded) == want and all(r.round_trip for r in encoded)
    back = bpe.decode(spark.createDataFrame([(r.doc_id, r.token_ids) for r in encoded], "doc_id long, token_ids array<int>")).collect()
    assert all(r.text == kept[r.doc_id].text for r in back)


def test_whole_run(spark):
    docs = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert all(r.round_trip for r in rows) and {r.doc_id for r in rows} <= docs and len({r.doc_id for r in rows}) > 0.7 * len(docs)
