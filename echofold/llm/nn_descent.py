"""Near-duplicate embeddings by NN-descent (operator 4).

A neighbour graph starts from sorted random projections and is refined by joins of neighbours of neighbours:
whoever meets at a common neighbour, and is nearer than one of the two knew, enters its list. Lists hold LIST
neighbours. A list full of neighbours within the threshold is saturated: it may hide more. A link that neither of two
lists shows is between two saturated ones; these are enlarged to all saturated ones that threshold edges between
saturated ones connect to them, compared exactly in tiles. All other links are in the list of one of the two. An audit
compares sampled vectors, and sampled ones with links, with all others; short of the wanted recall, lists are doubled
and refined again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small
from .ngram_join import components

THRESHOLD = 0.95
LIST = 10
#: random projection orders that the graph starts from, bits of each one's code, and links to each side in it
ORDERS, WINDOW = 8, 6
#: refinement ends when a round changes less than this share of the lists' entries
STILL = 0.002
#: half precision is enough to find edges; those this near to the threshold are compared exactly
MARGIN = 0.01
AUDITED, RECALL = 256, 0.95
BLOCK = 2048
SEED = 3

_EDGE = "v long, u long, sim float, fresh boolean"


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Rows of packed vectors."""
    if not len(column):
        return np.zeros((0, 0), np.float32)
    return np.stack([np.frombuffer(x, kind) for x in column.to_pylist()]).astype(np.float32)


def unit_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, full, half): packed unit vectors, in single and half precision; no row for null ids and vectors, those with a null or infinite element and zero ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, full, half = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                v = x.values
                if v is None or v.null_count or not len(v):
                    continue
                v = v.to_numpy().astype(np.float64)
                size = float(np.sqrt(v @ v))
                if not np.isfinite(size) or size == 0:
                    continue
                v = (v / size).astype(np.float32)
                ids.append(i)
                full.append(v.tobytes())
                half.append(v.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(full, pa.binary()), pa.array(half, pa.binary())], ["id", "full", "half"])

    picked = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return picked.where("id is not null and v is not null").mapInArrow(run, "id long, full binary, half binary")


def _projected(orders: int, bits: int, seed: int):
    def run(batches):
        planes = {}
        for b in batches:
            by: dict[int, list[int]] = {}
            for k, x in enumerate(b.column(1).to_pylist()):
                by.setdefault(len(x), []).append(k)
            for size, at in by.items():
                part = b.take(pa.array(at))
                m = _matrix(part.column(1), np.float16)
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, seed, size]).standard_normal((orders, bits + 1, m.shape[1])).astype(np.float32)
                for o in range(orders):
                    p = m @ planes[size][o].T
                    code = ((p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), o, np.int32)), pa.array(code), pa.array(p[:, bits]), part.column(0), part.column(1)], ["o", "code", "at", "id", "half"])

    return run


def _links(window: int):
    """Edges both ways between rows that are near in an order."""

    def run(batches):
        tail = None
        for b in batches:
            o, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            if tail is not None:
                o, ids, x = np.concatenate([tail[0], o]), np.concatenate([tail[1], ids]), tail[2] + x
            done = 0 if tail is None else len(tail[1])
            lens = np.array([len(v) for v in x])
            v, u, sim = [], [], []
            for size in np.unique(lens):
                at = np.flatnonzero(lens == size)
                m = np.stack([np.frombuffer(x[k], np.float16) for k in at]).astype(np.float32)
                for w in range(1, window + 1):
                    a, c = at[:-w], at[w:]
                    ok = (o[a] == o[c]) & (c >= done) & (ids[a] != ids[c])
                    s = np.einsum("ij,ij->i", m[:-w][ok], m[w:][ok])
                    v += [ids[a][ok], ids[c][ok]]
                    u += [ids[c][ok], ids[a][ok]]
                    sim += [s, s]
            tail = o[-window:], ids[-window:], x[-window:]
            if v:
                yield _edges(*(np.concatenate(k) for k in (v, u, sim)))

    return run


def _edges(v, u, sim, fresh=None) -> pa.RecordBatch:
    fresh = np.ones(len(v), bool) if fresh is None else fresh
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(sim.astype(np.float32)), pa.array(fresh)], ["v", "u", "sim", "fresh"])


def _nearest(k: int):
    """The k nearest of each list; an entry that was there before isn't fresh."""

    def run(batches):
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not held:
            return
        v, u, sim, fresh = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((fresh, u, v))
        v, u, sim, fresh = v[order], u[order], sim[order], fresh[order]
        once = np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1])])
        v, u, sim, fresh = v[once], u[once], sim[once], fresh[once]
        order = np.lexsort((u, -sim, v))
        v, u, sim, fresh = v[order], u[order], sim[order], fresh[order]
        near = np.arange(len(v)) - np.searchsorted(v, v) < k
        yield _edges(v[near], u[near], sim[near], fresh[near])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by v: (v, u, fresh, worst, half), who meets at v. Edges between those of whom one is fresh, if new to a list that isn't nearer already."""

    def joined(u, fresh, worst, x):
        m = np.stack([np.frombuffer(k, np.float16) for k in x]).astype(np.float32)
        sim = m @ m.T
        ok = np.triu(fresh[:, None] | fresh[None, :], 1) & (sim > np.minimum(worst[:, None], worst[None, :])) & (u[:, None] != u[None, :])
        a, c = np.nonzero(ok)
        s = sim[a, c]
        one, two = s > worst[a], s > worst[c]
        return np.concatenate([u[a][one], u[c][two]]), np.concatenate([u[c][one], u[a][two]]), np.concatenate([s[one], s[two]])

    def groups(v, u, fresh, worst, x):
        edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
        found = []
        for i, j in zip(edge[:-1], edge[1:]):
            if j - i > 1 and fresh[i:j].any():
                lens = {len(k) for k in x[i:j]}
                for size in lens:
                    at = np.arange(i, j) if len(lens) == 1 else np.array([k for k in range(i, j) if len(x[k]) == size])
                    found.append(joined(u[at], fresh[at], worst[at], [x[k] for k in at]))
        if found:
            yield _edges(*(np.concatenate(k) for k in zip(*found)))

    tail = None
    for b in batches:
        v, u, fresh, worst = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        x = b.column(4).to_pylist()
        if tail is not None:
            v, u, fresh, worst = (np.concatenate(k) for k in zip(tail[:4], (v, u, fresh, worst)))
            x = tail[4] + x
        cut = int(np.searchsorted(v, v[-1])) if len(v) else 0
        yield from groups(v[:cut], u[:cut], fresh[:cut], worst[:cut], x[:cut])
        tail = v[cut:], u[cut:], fresh[cut:], worst[cut:], x[cut:]
    if tail is not None and len(tail[0]):
        yield from groups(*tail)


def refine(vectors: DataFrame, graph: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Rounds of NN-descent until the lists rest. graph: v, u, sim, fresh."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = vectors.count()
    while True:
        worst = graph.groupBy("v").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst")).withColumnRenamed("v", "id")
        known = vectors.select("id", "half").join(worst, "id")
        both = graph.select("v", "u", "fresh").unionByName(graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "fresh"))
        both = both.groupBy("v", "u").agg(F.bool_or("fresh").alias("fresh"))
        met = both.join(known, both["u"] == known["id"]).select("v", "u", "fresh", "worst", "half")
        found = met.repartition(parts, "v").sortWithinPartitions("v").mapInArrow(_meet, _EDGE)
        old = graph.withColumn("fresh", F.lit(False))
        after = scratch.table(old.unionByName(found).repartition(parts, "v").mapInArrow(_nearest(k), _EDGE), "graph")
        scratch.drop(graph)
        graph = after
        if graph.where("fresh").count() <= STILL * n * k:
            return graph


def start(vectors: DataFrame, k: int, orders: int, seed: int, scratch: Scratch) -> DataFrame:
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, int(np.log2(max(2, vectors.count() / 32))))
    rows = vectors.select("id", "half").mapInArrow(_projected(orders, bits, seed), "o int, code long, at float, id long, half binary")
    rows = rows.repartitionByRange(parts, "o", "code", "at", "id").sortWithinPartitions("o", "code", "at", "id").select("o", "id", "half")
    return scratch.table(rows.mapInArrow(_links(WINDOW), _EDGE).repartition(parts, "v").mapInArrow(_nearest(k), _EDGE), "graph")


def _stacked(packed: list[bytes], at: np.ndarray) -> np.ndarray:
    return np.stack([np.frombuffer(packed[i], np.float32) for i in at]).astype(np.float64)


_LINKS = "doc long, links long, pairs long, label long"


def _link_rows(ids, links, pairs, label) -> pa.Table:
    return pa.table({k: pa.array(np.asarray(x, np.int64)) for k, x in (("doc", ids), ("links", links), ("pairs", pairs), ("label", label))})


def _tile(t: float):
    """By vector with links in the tile: rows and vectors that it is near to, and the smallest id that the tile connects it to."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            same_block = key[1].as_py() == key[2].as_py()
            x, y = left["full"].to_pylist(), right["full"].to_pylist()
            one, two = left["id"].to_numpy(), right["id"].to_numpy()
            w, v = left["weight"].to_numpy(), right["weight"].to_numpy()
            for size in {len(k) for k in x}:
                p, q = (np.array([i for i, k in enumerate(z) if len(k) == size], np.int64) for z in (x, y))
                if not len(q):
                    continue
                near = _stacked(x, p) @ _stacked(y, q).T >= t
                if same_block:
                    near &= one[p][:, None] < two[q][None, :]
                a, c = np.nonzero(near)
                ids, at = np.unique(np.concatenate([one[p][a], two[q][c]]), return_inverse=True)
                if not len(ids):
                    continue
                a, c, weights = at[: len(a)], at[len(a) :], np.concatenate([v[q][c], w[p][a]])
                label, before = np.arange(len(ids)), None
                while before is None or (label != before).any():
                    before = label.copy()
                    np.minimum.at(label, a, before[c])
                    np.minimum.at(label, c, before[a])
                out.append(_link_rows(ids, np.bincount(at, weights, len(ids)), np.bincount(at, minlength=len(ids)), ids[label]))
        return pa.concat_tables(out) if out else _link_rows([], [], [], [])

    return run


def _compared(t: float):
    """Of pairs of packed vectors, those of a cosine of t or more."""

    def run(batches):
        for b in batches:
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            ok = np.array([len(p) == len(q) and float(np.frombuffer(p, np.float32).astype(np.float64) @ np.frombuffer(q, np.float32).astype(np.float64)) >= t for p, q in zip(x, y)], bool)
            a, c, w, v = (b.column(i).to_numpy()[ok] for i in range(4))
            for k in (0, 1):
                ids, other, weight = (a, c, v) if k == 0 else (c, a, w)
                yield _link_rows(ids, weight, np.ones(len(ids)), np.minimum(ids, other)).to_batches()[0] if len(ids) else _link_rows([], [], [], []).combine_chunks().to_batches()[0]

    return run


def links(vectors: DataFrame, graph: DataFrame, k: int, t: float, scratch: Scratch) -> DataFrame:
    """Rows of _LINKS, one or more for each vector with links. vectors: id, full, weight."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = graph.where(F.col("sim") >= t - MARGIN)
    full = near.groupBy("v").count().where(F.col("count") >= k).select(F.col("v").alias("s"))
    full = broadcast_if_small(scratch.table(full, "saturated"), 8)
    edges = near.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
    edges = edges.join(full.select(F.col("s").alias("a"), F.lit(1).alias("full_a")), "a", "left").join(full.select(F.col("s").alias("b"), F.lit(1).alias("full_b")), "b", "left")
    edges = scratch.table(edges.select("a", "b", (F.col("full_a").isNotNull() & F.col("full_b").isNotNull()).alias("hiding")), "near")
    x, y = (vectors.select(F.col("id").alias(k), F.col("weight").alias(f"weight_{k}"), F.col("full").alias(f"full_{k}")) for k in "ab")
    listed = edges.where("not hiding").join(x, "a").join(y, "b").select("a", "b", "weight_a", "weight_b", "full_a", "full_b").mapInArrow(_compared(t), _LINKS)
    member = components(edges.where("hiding").select("a", "b"), "a", "b")
    member = member.unionByName(member.select(F.col("group_id").alias("doc_id"), "group_id").distinct())
    sizes = member.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = member.join(sizes, "group_id").select(F.col("doc_id").alias("id"), F.col("group_id").alias("g"), "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    placed = scratch.table(placed.join(vectors.select("id", "full", "weight"), "id"), "members")
    left = placed.select("g", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "id", "full", "weight")
    right = placed.select("g", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), "id", "full", "weight")
    tiles = left.repartition(parts, "g", "i", "j").groupBy("g", "i", "j").cogroup(right.repartition(parts, "g", "i", "j").groupBy("g", "i", "j"))
    return listed.unionByName(tiles.applyInArrow(_tile(t), _LINKS))


def audit(vectors: DataFrame, found: DataFrame, t: float, sampled: int = AUDITED) -> float:
    """Share of the links of sampled vectors, each compared with all vectors, that were found (doc, pairs): of as many vectors at random, and of as many at random that have links."""
    order = lambda k: (F.xxhash64(k, F.lit(SEED)), k)
    some = found.where("pairs > 0").orderBy(*order("doc")).limit(sampled).select(F.col("doc").alias("id"))
    some = some.unionByName(vectors.orderBy(*order("id")).limit(sampled).select("id")).distinct()
    sample = vectors.join(F.broadcast(some), "id").select("id", "full").collect()
    ids, rows = np.array([r[0] for r in sample], np.int64), [bytes(r[1]) for r in sample]
    by: dict[int, list[int]] = {}
    for k, x in enumerate(rows):
        by.setdefault(len(x), []).append(k)
    known = {size: (ids[at], _stacked(rows, at)) for size, at in by.items()}
    handle = vectors.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for b in batches:
            own, x = b.column(0).to_numpy(), b.column(1).to_pylist()
            for size, (q, m) in handle.value.items():
                at = np.array([k for k, v in enumerate(x) if len(v) == size], np.int64)
                if len(at):
                    i, j = np.nonzero(_stacked(x, at) @ m.T >= t)
                    j = j[own[at][i] != q[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.bincount(j, minlength=len(q)))], ["doc", "links"])

    true = vectors.select("id", "full").mapInArrow(run, "doc long, links long").groupBy("doc").agg(F.sum("links").alias("links"))
    got = true.join(found.select("doc", "pairs"), "doc", "left").agg(F.sum("links"), F.sum(F.coalesce("pairs", F.lit(0)))).first()
    return min(1.0, got[1] / got[0]) if got[0] else 1.0


def near_classes(rows: DataFrame, t: float = THRESHOLD, k: int = LIST, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, class_id, n_links): with how many other vectors each one has a cosine of t or more, and the smallest id that these links connect it to. Precision is exact, recall is audited.

    One row for each id, its own class with no links if it is near to none. Vectors of equal direction (to single
    precision) are compared as one and count each. Rows with a null vector, a null or infinite element or a zero vector
    have no links, rows with a null id are left out; vectors of unlike dimension have none with each other. An id names
    a vector: of rows that repeat it one counts (the least vector). Ties in a list go to the smaller id. Other columns
    are ignored; an empty table gives none. The rounds run while the plan is built.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = unit_vectors(rows, id_column, vector_column)
    units = units.groupBy("id").agg(F.min("full").alias("full"), F.min_by("half", "full").alias("half"))
    units = scratch.table(units, "units")
    first = units.groupBy("full").agg(F.min("id").alias("id"), F.first("half").alias("half"), F.count(F.lit(1)).alias("weight"))
    vectors = scratch.table(first.select("id", "full", "half", "weight"), "vectors")
    many = broadcast_if_small(vectors.where("weight > 1").select(F.col("id").alias("rep"), F.col("full").alias("f")), 1024)
    twins = scratch.table(units.select("id", "full").join(many, F.col("full") == F.col("f")).where("id <> rep").select("id", "rep"), "twins")
    graph, seed, count = None, 0, vectors.count()
    while True:
        more = start(vectors, k, ORDERS, seed, scratch)
        if graph is not None:  # what was found counts as fresh again for the longer lists
            more = scratch.table(graph.withColumn("fresh", F.lit(True)).unionByName(more).repartition(parts, "v").mapInArrow(_nearest(k), _EDGE), "graph")
        graph = refine(vectors, more, k, scratch)
        found = scratch.table(links(vectors, graph, k, t, scratch), "links")
        by_doc = scratch.table(found.groupBy("doc").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs")), "by-vector")
        if audit(vectors, by_doc, t) >= RECALL or k >= count:
            break
        k, seed = 2 * k, seed + 1
    group = components(found.select("doc", "label"), "doc", "label").withColumnsRenamed({"doc_id": "rep"})
    own = by_doc.select(F.col("doc").alias("rep"), "links").unionByName(vectors.where("weight > 1").select(F.col("id").alias("rep"), (F.col("weight") - 1).alias("links")))
    own = own.groupBy("rep").agg(F.sum("links").alias("links")).join(group, "rep", "left")
    reps = scratch.table(own.select("rep", F.coalesce("group_id", "rep").alias("class_id"), "links"), "representatives")
    others = twins.join(broadcast_if_small(reps, 32), "rep").select(F.col("id").alias("rep"), "class_id", "links")
    linked = scratch.table(reps.unionByName(others), "linked")
    ids = rows.select(F.col(id_column).cast("long").alias("id")).where("id is not null").distinct()
    joined = ids.join(broadcast_if_small(linked, 32), F.col("id") == F.col("rep"), "left")
    return joined.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


SQL = """
with recursive u as (
  select vec_id, list_transform(v, lambda x: (x / n)::float::double) as v from (
    select vec_id, list_transform(embedding, lambda x: x::double) as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n
    from embeddings where vec_id is not null and embedding is not null) where n > 0 and isfinite(n)
), r as materialized (
  select vec_id, v, min(vec_id) over (partition by v) as rep, count(*) over (partition by v) as copies from u
), pairs as materialized (
  select a.vec_id as x, b.vec_id as y, a.copies as nx, b.copies as ny
  from r a join r b on a.vec_id < b.vec_id and a.vec_id = a.rep and b.vec_id = b.rep and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) >= 0.95
), edges as materialized (
  select x, y, ny as n from pairs union all select y, x, nx from pairs
), reach as (
  select vec_id as id, vec_id as root from r where vec_id = rep
  union select y, root from reach join edges on x = id where root < y
), class as (
  select id, min(root) as root from reach group by id
), links as (
  select x as id, sum(n) as n from edges group by x
)
select d.vec_id, coalesce(class.root, d.vec_id) as class_id, (coalesce(links.n, 0) + coalesce(r.copies - 1, 0))::bigint as n_links
from (select distinct vec_id from embeddings where vec_id is not null) d
left join r using (vec_id) left join class on class.id = r.rep left join links on links.id = r.rep
"""
