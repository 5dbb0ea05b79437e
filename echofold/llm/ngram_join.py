"""Jaccard self-join of word n-gram sets with adaptive multi-match prefixes (operator 7).

Grams have one global order: rare first, by a sketch of how many documents hold them. Two sets of Jaccard t
share o = ceil(t / (1 + t) (|x| + |y|)) grams, so with prefixes that leave r_x and r_y grams out they share at
least o - max(r_x, r_y) prefix grams. A document whose prefix grams are expected to meet many others takes a
longer prefix, and its pairs then need as many more matches before their full sets are compared. Near copies would
match in every bucket of grams: a pair that has the same leading gram meets at that one alone, and is verified
whatever its other matches. Results don't depend on the sketch; they are exact but for equal hashes of different
grams (48 bits in the sets, 32 in leaders: a pair is missed or miscounted with probability about 2^-31). Documents of
equal sets are joined as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, broadcast_if_small, documents, drop_ids, grams, mix, per_doc_sets, text_slices

N = 4
THRESHOLD = 0.45
SKETCH_BITS = 22
CHUNKS = 32
#: matches asked beyond the plain prefix, as shares of the set; each costs as many more prefix grams
EXTRA = (0.0, 0.03, 0.08, 0.15)
VERIFY_COST = 40.0
FLUSH_GRAMS = 1_500_000
#: pairs formed at once, and held before they are summed
BLOCK_PAIRS, HELD_PAIRS = 500_000, 3_000_000
SIZE_STEP = 1.1
#: prefix grams of a bucket, and candidate pairs that one task compares: the numbers of both follow the input
BUCKET_GRAMS, BLOCK_CANDIDATES = 2_000_000, 200_000
#: of each gram's 64 bits, those that full sets are compared by
SET_BYTES = 6


def _gram_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, grams, text of each gram) by slice; grams are distinct in their text and sorted."""
    for b in batches:
        ids, texts = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
        for i, j in text_slices(texts):
            yield ids[i:j], *per_doc_sets(*grams(Words(texts.slice(i, j - i)), n))


def _survey(n: int, bits: int):
    """Signatures of the gram sets, and a sketch of document counts by gram bucket."""

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for ids, g, doc in _gram_sets(batches, n):
            counts += np.bincount((g >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            size = np.bincount(doc, minlength=len(ids))
            first = np.searchsorted(doc, np.arange(len(ids)))
            has = np.flatnonzero(size)
            one, two = (np.add.reduceat(mix(g ^ np.uint64(s)), first[has]) if len(has) else np.zeros(0, np.uint64) for s in (0x51, 0xA7))
            yield _survey_batch(ids[has], size[has], one, two)
        for k, part in enumerate(np.split(counts, CHUNKS)):
            if part.any():
                yield _survey_batch([k], [-1], np.zeros(1, np.uint64), np.zeros(1, np.uint64), zlib.compress(part.tobytes(), 1))

    return run


_SURVEY = "doc_id long, size long, one long, two long, part binary"


def _survey_batch(ids, size, one, two, part=None):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([part] * len(ids), pa.binary())], ["doc_id", "size", "one", "two", "part"])


def _add_parts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(part), np.uint32)
            total[k] = total[k] + x if k in total else x.astype(np.uint64)
    for k, x in total.items():
        level = np.minimum(255, np.rint(8 * np.log2(1 + x.astype(np.float64)))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(level.tobytes(), 1)])], ["k", "level"])


def prefix_length(size: int, counts: np.ndarray, t: float, usual: float) -> int:
    """How many of the ordered grams (with their estimated document counts) to index: the cheapest of the EXTRA matches."""
    base = size - int(np.ceil(t * size)) + 1
    meets = np.cumsum(np.maximum(0.0, counts - 1 - 2 * usual))
    best, cost = base, np.inf
    for share in EXTRA:
        extra = int(share * size)
        p = min(size, base + extra)
        c = p + VERIFY_COST * meets[p - 1] / (1 + extra) ** 2 + meets[p - 1]
        if c < cost:
            best, cost = p, c
    return best


_FACTS = np.dtype([("id", "<i8"), ("one", "<u4"), ("two", "<u4"), ("step", "u1")])


def leaders(g: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two grams of each prefix (their upper halves), the least in two random orders; near copies mostly have the same."""
    low = g >> np.uint64(32)
    keys = (mix(low ^ np.uint64(seed)) & np.uint64(0xFFFFFFFF00000000) | low for seed in (0x1D5, 0x7E3))
    return [(np.minimum.reduceat(k, first) & np.uint64(0xFFFFFFFF)).astype(np.uint32) if len(first) else np.zeros(0, np.uint32) for k in keys]


def _prefixes(n: int, t: float, bits: int, buckets: int, levels, usual: float):
    """Packed prefix grams by bucket, and (doc_id, size, rest) of each document (bucket -1)."""

    def flush(held):
        """Blobs of a bucket's prefix grams by document: counts, size steps, leaders and ids, then the grams."""
        if not held:
            return
        g, doc, facts = [], [], []
        for x, d, f in held:
            g.append(x), doc.append(d + sum(map(len, facts))), facts.append(f)
        g, doc, facts = np.concatenate(g), np.concatenate(doc), np.concatenate(facts)
        bucket = (g % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")  # documents stay together
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in range(buckets):
            o = order[edges[k] : edges[k + 1]]
            if len(o):
                own, size = np.unique(doc[o], return_counts=True)
                f = facts[own]
                ids = np.ascontiguousarray(f["id"]).view(np.uint8).reshape(-1, 8).T.tobytes()
                packed = np.array([len(own)], "<u4").tobytes() + size.astype("<u4").tobytes() + f["one"].tobytes() + f["two"].tobytes() + f["step"].tobytes() + ids + (g[o] >> np.uint64(32)).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary()), *[pa.array([None], pa.int64())] * 3], ["bucket", "packed", "doc_id", "size", "rest"])

    def run(batches):
        table, held, count = levels.value, [], 0
        table = np.frombuffer(zlib.decompress(table), np.uint8)
        for ids, g, doc in _gram_sets(batches, n):
            if not len(g):
                continue
            level = table[(g >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((g, level, doc))
            g, level = g[order], level[order]
            size = np.bincount(doc, minlength=len(ids))
            first = np.concatenate([[0], np.cumsum(size)])
            counts = np.exp2(level / 8.0) - 1
            p = np.array([prefix_length(int(size[d]), counts[first[d] : first[d + 1]], t, usual) if size[d] else 0 for d in range(len(ids))])
            within = np.arange(len(g)) - first[doc] < p[doc]
            steps = np.floor(np.log(np.maximum(size, 1)) / np.log(SIZE_STEP)).astype(np.uint8)
            has = size > 0
            facts = np.zeros(len(ids), _FACTS)
            facts["id"], facts["step"] = ids, steps
            facts["one"][has], facts["two"][has] = leaders(g[within], np.concatenate([[0], np.cumsum(p[has])[:-1]]))
            held.append((g[within], doc[within], facts))
            count += int(within.sum())
            m = int(has.sum())
            yield pa.RecordBatch.from_arrays([pa.array([-1] * m, pa.int32()), pa.array([None] * m, pa.binary()), pa.array(ids[has]), pa.array(size[has].astype(np.int64)), pa.array((size - p)[has].astype(np.int64))], ["bucket", "packed", "doc_id", "size", "rest"])
            if count > FLUSH_GRAMS:
                yield from flush(held)
                held, count = [], 0
        yield from flush(held)

    return run


def _pairs_of_runs(g, ids, steps, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal grams with sizes that can be near enough; input sorted by gram, then size step."""
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    length = np.diff(edge)
    for m in np.unique(length):
        if m < 2:
            continue
        at = edge[:-1][length == m]
        if m <= 64:
            i, j = np.triu_indices(m, 1)
            block = max(1, BLOCK_PAIRS // len(i))
            for k in range(0, len(at), block):
                a, b = (at[k : k + block, None] + i).ravel(), (at[k : k + block, None] + j).ravel()
                ok = (steps[b].astype(np.int16) - steps[a] <= far) & (ids[a] != ids[b])
                yield a[ok], b[ok]
        else:
            for start in at:
                s = steps[start : start + m].astype(np.int16)
                ends = np.searchsorted(s, s + far, "right")
                todo = ends - np.arange(m) - 1
                begin = 0
                while begin < m:
                    stop = begin + max(1, int(np.searchsorted(np.cumsum(todo[begin:]), BLOCK_PAIRS)))
                    a = np.repeat(np.arange(begin, min(stop, m)), todo[begin:stop])
                    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(todo[begin:stop]) - todo[begin:stop], todo[begin:stop])
                    ok = ids[start + a] != ids[start + b]
                    yield start + a[ok], start + b[ok]
                    begin = stop


#: matches that stand for any number
SURE = 1 << 24


def _match(t: float, parts_out: int):
    far = int(np.ceil(np.log(1 / t) / np.log(SIZE_STEP))) + 1

    def joined(blobs):
        g, facts = [], []
        for x in blobs:
            k = int(np.frombuffer(x, "<u4", 1)[0])
            size = np.frombuffer(x, "<u4", k, 4)
            f = np.zeros(k, _FACTS)
            f["one"], f["two"], f["step"] = np.frombuffer(x, "<u4", k, 4 + 4 * k), np.frombuffer(x, "<u4", k, 4 + 8 * k), np.frombuffer(x, np.uint8, k, 4 + 12 * k)
            f["id"] = np.frombuffer(x, np.uint8, 8 * k, 4 + 13 * k).reshape(8, k).T.copy().view("<i8").ravel()
            g.append(np.frombuffer(x, "<u4", int(size.sum()), 4 + 21 * k))
            facts.append(np.repeat(f, size))
        g, facts = np.concatenate(g), np.concatenate(facts)
        order = np.lexsort((facts["step"], g))
        g, facts = g[order], facts[order]
        steps, ids, one, two = (np.ascontiguousarray(facts[k]) for k in ("step", "id", "one", "two"))
        del facts
        name, local = np.unique(ids, return_inverse=True)
        width, parts, held = np.int64(len(name)), [], 0
        for a, b in _pairs_of_runs(g, ids, steps, far):
            # a pair with a leader in common is a candidate, and is sent from there and nowhere else
            same_one, same_two = one[a] == one[b], two[a] == two[b]
            sure = same_one & (g[a] == one[a]) | ~same_one & same_two & (g[a] == two[a])
            sent = sure | ~(same_one | same_two)
            x, y, sure = local[a[sent]], local[b[sent]], sure[sent]
            parts.append((np.minimum(x, y) * width + np.maximum(x, y), np.where(sure, SURE, 1)))
            held += len(x)
            if held > HELD_PAIRS:
                yield from _packed_pairs(name, width, parts, parts_out)
                parts, held = [], 0
        if held:
            yield from _packed_pairs(name, width, parts, parts_out)

    def run(batches):
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(k, []).append(x)
        for k in sorted(by):
            yield from joined(by.pop(k))

    return run


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of the differences of consecutive values: neighbours are near, so that the planes compress."""
    return np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes, m: int, at: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8, 8 * m, at).reshape(8, m).T.copy().view("<i8").ravel())


def _packed_pairs(name: np.ndarray, width: np.int64, parts: list[tuple[np.ndarray, np.ndarray]], out: int) -> Iterator[pa.RecordBatch]:
    """Pairs with their matches so far, packed by the part that sums up those of the pair's first document."""
    key, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    count = np.minimum(np.bincount(inverse, np.concatenate([c for _, c in parts]), len(key)).astype(np.int64), 2 * SURE)
    a, b = name[key // width], name[key % width]
    part = (mix(a.astype(np.uint64)) % np.uint64(out)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(out + 1))
    for k in np.flatnonzero(np.diff(edge)):
        o = order[edge[k] : edge[k + 1]]
        packed = _planes(a[o]) + _planes(b[o]) + count[o].astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["part", "packed"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, c) of the pairs of each part."""

    def add(held):
        a, b, c = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[first], b[first], np.add.reduceat(c, first)

    by: dict[int, list] = {}
    size: dict[int, int] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            m = len(x) // 20
            by.setdefault(k, []).append((_unplaned(x, m, 0), _unplaned(x, m, 8 * m), np.frombuffer(x, "<u4", m, 16 * m).astype(np.int64)))
            size[k] = size.get(k, 0) + m
            if size[k] > HELD_PAIRS and size[k] > 2 * len(by[k][0][0]):
                by[k] = [add(by[k])]
                size[k] = len(by[k][0][0])
    for k in sorted(by):
        a, b, c = add(by.pop(k))
        for i in range(0, len(a), 1_000_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 1_000_000]) for x in (a, b, c)], ["a", "b", "c"])


def _sets(n: int):
    """For each block that wants a document, the leading SET_BYTES of its sorted grams as byte planes: the first ones hardly change along a set."""

    def of(batch):
        blocks, weight = batch.column(2), batch.column(3)
        for ids, g, doc in _gram_sets([batch], n):
            first = np.searchsorted(doc, np.arange(len(ids) + 1))
            planes = g.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
            packed = pa.array([np.ascontiguousarray(planes[first[i] : first[i + 1]].T).tobytes() for i in range(len(ids))], pa.binary())
            here, own = blocks.slice(0, len(ids)), weight.slice(0, len(ids))
            blocks, weight = blocks.slice(len(ids)), weight.slice(len(ids))
            row = pc.list_parent_indices(here)
            yield pa.RecordBatch.from_arrays([here.flatten(), pa.array(ids).take(row), own.take(row), packed.take(row)], ["at", "doc_id", "weight", "grams"])

    def run(batches):
        for b in batches:
            yield from of(b)

    return run


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(packed, np.uint8).reshape(SET_BYTES, -1).T
    return out.view(">u8").ravel().astype(np.uint64)


def _verify(t: float, out):
    """Compares the candidates of a block; out(pairs, shared grams, sizes of the unions, weights by document) makes the result."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["doc_id"].to_pylist()
        sets = {i: _unpacked(x) for i, x in zip(ids, right["grams"].to_pylist())}
        pairs, both, either = [], [], []
        for x, y in zip(left["a"].to_pylist(), left["b"].to_pylist()):
            one, two = sets[x], sets[y]
            if len(one) > len(two):
                one, two = two, one
            at = np.minimum(np.searchsorted(two, one), len(two) - 1)
            k = int((two[at] == one).sum())
            if k >= t * (len(one) + len(two) - k):
                pairs.append((x, y)), both.append(k), either.append(len(one) + len(two) - k)
        return out(pairs, both, either, dict(zip(ids, right["weight"].to_pylist())))

    return run


_PAIRS = "doc_a long, doc_b long, shared long, jaccard double"


def _pair_rows(pairs, both, either, weights) -> pa.Table:
    shared, union = np.array(both, np.int64), np.array(either, np.int64)
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pa.table({"doc_a": pa.array(a), "doc_b": pa.array(b), "shared": pa.array(shared), "jaccard": pa.array(shared / np.maximum(union, 1))})


_LINKS = "doc long, links long, label long"


def _link_rows(pairs, both, either, weights) -> pa.Table:
    """By document of the block: how many documents its pairs reach, and the smallest id that the block connects it to."""
    links: dict[int, int] = {}
    above: dict[int, int] = {}

    def top(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for x, y in pairs:
        links[x], links[y] = links.get(x, 0) + weights[y], links.get(y, 0) + weights[x]
        p, q = top(above.setdefault(x, x)), top(above.setdefault(y, y))
        above[max(p, q)] = min(p, q)
    docs = list(links)
    return pa.table({"doc": pa.array(docs, pa.int64()), "links": pa.array([links[x] for x in docs], pa.int64()), "label": pa.array([top(x) for x in docs], pa.int64())})


def _found(docs: DataFrame, n: int, t: float, bits: int, out, schema: str) -> tuple[DataFrame, DataFrame]:
    """(doc_a, doc_b, shared) of each doc_b whose set is that of the smaller doc_a, and what out makes of the verified pairs of other documents, by block."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    survey = scratch.table(texts.mapInArrow(_survey(n, bits), _SURVEY), "survey")
    rows = survey.where("size >= 0").select("doc_id", "one", "two", "size")
    first = rows.groupBy("one", "two", "size").agg(F.min("doc_id").alias("doc_a"), F.max("doc_id").alias("last")).where("doc_a <> last").drop("last")
    first = broadcast_if_small(scratch.table(first, "repeated-sets"), 40)
    same = rows.join(first, ["one", "two", "size"]).where("doc_id <> doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.col("size").alias("shared")).distinct()
    same = scratch.table(same, "equal-sets")
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_GRAMS))
    parts = survey.where("size < 0").select("doc_id", "part").repartition("doc_id").mapInArrow(_add_parts, "k long, level binary").collect()  # CHUNKS rows
    scratch.drop(survey)
    levels = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.uint8)
    for r in parts:
        levels[r.k] = np.frombuffer(zlib.decompress(r.level), np.uint8)
    usual = float(2 ** (np.median(levels) / 8.0) - 1)
    handle = spark.sparkContext.broadcast(zlib.compress(levels.tobytes(), 1))
    single = drop_ids(texts, same.select("doc_b"))
    index = scratch.table(single.mapInArrow(_prefixes(n, t, bits, buckets, handle, usual), "bucket int, packed binary, doc_id long, size long, rest long"), "prefixes")
    counts = index.where("bucket >= 0").select("bucket", "packed").repartition(buckets, "bucket").mapInArrow(_match(t, buckets), "part int, packed binary")
    counts = counts.repartition(buckets, "part").mapInArrow(_summed, "a long, b long, c long")
    facts = index.where("bucket < 0").groupBy("doc_id").agg(F.max("size").alias("size"), F.max("rest").alias("rest"))
    facts = broadcast_if_small(facts, 32)
    x, y = (facts.select(F.col("doc_id").alias(k), F.col("size").alias(f"size_{k}"), F.col("rest").alias(f"rest_{k}")) for k in "ab")
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("size_a") + F.col("size_b")) - 1e-6) - F.greatest("rest_a", "rest_b")
    near = F.least("size_a", "size_b") >= F.lit(t) * F.greatest("size_a", "size_b") - 1e-6
    candidates = scratch.table(counts.join(x, "a").join(y, "b").where(near & (F.col("c") >= need)).select("a", "b"), "candidates")
    scratch.drop(index)
    placed = scratch.table(_placed(candidates, scratch, buckets), "placed")
    wanted = placed.select(F.col("block").alias("at"), F.col("a").alias("doc_id")).unionByName(placed.select(F.col("block").alias("at"), F.col("b").alias("doc_id"))).distinct()
    lists = scratch.table(wanted.groupBy("doc_id").agg(F.collect_list("at").alias("blocks")), "wanted")
    many = same.groupBy("doc_a").agg((F.count(F.lit(1)) + 1).alias("weight"))
    lists = lists.join(broadcast_if_small(many, 16), F.col("doc_id") == F.col("doc_a"), "left")
    lists = scratch.table(lists.select(F.col("doc_id").alias("want"), "blocks", F.coalesce("weight", F.lit(1)).cast("long").alias("weight")), "weighted")
    members = single.join(broadcast_if_small(lists, 48), F.col("doc_id") == F.col("want")).select("doc_id", "text", "blocks", "weight")
    shipped = members.mapInArrow(_sets(n), "at long, doc_id long, weight long, grams binary")
    return same, placed.groupBy("block").cogroup(shipped.groupBy("at")).applyInArrow(_verify(t, out), schema)


def _placed(candidates: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(block, a, b): pairs near to one another in one block, so that a set goes to few; the pairs of a large cluster are
    cut into tiles by both of their documents, so that no block gets more than about BLOCK_CANDIDATES."""
    ends = candidates.select(F.col("a").alias("doc"), F.col("b").alias("other")).unionByName(candidates.select(F.col("b").alias("doc"), F.col("a").alias("other")))
    label = ends.groupBy("doc").agg(F.least(F.min("other"), F.first("doc")).alias("label"))
    labelled = scratch.table(candidates.join(label, candidates["a"] == label["doc"]).select("label", "a", "b"), "labelled")
    blocks = max(4 * least, -(-labelled.count() // BLOCK_CANDIDATES))
    tiles = labelled.groupBy("label").count().where(F.col("count") > BLOCK_CANDIDATES)
    tiles = tiles.select(F.col("label").alias("large"), F.ceil(F.sqrt(F.col("count") / BLOCK_CANDIDATES)).cast("int").alias("tiles"))
    cut = labelled.join(broadcast_if_small(tiles, 16), F.col("label") == F.col("large"), "left")
    tile = lambda k: F.when(F.col("tiles").isNotNull(), F.pmod(F.xxhash64(k), F.col("tiles")))
    return cut.select(F.pmod(F.xxhash64("label", tile("a"), tile("b")), F.lit(blocks)).alias("block"), "a", "b")


def similar_pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_a, doc_b, shared, jaccard) of all pairs doc_a < doc_b whose sets of word n-grams have Jaccard t or more.

    Of documents with equal sets the smallest doc_id stands for all in the pairs, and each other one has a pair
    with it (jaccard 1), so that many copies give as many rows, not their square. A text of fewer words than n
    has one gram of all its words; null and wordless texts and rows without a doc_id match nothing. doc_id names
    a document: rows that repeat it count once. Other columns are ignored; an empty table gives none. A task holds a
    few dozen bytes for each byte of a text. Jobs run while the plan is built.
    """
    same, found = _found(docs, n, t, bits, _pair_rows, _PAIRS)
    return found.unionByName(same.select("doc_a", "doc_b", "shared", F.lit(1.0).alias("jaccard")))


def near_classes(docs: DataFrame, n: int = N, t: float = THRESHOLD, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, class_id, n_links): with how many other documents each one has Jaccard t or more, and the smallest doc_id that these links connect it to.

    One row for each doc_id, its own class with no links if it is near to none; rows that repeat a doc_id are one
    document. What has links is as in similar_pairs(), but copies count each: pairs are verified and counted between
    documents of different sets, and never written out, so that a cluster gives as many rows as it has documents.
    """
    scratch = Scratch(docs.sparkSession)
    same, found = _found(docs, n, t, bits, _link_rows, _LINKS)
    found = scratch.table(found, "links")
    group = components(found.select("doc", "label"), "doc", "label").withColumnsRenamed({"doc_id": "rep"})
    copies = same.groupBy(F.col("doc_a").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
    links = found.select(F.col("doc").alias("rep"), "links").unionByName(copies).groupBy("rep").agg(F.sum("links").alias("links"))
    reps = scratch.table(links.join(group, "rep", "left").select("rep", F.coalesce("group_id", "rep").alias("class_id"), "links"), "representatives")
    others = same.join(broadcast_if_small(reps, 32), F.col("doc_a") == F.col("rep")).select(F.col("doc_b").alias("rep"), "class_id", "links")
    linked = scratch.table(reps.unionByName(others), "linked")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    joined = ids.join(broadcast_if_small(linked, 32), F.col("doc_id") == F.col("rep"), "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(doc_id, group_id): the smallest id that each id is connected to; no row for that id itself. Alternating large-star and small-star steps, each written to the shared folder.

    Null ids, pairs of an id with itself and repeated pairs say nothing; an empty table gives none; other columns are ignored.
    """
    scratch = Scratch(pairs.sparkSession)
    edges = scratch.table(pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.table(hooked, "edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = after
        if state == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id"))
        before = state


def drop_near_copies(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of connected similar pairs, the one with the smallest doc_id (rows that repeat it stay).

    Null, wordless and id-less rows stay, and so does every document that is similar to none. An empty table stays
    empty, columns stay as they are whatever their names. Jobs run while the plan is built.
    """
    return drop_ids(docs, Scratch(docs.sparkSession).table(near_classes(docs, n, t).where("doc_id <> class_id").select("doc_id"), "near"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))


SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as words
  from documents where doc_id is not null and text is not null
), s as (
  select doc_id, case when len(words) < 4 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))) end as grams
  from w where len(words) > 0
), named as (
  select doc_id, grams, len(grams) as size, min(doc_id) over (partition by list_sort(grams)) as rep, count(*) over (partition by list_sort(grams)) as copies from s
), g as materialized (
  select doc_id, size, copies, unnest(grams) as gram from named where doc_id = rep
), met as (
  select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as shared, any_value(a.size) + any_value(b.size) - count(*) as either, any_value(a.copies) as copies_a, any_value(b.copies) as copies_b
  from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id and least(a.size, b.size) >= 0.45 * greatest(a.size, b.size)
  group by 1, 2
), pairs as materialized (
  select * from met where shared >= 0.45 * either
), edges as materialized (
  select doc_a as x, doc_b as y, copies_b as n from pairs union all select doc_b, doc_a, copies_a from pairs
), reach as (
  select doc_id as id, doc_id as root from named where doc_id = rep
  union select y, root from reach join edges on x = id where root < y
), class as (
  select id, min(root) as root from reach group by id
), links as (
  select x as id, sum(n) as n from edges group by x
)
select d.doc_id, coalesce(class.root, d.doc_id) as class_id, (coalesce(links.n, 0) + coalesce(named.copies - 1, 0))::bigint as n_links
from (select distinct doc_id from documents where doc_id is not null) d
left join named using (doc_id) left join class on class.id = named.rep left join links on links.id = named.rep
"""
