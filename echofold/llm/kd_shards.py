"""Shards as leaves of a k-d tree over metadata (operator 6).

Every node over the target is split at the weighted median (bytes) of its widest metadata dimension, all nodes of
a level together. A median is found by histograms: each pass adds up bytes in equal bins of every open interval
and goes on inside the bin that holds the middle, until one value is left. Only histograms and the tree reach the
driver, and only of the tree's top: once a node's rows fit into a task they go there and are split on the spot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, documents, free_names

TARGET_BYTES = 32 << 20
#: histogram cells of one pass over all open nodes, and the least bins of a node
CELLS, LEAST_BINS = 1 << 17, 16
#: a node of so many rows or fewer is split within one task
LOCAL_ROWS = 1 << 20
#: dimensions of documents; strings are ordered by name
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")


@dataclass
class Tree:
    """Nodes by number; rows with value <= cut go left. leaf: -1 or the shard."""

    dim: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    leaf: list[int] = field(default_factory=lambda: [-1])

    def add(self) -> int:
        for x, v in ((self.dim, -1), (self.cut, 0), (self.left, -1), (self.leaf, -1)):
            x.append(v)
        return len(self.dim) - 1

    def nodes(self, values: np.ndarray) -> np.ndarray:
        """The node where each row (dimensions x rows) ends."""
        dim, cut, left = np.array(self.dim), np.array(self.cut, np.int64), np.array(self.left)
        at = np.zeros(values.shape[1], np.int64)
        live = np.arange(len(at))
        while len(live):
            live = live[dim[at[live]] >= 0]
            a = at[live]
            at[live] = left[a] + (values[dim[a], live] > cut[a])
        return at


def _values(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.stack([b.column(i).to_numpy() for i in range(dims)])


def _ranges(dims: int, tree: Tree):
    """Bytes, rows, least and largest values by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(tree.dim)
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = np.full((dims, n), np.iinfo(np.int64).max), np.full((dims, n), np.iinfo(np.int64).min)
        for b in batches:
            x = _values(b, dims)
            at = tree.nodes(x)
            np.add.at(size, at, b.column(dims).to_numpy())
            np.add.at(rows, at, 1)
            for d in range(dims):
                np.minimum.at(low[d], at, x[d])
                np.maximum.at(high[d], at, x[d])
        has = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(has), pa.array(size[has]), pa.array(rows[has]), *[pa.array(low[d][has]) for d in range(dims)], *[pa.array(high[d][has]) for d in range(dims)]],
            ["node", "size", "n", *[f"low{d}" for d in range(dims)], *[f"high{d}" for d in range(dims)]],
        )

    return run


def _histogram(dims: int, tree: Tree, open_: dict[int, tuple[int, int, int]], bins: int):
    """Bytes by (node, bin) in each open node's interval of its dimension."""
    n = len(tree.dim)
    dim, low, width = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, np.int64)
    high = np.zeros(n, np.int64)
    for node, (d, a, z) in open_.items():
        dim[node], low[node], high[node], width[node] = d, a, z, max(1, -(-(z - a + 1) // bins))

    def run(batches):
        keys, sizes = [], []
        for b in batches:
            x = _values(b, dims)
            at = tree.nodes(x)
            here = np.flatnonzero(dim[at] >= 0)
            v, a = x[dim[at[here]], here], at[here]
            inside = (v >= low[a]) & (v <= high[a])
            v, a = v[inside], a[inside]
            key, inverse = np.unique(a * bins + (v - low[a]) // width[a], return_inverse=True)
            keys.append(key)
            sizes.append(np.bincount(inverse, b.column(dims).to_numpy()[here][inside], len(key)).astype(np.int64))
        if keys:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(inverse, np.concatenate(sizes), len(key)).astype(np.int64))], ["cell", "size"])

    return run


def medians(rows: DataFrame, dims: int, tree: Tree, nodes: dict[int, tuple[int, int, int, int]]) -> dict[int, int]:
    """The weighted median of each node's dimension: the smallest value with half of the bytes at or below it, short of the largest.

    nodes: (dimension, least, largest value, bytes) by node; least < largest.
    """
    state = {k: [d, a, z, 0, half // 2] for k, (d, a, z, half) in nodes.items()}  # interval, bytes below it, bytes wanted
    found: dict[int, int] = {}
    while state:
        bins = max(LEAST_BINS, CELLS // len(state))
        run = _histogram(dims, tree, {k: (s[0], s[1], s[2]) for k, s in state.items()}, bins)
        cells = rows.mapInArrow(run, "cell long, size long").groupBy("cell").agg(F.sum("size").alias("size")).toArrow()
        cell, size = cells["cell"].to_numpy(), cells["size"].to_numpy()
        order = np.argsort(cell)
        cell, size = cell[order], size[order]
        for k, s in list(state.items()):
            i, j = np.searchsorted(cell, [k * bins, (k + 1) * bins])
            total = s[3] + np.cumsum(size[i:j])
            hit = min(int(np.searchsorted(total, s[4])), j - i - 1)
            width = max(1, -(-(s[2] - s[1] + 1) // bins))
            low = s[1] + int(cell[i + hit] - k * bins) * width
            s[3] = int(total[hit - 1]) if hit else s[3]
            s[1], s[2] = low, min(s[2], low + width - 1)
            if s[1] == s[2]:
                found[k] = min(s[1], nodes[k][2] - 1)
                del state[k]
    return found


def split(rows: DataFrame, dims: int, target: int, local_rows: int) -> tuple[Tree, list[int], set[int]]:
    """The top of the tree, the scale of each dimension, and the ends of it that are still to be split, each of at most local_rows rows.
    Other ends hold at most target bytes, or rows alike in all dimensions. rows: dimensions as long, then bytes."""
    tree, scale, todo, small = Tree(), None, {0}, set()
    while todo:
        found = rows.mapInArrow(_ranges(dims, tree), ", ".join(f"{c} long" for c in ("node", "size", "n", *[f"low{d}" for d in range(dims)], *[f"high{d}" for d in range(dims)])))
        aggs = [F.sum("size").alias("size"), F.sum("n").alias("n"), *[F.min(f"low{d}").alias(f"low{d}") for d in range(dims)], *[F.max(f"high{d}").alias(f"high{d}") for d in range(dims)]]
        stats = {r["node"]: r for r in found.where(F.col("node").isin(sorted(todo)) if len(todo) <= 1000 else F.lit(True)).groupBy("node").agg(*aggs).collect()}
        if scale is None:
            scale = [max(1, stats[0][f"high{d}"] - stats[0][f"low{d}"]) if 0 in stats else 1 for d in range(dims)]
        wanted = {}
        for node in sorted(todo & stats.keys()):
            r = stats[node]
            wide = [(r[f"high{d}"] - r[f"low{d}"]) / scale[d] for d in range(dims)]
            d = int(np.argmax(wide))
            if r["size"] > target and wide[d] > 0:
                if r["n"] <= local_rows:
                    small.add(node)
                else:
                    wanted[node] = (d, r[f"low{d}"], r[f"high{d}"], r["size"])
        todo = set()
        for node, cut in medians(rows, dims, tree, wanted).items():
            tree.dim[node], tree.cut[node], tree.left[node] = wanted[node][0], cut, tree.add()
            todo |= {tree.left[node], tree.add()}
    return tree, scale, small


def split_here(values: np.ndarray, size: np.ndarray, target: int, scale: list[int]) -> np.ndarray:
    """The leaf of each row, in the order of the tree: the same splits as those of the top, by sorting."""
    out, leaves, stack = np.zeros(values.shape[1], np.int64), 0, [np.arange(values.shape[1])]
    while stack:
        at = stack.pop()
        low, high = values[:, at].min(1), values[:, at].max(1)
        wide = [(int(z) - int(a)) / s for a, z, s in zip(low, high, scale)]
        d, total = int(np.argmax(wide)), int(size[at].sum())
        if total <= target or wide[d] <= 0:
            out[at], leaves = leaves, leaves + 1
            continue
        v = values[d][at]
        order = np.argsort(v, kind="stable")
        middle = v[order[min(int(np.searchsorted(np.cumsum(size[at][order]), total // 2)), len(at) - 1)]]
        left = v <= min(int(middle), int(high[d]) - 1)
        stack += [at[~left], at[left]]
    return out


def _within(dims: int, target: int, scale: list[int]):
    """Rows with their node first: the leaf within the node last. All rows of a node are in one task."""

    def run(batches):
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        node = t.column(0).to_numpy()
        order = np.argsort(node, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(node[order]) != 0, [True]])) if len(node) else np.zeros(1, np.int64)
        values, size = np.stack([t.column(1 + d).to_numpy() for d in range(dims)]), t.column(1 + dims).to_numpy()
        leaf = np.zeros(len(node), np.int64)
        for i, j in zip(edge[:-1], edge[1:]):
            at = order[i:j]
            leaf[at] = split_here(values[:, at], size[at], target, scale)
        yield from t.append_column("leaf", pa.array(leaf)).to_batches(max_chunksize=100_000)

    return run


def kd_shards(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, target: int = TARGET_BYTES, local_rows: int | None = None) -> DataFrame:
    """docs' dimensions with bytes (of the text) and shard, one row for each row.

    A null dimension counts as just below the least value (as that value if it is the least long), a null or empty text
    as 0 bytes. Rows alike in all dimensions, repeated rows among them, stay together even beyond the target; of values
    that tie at a median all go left. A string dimension is ordered by the ranks of its distinct values, which must be
    few enough to list; numbers are used as they are (fractions cut off). Other columns are ignored whatever their
    names. An empty table gives none. The tree is built while the plan is.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    kinds = {name: docs.schema[name].dataType for name in dimensions}
    docs = docs.select(*dimensions, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias(free_names(docs, "bytes")[0]))
    size_name, dims = docs.columns[-1], len(dimensions)
    numeric = [name for name in dimensions if kinds[name].typeName() != "string"]
    least = docs.agg(*[F.min(F.col(name).cast("long")) for name in numeric]).first() if numeric else ()
    below = {name: max(-(1 << 63), (0 if x is None else x) - 1) for name, x in zip(numeric, least)}
    columns = []
    for i, name in enumerate(dimensions):
        if name in below:
            columns.append(F.coalesce(F.col(name).cast("long"), F.lit(below[name])).alias(f"d{i}"))
            continue
        names = [r[0] for r in docs.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).collect()]
        text, rank = free_names(docs, f"__s{i}", f"__r{i}")
        ranks = spark.createDataFrame([(x, k) for k, x in enumerate(names)], f"`{text}` string, `{rank}` long")
        docs = docs.join(broadcast_if_small(ranks, 64), docs[name] == F.col(text), "left")
        columns.append(F.coalesce(F.col(rank), F.lit(-1)).alias(f"d{i}"))
    rows = scratch.table(docs.select(*columns, F.col(size_name).alias("size"), *[docs[name].alias(f"x{i}") for i, name in enumerate(dimensions)]), "metadata")
    tree, scale, small = split(rows.select(*[f"d{i}" for i in range(dims)], "size"), dims, target, local_rows)

    def placed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.nodes(_values(b, dims))), *b.columns], ["node", *b.schema.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    nodes = scratch.table(rows.mapInArrow(placed, f"node long, {fields}"), "nodes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    which = broadcast_if_small(spark.createDataFrame([(n,) for n in sorted(small)], "wanted long"), 8)
    inside, rest = (nodes.join(which, F.col("node") == F.col("wanted"), how) for how in ("left_semi", "left_anti"))
    inside = scratch.table(inside.repartition(max(parts, len(small) // 4), "node").mapInArrow(_within(dims, target, scale), f"node long, {fields}, leaf long"), "leaves")
    leaves = {r["node"]: r["n"] for r in inside.groupBy("node").agg((F.max("leaf") + 1).alias("n")).collect()}  # a row for each local_rows rows or so
    shard, offsets, stack = 0, {}, [0]
    while stack:  # shards in the order of the tree, so that near ones have near numbers
        node = stack.pop()
        if tree.dim[node] < 0:
            offsets[node], shard = shard, shard + leaves.get(node, 1)
        else:
            stack += [tree.left[node] + 1, tree.left[node]]
    first = broadcast_if_small(spark.createDataFrame(sorted(offsets.items()), "at long, first long"), 16)
    both = inside.unionByName(rest.withColumn("leaf", F.lit(0).cast("long"))).join(first, F.col("node") == F.col("at"))
    shown = [F.col(f"x{i}").alias(name) for i, name in enumerate(dimensions)]
    return both.select(*shown, F.col("size").alias("bytes"), (F.col("first") + F.col("leaf")).cast("int").alias("shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir))
