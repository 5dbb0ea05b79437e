"""Mixing overlapping sources to target weights by min-cost flow (operator 9).

A document can belong to several sources; documents are aggregated by the set of sources they belong to. On
that small graph the patterns' tokens flow to the sources' quotas; each further epoch over a pattern costs more
than the last. What a pattern sends, over what it has, is how often its documents are taken; a seeded hash of
doc_id decides who is taken once more for the fraction.
"""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, documents, free_names

SEED = 11
#: exponent that flattens the sources' natural shares into target weights
TEMPERATURE = 0.3
#: weight of each kind of source; a kind's weight goes to its sources by their flattened shares
KINDS = {"lang": 0.8, "source": 0.2}
#: cost of the k-th epoch over a pattern; the last price holds for all that follow
EPOCH_COSTS = (0, 1, 3, 6, 10, 15, 21, 28, 36, 45)


class Network:
    """Directed graph with integer capacities and costs; arcs 2k and 2k + 1 are each other's reverse."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, s: int, t: int) -> tuple[int, int]:
        """Sends as much as goes from s to t, at the least cost; (amount, cost). Primal-dual with blocking flows; costs must be 0 or more."""
        n, potential, sent, paid = len(self.out), [0] * len(self.out), 0, 0
        while True:
            far = [None] * n
            far[s], heap = 0, [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e]:
                        b, x = self.to[e], d + self.cost[e] + potential[a] - potential[self.to[e]]
                        if far[b] is None or x < far[b]:
                            far[b] = x
                            heapq.heappush(heap, (x, b))
            if far[t] is None:
                return sent, paid
            most = far[t]
            for a in range(n):
                potential[a] += most if far[a] is None else min(far[a], most)
            while amount := self._blocking(s, t, potential):
                sent += amount
                paid += amount * (potential[t] - potential[s])

    def _tight(self, e: int, a: int, potential: list[int]) -> bool:
        return self.room[e] > 0 and self.cost[e] + potential[a] - potential[self.to[e]] == 0

    def _blocking(self, s: int, t: int, potential: list[int]) -> int:
        level, queue = {s: 0}, deque([s])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.to[e] not in level and self._tight(e, a, potential):
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        if t not in level:
            return 0
        at, total = [0] * len(self.out), 0
        while True:
            path, a = [], s
            while a != t:
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    if level.get(self.to[e]) == level[a] + 1 and self._tight(e, a, potential):
                        break
                    at[a] += 1
                if at[a] == len(self.out[a]):
                    if not path:
                        return total
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1
                    continue
                path.append(e)
                a = self.to[e]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount
            total += amount


@dataclass
class Mix:
    """epochs: how often the documents of each pattern are taken; flow: tokens by (pattern, source); quota: tokens by source;
    columns: the names that mix() gave to times, tokens and pattern."""

    epochs: dict[tuple, float]
    flow: dict[tuple[tuple, str], int]
    quota: dict[str, int]
    columns: tuple[str, str, str] = ("__times", "__tokens", "__pattern")


def _network(tokens: dict[tuple, int], quota: dict[str, int], costs: tuple[int, ...], endless: bool) -> tuple[Network, dict, dict]:
    """The graph and its arcs by pattern (one for each epoch, the last one without bound if endless) and by (pattern, source)."""
    patterns, sources = sorted(p for p in tokens if p and tokens[p]), sorted(quota)
    g = Network(2 + len(patterns) + len(sources))
    into = {s: 2 + len(patterns) + j for j, s in enumerate(sources)}
    feeds, routes, everything = {}, {}, sum(quota.values())
    for i, p in enumerate(patterns, 2):
        feeds[p] = [g.arc(0, i, everything if endless and k + 1 == len(costs) else tokens[p], c) for k, c in enumerate(costs)]
        for s in p:
            if s in into:
                routes[p, s] = g.arc(i, into[s], everything)
    for s in sources:
        g.arc(into[s], 1, quota[s])
    return g, feeds, routes


def least_budget(tokens: dict[tuple, int], weights: dict[str, float]) -> int:
    """The smallest total of tokens with whose quotas every document of a weighted source finds room once."""
    live = {p: n for p, n in tokens.items() if n and any(weights.get(s, 0) > 0 for s in p)}
    need = sum(live.values())
    fits = lambda total: _network(live, {s: int(total * w) for s, w in weights.items()}, (0,), False)[0].run(0, 1)[0] >= need
    low, high = need - 1, need + len(weights)  # what is low doesn't fit
    while need and not fits(high):
        low, high = high, 2 * high
    while high - low > max(1, need // 10_000):
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def solve(tokens: dict[tuple, int], weights: dict[str, float], budget: int | None = None, costs: tuple[int, ...] = EPOCH_COSTS) -> Mix:
    """tokens by pattern (a sorted tuple of source names) and weights by source; without a budget the least_budget(). Documents of no source are taken once, outside the mix."""
    total = sum(weights.values())
    weights = {s: w / total for s, w in weights.items()} if total else {}
    budget = least_budget(tokens, weights) if budget is None else budget
    quota = {s: int(budget * w) for s, w in weights.items()}
    g, feeds, routes = _network(tokens, quota, costs, True)
    g.run(0, 1)
    epochs = {p: sum(g.flow(e) for e in feeds[p]) / n if p in feeds else 0.0 for p, n in tokens.items()}
    if budget and least_fit(epochs, tokens):
        epochs = {p: max(1.0, x) if x > 0.999 else x for p, x in epochs.items()}
    if () in epochs:
        epochs[()] = 1.0
    return Mix(epochs, {k: g.flow(e) for k, e in routes.items() if g.flow(e)}, quota)


def least_fit(epochs: dict[tuple, float], tokens: dict[tuple, int]) -> bool:
    """Whether all patterns are taken once but for rounding of the quotas to whole tokens."""
    return all(x > 0.999 for p, x in epochs.items() if p and tokens[p])


def membership(docs: DataFrame) -> Column:
    """The sources of a row, sorted: its crawl source and its language are one each; nulls are none."""
    c = lambda k: F.when(docs[k].isNotNull(), F.concat(F.lit(f"{k}:"), docs[k].cast("string")))
    return F.array_sort(F.array_compact(F.array(c("lang"), c("source"))))


def tokens_of(docs: DataFrame) -> Column:
    """Words of a text, at least 1 (a null or empty text counts 1, so that it can be placed): white-space runs plus one."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(docs["text"], F.lit(r"\S+")), F.lit(0))).cast("long")


def natural_weights(tokens: dict[tuple, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    """The weight of each of KINDS over its sources, by their share of tokens to the power of temperature."""
    share: dict[str, int] = {}
    for p, n in tokens.items():
        for s in p:
            share[s] = share.get(s, 0) + n
    out: dict[str, float] = {}
    for kind in sorted({s.split(":")[0] for s in share}):
        own = {s: n**temperature for s, n in share.items() if s.split(":")[0] == kind}
        out |= {s: KINDS[kind] * x / sum(own.values()) for s, x in own.items()}
    return out


def _measured(docs: DataFrame, pattern: str, size: str, draw: str, seed: int) -> DataFrame:
    drawn = F.pmod(F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), docs["text"]), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return docs.withColumns({pattern: membership(docs), size: tokens_of(docs), draw: drawn})


def _taken(rows: DataFrame, plan: Mix, draw: str) -> DataFrame:
    """rows of _measured() with how often each is taken."""
    times, size, pattern = plan.columns
    key, share = free_names(rows, "__key", "__epochs")
    table = rows.sparkSession.createDataFrame([(list(p), float(x)) for p, x in plan.epochs.items()], f"`{key}` array<string>, `{share}` double")
    rows = rows.join(broadcast_if_small(table, 200), F.col(pattern) == F.col(key), "left")
    epochs = F.coalesce(share, F.lit(0.0))
    taken = (F.floor(epochs) + (F.col(draw) < epochs - F.floor(epochs)).cast("int")).cast("int")
    return rows.withColumn(times, taken).drop(key, share, draw)


def _plan(rows: DataFrame, columns: tuple[str, str, str], weights: dict[str, float] | None, budget: int | None) -> Mix:
    found = rows.groupBy(columns[2]).agg(F.sum(columns[1]).alias("n")).collect()  # one row for each set of sources
    tokens = {tuple(r[0]): int(r["n"]) for r in found}
    plan = solve(tokens, natural_weights(tokens) if weights is None else weights, budget)
    plan.columns = columns
    return plan


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: int = SEED) -> tuple[DataFrame, Mix]:
    """docs with the columns __times (how often a row is taken, 0 or more), __tokens and __pattern, and the plan.

    weights: by source name as in membership(); None for natural_weights(). Without a budget no document is lost:
    quotas are as small as leaves room for all once, and reach their weights by repeats. A row of no source at all is
    outside the mix and taken once; one whose sources all have no weight is taken never. A null doc_id draws by its
    text. A null or empty text counts one token. Repeated rows draw alike. Empty docs: no rows, an empty plan.
    If docs has a column of one of the three names, the new one gets a further underscore (plan.columns has the names).
    A job that adds up tokens by set of sources runs while the plan is built.
    """
    times, size, pattern, draw = free_names(docs, "__times", "__tokens", "__pattern", "__draw")
    rows = _measured(docs, pattern, size, draw, seed)
    plan = _plan(rows, (times, size, pattern), weights, budget)
    return _taken(rows, plan, draw), plan


def mixed_rows(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """docs with each row as many times as the mix takes it, never if that is 0; same columns. Nulls, ties, repeated rows and empty docs as in mix()."""
    rows, plan = mix(docs, weights, budget, seed)
    times = plan.columns[0]
    (copy,) = free_names(rows, "__copy")
    return rows.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[rows[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pattern, tokens and times for every document. Texts are read once: their words and draws are written, and read by both steps."""
    rows = _measured(documents(spark, sf_dir), "pattern", "tokens", "draw", SEED).select("doc_id", "pattern", "tokens", "draw")
    rows = Scratch(spark).table(rows, "measured")
    rows = _taken(rows, _plan(rows, ("times", "tokens", "pattern"), None, None), "draw")
    return rows.select("doc_id", F.array_join("pattern", "+").alias("pattern"), "tokens", "times")
