"""HTML extraction by wrapper induction (operator 1).

Pages of a host are aligned, as DOM trees, with the host's leaders by simple tree matching. A text that sits in
the same slot of a leader on enough pages is template; what varies is content. Leaders come from a few pages of
each host, then from pages that none of them resembles until there are none; how often a slot's text recurs is
counted over all pages.
"""

from __future__ import annotations

import html as html_entities
import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

#: pages of a host (in hash order) among which the first leaders are found; each round takes GROWTH times as many of the pages that no leader resembles
LEARNED = 16
GROWTH = 4
#: pages at least this similar to a leader (matched nodes over mean size) are of its kind
SIMILAR = 0.5
#: a slot whose recurring texts are on this share of its pages rotates through them: each is template
RECURRING = 0.2
#: elsewhere a text is template if, texts being drawn alike, any of the slot's is on so many pages with this chance
CHANCE = 0.01
#: elements that show no text, or by definition none of the page's own
SILENT = frozenset({"script", "style", "noscript", "template", "head", "iframe", "svg", "nav"})
#: none of the page's own unless within an article, whose they are then
FURNITURE = frozenset({"footer", "aside"})
RAW = frozenset({"script", "style"})
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article blockquote body dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul aside".split())
#: deeper elements are laid flat
DEPTH = 150
MODEL_BYTES = 64 << 20
#: pages of a host that one task handles at most, when models don't fit into a broadcast
SALT_PAGES = 20_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^<>]*>|[^<]+|<", re.S)
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Page:
    """Nodes in document order: label (tag with class and id, '#' for text), parent's children, text, whether a block."""

    __slots__ = ("label", "kids", "text", "tag")

    def __init__(self, source: str):
        self.label, self.kids, self.text, self.tag = ["^"], [[]], [""], ["^"]
        stack, at, silent = [0], 0, 0  # silent: depth of the stack at which silence began
        while m := _TOKEN.match(source, at):
            at = m.end()
            close, tag = m.group(1), m.group(2)
            if tag is None:
                piece = m.group()
                if piece[0] == "<" and len(piece) > 1 or silent:
                    continue
                words = html_entities.unescape(piece).split()
                if words:
                    self._add("#", stack[-1], " ".join(words), "#")
                continue
            tag = tag.lower()
            if close:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                if silent and len(stack) <= silent:
                    silent = 0
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(source, at)
                at = source.find(">", end.end()) + 1 if end else len(source)
                at = at or len(source)
                continue
            if tag in BLOCK:
                open_p = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] in BLOCK), 0)
                if open_p and self.tag[stack[open_p]] in ("p", tag if tag in ("li", "td", "tr", "dt", "dd") else "p"):
                    del stack[open_p:]
                    if silent and len(stack) <= silent:
                        silent = 0
            if silent and tag in VOID:
                continue
            quiet = tag in SILENT or tag in FURNITURE and not any(self.tag[k] == "article" for k in stack)
            names = " ".join(x.strip("\"'") for x in _CLASS.findall(m.group(3))) if m.group(3) else ""
            if silent:
                node = self._add(tag, None, "", tag)
            else:
                node = self._add(f"{tag}.{names}" if names else tag, None if quiet else stack[-1], "", tag)
            if tag not in VOID and not m.group(3).endswith("/"):
                if quiet and not silent:
                    silent = len(stack)
                if len(stack) < DEPTH or silent:
                    stack.append(node)

    def _add(self, label: str, parent: int | None, text: str, tag: str) -> int:
        if parent is not None:
            self.kids[parent].append(len(self.label))
        self.label.append(label), self.kids.append([]), self.text.append(text), self.tag.append(tag)
        return len(self.label) - 1


class Matcher:
    """Simple tree matching on interned shapes: equal subtrees are one shape, and each pair of shapes is compared once."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}
        self.ways: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def shapes(self, page: Page) -> list[int]:
        out = [0] * len(page.label)
        for k in range(len(out) - 1, -1, -1):
            key = page.label[k], tuple(out[c] for c in page.kids[k])
            s = self.known.get(key)
            if s is None:
                s = self.known[key] = len(self.size)
                self.label.append(key[0]), self.kids.append(key[1]), self.size.append(1 + sum(self.size[c] for c in key[1]))
            out[k] = s
        return out

    def score(self, a: int, b: int) -> int:
        """Nodes of the largest matching of two trees that keeps roots, parents and the order of siblings."""
        if a == b:
            return self.size[a]
        if self.label[a] != self.label[b]:
            return 0
        found = self.scores.get((a, b))
        if found is None:
            self._compare(a, b)
            found = self.scores[a, b]
        return found

    def way(self, a: int, b: int) -> list[tuple[int, int]]:
        """Which children match which."""
        if a == b:
            return [(k, k) for k in range(len(self.kids[a]))]
        self.score(a, b)
        return self.ways[a, b]

    def _compare(self, a: int, b: int) -> None:
        x, y = self.kids[a], self.kids[b]
        begin, m, n, total, way = 0, len(x), len(y), 1, []
        while begin < m and begin < n and x[begin] == y[begin]:  # an equal child at an end is best matched
            total += self.size[x[begin]]
            way.append((begin, begin))
            begin += 1
        tail = []
        while m > begin and n > begin and x[m - 1] == y[n - 1]:
            m, n = m - 1, n - 1
            total += self.size[x[m]]
            tail.append((m, n))
        if m > begin and n > begin:
            rows = [[0] * (n - begin + 1)]
            for i in range(begin, m):
                before, row, left, xi, label = rows[-1], [0], 0, x[i], self.label[x[i]]
                for j in range(begin, n):
                    yj = y[j]
                    up = before[j - begin + 1]
                    best = up if up > left else left
                    if label == self.label[yj]:
                        s = before[j - begin] + self.score(xi, yj)
                        if s > best:
                            best = s
                    row.append(best)
                    left = best
                rows.append(row)
            total += rows[-1][-1]
            i, j, middle = m - begin, n - begin, []
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    middle.append((begin + i, begin + j))
            way += reversed(middle)
        self.scores[a, b], self.ways[a, b] = total, way + tail[::-1]

    def align(self, page: Page, shapes: list[int], leader: Page, its: list[int]) -> dict[int, int]:
        """The leader's text node for each text node of the page that has one."""
        out, stack = {}, [(0, 0)]
        while stack:
            a, b = stack.pop()
            if page.label[a] == "#":
                out[a] = b
            stack += [(page.kids[a][i], leader.kids[b][j]) for i, j in self.way(shapes[a], its[b])]
        return out


def text_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Wrapper:
    """A host's leaders with, for each, the template texts of its slots."""

    def __init__(self, leaders: list[str], texts: list[dict[int, set[int]]]):
        self.leaders, self.texts = [Page(x) for x in leaders], texts
        self._start()

    def _start(self) -> None:
        self.matcher = Matcher()
        self.shapes = [self.matcher.shapes(p) for p in self.leaders]

    def kind(self, page: Page) -> tuple[int, dict[int, int]]:
        """The leader that the page is most like and the alignment with it; -1 if none is similar."""
        if len(self.matcher.size) > 100_000:
            self._start()
        own, best, most = self.matcher.shapes(page), -1, 0.0
        for k, its in enumerate(self.shapes):
            similar = 2 * self.matcher.score(own[0], its[0]) / (self.matcher.size[own[0]] + self.matcher.size[its[0]])
            if similar >= SIMILAR and similar > most:
                best, most = k, similar
        return best, self.matcher.align(page, own, self.leaders[best], self.shapes[best]) if best >= 0 else {}


def learn(sources: list[str]) -> list[str]:
    """Leaders among the pages."""
    leaders, wrapper = [], Wrapper([], [])
    for source in sources:
        page = Page(source)
        if wrapper.kind(page)[0] < 0:
            leaders.append(source)
            wrapper.leaders.append(page), wrapper.shapes.append(wrapper.matcher.shapes(page))
    return leaders


def beyond_chance(most: float, texts: int) -> int:
    """The least count that any of so many texts, each on most pages on average, reaches by chance with CHANCE or less (Poisson)."""
    n, term, below = 0, math.exp(-most), 0.0
    while (1 - below) * texts > CHANCE:
        below += term
        n += 1
        term *= most / n
    return n


def content(page: Page, k: int, slots: dict[int, int], template: list[dict[int, set[int]]]) -> tuple[str, int, int]:
    """(text outside the template, its text nodes, the template's). Blocks and line breaks end lines."""
    lines, line, kept, gone, stack = [], [], 0, 0, [(0, False)]
    while stack:
        node, done = stack.pop()
        tag = page.tag[node]
        if tag == "#":
            slot = slots.get(node)
            if slot is not None and text_hash(page.text[node]) in template[k].get(slot, ()):
                gone += 1
            else:
                kept += 1
                line.append(page.text[node])
            continue
        if (tag in BLOCK or tag == "br") and line:
            lines.append(" ".join(line))
            line = []
        if not done:
            stack.append((node, True))
            stack += [(c, False) for c in reversed(page.kids[node])]
    return "\n".join(lines + ([" ".join(line)] if line else [])), kept, gone


# ---------------------------------------------------------------------------------- on tables


def _with_models(pages: DataFrame, models: DataFrame, f: Callable[[Iterator[tuple[int, str, str, Wrapper | None]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over (page_id, host, html, the host's wrapper) of all pages. Models are broadcast if their size allows; else
    pages go to their host's model, a host of many pages to several copies of it."""
    spark = pages.sparkSession
    size = models.agg(F.sum(F.length("model"))).first()[0] or 0
    if size <= MODEL_BYTES:
        handle = spark.sparkContext.broadcast({r["host"]: bytes(r["model"]) for r in models.collect()})

        def run(batches):
            open_: dict[str, Wrapper | None] = {}

            def rows():
                for b in batches:
                    for i, host, x in zip(*(c.to_pylist() for c in b.columns)):
                        if host not in open_:
                            model = handle.value.get(host)
                            open_[host] = Wrapper(*pickle.loads(model)) if model else None
                        yield i, host, x or "", open_[host]

            yield from f(rows())

        return pages.mapInArrow(run, schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = pages.groupBy("host").count().select(F.col("host").alias("h"), F.ceil(F.col("count") / SALT_PAGES).cast("int").alias("copies"))
    copies = Scratch(spark).table(copies, "copies")
    spread = pages.join(copies, F.col("host").eqNullSafe(F.col("h")))
    spread = spread.select("host", F.pmod(F.xxhash64("page_id", "html"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("kind"), "page_id", "html", F.lit(None).cast("binary").alias("model"))
    each = models.join(copies, F.col("host") == F.col("h")).select("host", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("html"), "model")
    both = each.unionByName(spread).repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "kind")

    def stream(batches):
        def rows():
            held = None, None
            for b in batches:
                for host, _, kind, i, x, model in zip(*(c.to_pylist() for c in b.columns)):
                    if kind == 0:
                        held = host, Wrapper(*pickle.loads(model))
                    else:
                        yield i, host, x or "", held[1] if host is not None and held[0] == host else None

        yield from f(rows())

    return both.mapInArrow(stream, schema)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, list[tuple[int, str]]] = {}
    for b in batches:
        for host, h, x in zip(*(c.to_pylist() for c in b.columns)):
            by.setdefault(host, []).append((h, x))
    for host, pages in by.items():
        leaders = learn([x for _, x in sorted(set(pages))])
        model = pickle.dumps((leaders, [{} for _ in leaders]))
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([model], pa.binary())], ["host", "model"])


def _unlike(rows) -> Iterator[pa.RecordBatch]:
    """The pages that no leader of their host resembles."""
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), (pa.int64(), pa.string(), pa.string()))], ["page_id", "host", "html"])

    for i, host, x, wrapper in rows:
        if wrapper is not None and wrapper.kind(Page(x))[0] < 0:
            held.append((i, host, x))
            size += len(x)
            if size > 4 << 20:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


def _joined(models: pa.Table) -> pa.Table:
    """One model of a host's leaders of all rounds."""
    leaders = [x for _, m in sorted(zip(models["round"].to_pylist(), models["model"].to_pylist())) for x in pickle.loads(m)[0]]
    return pa.table({"host": models["host"][:1], "model": pa.array([pickle.dumps((leaders, [{} for _ in leaders]))], pa.binary())})


def _leaders(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, model): leaders that every page of the host with an html resembles one of. Each round's are among pages unlike all before."""
    parts, models, most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), None, LEARNED
    rows = rows.where("host is not null and html is not null")
    while True:
        hashed = rows.select("host", F.xxhash64("html").alias("h")).distinct()
        first = hashed.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("h"))).where(F.col("r") <= most)
        first = scratch.table(first.select(F.col("host").alias("wanted_host"), F.col("h").alias("wanted")), "learned")
        chosen = rows.withColumn("h", F.xxhash64("html")).join(broadcast_if_small(first, 60), (F.col("host") == F.col("wanted_host")) & (F.col("h") == F.col("wanted")), "left_semi")
        new = scratch.table(chosen.select("host", "h", "html").repartition(parts, "host").mapInArrow(_learned, "host string, model binary"), "models")
        if models is None:
            models = new
        else:
            both = models.withColumn("round", F.lit(0)).unionByName(new.withColumn("round", F.lit(1)))
            models = scratch.table(both.groupBy("host").applyInArrow(_joined, "host string, model binary"), "models")
        rows = scratch.table(_with_models(rows, new, _unlike, "page_id long, host string, html string"), "unlike")
        if rows.isEmpty():
            return models
        most *= GROWTH


def _cells(rows, bodies: bool) -> Iterator[pa.RecordBatch]:
    """Each slot's texts and how many pages have them, at slot -1 the kind's pages. With bodies, once for each body
    instead: the page's longest other text that isn't known as template. Pages that share it are copies."""
    seen: Counter = Counter()

    def flush():
        yield pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c, kind in zip(zip(*seen), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))), pa.array(seen.values(), pa.int64())], ["host", "kind", "slot", "text", "body", "n"])
        seen.clear()

    for _, host, x, wrapper in rows:
        if wrapper is None:
            continue
        page = Page(x)
        k, slots = wrapper.kind(page)
        if k < 0:
            continue
        hashes = {node: text_hash(page.text[node]) for node in slots}
        own = {page.text[node] for node, slot in slots.items() if hashes[node] not in wrapper.texts[k].get(slot, ())} if bodies else ()
        longest = [text_hash(t) for t in sorted(own, key=lambda t: (-len(t), t))[:2]] + [0, 0]
        if not bodies:
            seen[host, k, -1, 0, 0] += 1
        for node, slot in slots.items():
            h = hashes[node]
            seen[host, k, slot, h, longest[h == longest[0]] if bodies else 0] += 1
        if len(seen) > 100_000:
            yield from flush()
    if seen:
        yield from flush()


_CELLS = "host string, kind int, slot int, text long, body long, n long"


def _common(key, models: pa.Table, counts: pa.Table) -> pa.Table:
    """The model with the texts that more than half of a kind's pages have in one slot."""
    out = []
    for x in models["model"].to_pylist():
        leaders, _ = pickle.loads(x)
        rows = list(zip(*(counts[c].to_pylist() for c in ("kind", "slot", "text", "n"))))
        pages = {k: n for k, slot, _, n in rows if slot < 0}
        often: list[dict[int, set[int]]] = [{} for _ in leaders]
        for k, slot, h, n in rows:
            if slot >= 0 and 2 * n > pages[k]:
                often[k].setdefault(slot, set()).add(h)
        out.append(pickle.dumps((leaders, often)))
    return pa.table({"host": models["host"], "model": pa.array(out, pa.binary())})


def _recurring(cells: DataFrame) -> DataFrame:
    """(host, kind, slot, text, n): the texts of more than one page; with a null text the slot's pages, and its texts as seen."""
    each = cells.groupBy("host", "kind", "slot", "text").agg(F.count_distinct("body").alias("n"))
    each = Scratch(cells.sparkSession).table(each, "texts")
    slots = each.groupBy("host", "kind", "slot").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.max("n").alias("most")).where("most > 1")
    return each.where("n > 1").withColumn("texts", F.lit(None).cast("long")).unionByName(slots.drop("most").withColumn("text", F.lit(None).cast("long")))


def _decided(key, models: pa.Table, counts: pa.Table) -> pa.Table:
    """The model with the texts that recur more than chance allows for their slot."""
    out = []
    for x in models["model"].to_pylist():
        leaders, _ = pickle.loads(x)
        rows = list(zip(*(counts[c].to_pylist() for c in ("kind", "slot", "text", "n", "texts"))))
        pages = {(k, slot): (n, texts) for k, slot, h, n, texts in rows if h is None}
        again = Counter()
        for k, slot, h, n, _ in rows:
            if h is not None:
                again[k, slot] += n
        least = {at: 2 if again[at] >= RECURRING * n else max(2, beyond_chance(n / texts, texts)) for at, (n, texts) in pages.items()}
        often: list[dict[int, set[int]]] = [{} for _ in leaders]
        for k, slot, h, n, _ in rows:
            if h is not None and n >= least[k, slot]:
                often[k].setdefault(slot, set()).add(h)
        out.append(pickle.dumps((leaders, often)))
    return pa.table({"host": models["host"], "model": pa.array(out, pa.binary())})


def _extracted(rows) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch():
        ids, hosts, texts, kept, gone = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(texts, pa.string()), pa.array(kept, pa.int32()), pa.array(gone, pa.int32())], ["page_id", "host", "content", "n_content", "n_template"])

    for i, host, x, wrapper in rows:
        page = Page(x)
        k, slots = wrapper.kind(page) if wrapper else (-1, {})
        held.append((i, host, *content(page, k, slots, wrapper.texts if wrapper else [])))
        size += len(held[-1][2])
        if size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, content, n_content, n_template): a page's text without its host's template, and how many text nodes were content and template.

    One row for each row. The host is the URL's in lower case. Without one (null or broken URL), and for a page
    unlike all others of its host, all visible text is content. A null or empty html gives the empty text. Broken
    markup is read as it stands: unclosed elements end with their parent, stray end tags are dropped, elements deeper
    than DEPTH are siblings. Repeated rows give repeated rows and count as one page. Other columns are ignored; an empty
    table gives none. The wrappers are learned while the plan is built.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.when(host != "", host).alias("host"), "html")
    models = _leaders(rows, scratch)
    once = _with_models(rows, models, lambda x: _cells(x, False), _CELLS).groupBy("host", "kind", "slot", "text").agg(F.sum("n").alias("n")).where("n > 1 or slot < 0")
    models = scratch.table(models.groupBy("host").cogroup(once.groupBy("host")).applyInArrow(_common, "host string, model binary"), "common")
    counts = _recurring(_with_models(rows, models, lambda x: _cells(x, True), _CELLS))
    wrappers = scratch.table(models.groupBy("host").cogroup(counts.groupBy("host")).applyInArrow(_decided, "host string, model binary"), "wrappers")
    return _with_models(rows, wrappers, _extracted, "page_id long, host string, content string, n_content int, n_template int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
