"""Toxic passages as maximum-scoring segments (operator 8).

A token is a word cut to its first five characters (a truncation stemmer). Log-odds of toxic against clean
documents with a Dirichlet prior proportional to the background are shrunk by their standard error; other
tokens score a small negative drift. A linear scan finds all maximal segments of each whole text, and
extreme-value statistics turn segment scores and text lengths into a p-value of the document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, broadcast_if_small, documents, text_slices

STEM = 5
#: bound on the labelled documents of each class that the classifier is fitted on, taken in seeded hash order
PER_CLASS = 10_000
SIGNIFICANT = 0.001
PASSAGE = 0.05
SHRINK = 1.64
#: a token scores only if its shrunken odds ratio is at least 5
EFFECT = math.log(5)
#: mass of the Dirichlet prior, as a share of the toxic class's
PRIOR = 0.1

RESULT = "doc_id long, n_tokens long, n_passages int, top_score double, p_value double, passages array<struct<first:int,last:int,score:double,e_value:double>>"


@dataclass
class Model:
    """Scores of the tokens that tell toxic from clean; decay and scale are the extreme-value parameters lambda and K."""

    hashes: np.ndarray
    scores: np.ndarray
    drift: float
    decay: float
    scale: float
    floor: float = 0.0  # segments below the least calibrated score don't count

    def score(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(tokens), -self.drift)
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.scores[at], 0.0) - self.drift

    def score_text(self, words: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Scores of one text in which the k-th occurrence of a scoring word counts 1/k: words come in bursts."""
        up = np.flatnonzero(scores > 0)
        order = np.argsort(words[up], kind="stable")
        same = words[up][order]
        first = np.searchsorted(same, same)
        k = np.empty(len(up))
        k[order] = np.arange(len(up)) - first + 1
        out = scores.copy()
        out[up] = (scores[up] + self.drift) / k - self.drift
        return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) in one left-to-right scan in linear time (Ruzzo and Tompa).

    Each candidate links to the nearest one before it whose left sum is smaller: those between need never be looked
    at again, so that every link is followed once.
    """
    total = np.cumsum(scores)
    up = np.flatnonzero(scores > 0)
    first, last, low, high, link = [], [], [], [], []
    for k, after in zip(up.tolist(), total[up].tolist()):
        begin, before, j = k, after - float(scores[k]), len(first) - 1
        while True:
            while j >= 0 and low[j] >= before:
                j = link[j]
            if j < 0 or high[j] >= after:
                break
            begin, before, nearest = first[j], low[j], link[j]
            del first[j:], last[j:], low[j:], high[j:], link[j:]
            j = nearest
        first.append(begin), last.append(k), low.append(before), high.append(after), link.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, low, high)]


def poisson_p_value(scores: list[float], n: int, decay: float, scale: float, floor: float = 0.0) -> float:
    """p-value of the best r segments together: segments of at least the r-th score come as a Poisson variable of
    mean K n exp(-lambda score). The smallest over r, with weights 1/2, 1/4, ... for having looked at all r."""
    best = 0.0  # logarithm
    rate = math.log(scale * n) if scale * n > 0 else -math.inf
    for r, s in enumerate(sorted((x for x in scores if x >= floor), reverse=True), 1):
        mean = rate - decay * s
        expected = math.exp(min(mean, 700.0))
        first = r * (mean + math.log(2)) - expected - math.lgamma(r + 1)
        if expected >= r or first >= best:  # the sum is no less than its first term
            continue
        term = total = 1.0
        i = r + 1
        while term > 1e-17 * total:
            term *= expected / i
            total += term
            i += 1
        best = min(best, first + math.log(total))
    return math.exp(best)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many different words of each token toxic and clean documents hold, added up over documents."""
    every, flags, tokens = [], [], np.zeros(2, np.int64)
    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False)
        for i, j in text_slices(b.column(0)):
            words = Words(b.column(0).slice(i, j - i), STEM)
            order = np.lexsort((words.full, words.doc))
            h, f, d = words.hash[order], words.full[order], words.doc[order]
            once = np.ones(len(h), bool)
            once[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
            every.append(h[once])
            flags.append(toxic[i:j][d[once]] == 1)
            tokens += np.bincount(toxic[i:j][words.doc] == 1, minlength=2)
    if every and sum(map(len, every)):
        h, at = np.unique(np.concatenate(every), return_inverse=True)
        flag = np.concatenate(flags)
        t = np.bincount(at, flag, len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t), pa.array(np.bincount(at, minlength=len(h)) - t)], ["h", "toxic", "clean"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array(tokens[1:]), pa.array(tokens[:1])], ["h", "toxic", "clean"])


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_t: float, n_c: float, shrink: float = SHRINK) -> np.ndarray:
    """Log-odds with a Dirichlet prior spread as the background, less shrink standard errors; 0 below EFFECT.

    toxic and clean count a word of the token once for each document that holds it, n_t and n_c all words: a word that
    one document repeats then tells little, and a token of which a document has many words tells much.
    """
    mass = PRIOR * n_t
    prior = mass * (toxic + clean) / (n_t + n_c)
    t, c = toxic + prior, clean + prior
    delta = np.log(t / (n_t + mass - t)) - np.log(c / (n_c + mass - c))
    s = np.abs(delta) - shrink * np.sqrt(1 / t + 1 / c)
    return np.where(s >= EFFECT, np.sign(delta) * s, 0.0)


def solve_decay(p: np.ndarray, s: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1, by bisection; the mean score must be negative."""
    low, high = 0.0, 1.0
    f = lambda x: float((p * np.expm1(np.minimum(x * s, 700))).sum())
    while f(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 7) -> DataFrame:
    """(text, toxic) of at most per_class labelled documents of each class, in seeded hash order of doc_id.

    Null labels and ids are left out; of labels that disagree about a document the toxic one counts. Copies of a
    text count once, or else their every token would seem to be toxic or clean.
    """
    once = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    sample = once.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(once.where("toxic = 0").orderBy(*order).limit(per_class))
    sample = sample.select(F.col("doc_id").alias("__id"), "toxic")
    texts = docs.select("doc_id", "text").where("text is not null")
    found = texts.join(broadcast_if_small(sample, 16), F.col("doc_id") == F.col("__id"))
    return found.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The scores and extreme-value parameters. Without toxic or without clean labelled text no token scores, and nothing is toxic."""
    from .common import Scratch

    scratch = Scratch(docs.sparkSession)
    sample = scratch.table(labelled(docs, labels, per_class), "labelled")
    counts = sample.mapInArrow(_count_tokens, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    totals, counts = counts.filter(counts.column("h").is_null()), counts.filter(counts.column("h").is_valid())
    h = counts.column("h").to_numpy().astype(np.int64).view(np.uint64)
    toxic, clean = (counts.column(k).to_numpy().astype(np.float64) for k in ("toxic", "clean"))
    n_t, n_c = (float(totals.column(k)[0].as_py() or 0) if totals.num_rows else 0.0 for k in ("toxic", "clean"))
    if not n_t or not n_c:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.05, 1.0, 1.0)
    order = np.argsort(h)
    h, toxic, clean = h[order], toxic[order], clean[order]
    s = log_odds(toxic, clean, n_t, n_c)
    up = s > 0
    drift = float(min(0.2, max(0.02, -math.log1p(-min(0.5, toxic[up].sum() / n_t)))))
    background = clean + PRIOR * n_t * (toxic + clean) / (n_t + n_c)
    decay = solve_decay(np.append(background, max(0.0, n_c - background.sum())) / max(n_c, background.sum()), np.append(s, 0.0) - drift) if up.any() else 1.0
    keep = s != 0
    model = Model(h[keep], s[keep], drift, decay, 1.0)
    if up.any():
        model.scale, model.floor = _calibrate(sample.where("toxic = 0"), model)
    scratch.drop(sample)
    return model


def _calibrate(clean: DataFrame, model: Model) -> tuple[float, float]:
    """K, and the least score it holds for, from the segments of clean documents: the largest of (segments of at least x + 3) exp(lambda x) / tokens, x up to the median positive score."""
    marks = np.unique(np.quantile(model.scores[model.scores > 0] - model.drift, [0, 0.1, 0.2, 0.3, 0.4, 0.5]))

    def run(batches):
        tokens, above = 0, np.zeros(len(marks), np.int64)
        for b in batches:
            for i, j in text_slices(b.column(0)):
                words = Words(b.column(0).slice(i, j - i), STEM)
                tokens += len(words.hash)
                scores = model.score(words.hash)
                for d in np.unique(words.doc[scores > 0]):
                    a, z = words.first[d], words.first[d + 1]
                    for _, _, x in maximal_segments(model.score_text(words.full[a:z], scores[a:z])):
                        above += x >= marks
        yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([above.tolist()])], ["tokens", "above"])

    rows = clean.select("text").mapInArrow(run, "tokens long, above array<long>").collect()
    tokens, above = sum(r.tokens for r in rows), np.sum([r.above for r in rows], axis=0)
    return float(np.max((above + 3) * np.exp(model.decay * marks)) / max(tokens, 1)), float(marks[0])


def _judged(texts: pa.Array, model: Model, significant: float, passage: float) -> Iterator[tuple[int, int, float, float, list]]:
    """(row, tokens, top score, p-value, significant passages) of each text that is toxic."""
    for i, j in text_slices(texts):
        words = Words(texts.slice(i, j - i), STEM)
        scores = model.score(words.hash)
        for d in np.unique(words.doc[scores > 0]):
            first, last = words.first[d], words.first[d + 1]
            n = int(last - first)
            segments = maximal_segments(model.score_text(words.full[first:last], scores[first:last]))
            if not segments:
                continue
            p = poisson_p_value([x for _, _, x in segments], n, model.decay, model.scale, model.floor)
            if p <= significant:  # passages are found as each occurrence scores in full: a second one is a passage too
                segments = maximal_segments(scores[first:last])
                e = [(a, b, x, model.scale * n * math.exp(-model.decay * x)) for a, b, x in segments]
                top = max(x for _, _, x, _ in e)
                yield i + int(d), n, top, p, [v for v in e if v[3] <= passage or v[2] == top]


def toxic_passages(docs: DataFrame, model: Model, significant: float = SIGNIFICANT, passage: float = PASSAGE) -> DataFrame:
    """One row for each toxic document with every significant passage: tokens first to last, score, E-value.

    Clean, empty and null texts give no row. A row with a null doc_id is judged too. Repeated rows give repeated rows, an
    empty table none; other columns are ignored. Whether a text is toxic goes by scores damped for bursts of a word,
    passages by the full ones; e_value ties with passage count as significant. A task holds a few dozen bytes for each
    byte of its longest text.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = list(_judged(b.column(1), handle.value, significant, passage))
            ids = b.column(0).take(pa.array([r[0] for r in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([r[1] for r in found], pa.int64()), pa.array([len(r[4]) for r in found], pa.int32()), pa.array([r[2] for r in found], pa.float64()), pa.array([r[3] for r in found], pa.float64()),
                 pa.array([[{"first": a, "last": z, "score": x, "e_value": e} for a, z, x, e in r[4]] for r in found], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])))],
                ["doc_id", "n_tokens", "n_passages", "top_score", "p_value", "passages"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def drop_toxic(docs: DataFrame, model: Model, significant: float = SIGNIFICANT) -> DataFrame:
    """docs without the toxic documents, in one pass without a shuffle.

    Null and empty texts stay, and rows with a null doc_id that aren't toxic. Repeated rows stay or go together; an empty
    table stays empty; columns stay as they are whatever their names.
    """
    handle, at, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.schema

    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[r[0] for r in _judged(b.column(at), handle.value, significant, PASSAGE)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxic_passages(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
