"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are cut into bins; cyclic boosting visits one feature after another (then one chosen pair
after another) and adds a shallow tree over its bins to that feature's lookup table. A score is the logistic of the sum of
table entries, looked up for a whole Arrow batch at once.

It is fitted on at most TRAIN_ROWS labelled rows, those with the smallest hash of doc_id, and only on rows whose
crc32(doc_id as text) mod 5 isn't 0. labels, lang, source and doc_id are no inputs of a score.

Edge cases: null or empty text: scored by its features, all of them 0. Labels that are null are left out; of several labels of
one doc_id the least counts. Without labels, or with one class only, every score is the (smoothed) share of label 1. Repeated
rows are scored each for itself; ties in features fall into one bin; an empty table gives no rows; null doc_id: held_out null;
very long texts are read whole; further columns are ignored by the query and kept by reject_documents.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, text_column

TRAIN_ROWS, THRESHOLD, FOLDS = 20_000, 0.3, 5
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, L2 = 32, 8, 150, 40, 8, 0.15, 2.0
FEATURES = ("log_words", "word_length", "symbols", "upper", "bars", "bangs", "distinct_words", "top_word", "same_as_last", "repeated_lines", "distinct_triples", "digits", "words_per_line", "odd_ends", "stops", "top_triple")
ODD_END = re.compile(r"[#$%&*!|~^=+]{2,}(?=\s|$)")


def features(text: str) -> list[float]:
    """FEATURES of one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text) - text.count(" ")
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    digits = len(re.findall(r"\d", text))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    counts = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    marks = chars - letters - digits
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        marks / chars,
        upper / max(1, letters),
        text.count("|") / n,
        text.count("!") / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(triples) / max(1, n - 2),
        digits / chars,
        n / max(1, len(lines)),
        len(ODD_END.findall(text)) / n,
        text.count(".") / n,
        max(triples.values(), default=0) / max(1, n - 2),
    ]


@dataclass
class Model:
    """Bin edges and lookup tables; some 20 kB, whatever the corpus."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, k], side="right")]
        coarse = [np.searchsorted(edges, x[:, k], side="right") for k, edges in enumerate(self.pair_edges)]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Edges of about equally filled bins."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + L2)


def stump_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, per bin, of a tree of that depth over ordered bins with gradient and curvature sums g and h."""
    out = np.full(len(g), g.sum() / (h.sum() + L2))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = gain(left_g, left_h) + gain(g.sum() - left_g, h.sum() - left_h)
        k = int(gains.argmax()) + 1
        if gains[k - 1] > gain(g.sum(), h.sum()) + 1e-9:
            out[:k], out[k:] = stump_tree(g[:k], h[:k], depth - 1), stump_tree(g[k:], h[k:], depth - 1)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values over a grid of bins, and the gain, of the best tree that cuts one axis once and then each side along the other."""
    best = (-1.0, None)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            leaves, total = np.zeros_like(a), 0.0
            for rows in (slice(0, k), slice(k, None)):
                sg, sh = a[rows].sum(0), b[rows].sum(0)
                lg, lh = np.cumsum(sg)[:-1], np.cumsum(sh)[:-1]
                gains = gain(lg, lh) + gain(sg.sum() - lg, sh.sum() - lh)
                j = int(gains.argmax()) + 1
                leaves[rows, :j] = sg[:j].sum() / (sh[:j].sum() + L2)
                leaves[rows, j:] = sg[j:].sum() / (sh[j:].sum() + L2)
                total += float(gains[j - 1])
            if total > best[0]:
                best = (total, leaves.T if flip else leaves)
    return best[1], best[0]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    width = len(FEATURES)
    if n < 2 or y.min() == y.max():
        return Model(base, [np.zeros(0)] * width, [np.zeros(1)] * width, [], [np.zeros(0)] * width, [])
    edges = [cuts(x[:, k], BINS) for k in range(width)]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, base)

    def sums(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(places, y - p, size), np.bincount(places, p * (1 - p), size)

    for _ in range(ROUNDS):
        for k in range(width):
            step = RATE * stump_tree(*sums(bins[k], len(tables[k])))
            tables[k] += step
            total += step[bins[k]]
    coarse_edges = [cuts(x[:, k], PAIR_BINS) for k in range(width)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse_edges)]
    shape = [len(e) + 1 for e in coarse_edges]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(s.reshape(shape[a], shape[b]) for s in sums(coarse[a] * shape[b] + coarse[b], shape[a] * shape[b]))

    ranked = sorted(((-cross_tree(*grid(a, b))[1], a, b) for a, b in combinations(range(width), 2) if min(shape[a], shape[b]) > 1))
    pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    pair_tables = [np.zeros((shape[a], shape[b])) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            step = RATE * cross_tree(*grid(a, b))[0]
            pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return Model(base, edges, tables, pairs, coarse_edges, pair_tables)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def featured(docs: DataFrame, keep: str) -> DataFrame:
    """The columns named in keep (a schema) and x, the features of text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])

    return map_batches(docs, run, f"{keep}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most so many labelled rows outside the held-out fold."""
    labelled = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("long").alias("quality"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # so few that it can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    found = sorted((r["doc_id"], r["quality"], r["x"]) for r in featured(texts, "doc_id long, quality long").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect())
    x = np.array([r[2] for r in found], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in found], float))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t.as_py()) for t in batch.column(1)], float)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_column().alias("text")), run, "doc_id long, score double")


def reject_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, as they were, whose text scores THRESHOLD or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t.as_py()) for t in batch.column(1)], float)
        return batch.select([0]).filter(pa.array(model.score(x) >= THRESHOLD))

    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    held = docs.select(row, text_column().alias("_text"))
    return map_batches(held, run, f"_row {held.schema['_row'].dataType.simpleString()}").select("_row.*")


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
