"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from a document's bytes in numpy. Trees are grown on the driver from a bounded sample of labelled rows, level by level over
quantile bins, and flattened into arrays; a batch of documents walks all trees with array lookups.

Defined results: a null text is empty; an empty text has statistics of zeros and a score like any other; repeated rows get equal scores; with no
labelled rows every score is 0.5; an empty table gives an empty result; only the text decides a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import learns, numbered, shingles, slices, span_hashes, texts_of, word_spans
from kvloom.llm.training import labelled

#: Labelled rows that a model is fitted on, about.
MOST_ROWS = 20_000
THRESHOLD = 0.3
_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r", ".", ",;:", "!?", "#$%&*", "\"'()-", "@/\\_=<>[]{}|~^+`")
_CODE = np.full(256, len(_GROUPS), np.int64)
for _k, _chars in enumerate(_GROUPS):
    _CODE[list(_chars.encode())] = _k
_CODE[128:] = len(_GROUPS) + 1
_CODES = len(_GROUPS) + 2


def statistics(run: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of statistics for each document."""
    n = len(at) - 1
    size = np.diff(at)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * _CODES + _CODE[run], minlength=n * _CODES).reshape(n, _CODES)
    share = kinds / np.maximum(size, 1)[:, None]
    start, end, first = word_spans(run, at)
    count = np.diff(first)
    some = np.maximum(count, 1)
    word_doc = np.repeat(np.arange(n), count)
    length = (end - start).astype(np.float64)
    mean = np.bincount(word_doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(word_doc, length**2, n) / some - mean**2, 0))
    hashed = span_hashes(run, start, end)
    _, repeat = numbered(hashed, first)
    distinct = np.bincount(word_doc, repeat == 0, n) / some
    five, five_first = shingles(run, at)
    _, repeat5 = numbered(five, five_first)
    fives = np.diff(five_first)
    distinct5 = np.bincount(np.repeat(np.arange(n), fives), repeat5 == 0, n) / np.maximum(fives, 1)
    breaks = np.flatnonzero(run == 10)
    line_start = np.unique(np.concatenate([at[:-1][size > 0], breaks + 1]))
    line_start = line_start[line_start < len(run)]
    line_end = np.append(line_start[1:], len(run))
    line_first = np.searchsorted(line_start, at, "left")
    lines = np.diff(line_first)
    _, again = numbered(span_hashes(run, line_start, line_end), line_first)
    distinct_lines = np.bincount(np.repeat(np.arange(n), lines), again == 0, n) / np.maximum(lines, 1)
    capital = np.bincount(word_doc, _CODE[run[start]] == 1, n) / some
    short = np.bincount(word_doc, length <= 2, n) / some
    long = np.bincount(word_doc, length > 12, n) / some
    return np.column_stack([share, np.log1p(size), np.log1p(count), mean, spread, distinct, distinct5, np.log1p(lines), distinct_lines, size / np.maximum(lines, 1), capital, short, long, count / np.maximum(kinds[:, 6] + 1, 1)]).astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of equal depth: node i's children are 2i+1 and 2i+2; a value above the node's threshold goes right."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2**self.depth - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 2.0) -> Trees:
    """Boost logistic loss; a split is the best bin edge of any feature by second-order gain."""
    n, k = x.shape
    inner = 2**depth - 1
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    model = Trees(depth, float(np.log(mean / (1 - mean))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)))
    if n == 0:
        return model
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0, method="lower").astype(np.float32)  # bins - 1 edges a feature
    code = np.stack([np.searchsorted(edges[:, j], x[:, j], "left") for j in range(k)], axis=1)
    flat = code + np.arange(k) * bins
    raw = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            local = node - (width - 1)
            key = (local[:, None] * (k * bins) + flat).ravel()
            sg = np.bincount(key, np.repeat(g, k), width * k * bins).reshape(width, k, bins).cumsum(2)
            sh = np.bincount(key, np.repeat(h, k), width * k * bins).reshape(width, k, bins).cumsum(2)
            left_g, left_h = sg[:, :, :-1], sh[:, :, :-1]
            right_g, right_h = sg[:, :, -1:] - left_g, sh[:, :, -1:] - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - sg[:, :, -1:] ** 2 / (sh[:, :, -1:] + l2)
            gain[(left_h < 1) | (right_h < 1)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            f, b = best // (bins - 1), best % (bins - 1)
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            at = np.arange(width) + width - 1
            model.feature[t, at] = f
            model.threshold[t, at] = np.where(worth, edges[b, f], np.inf)
            node = 2 * node + 1 + (worth[local] & (code[np.arange(n), f[local]] > b[local]))
        leaf = node - inner
        values = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        model.leaf[t] = values
        raw += values[leaf]
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Trees:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(list(statistics(data, at))), rows.column(1)], ["x", "label"])

    held = labelled(docs, labels, "quality", most).mapInArrow(run, "x array<float>, label int").toPandas()
    order = np.lexsort(np.stack(held["x"]).T) if len(held) else []  # equal samples give equal models, however they were gathered
    x = np.stack(held["x"])[order] if len(held) else np.zeros((0, _CODES + 13), np.float32)
    return grow(x, held["label"].to_numpy(np.float64)[order] if len(held) else np.zeros(0))


def score(docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.scores(statistics(data, at)))], ["doc_id", "score"])

    return texts_of(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, "doc_id long, score double")


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    """The contract's columns."""
    held: Column = ~learns()
    return scores.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
