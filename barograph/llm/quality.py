"""Operator 2: quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import Words, as_bytes, labelled, slices

# Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 sentence mark, 6 comma-like,
# 7 exclamation, 8 bar, 9 other punctuation, 10 control, 11 beyond ASCII.
_CLASS = np.array([
    0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in (32, 9) else 4 if b in (10, 13)
    else 5 if b in b".?" else 6 if b in b",;:" else 7 if b == 33 else 8 if b == 124 else 9 if 33 <= b <= 126
    else 11 if b >= 128 else 10 for b in range(256)])
_CLASSES = 12
_MARK = (_CLASS >= 5) & (_CLASS <= 9)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of document statistics per text, from bytes and words alone."""
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    kind = np.bincount(doc * _CLASSES + _CLASS[buf], minlength=n * _CLASSES).reshape(n, _CLASSES)
    words = Words(texts, lower=True)
    count = words.count
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    length = words.end - words.start
    head, tail = flat[words.start] if len(length) else flat[:0], flat[words.end - 1] if len(length) else flat[:0]
    total = lambda x: np.bincount(words.doc, x, n)
    order = np.lexsort((words.hash, words.doc))
    fresh = np.concatenate([[True], (words.hash[order][1:] != words.hash[order][:-1])
                            | (words.doc[order][1:] != words.doc[order][:-1])])[:len(order)]
    distinct = np.bincount(words.doc[order][fresh], minlength=n)
    lines = [t.split(b"\n") for t in texts]
    many = np.fromiter(map(len, lines), np.int64, n)
    unique = np.fromiter((len(set(x)) for x in lines), np.int64, n)
    some = np.maximum(count, 1)
    columns = [np.log1p(size), np.log1p(count), np.log1p(many), size / np.maximum(many, 1), unique / np.maximum(many, 1),
               *(kind / np.maximum(size, 1)[:, None]).T, total(length) / some, total(length * length) / some,
               np.bincount(words.doc, length <= 3, n) / some, np.bincount(words.doc, length >= 12, n) / some,
               total((_CLASS[head] == 1)) / some, total(_MARK[tail]) / some, total(_MARK[head]) / some,
               total(_CLASS[tail] == 1) / some, distinct / some,
               kind[:, 5:10].sum(1) / some, total(_CLASS[tail] == 9) / some]
    return np.stack(columns, 1).astype(np.float32)


class Trees:
    """Boosted complete binary trees as flat arrays; a whole block walks down level by level."""

    def __init__(self, depth: int, prior: float):
        self.depth, self.prior = depth, prior
        self.feature, self.above, self.leaf = [], [], []

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, above, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, bins: int = 64, rate: float = 0.2,
        least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Histogram gradient boosting for the logistic loss: quantile bins, one histogram per level."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Trees(depth, float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) for k in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1)  # x <= edge
    flat = binned + np.arange(f) * bins
    margin = np.full(n, model.prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, above = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            cell = ((node - base)[:, None] * (f * bins) + flat).ravel()
            g = np.bincount(cell, np.repeat(grad, f), width * f * bins).reshape(width, f, bins).cumsum(2)
            h = np.bincount(cell, np.repeat(hess, f), width * f * bins).reshape(width, f, bins).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g)**2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(width, -1).max(1) > 1e-6):
                c, b = divmod(int(best[k]), bins)
                if b < len(edges[c]):
                    feature[base + k], above[base + k] = c, edges[c][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > above[node])
        at = node - (2**depth - 1)
        leaf = -rate * np.bincount(at, grad, 2**depth) / (np.bincount(at, hess, 2**depth) + ridge)
        margin += leaf[at]
        model.feature.append(feature)
        model.above.append(above)
        model.leaf.append(leaf)
    return model


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, rows: int = 30_000) -> DataFrame:
    """Quality score of every text; only statistics of the text itself are inputs.

    The model is fitted on the driver over at most about ``rows`` labelled rows outside the
    held-out fold (crc32(doc_id as text) mod ``folds`` = ``fold``). Null texts count as
    empty and are scored; null ids are not held out; with no labels or one class alone the
    score is constant. Returns doc_id, held_out, score, predicted.
    """
    width = statistics([b""]).shape[1]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                yield pd.DataFrame({"x": list(statistics(as_bytes(part["text"]))), "label": part["label"]})

    sample = labelled(docs, labels, "quality", rows, folds, fold).mapInPandas(
        describe, "x array<float>, label int").toPandas()
    x = np.stack(sample["x"]) if len(sample) else np.zeros((0, width), np.float32)
    model = fit(x, sample["label"].to_numpy(float))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                p = model.probability(statistics(as_bytes(part["text"])))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": p,
                                    "predicted": (p >= 0.5).astype(np.int32)})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        judge, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")
