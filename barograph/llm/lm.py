"""Operator 9: language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood bigram, the maximum-likelihood unigram
and the uniform distribution. The weights depend on the bucket (binary magnitude) of the
context's count and are learned by expectation-maximisation on held-out counts, formed by
deletion: each training occurrence is judged by the counts without itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import MULT, Words, as_bytes, ask, buckets_for, chunked, mix, packed, spread, squeeze, told, unsqueeze

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BUCKETS, CELLS = 48, 256  # context buckets; quantised levels of a ratio or count


def held_out_ids(ids: pd.Series, folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(str(int(i)).encode()) % folds == fold if pd.notna(i) else False for i in ids], bool)


class _Tokens:
    """Tokens of one chunk: unigram and bigram keys of every occurrence, end tokens included."""

    def __init__(self, group: pd.DataFrame, folds: int, fold: int):
        words = Words(as_bytes(group["text"]), lower=True)
        docs = len(group)
        self.n = words.count + 1
        total = int(self.n.sum())
        last = np.cumsum(self.n) - 1
        token = np.full(total, END, np.uint64)
        inner = np.ones(total, bool)
        inner[last] = False
        token[inner] = words.hash
        context = np.concatenate([[START], token[:-1]])
        context[last - self.n + 1] = START
        self.doc = np.repeat(np.arange(docs), self.n)
        self.held = held_out_ids(group["doc_id"], folds, fold)
        uni, self.uni_at = np.unique(mix(token * MULT[1] + np.uint64(1)), return_inverse=True)
        bi, first, self.bi_at = np.unique(mix(context * MULT[2] + token * MULT[3]), return_index=True,
                                          return_inverse=True)
        keys = np.concatenate([uni, bi])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        place = np.empty(len(keys), np.int64)
        place[self.order] = np.arange(len(keys))
        self.uni_place, self.bi_place = place[:len(uni)], place[len(uni):]
        self.bi_uni = self.uni_at[first]
        # a context's count is its token's; a document's start counts as often as its end
        before = np.concatenate([[0], self.uni_at[:-1]])
        before[last - self.n + 1] = self.uni_at[last[0]] if docs else 0
        self.bi_ctx = before[first]
        self.learn = ~self.held[self.doc]
        self.uni_count = np.bincount(self.uni_at, self.learn, len(uni)).astype(np.int64)
        self.bi_count = np.bincount(self.bi_at, self.learn, len(bi)).astype(np.int64)


def _total(index: np.ndarray, vals: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Twice the learning count of each key, plus 1 in the first chunk that holds the key."""
    own = np.concatenate(list(map(unsqueeze, vals)))
    count = np.zeros(index.max() + 1, np.int64)
    np.add.at(count, index, own)
    out = count[index] * 2
    out[np.unique(index, return_index=True)[1]] += 1
    return out


def _magnitude(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(np.maximum(count, 0) + 1)), BUCKETS - 1).astype(np.int64)


def _level(x: np.ndarray, low: float, step: float) -> np.ndarray:
    """0 for 0, else 1 + steps of the binary logarithm above ``low``."""
    with np.errstate(divide="ignore"):
        y = np.rint((np.log2(x) - low) / step)
    return np.where(x > 0, 1 + np.clip(y, 0, CELLS - 2), 0).astype(np.int64)


def learn_weights(cells: np.ndarray, weight: np.ndarray, tokens: int, vocabulary: int, steps: int = 60) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) per context bucket by EM on counted cells."""
    bucket, bi, uni = cells // CELLS**2, cells // CELLS % CELLS, cells % CELLS
    p = np.stack([np.where(bi > 0, 2.0 ** (-48 + (bi - 1) * 0.25), 0.0),
                  np.where(uni > 0, 2.0 ** ((uni - 1) * 0.25), 0.0) / max(tokens - 1, 1),
                  np.full(len(cells), 1.0 / (vocabulary + 1))], 1)
    mean = np.full((1, 3), 1 / 3)
    out = np.tile(mean, (BUCKETS, 1))
    for _ in range(steps):
        share = p * out[bucket]
        share *= (weight / share.sum(1))[:, None]
        new = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], 1)
        mass = new.sum(1, keepdims=True)
        mean = new.sum(0, keepdims=True) / max(mass.sum(), 1e-300) if mass.sum() else mean
        # one pseudo-count of the common mixture keeps empty buckets and the uniform share positive
        out = (new + mean + 1e-6) / (mass + 1 + 3e-6)
    return out


def score(docs: DataFrame, folds: int = 10, fold: int = 0) -> DataFrame:
    """Log10 probability of every text under a bigram model learned from the other folds.

    Rows with crc32(doc_id as text) mod ``folds`` = ``fold`` are held out. A null text is
    empty and scores its end token alone; a null id learns. Repeated rows count each time
    and are scored each time. Input columns other than doc_id and text are not read. An
    empty table gives an empty result. A chunk of a few MB of text is in memory at a time.
    """
    chunks, n_chunks = chunked(docs)
    bounds = spread(buckets_for(n_chunks, 0.12))

    def emit(chunk: int, group: pd.DataFrame) -> pd.DataFrame:
        t = _Tokens(group, folds, fold)
        counts = np.concatenate([t.uni_count, t.bi_count])[t.order]
        return packed(chunk, t.keys, bounds, lambda part: squeeze(counts[part]))

    counts = ask(chunks, emit, _total)
    paired = chunks.groupBy("chunk").cogroup(counts.groupBy("chunk"))

    def tally(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        t = _Tokens(group.sort_values("row"), folds, fold)
        got = told(answers)
        count, first = got >> 1, got & 1
        c_uni, c_bi = count[t.uni_place], count[t.bi_place]
        some = t.bi_count > 0
        ctx, word, both = c_uni[t.bi_ctx][some], c_uni[t.bi_uni][some], c_bi[some]
        ratio = (both - 1) / np.maximum(ctx - 1, 1)
        cell = (_magnitude(ctx - 1) * CELLS + _level(ratio, -48, 0.25)) * CELLS + _level(word - 1, 0, 0.25)
        cells, at = np.unique(cell, return_inverse=True)
        weight = np.bincount(at, t.bi_count[some], len(cells)).astype(np.int64)
        vocabulary = int((first[t.uni_place] * (c_uni > 0)).sum())
        return pd.DataFrame({"cell": np.append(cells, [-1, -2]).astype(np.int64),
                             "weight": np.append(weight, [int(t.learn.sum()), vocabulary]).astype(np.int64)})

    seen = paired.applyInPandas(tally, "cell long, weight long").groupBy("cell").agg(F.sum("weight").alias("weight"))
    seen = {r["cell"]: r["weight"] for r in seen.collect()}  # at most BUCKETS * CELLS**2 cells, whatever the input
    tokens, vocabulary = seen.pop(-1, 0), seen.pop(-2, 0)
    weights = learn_weights(np.fromiter(seen, np.int64, len(seen)), np.fromiter(seen.values(), float, len(seen)),
                            tokens, vocabulary)

    def finish(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        t = _Tokens(group, folds, fold)
        count = told(answers) >> 1
        c_uni, c_bi = count[t.uni_place], count[t.bi_place]
        ctx = c_uni[t.bi_ctx]
        w = weights[_magnitude(ctx)]
        p = (w[:, 0] * c_bi / np.maximum(ctx, 1) + w[:, 1] * c_uni[t.bi_uni] / max(tokens, 1)
             + w[:, 2] / (vocabulary + 1))
        base = np.log10((c_uni + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        docs_here = len(group)
        return pd.DataFrame({
            "doc_id": group["doc_id"].astype("Int64"), "held_out": t.held, "n_tokens": t.n,
            "n_known": np.bincount(t.doc, c_uni[t.uni_at] > 0, docs_here).astype(np.int64),
            "train_tokens": np.full(docs_here, tokens, np.int64),
            "base_score": np.bincount(t.doc, base[t.uni_at], docs_here),
            "score": np.bincount(t.doc, np.log10(p)[t.bi_at], docs_here)})

    return paired.applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                        "train_tokens long, base_score double, score double")
