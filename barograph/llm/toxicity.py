"""Operator 4: toxicity by a chain of linear classifiers.

Categories are predicted in order. Each linear model sees which of the telling words a
text holds and the probabilities of all earlier categories; those it was trained with are
out-of-fold, so later links learn from probabilities as uncertain as at prediction time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import NOT_ALNUM, Words, as_bytes, keep, labelled, slices, without

# A labelled text belongs to a named category if it also holds one of these words; the last link is the label itself.
CATEGORIES = {
    "insult": ("idiot", "moron", "stupid", "dumb", "fool", "clown", "loser", "imbecile"),
    "contempt": ("pathetic", "worthless", "disgusting", "scum", "trash", "garbage", "vermin", "filth"),
    "threat": ("kill", "murder", "hurt", "stab", "strangle", "shoot", "beat", "burn"),
}


PREFIXES = (4, 5, 6)  # bytes of a word's beginning that count as features of their own, for inflected forms


def _held(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, fingerprint) of every distinct word or word beginning of each text.

    Words are lower-cased runs of letters and digits; beginnings have ``PREFIXES`` bytes.
    """
    words = Words(texts, lower=True, gaps=NOT_ALNUM)
    docs, names = [words.doc], [words.hash]
    for size in PREFIXES:
        some = np.flatnonzero(words.end - words.start > size)
        docs.append(words.doc[some])
        names.append(words.beginning(some, size))
    doc, name = np.concatenate(docs), np.concatenate(names)
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])])[:len(doc)]
    return doc[new], name[new]


def _flat(held: pd.Series) -> np.ndarray:
    """All fingerprints in a row; empty arrays reach pandas as floats, which must not round the others."""
    return np.concatenate([np.zeros(0, np.int64), *(np.asarray(w, np.int64) for w in held)])


def logistic(row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, ridge: float = 1e-4,
             steps: int = 200) -> np.ndarray:
    """Weights [words, dense columns, constant] of a ridge logistic regression, by accelerated descent."""
    n, d = len(y), dense.shape[1]
    share = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    w = np.zeros(width + d + 1)
    w[-1] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return w
    # each coordinate's step by its own curvature bound, scaled for the words a text holds at once
    heavy = max(float(np.bincount(row, minlength=n).max(initial=0)), 1.0) + d + 1
    bound = np.concatenate([np.bincount(col, minlength=width), (dense**2).sum(0), [n]]) / (4 * n)
    rate = 1 / (bound * min(heavy, 12.0) + ridge + 1e-9)
    rate[:width] = np.minimum(rate[:width], 4e3)
    look, last = w.copy(), w.copy()
    for k in range(1, steps + 1):
        z = np.bincount(row, look[col], n) + dense @ look[width:-1] + look[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.concatenate([np.bincount(col, r[row], width), dense.T @ r, [r.sum()]])
        grad[:-1] += ridge * look[:-1]
        w = look - rate * grad
        if (w - look) @ (w - last) < 0:  # momentum turned uphill: restart it
            look = w.copy()
        look = w + (k - 1) / (k + 2) * (w - last)
        last = w
    return w


def _apply(w: np.ndarray, row: np.ndarray, col: np.ndarray, dense: np.ndarray, n: int, width: int) -> np.ndarray:
    z = np.bincount(row, w[col], n) + dense @ w[width:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(row: np.ndarray, col: np.ndarray, targets: np.ndarray, fold: np.ndarray, width: int) -> list[np.ndarray]:
    """One weight vector per category; earlier categories enter by out-of-fold probabilities."""
    n, links = targets.shape
    earlier = np.zeros((n, 0))
    models = []
    for k in range(links):
        y = targets[:, k].astype(float)
        models.append(logistic(row, col, earlier, y, width))
        out = np.zeros(n)
        for f in np.unique(fold):
            rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            number = np.full(n, -1)
            number[rest] = np.arange(len(rest))
            some = number[row] >= 0
            w = logistic(number[row[some]], col[some], earlier[rest], y[rest], width)
            number[:] = -1
            number[own] = np.arange(len(own))
            some = number[row] >= 0
            out[own] = _apply(w, number[row[some]], col[some], earlier[own], len(own), width)
        earlier = np.column_stack([earlier, out])
    return models


def chain(docs: DataFrame, labels: DataFrame, rows: int = 20_000, telling: int = 512, folds: int = 3, fold: int = 1,
          inner: int = 4, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> DataFrame:
    """Category probabilities, score (the last link, ``labels.toxic``) and predicted of every whole text.

    Learns from at most about ``rows`` labelled rows outside the held-out fold
    (crc32(doc_id as text) mod ``folds`` = ``fold``). The ``telling`` words whose presence
    differs most between the classes (by z value of the counts that Spark adds up) are the
    inputs. Null texts count as empty; without labels or positives nothing is toxic.
    Returns doc_id, held_out, p_<category>..., score, predicted.
    """
    names = [*categories, "toxic"]
    lexicon = [np.sort(Words([" ".join(w).encode()], lower=True).hash) for w in categories.values()]

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                doc, word = _held(as_bytes(part["text"]))
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "words": [
                    word[a:b].view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    sample = keep(labelled(docs, labels, "toxic", rows, folds, fold).mapInPandas(
        reduce, "doc_id long, label int, words array<long>"))
    size = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    positive, negative = size[1], size[0] - size[1]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at:at + 2000]
                names, where = np.unique(_flat(part["words"]), return_inverse=True)
                of = np.repeat(part["label"].to_numpy(np.int64), [len(w) for w in part["words"]])
                yield pd.DataFrame({"word": names, "t": np.bincount(where, of, len(names)).astype(np.int64),
                                    "n": np.bincount(where, minlength=len(names)).astype(np.int64)})

    word = keep(sample.mapInPandas(count, "word long, t long, n long").groupBy("word").agg(
        F.sum("t").alias("t"), F.sum("n").alias("n")))
    share = F.col("n") / max(size[0], 1)
    apart = F.abs(F.col("t") / max(positive, 1) - (F.col("n") - F.col("t")) / max(negative, 1))
    z = apart / F.sqrt(share * (1 - share) + F.lit(0.5 / max(size[0], 1)))
    best = word.orderBy(z.desc(), "word").limit(telling).select("word").toPandas()["word"]
    chosen = np.sort(best.to_numpy(np.int64).view(np.uint64))
    wanted = np.unique(np.concatenate([chosen, *lexicon])).view(np.int64)
    held = sample.select("doc_id", "label", F.array_intersect(
        "words", F.array(*[F.lit(int(v)) for v in wanted])).alias("words")).toPandas()  # at most ``rows`` short rows

    def columns(doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(chosen, words), max(len(chosen) - 1, 0))
        hit = chosen[at] == words if len(chosen) else np.zeros(len(words), bool)
        return doc[hit], at[hit]

    doc = np.repeat(np.arange(len(held)), [len(w) for w in held["words"]]).astype(np.int64)
    flat = _flat(held["words"]).view(np.uint64)
    row, col = columns(doc, flat)
    toxic = held["label"].to_numpy(int)
    targets = np.stack([*(toxic * (np.bincount(doc, np.isin(flat, lex), len(held)) > 0) for lex in lexicon), toxic], 1)
    inner_fold = held["doc_id"].to_numpy(np.int64) * 2654435761 % 2**32 * inner // 2**32
    models = fit_chain(row, col, targets, inner_fold, len(chosen))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                r, c = columns(*_held(as_bytes(part["text"])))
                earlier = np.zeros((len(part), 0))
                for w in models:
                    earlier = np.column_stack([earlier, _apply(w, r, c, earlier, len(part), len(chosen))])
                out = {"doc_id": part["doc_id"].astype("Int64")} | {
                    f"p_{name}": earlier[:, k] for k, name in enumerate(names[:-1])}
                yield pd.DataFrame(out | {"score": earlier[:, -1], "predicted": (earlier[:, -1] >= 0.5).astype(np.int32)})

    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names[:-1]) + ", score double, predicted int"
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        judge, schema).withColumn("held_out", out_of)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the chain does not call toxic."""
    return without(docs, chain(docs, labels).where("predicted = 1"))
