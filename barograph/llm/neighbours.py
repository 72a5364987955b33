"""Operator 7: approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample with a penalty on large clusters. Every vector is
posted to its nearest centroid and, near a boundary, to further ones; a query walks a
neighbour graph over the centroids in memory and opens the lists within a distance ratio.
How many lists that takes depends on the vectors: the true neighbours of some queries are
found among all rows first, and the search is widened until it would find them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barograph.llm.common import keep

LIST_ROWS = 4096  # posting rows of one task's block
AT_ONCE = 256  # queries compared with a block at once


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, weight: float = 0.3) -> np.ndarray:
    """k-means whose assignment pays for joining clusters over the mean size."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    size = np.full(k, len(x) / k)
    for _ in range(rounds):
        d = _squared(x, c)
        d += weight * np.median(d.min(1)) * np.maximum(size * k / len(x) - 1, 0)
        near = d.argmin(1)
        size = np.bincount(near, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        some = size > 0
        c[some] = total[some] / size[some, None]
        for j in np.flatnonzero(~some):  # an empty cluster restarts beside a member of the largest
            c[j] = x[rng.choice(np.flatnonzero(near == size.argmax()))]
    return c


class Graph:
    """Neighbour graph over the centroids; best-first search of many queries at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, entries: int = 16):
        k = len(centroids)
        self.c = centroids
        degree = min(degree, k - 1) or 1
        near = np.argsort(_squared(centroids, centroids), axis=1)[:, 1:degree + 1] if k > 1 else np.zeros((1, 1), int)
        rng = np.random.default_rng(11)
        self.links = np.concatenate([near, rng.integers(0, k, (k, 4))], 1)  # a few far links keep it connected
        self.entry = np.unique(np.linspace(0, k - 1, min(entries, k)).astype(int))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of the ``width`` nearest found, nearest first."""
        k = len(self.c)
        width = min(width, k)
        out_c, out_d = np.empty((len(q), width), np.int64), np.empty((len(q), width))
        for i, v in enumerate(q):
            seen = np.zeros(k, bool)
            dist = np.full(k, np.inf)
            fresh = self.entry
            done = np.zeros(k, bool)
            while True:
                seen[fresh] = True
                dist[fresh] = ((self.c[fresh] - v)**2).sum(1)
                best = np.argpartition(dist, width - 1)[:width]
                grow = best[seen[best] & ~done[best]]
                if not len(grow):
                    break
                done[grow] = True
                fresh = np.unique(self.links[grow])
                fresh = fresh[~seen[fresh]]
                if not len(fresh):
                    continue
            rest = np.flatnonzero(~seen)
            if seen.sum() < width:  # parts of the graph that no entry reaches
                dist[rest] = ((self.c[rest] - v)**2).sum(1)
            out_c[i] = np.argsort(dist, kind="stable")[:width]
            out_d[i] = dist[out_c[i]]
        return out_c, out_d


def _closest(q: np.ndarray, names: np.ndarray, x: np.ndarray, ids: np.ndarray, middle: np.ndarray, k: int,
             bound: np.ndarray | float = np.inf) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows of ``x``, distances) of each query's ``k`` nearest rows but its own, nearest first.

    ``bound`` is a squared distance that a query's nearest rows are known to keep within.
    """
    near = x - middle
    most = (near * near).sum(1).max()
    for a in range(0, len(q), AT_ONCE):
        moved = q[a:a + AT_ONCE] - middle
        d = _squared(moved, near)
        d[names[a:a + AT_ONCE, None] == ids] = np.inf
        # products, which may round, sort out who can be among the nearest; differences decide
        kth = np.minimum(np.partition(d, min(k, len(x)) - 1)[:, min(k, len(x)) - 1], np.broadcast_to(bound, len(q))[a:a + AT_ONCE])
        may = d <= (kth + 1e-14 * (x.shape[1] + 8) * (most + (moved * moved).sum(1)))[:, None]
        may &= d < np.inf
        for i in np.flatnonzero(may.any(1)):
            js = np.flatnonzero(may[i])
            s = np.sqrt(((x[js] - q[a + i])**2).sum(1))
            best = np.lexsort((ids[js], s))[:k]
            best = best[s[best] < np.inf]
            yield a + i, js[best], s[best]


def _true_neighbours(rows: DataFrame, names: np.ndarray, q: np.ndarray, middle: np.ndarray, k: int, lists_of) -> list[list]:
    """For each of the few queries ``q``, the lists that hold its ``k`` nearest of all rows, an entry per neighbour.

    A task keeps its own ``k`` best per query, so what is exchanged does not grow with its rows.
    """
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, q.shape[1])))] * len(q)
        for batch in batches:
            if not len(batch):
                continue
            x, ids = np.stack(batch["v"]), batch["vec_id"].to_numpy(np.int64)
            for i, js, s in _closest(q, names, x, ids, middle, k):
                s, name, v = (np.concatenate(both) for both in zip(kept[i], (s, ids[js], x[js]), strict=True))
                pick = np.lexsort((name, s))[:k]
                kept[i] = s[pick], name[pick], v[pick]
        for i, (s, name, v) in enumerate(kept):
            if len(s):
                r, c = lists_of(v - middle)
                yield pd.DataFrame({"query": i, "score": s, "vec_id": name, "lists": np.split(c, np.searchsorted(r, np.arange(1, len(s))))})

    by = W.partitionBy("query").orderBy("score", "vec_id")
    top = rows.mapInPandas(best, "query long, score double, vec_id long, lists array<long>").withColumn(
        "place", F.row_number().over(by)).where(F.col("place") <= k).select("query", "lists").collect()
    held: list[list] = [[] for _ in range(len(q))]
    for r in top:
        held[r["query"]].append(r["lists"])
    return held


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, sample_rows: int = 20_000, list_size: int = 64,
            boundary: float = 0.12, copies: int = 4, ratio: float = 0.25, lists: int = 96, recall: float = 0.97,
            tries: int = 256) -> DataFrame:
    """The ``k`` nearest found rows of each query (vec_id divisible by ``every``), by Euclidean distance.

    Null or zero vectors, vectors with null or non-finite parts and vectors of another than
    the most frequent length take no part. ``sample_rows`` bounds the fitting sample (all
    rows are indexed); a vector joins up to ``copies`` lists within (1 + ``boundary``) of
    its nearest centroid's distance, a query opens up to ``lists`` within (1 + ``ratio``).
    Both are widened until the lists opened by ``tries`` of the queries hold the share
    ``recall`` of their true neighbours among all rows, up to every list if need be.
    Lists over LIST_ROWS rows, as identical vectors make, are split over several tasks.
    Ties go to the smaller vec_id; repeated ids are one candidate each row. Returns query_id,
    rank, vec_id, score; queries without candidates return nothing.
    """
    part = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.forall(part, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), part.alias("v")).where(
        F.col("vec_id").isNotNull() & good & F.exists("v", lambda v: v != 0)).withColumn("dim", F.size("v"))
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim, n = dims
    rows = rows.where(F.col("dim") == dim).select("vec_id", "v")
    draw = F.xxhash64("vec_id") / F.lit(2.0**64) + 0.5 < sample_rows / n
    drawn = (rows.where(draw) if n > sample_rows else rows).toPandas()
    if not len(drawn):
        drawn = rows.limit(sample_rows).toPandas()
    sample, sample_ids = np.stack(drawn["v"]), drawn["vec_id"].to_numpy(np.int64)
    # products of vectors far from the origin would lose their differences; a median, as no outlier moves it
    middle = np.median(sample, axis=0)
    sample = sample - middle
    distinct = len(np.unique(sample, axis=0))
    count = int(max(1, min(n // list_size, distinct, 1024)))
    centroids = balanced_centroids(sample, count)
    graph = Graph(centroids)

    def lists_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every posting, by row."""
        d = _squared(x, centroids)
        near = np.argsort(d, axis=1, kind="stable")[:, :copies]
        dn = np.sqrt(np.take_along_axis(d, near, 1))
        r, c = np.nonzero(dn <= dn[:, :1] * (1 + boundary))
        return r, near[r, c]

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"])
            r, to = lists_of(x - middle)
            yield pd.DataFrame({"list": to, "vec_id": batch["vec_id"].to_numpy()[r], "v": [x[i].tobytes() for i in r]})

    postings = keep(rows.mapInPandas(post, "list long, vec_id long, v binary"))
    sizes = postings.groupBy("list").count()  # one row per centroid, of which there are at most 1024
    held = np.zeros(count, np.int64)
    for r in sizes.collect():
        held[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-held // LIST_ROWS))

    def opened(q: np.ndarray, lists: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of every list to open, by query, nearest first."""
        c, d = graph.search(q, lists)
        d = np.sqrt(d)
        room = np.cumsum(held[c], 1) - held[c]  # rows in nearer lists
        r, j = np.nonzero((d <= d[:, :1] * (1 + ratio)) | (room < 12 * copies * k))
        return r, c[r, j]

    asked = rows.where(F.col("vec_id") % every == 0)
    probed = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(tries).toPandas()
    if len(probed):
        q = np.stack(probed["v"])
        truth = _true_neighbours(rows, probed["vec_id"].to_numpy(np.int64), q, middle, k, lists_of)
        q = q - middle
        wanted = sum(map(len, truth))
        while True:
            r, c = opened(q, lists, ratio)
            open_ = np.zeros((len(q), count), bool)
            open_[r, c] = True
            if sum(open_[i, near].any() for i, each in enumerate(truth) for near in each) >= recall * wanted or open_.all():
                break
            lists, ratio = lists + -(-lists // 4), ratio * 1.25 if ratio < 1000 else 1e300

    r, c = lists_of(sample)
    order = np.argsort(c, kind="stable")
    members = np.split(r[order], np.searchsorted(c[order], np.arange(1, count)))  # sample rows of each list

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"])
            q, ids = x - middle, batch["vec_id"].to_numpy()
            r, c = opened(q, lists, ratio)
            # the sampled rows of the nearest lists bound how far the k-th neighbour can be
            bound = np.full(len(q), np.inf)
            for i, own in enumerate(np.split(c, np.searchsorted(r, np.arange(1, len(q))))):
                some = np.unique(np.concatenate([members[j] for j in own[:8]]))
                some = some[sample_ids[some] != ids[i]]
                if len(some) >= 2 * k:
                    bound[i] = np.partition(((sample[some] - q[i])**2).sum(1), 2 * k - 1)[2 * k - 1]
            m = blocks[c]
            r, to = np.repeat(r, m), np.repeat(c, m)
            block = np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m)
            yield pd.DataFrame({"list": to, "block": block, "query_id": ids[r], "bound": bound[r],
                                "q": [x[i].tobytes() for i in r]})

    queries = asked.mapInPandas(probe, "list long, block long, query_id long, bound double, q binary")
    split = F.array(*[F.lit(int(b)) for b in blocks])
    blocked = postings.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(split, (F.col("list") + 1).cast("int"))))

    def compare(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(ps):
            x = np.frombuffer(b"".join(ps["v"]), np.float64).reshape(len(ps), dim)
            q = np.frombuffer(b"".join(qs["q"]), np.float64).reshape(len(qs), dim)
            ids, names = ps["vec_id"].to_numpy(np.int64), qs["query_id"].to_numpy(np.int64)
            for i, js, s in _closest(q, names, x, ids, middle, k, qs["bound"].to_numpy()):
                out += zip([names[i]] * len(js), ids[js], s, strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = queries.groupBy("list", "block").cogroup(blocked.groupBy("list", "block")).applyInPandas(
        compare, "query_id long, vec_id long, score double")
    by = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
