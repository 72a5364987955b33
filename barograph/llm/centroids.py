"""Operator 12: exact integer k-means by equal-average equal-variance search.

Centroids are sorted by the mean of their components. A vector starts at the centroid whose
mean is next to its own and scans outward. With S the sum of components, V the deviation
from the mean (|x|^2 = S^2/d + V^2) and d the number of components,

    |x - c|^2  >=  (Sx - Sc)^2 / d  +  (Vx - Vc)^2,

so a side of the scan ends once its mean alone is too far, and a centroid between is
rejected by both terms before any component is looked at. What is left is measured in
integers. Bounds are floating point and give way by a relative SLACK, never the distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import keep

LARGEST = 1 << 27  # components up to this size keep 64-term squared distances within a long
SLACK = 1e-9


class Outward:
    """Centroids in order of their sums, and the outward scan of many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.order = np.lexsort((np.arange(len(centroids)), centroids.sum(1)))
        self.c = centroids[self.order]
        self.sum = self.c.sum(1).astype(float)
        self.spread = spread(self.c)
        self.measured = 0  # distances computed in full, for tests and tuning

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid; ties to the smaller number."""
        n, d = x.shape
        k = len(self.c)
        own, dev = x.sum(1).astype(float), spread(x)
        right = np.searchsorted(self.sum, own)
        left = right - 1
        best = np.full(n, np.iinfo(np.int64).max)
        which = np.full(n, k, np.int64)
        rows = np.arange(n)
        while len(rows):
            lgap = np.where(left[rows] >= 0, own[rows] - self.sum[np.maximum(left[rows], 0)], np.inf)
            rgap = np.where(right[rows] < k, self.sum[np.minimum(right[rows], k - 1)] - own[rows], np.inf)
            gap, lefts = np.minimum(lgap, rgap), lgap <= rgap
            limit = best[rows].astype(float) * (1 + SLACK)
            on = gap * gap <= limit * d  # the nearer side decides: the other one is farther still
            on &= gap < np.inf
            rows, gap, lefts, limit = rows[on], gap[on], lefts[on], limit[on]
            at = np.where(lefts, left[rows], right[rows])
            left[rows[lefts]] -= 1
            right[rows[~lefts]] += 1
            close = gap * gap / d + (dev[rows] - self.spread[at])**2 <= limit + SLACK * dev[rows]**2
            some, c = rows[close], at[close]
            self.measured += len(some)
            apart = x[some] - self.c[c]
            far = (apart * apart).sum(1)
            number = self.order[c]
            better = (far < best[some]) | ((far == best[some]) & (number < which[some]))
            best[some[better]], which[some[better]] = far[better], number[better]
        return which, best


def spread(x: np.ndarray) -> np.ndarray:
    """Root of the summed squared deviations from the mean of each row."""
    y = x.astype(float)
    return np.sqrt(((y - y.mean(1, keepdims=True))**2).sum(1))


def integer_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors with ``dim`` finite components."""
    part = F.col("embedding").cast("array<double>")
    good = F.coalesce((F.size(part) == dim) & F.forall(
        part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LARGEST)), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(
        good, F.transform(part, lambda x: F.floor(x * scale).cast("int"))).alias("v")).where("v is not null")


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(list(batch["v"])).astype(np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept.

    Starts from the ``k`` vectors with the smallest sha256 of ``seed`` + vec_id (all, if
    fewer; null ids last, ties by components); each round assigns all vectors and moves every
    non-empty centroid to floor(sum / count); a last assignment follows. Vectors that are
    null, of another length than ``dim``, or hold null or non-finite components take no part,
    nor do those with a component of LARGEST / ``scale`` and more, whose squared distance no
    long could hold. Each row counts, also repeated ids. Only k x dim sums reach the driver.
    Inertias over the range of a long are null.
    """
    rows = keep(integer_vectors(vectors, dim, scale))
    name = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()
    c = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Outward(c)
        count, total = np.zeros(len(c), np.int64), np.zeros((len(c), dim), np.int64)
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                which, _ = search.nearest(x)
                count += np.bincount(which, minlength=len(c))
                for j in np.unique(which):
                    total[j] += x[which == j].sum(0)
        some = np.flatnonzero(count)
        if len(some):
            yield pd.DataFrame({"cluster": some, "n": count[some], "total": list(total[some])})

    for _ in range(rounds if len(c) else 0):
        wide = F.sum("n").cast("decimal(38,0)").alias("n"), *[
            F.sum(F.col("total")[i].cast("decimal(28,0)")).alias(f"s{i}") for i in range(dim)]
        moved = rows.select("v").mapInPandas(sums, "cluster int, n long, total array<long>").groupBy("cluster").agg(*wide).collect()
        after = c.copy()
        for r in moved:
            after[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(dim)]
        if (after == c).all():
            break  # every further round would repeat this one
        c = after
    signs = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Outward(c)
        for batch in batches:
            if len(batch):
                which, far = search.nearest(_matrix(batch))
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": which, "distance": far,
                                    "centroid_sha256": [signs[j] for j in which]})

    # ids travel as text: a null among them would turn a batch of longs into doubles
    placed = keep(rows.select(F.col("vec_id").cast("string").alias("vec_id"), "v").mapInPandas(
        assign, "vec_id string, cluster int, distance long, centroid_sha256 string").withColumn(
        "vec_id", F.col("vec_id").cast("long")))
    per = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(  # at most k rows
        F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}

    def fitting(value: int) -> Column:
        return F.lit(int(value) if value < 1 << 63 else None).cast("long")

    of = F.lit(None).cast("long")
    for j, s in per.items():
        of = F.when(F.col("cluster") == j, fitting(s)).otherwise(of)
    return placed.select("vec_id", "cluster", "distance", of.alias("cluster_inertia"),
                         fitting(sum(per.values())).alias("inertia"), "centroid_sha256")
