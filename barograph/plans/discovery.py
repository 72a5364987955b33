"""Discovery statistics: information coefficients, sweep, FDR, principal factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions.stats import t_tail
from barograph.operators import rolling as R
from barograph.operators.calendar import at_slot
from barograph.operators.ranking import adjust_fdr
from barograph.session import cut_lineage

MIN_NAMES = 10
MIN_DATES = 5


def with_forward_lags(panel: DataFrame, forward: str, lags: int) -> DataFrame:
    """Adds ``fwd``: array of the forward value at t+1..t+lags (null when that slot is invalid)."""
    value = F.when(F.col("valid"), F.col(forward))
    return panel.withColumn("fwd", F.array(*[at_slot(value, k) for k in range(1, lags + 1)]))


def _rank_kernel(least: int):
    """Rank correlations of every feature with every lag on one date, from one block of rows."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol", kind="stable")
        x, y = (np.array(pdf[c].tolist(), dtype=float) for c in ("x", "fwd"))
        here, ahead = ~np.isnan(x), ~np.isnan(y)
        ox, oy = (np.argsort(np.where(ok, v, np.inf), axis=0, kind="stable") for v, ok in ((x, here), (y, ahead)))
        out = []
        for f in range(x.shape[1]):
            both = here[:, f, None] & ahead
            n = both.sum(0)
            some = np.flatnonzero(n >= max(least, 2))
            if not len(some):
                continue
            both = both[:, some]
            rx, ry = np.empty(both.shape), np.empty(both.shape)
            rx[ox[:, f]] = both[ox[:, f]].cumsum(0)
            np.put_along_axis(ry, oy[:, some], np.take_along_axis(both, oy[:, some], 0).cumsum(0), 0)
            n = n[some].astype(float)
            # ranks 1..n without ties: their mean and spread are known
            cov = (rx * ry * both).sum(0) - n * (n + 1) ** 2 / 4
            out.append(pd.DataFrame({"date": pdf["date"].iloc[0], "f": f, "k": some, "n": n.astype(np.int64), "ic": cov / (n * (n * n - 1) / 12)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["date", "f", "k", "n", "ic"])

    return kernel


def ic_series(panel: DataFrame, features: list[str], forward: str, lags: int, least: int = MIN_NAMES) -> DataFrame:
    """Spearman IC per (feature, lag, date), ordinal ranks, symbols breaking ties.

    Rows cross the network once, by date, as two short arrays. A date's block (one row per
    symbol) is ranked as a whole: each feature and each lag is sorted once, and the rank among
    the rows that have both is a running count along that order.
    """
    packed = with_forward_lags(panel, forward, lags).where("valid").select("symbol", "date", F.array(*features).alias("x"), "fwd")
    ic = packed.groupBy("date").applyInPandas(_rank_kernel(least), "date date, f int, k int, n long, ic double")
    names = F.array(*[F.lit(f) for f in features])
    return ic.select(F.element_at(names, F.col("f") + 1).alias("feature"), (F.col("k") + 1).alias("lag"), "date", "n", "ic")


def ic_stats(series: DataFrame, *keys: str) -> DataFrame:
    """Mean, spread, information ratio, t and p of IC series; below five dates all are null, p 1."""
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    raw = series.groupBy(*keys).agg(mean.alias("mean_ic"), std.alias("std_ic"), n.alias("_n"))
    enough = F.col("_n") >= MIN_DATES
    t = F.col("mean_ic") / (F.col("std_ic") / F.sqrt("_n") + 1e-10)
    staged = raw.select(
        *keys, F.when(enough, F.col("mean_ic")).alias("mean_ic"), F.when(enough, F.col("std_ic")).alias("std_ic"),
        F.when(enough, F.col("mean_ic") / (F.col("std_ic") + 1e-10)).alias("ic_ir"),
        F.when(enough, t).alias("t_stat"), F.when(enough, F.col("_n")).otherwise(0).alias("n"))
    return staged.withColumn("p_value", F.coalesce(t_tail(F.col("t_stat"), F.col("n") - 1), F.lit(1.0)))


def test_grid(spark, features: list[str], lags: int) -> DataFrame:
    """Every (feature, lag) test; as many rows as tests, whatever the data."""
    names = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    return names.select("feature", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"))


def ic_sweep(panel: DataFrame, features: list[str], forward: str, lags: int = 20, alpha: float = 0.05) -> DataFrame:
    """All features at all lags in one job, FDR over the whole sweep, strongest |IR| first."""
    found = ic_stats(ic_series(panel, features, forward, lags), "feature", "lag")
    stats_ = test_grid(panel.sparkSession, features, lags).join(found, ["feature", "lag"], "left").fillna(1.0, ["p_value"]).fillna(0, ["n"])
    adjusted = adjust_fdr(stats_, "p_value")
    return adjusted.withColumn("significant", F.col("fdr_p") <= alpha).orderBy(F.abs("ic_ir").desc_nulls_last(), "feature", "lag")


def top_significant(sweep: DataFrame, n: int = 20) -> DataFrame:
    return sweep.where("significant").orderBy(F.abs("ic_ir").desc(), "feature", "lag").limit(n).select("feature", "lag")


def best_lags(sweep: DataFrame) -> DataFrame:
    best = F.when(F.col("ic_ir").isNotNull(), F.struct(F.abs("ic_ir").alias("s"), (-F.col("lag")).alias("l"), F.col("ic_ir")))
    return sweep.groupBy("feature").agg(F.max(best).alias("b"), F.count_if("significant").alias("n_significant")).select(
        "feature", (-F.col("b.l")).alias("best_lag"), F.col("b.ic_ir").alias("best_ic_ir"), "n_significant")


def _centred_product(cells: DataFrame, means: DataFrame, vectors: DataFrame, dates: int, p: int) -> DataFrame:
    """(symbol, v): C v for each of ``p`` vectors, C the covariance of the symbols.

    C is never formed: each product is two passes over the stored cells, first X v by date,
    then its transpose by symbol. Missing values are zeros, so only stored cells move, and
    centring is a correction by sums of length ``p``.
    """
    def total(column: Column) -> list[Column]:
        return [F.sum(column * F.element_at("v", j + 1)).alias(f"s{j}") for j in range(p)]

    packed = F.array(*[f"s{j}" for j in range(p)]).alias("v")
    shift = means.join(vectors, "symbol").agg(*total(F.col("mean"))).select(packed).first()["v"] or [0.0] * p
    by_date = cells.join(vectors, "symbol").groupBy("date").agg(*total(F.col("x"))).select("date", packed)
    sums = by_date.agg(*[F.sum(F.element_at("v", j + 1)).alias(f"s{j}") for j in range(p)]).select(packed).first()["v"] or [0.0] * p
    # sum over all dates of (X v)_d - mean . v
    drift = F.array(*[F.lit(float((sums[j] or 0.0) - dates * (shift[j] or 0.0))) for j in range(p)])
    level = F.array(*[F.lit(float(shift[j] or 0.0)) for j in range(p)])
    by_symbol = cells.join(by_date, "date").groupBy("symbol").agg(F.sum("x").alias("sum"), *total(F.col("x"))).select("symbol", "sum", packed)
    joined = means.join(by_symbol.withColumnRenamed("v", "raw"), "symbol", "left").withColumns({
        "raw": F.coalesce("raw", F.array(*[F.lit(0.0)] * p)), "sum": F.coalesce("sum", F.lit(0.0))})
    return joined.select("symbol", F.transform(F.sequence(F.lit(1), F.lit(p)), lambda j: (
        F.element_at("raw", j) - F.col("sum") * F.element_at(level, j) - F.col("mean") * F.element_at(drift, j)) / (dates - 1)).alias("v"))


def _inner(left: DataFrame, right: DataFrame, p: int) -> np.ndarray:
    """p x p inner products of two sets of symbol vectors; the only thing of the iteration that reaches the driver."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for batch in batches:
            if len(batch):
                total += np.stack(batch["a"]).T @ np.stack(batch["b"])
        yield pd.DataFrame({"c": [total.ravel()]})

    both = left.select("symbol", F.col("v").alias("a")).join(right.select("symbol", F.col("v").alias("b")), "symbol").select("a", "b")
    parts = both.mapInPandas(partial, "c array<double>").select(F.posexplode("c").alias("at", "c"))
    out = np.zeros(p * p)
    for r in parts.groupBy("at").agg(F.sum("c").alias("c")).collect():
        out[r["at"]] = r["c"]
    return out.reshape(p, p)


def _turned(vectors: DataFrame, turn: np.ndarray) -> DataFrame:
    """Symbol vectors times a small matrix."""
    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(v=list(np.stack(batch["v"]) @ turn))

    return vectors.select("symbol", "v").mapInPandas(multiply, "symbol string, v array<double>")


def principal_factors(panel: DataFrame, symbols: DataFrame, k: int, value: str = "returns", spare: int = 20,
                      rounds: int = 60, tolerance: float = 1e-7):
    """Principal factors of the symbol x date matrix, missing values as zero, centred per symbol.

    Subspace iteration: min(symbols, ``k`` + ``spare``) vectors, one row of numbers per symbol,
    are multiplied by the covariance, made orthonormal, and turned to its axes, until the
    first ``k`` leave a residual |C v - lambda v| below ``tolerance`` of the largest (its square is a difference,
    so that about 1e-8 is the least that can be told). Symbols
    and dates stay in Spark; the driver sees matrices of that small number of vectors.
    Returns (per-date components, explained ratios, per-symbol loadings, residuals).
    """
    spark = panel.sparkSession
    cells = cut_lineage(panel.where(F.col(value).isNotNull()).select("symbol", "date", F.col(value).cast("double").alias("x")))
    dates = cut_lineage(panel.select("date").distinct())
    t = dates.count()
    names = symbols.select("symbol").distinct()
    means = cut_lineage(names.join(cells.groupBy("symbol").agg((F.sum("x") / t).alias("mean"), F.sum(F.col("x") ** 2).alias("square")), "symbol", "left")
                        .fillna(0.0, ["mean", "square"]))
    n, trace = means.agg(F.count(F.lit(1)), F.sum(F.col("square") - F.col("mean") ** 2 * t) / (t - 1)).first()
    p = min(n, k + spare)
    start = F.array(*[F.xxhash64("symbol", F.lit(j)) / F.lit(2.0 ** 63) for j in range(p)])
    vectors = cut_lineage(names.select("symbol", start.alias("v")))
    for turn in range(rounds):
        gram = _inner(vectors, vectors, p)
        root = np.linalg.cholesky(gram + np.eye(p) * 1e-14 * np.trace(gram))
        basis = cut_lineage(_turned(vectors, np.linalg.inv(root).T))
        image = cut_lineage(_centred_product(cells, means, basis, t, p))
        small = _inner(basis, image, p)
        roots, axes = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-roots, kind="stable")
        roots, axes = roots[order], axes[:, order]
        squares = np.diag(axes.T @ _inner(image, image, p) @ axes)
        off = np.sqrt(np.maximum(squares - roots ** 2, 0))  # |C v|^2 = |lambda v|^2 + |residual|^2
        if off[:min(k, p)].max() <= tolerance * max(roots[0], 1e-300) or p == n:
            break  # as many vectors as symbols span everything at once
        # the basis is added in traces, so that directions without variance stay directions
        trail = basis.withColumnRenamed("v", "own")
        vectors = cut_lineage(image.join(trail, "symbol").select(
            "symbol", F.zip_with("v", "own", lambda a, b: a + b * float(1e-8 * trace)).alias("v")))
    k = min(k, p)
    found = _turned(basis, axes[:, :k])
    each = found.select("symbol", F.posexplode("v").alias("j", "w"))
    signs = each.groupBy("j").agg(F.max_by(F.signum("w"), F.struct(F.abs("w"), "symbol")).alias("sign"))
    loadings = cut_lineage(each.join(signs, "j").select("symbol", (F.col("j") + 1).alias("factor"), (F.col("w") * F.col("sign")).alias("loading")))
    explained = spark.range(1).select(F.posexplode(F.array(*[F.lit(float(r / trace)) for r in roots[:k]])).alias("j", "explained")).select(
        (F.col("j") + 1).alias("factor"), "explained")
    scores = cells.join(loadings, "symbol").groupBy("date", "factor").agg(F.sum(F.col("x") * F.col("loading")).alias("s"))
    axis = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(k))).alias("factor"))
    components = dates.join(F.broadcast(axis)).join(scores, ["date", "factor"], "left").select(
        "date", "factor", F.coalesce("s", F.lit(0.0)).alias("score"))
    return components, explained, loadings, off[:k]


def industry_loadings(loadings: DataFrame, symbols: DataFrame, factor: int = 1, n: int = 5) -> DataFrame:
    rows = loadings.where(F.col("factor") == factor).join(symbols.select("symbol", "industry"), "symbol")
    return rows.groupBy("industry").agg(F.avg(F.abs("loading")).alias("mean_abs")).orderBy(F.col("mean_abs").desc(), "industry").limit(n)
