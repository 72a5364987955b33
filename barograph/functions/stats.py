"""Tail probabilities as Arrow-batched columns, and small statistics as native ones.

Both tails are regularised incomplete beta values. A batch's distinct arguments are
evaluated together by the continued fraction in its forward form; a value leaves the loop
once it has converged, so a batch costs what its slowest values cost and not a fixed number
of terms. The relative accuracy does not degrade for tiny probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _beta_tail():
    """Vectorised I_x(a, b). Nested, so that workers need not import this package."""
    def ln_gamma(z: np.ndarray) -> np.ndarray:
        """Stirling's series after shifting the argument by ten."""
        y, shift = z + 10, z.copy()
        for k in range(1, 10):
            shift *= z + k
        inv = 1 / y
        inv2 = inv * inv
        tail = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
        return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail - np.log(shift)

    def fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
        """1 / (1 + d1 / (1 + d2 / ...)) from the front, two terms a turn."""
        out, live = np.empty(len(x)), np.arange(len(x))
        tiny = 1e-300
        c, d = np.ones(len(x)), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(d == 0, tiny, d)
        h = d.copy()
        k = 0
        while len(live):
            k += 1
            for term in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)),
                         -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
                d, c = 1 + term * d, 1 + term / c
                d, c = 1 / np.where(d == 0, tiny, d), np.where(c == 0, tiny, c)
                h = h * d * c
            done = (np.abs(d * c - 1) < 1e-15) | (k >= 20_000)
            if done.any():
                out[live[done]] = h[done]
                on = ~done
                live, a, b, x, c, d, h = live[on], a[on], b[on], x[on], c[on], d[on], h[on]
        return out

    def tail(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``y`` is 1 - x, passed separately to keep its precision."""
        swap = x > (a + 1) / (a + b + 2)
        x, y, a, b = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, b, a), np.where(swap, a, b)
        part = np.zeros(len(x))
        some = np.flatnonzero(x > 0)
        x, y, a, b = x[some], y[some], a[some], b[some]
        part[some] = np.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * np.log(x) + b * np.log(y)) / a * fraction(a, b, x)
        return np.where(swap, 1 - part, part)

    return tail


def _over_distinct(evaluate):
    """A pandas UDF of two numbers that evaluates each distinct pair of a batch once; null without both."""
    def batch(u: pd.Series, v: pd.Series) -> pd.Series:
        u, v = u.to_numpy(dtype=float, na_value=np.nan), v.to_numpy(dtype=float, na_value=np.nan)
        out = np.full(len(u), np.nan)
        some = np.flatnonzero(~(np.isnan(u) | np.isnan(v)))
        if len(some):
            pairs, which = np.unique(u[some] + 1j * v[some], return_inverse=True)
            out[some] = evaluate(pairs.real, pairs.imag)[which]
        return pd.Series(out)

    return F.pandas_udf(batch, "double")


def t_tail(t: Column, dof: Column) -> Column:
    """Two-sided Student-t tail probability; null without t or degrees of freedom."""
    beta = _beta_tail()

    def tail(t: np.ndarray, n: np.ndarray) -> np.ndarray:
        out, some = np.full(len(t), np.nan), np.flatnonzero((n > 0) & np.isfinite(t))
        t, n = t[some], n[some]
        out[some] = beta(n / (n + t * t), t * t / (n + t * t), n / 2, np.full(len(n), 0.5))
        return out

    return _over_distinct(tail)(t.cast("double"), dof.cast("double"))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, 1/2); 0 beyond n."""
    beta = _beta_tail()

    def tail(k: np.ndarray, n: np.ndarray) -> np.ndarray:
        out, some = np.where(k <= 0, 1.0, 0.0), np.flatnonzero((k > 0) & (k <= n))
        k, n = k[some], n[some]
        half = np.full(len(k), 0.5)
        out[some] = beta(half, half, k, n - k + 1)
        return out

    return _over_distinct(tail)(k.cast("double"), n.cast("double"))


def with_t_tail(df: DataFrame, t: Column, dof: Column, out: str) -> DataFrame:
    return df.withColumn(out, t_tail(t, dof))


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a Pearson r over n points, r kept off +-1."""
    clipped = F.greatest(F.lit(-1 + 1e-8), F.least(F.lit(1 - 1e-8), r))
    return F.when(r.isNotNull(), clipped * F.sqrt(F.greatest(n - 2, F.lit(0)).cast("double"))
                  / F.sqrt(1 - clipped * clipped))


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """r in [-1, 1] from raw moments; zero variance gives 0."""
    cov = n * sxy - sx * sy
    var = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(var > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(var)))).otherwise(0.0)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
