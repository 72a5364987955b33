"""SQL twins of the statistics kernels (used only to check results)."""

from __future__ import annotations


def beta_sql(inner: str, x: str, y: str, a: str, b: str, out: str) -> str:
    swap = f"({x}) > (({a}) + 1) / (({a}) + ({b}) + 2)"
    return f"""
      SELECT * EXCLUDE (_x, _y, _a, _b, _swap),
        CASE WHEN _x IS NULL THEN NULL WHEN _x <= 0 THEN CASE WHEN _swap THEN 1.0 ELSE 0.0 END
        ELSE CASE WHEN _swap THEN 1 - part ELSE part END END AS {out}
      FROM (SELECT *, CASE WHEN _x > 0 AND _y > 0 THEN exp(lgamma(_a + _b) - lgamma(_a) - lgamma(_b) + _a * ln(_x) + _b * ln(_y)) / _a
          / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(400, 0, -1), lambda i: i::DOUBLE)),
            lambda acc, m: 1 + CASE WHEN m % 2 = 1
              THEN -(_a + floor(m / 2)) * (_a + _b + floor(m / 2)) * _x / ((_a + 2 * floor(m / 2)) * (_a + 2 * floor(m / 2) + 1))
              ELSE floor(m / 2) * (_b - floor(m / 2)) * _x / ((_a + 2 * floor(m / 2) - 1) * (_a + 2 * floor(m / 2))) END / acc)
          END AS part
        FROM (SELECT *, {swap} AS _swap,
                CASE WHEN {swap} THEN ({y}) ELSE ({x}) END AS _x, CASE WHEN {swap} THEN ({x}) ELSE ({y}) END AS _y,
                CASE WHEN {swap} THEN ({b}) ELSE ({a}) END AS _a, CASE WHEN {swap} THEN ({a}) ELSE ({b}) END AS _b
              FROM ({inner})))"""


def t_tail_sql(inner: str, t: str, dof: str, out: str) -> str:
    """``inner`` plus the two-sided t tail; leaves a helper column ``part``."""
    usable = f"({t}) IS NOT NULL AND ({dof}) > 0"
    d = f"({dof})::DOUBLE"
    return beta_sql(
        inner, f"CASE WHEN {usable} THEN {d} / ({d} + ({t}) * ({t})) END",
        f"CASE WHEN {usable} THEN ({t}) * ({t}) / ({d} + ({t}) * ({t})) END",
        f"CASE WHEN {usable} THEN {d} / 2 ELSE 1.0::DOUBLE END", "0.5::DOUBLE", out)


def binomial_tail_sql(inner: str, k: str, n: str, out: str) -> str:
    kk = f"greatest(({k})::DOUBLE, 1.0)"
    return (f"SELECT * REPLACE (CASE WHEN ({k}) <= 0 THEN 1.0 ELSE {out} END AS {out}) FROM ("
            + beta_sql(inner, "0.5::DOUBLE", "0.5::DOUBLE", kk, f"({n})::DOUBLE - {kk} + 1", out) + ")")


def corr_t_sql(r: str, n: str) -> str:
    c = f"greatest(-1 + 1e-8, least(1 - 1e-8, {r}))"
    return f"CASE WHEN {r} IS NOT NULL THEN {c} * sqrt(greatest({n} - 2, 0)::DOUBLE) / sqrt(1 - {c} * {c}) END"


def fdr_sql(inner: str, p: str, out: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""
      SELECT * EXCLUDE (_pp, _rk, _n, _raw), min(_raw) OVER ({part} ORDER BY _pp RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {out}
      FROM (SELECT *, least(1.0, _pp * _n / _rk) AS _raw FROM (
        SELECT *, count(*) OVER ({part} ORDER BY _pp RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _rk,
               count(*) OVER ({part}) AS _n
        FROM (SELECT *, coalesce(least({p}, 1.0), 1.0) AS _pp FROM ({inner}))))"""
