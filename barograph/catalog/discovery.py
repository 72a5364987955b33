"""DIS-01..05, TOP-07, TOP-09, AGG-17: information coefficients, sweep, FDR and factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.catalog.base import query, view
from barograph.catalog.rolling import features, r6
from barograph.catalog.sqlstats import fdr_sql, t_tail_sql
from barograph.operators import rolling as R
from barograph.operators.ranking import adjust_fdr
from barograph.plans import discovery as X
from barograph.plans import signals as G

_DIG = 6  # features are rounded before ranking, so ties do not hang on the last bit


def ic_sql(values: list[str], lags: int) -> str:
    names = ", ".join(f"'{v}'" for v in values)
    cells = ", ".join(f"round({v}, {_DIG})" for v in values)
    return f"""
      SELECT feature, CAST(k AS INTEGER) AS lag, date, count(*) AS n, corr(rx, ry) AS ic FROM (
        SELECT feature, k, date, row_number() OVER (PARTITION BY feature, k, date ORDER BY value, symbol) AS rx,
               row_number() OVER (PARTITION BY feature, k, date ORDER BY ahead, symbol) AS ry
        FROM (SELECT x.symbol, x.date, x.feature, x.value, k, f.fwd AS ahead FROM
               (SELECT symbol, date, t, unnest([{names}]) AS feature, unnest([{cells}]) AS value FROM m_bank) x
              JOIN range(1, {lags + 1}) r(k) ON TRUE JOIN m_fwd1 f ON f.symbol = x.symbol AND f.t = x.t + k
              WHERE x.value IS NOT NULL AND f.fwd IS NOT NULL)) GROUP BY feature, k, date HAVING count(*) >= 10"""


view("m_fwd1", "SELECT a.symbol, a.t, round(b.close / a.close - 1, 9) AS fwd FROM m_panel a JOIN m_panel b ON b.symbol = a.symbol AND b.t = a.t + 1")


def swept(m):
    """Feature bank with the one-slot forward return."""
    bank = G.feature_bank(features(m).withColumn("fwd1", F.round(R.forward_return("close", 1), 9)))
    return bank


def bank_with_forward(m):
    feat = features(m)
    forward = feat.select("symbol", "t", F.round(R.forward_return("close", 1), 9).alias("fwd1"))
    bank = G.feature_bank(feat).join(forward, ["symbol", "t"])
    return bank.withColumns({c: F.round(c, _DIG) for c in G.BANK})


@query("dis_01", f"SELECT feature, lag, date, n, round(ic, 6) AS ic FROM ({ic_sql(list(G.BANK), 20)})")
def _(m):
    return X.ic_series(bank_with_forward(m), list(G.BANK), "fwd1", 20).select(
        "feature", "lag", "date", "n", r6("ic", "ic"))


def stats_sql(inner: str) -> str:
    body = f"""SELECT feature, lag, CASE WHEN c >= 5 THEN m END AS mean_ic, CASE WHEN c >= 5 THEN s END AS std_ic, CASE WHEN c >= 5 THEN m / (s + 1e-10) END AS ic_ir,
        CASE WHEN c >= 5 THEN m / (s / sqrt(c) + 1e-10) END AS t_stat, CASE WHEN c >= 5 THEN c ELSE 0 END AS n
        FROM (SELECT feature, lag, avg(ic) AS m, stddev_samp(ic) AS s, count(ic) AS c FROM ({inner}) GROUP BY feature, lag)"""
    return f"SELECT * EXCLUDE (part, p), coalesce(p, 1.0) AS p_value FROM ({t_tail_sql(body, 't_stat', 'n - 1', 'p')})"


_STATS = ("mean_ic", "std_ic", "ic_ir", "t_stat", "p_value")


@query("dis_02", f"SELECT feature, lag, n, {', '.join(f'round({c}, 6) AS {c}' for c in _STATS)} FROM ({stats_sql(ic_sql(list(G.BANK), 20))})")
def _(m):
    series = X.ic_series(bank_with_forward(m), list(G.BANK), "fwd1", 20)
    return X.ic_stats(series, "feature", "lag").select("feature", "lag", "n", *[r6(c, c) for c in _STATS])


_GRID = f"""SELECT g.feature, CAST(g.lag AS INTEGER) AS lag, s.mean_ic, s.std_ic, s.ic_ir, s.t_stat, coalesce(s.n, 0) AS n, coalesce(s.p_value, 1.0) AS p_value
    FROM (SELECT unnest([{', '.join(f"'{c}'" for c in G.BANK)}]) AS feature, k AS lag FROM range(1, 21) r(k)) g LEFT JOIN ({stats_sql(ic_sql(list(G.BANK), 20))}) s ON s.feature = g.feature AND s.lag = g.lag"""
view("m_sweep", f"SELECT *, fdr_p <= 0.05 AS significant FROM ({fdr_sql(_GRID, 'p_value', 'fdr_p')})")


def sweep(m, lags=20):
    return X.ic_sweep(bank_with_forward(m), list(G.BANK), "fwd1", lags)


@query("dis_03", f"SELECT feature, lag, n, significant, {', '.join(f'round({c}, 6) AS {c}' for c in (*_STATS, 'fdr_p'))} FROM m_sweep")
def _(m):
    return sweep(m).select("feature", "lag", "n", "significant", *[r6(c, c) for c in (*_STATS, "fdr_p")])


_P = "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN least(value / 1000, 1.0) * (event_id % 97) / 97 END AS p FROM events"


@query("dis_04", f"SELECT event_id, round(p, 9) AS p, round(fdr_p, 9) AS fdr_p, fdr_p <= 0.05 AS reject FROM ({fdr_sql(_P, 'p', 'fdr_p')})")
def _(m):
    p = F.when(F.col("event_id") % 11 != 0, F.least(F.col("value") / 1000, F.lit(1.0)) * (F.col("event_id") % 97) / 97)
    tests = m.table("events").select("event_id", p.alias("p"))
    return adjust_fdr(tests, "p").select(
        "event_id", r6("p", "p", 9), r6("fdr_p", "fdr_p", 9), (F.col("fdr_p") <= 0.05).alias("reject"))


def factors(m, k=5):
    return X.principal_factors(R.with_step_features(m.panel), m.nations.select(F.col("n_name").alias("symbol")), k)


# The covariance as a list of rows, squared twenty times per factor: its leading direction is what is left.
view("m_cov", """
    WITH g AS (SELECT n_name AS symbol FROM nation), n AS (SELECT count(DISTINCT date) AS n FROM m_feat),
    x AS (SELECT symbol, date, returns AS x FROM m_feat WHERE returns IS NOT NULL),
    mu AS (SELECT g.symbol, coalesce(sum(x), 0.0) / any_value(n) AS mu FROM g CROSS JOIN n LEFT JOIN x USING (symbol) GROUP BY g.symbol),
    c AS (SELECT a.symbol AS a, b.symbol AS b, sum(a.x * b.x) AS s FROM x a JOIN x b USING (date) GROUP BY 1, 2)
    SELECT a.symbol, list((coalesce(s, 0.0) - n * a.mu * b.mu) / (n - 1) ORDER BY b.symbol) AS row
    FROM mu a CROSS JOIN mu b CROSS JOIN n LEFT JOIN c ON c.a = a.symbol AND c.b = b.symbol GROUP BY a.symbol""")
_SQUARED = "list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q) / list_sum(list_transform(m, lambda u: list_dot_product(u, u)))))"
_FACTORS = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT list(symbol ORDER BY symbol) AS names, list(row ORDER BY symbol) AS c FROM m_cov),
    w AS (SELECT 0 AS step, 1 AS factor, c AS left_over, c AS m, NULL::DOUBLE[] AS v, NULL::DOUBLE AS root FROM c UNION ALL
      SELECT step + 1, CASE WHEN step % 22 = 21 THEN factor + 1 ELSE factor END,
        CASE WHEN step % 22 = 21 THEN list_transform(left_over, lambda r, i: list_transform(r, lambda y, j: y - root * v[i] * v[j])) ELSE left_over END,
        CASE WHEN step % 22 < 20 THEN {_SQUARED} WHEN step % 22 = 21 THEN list_transform(left_over, lambda r, i: list_transform(r, lambda y, j: y - root * v[i] * v[j])) ELSE m END,
        CASE WHEN step % 22 = 20 THEN u ELSE v END, CASE WHEN step % 22 = 20 THEN list_dot_product(u, list_transform(left_over, lambda r: list_dot_product(r, u))) ELSE root END
      FROM (SELECT *, list_transform(p, lambda y: y * sign(p[list_position(list_transform(p, lambda z: abs(z)), list_max(list_transform(p, lambda z: abs(z))))]) / sqrt(list_dot_product(p, p))) AS u
            FROM (SELECT *, m[list_position(list_transform(m, lambda r, i: r[i]), list_max(list_transform(m, lambda r, i: r[i])))] AS p FROM w)) WHERE step < 109)
    SELECT unnest(names) AS symbol, factor, unnest(v) AS loading, root / total AS explained FROM w, c, (SELECT list_sum(list_transform(c, lambda r, i: r[i])) AS total FROM c) WHERE step % 22 = 21"""


@query("dis_05", f"WITH f AS ({_FACTORS}) SELECT symbol, CAST(factor AS INTEGER) AS factor, round(loading, 5) AS loading, round(explained, 6) AS explained FROM f")
def _(m):
    _, explained, loadings, _ = factors(m)
    return loadings.join(explained, "factor").select("symbol", "factor", r6("loading", "loading", 5), r6("explained", "explained"))


_GRID05 = """SELECT n_name AS symbol, coalesce((s2 - s1 * s1 / n) / (n - 1), 0.0) AS v FROM nation
    CROSS JOIN (SELECT count(DISTINCT date) AS n FROM m_feat) LEFT JOIN (SELECT symbol, sum(returns) AS s1, sum(returns * returns) AS s2 FROM m_feat GROUP BY symbol) ON symbol = n_name"""


@query("dis_05_shares", f"SELECT symbol, round(v / sum(v) OVER (), 6) AS share FROM ({_GRID05})")
def _(m):
    """With all factors, explained shares times squared loadings add up to each symbol's share of the variance."""
    _, explained, loadings, _ = factors(m, 25)
    return loadings.join(explained, "factor").groupBy("symbol").agg(r6(F.sum(F.col("explained") * F.col("loading") ** 2), "share"))


@query("dis_05_dates", "SELECT date, round(sum(coalesce(returns * returns, 0.0)), 6) AS energy FROM m_feat GROUP BY date")
def _(m):
    """With all factors, a date's squared components add up to its squared returns."""
    return factors(m, 25)[0].groupBy("date").agg(r6(F.sum(F.col("score") ** 2), "energy"))


@query("agg_17", f"""WITH f AS ({_FACTORS}) SELECT industry, round(avg(abs(loading)), 6) AS mean_abs FROM f JOIN m_symbols USING (symbol) WHERE factor = 1
       GROUP BY industry ORDER BY mean_abs DESC, industry LIMIT 5""")
def _(m):
    return X.industry_loadings(factors(m)[2], m.symbols).select("industry", r6("mean_abs", "mean_abs"))


@query("top_07", "SELECT feature, lag FROM m_sweep WHERE fdr_p <= 0.2 ORDER BY abs(ic_ir) DESC, feature, lag LIMIT 20")
def _(m):
    return X.top_significant(X.ic_sweep(bank_with_forward(m), list(G.BANK), "fwd1", 20, alpha=0.2))


@query("top_09", """SELECT feature, CAST(arg_max(lag, row(abs(ic_ir), -lag)) FILTER (ic_ir IS NOT NULL) AS INTEGER) AS best_lag, round(arg_max(ic_ir, row(abs(ic_ir), -lag)) FILTER (ic_ir IS NOT NULL), 6) AS best_ic_ir,
       count(*) FILTER (significant) AS n_significant FROM m_sweep GROUP BY feature""")
def _(m):
    return X.best_lags(sweep(m)).select("feature", "best_lag", r6("best_ic_ir", "best_ic_ir"), "n_significant")
