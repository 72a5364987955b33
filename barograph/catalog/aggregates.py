"""AGG: grouped statistics, breakpoints, month ends and screeners."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.catalog.base import query, view
from barograph.catalog.filters import closes
from barograph.catalog.joins import forecast_actual
from barograph.catalog.rolling import features, r6
from barograph.catalog.sqlstats import corr_t_sql, t_tail_sql
from barograph.functions import stats
from barograph.operators import aggregates as A
from barograph.operators import rolling as R
from barograph.operators.latest import latest, percent
from barograph.operators.merge import month_ends
from barograph.operators.ranking import value_at_shares
from barograph.operators.sets import drop_duplicates_ordered


@query("agg_01", "SELECT symbol, max(high) AS high_52w, min(low) AS low_52w FROM m_bars, m_asof WHERE date >= as_of - 365 GROUP BY symbol")
def _(m):
    return m.bars.where(F.col("date") >= F.date_sub(m.as_of(), 365)).groupBy("symbol").agg(
        F.max("high").alias("high_52w"), F.min("low").alias("low_52w"))


@query("agg_02", """
    WITH r AS (SELECT * FROM m_series WHERE date >= (SELECT max(date) - 365 FROM m_series))
    SELECT id, max(price) AS high_52w, min(price) AS low_52w, min(date) AS data_start,
           arg_max(date, row(price, -epoch(date))) AS high_date, arg_min(date, row(price, epoch(date))) AS low_date FROM r GROUP BY id""")
def _(m):
    recent = m.series.where(F.col("date") >= F.date_sub(m.series.agg(F.max("date")).scalar(), 365))
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    return recent.groupBy("id").agg(
        F.max("price").alias("high_52w"), F.min("price").alias("low_52w"), F.min("date").alias("data_start"),
        F.max_by("date", F.struct("price", -day)).alias("high_date"), F.min_by("date", F.struct("price", day)).alias("low_date"))


@query("agg_03", "SELECT symbol, date, max(px) AS px, max(q) AS q, count(*) AS copies FROM m_ticks GROUP BY symbol, date")
def _(m):
    return m.ticks.groupBy("symbol", "date").agg(F.max("px").alias("px"), F.max("q").alias("q"), F.count(F.lit(1)).alias("copies"))


@query("agg_04", """SELECT symbol, date, px, q FROM m_ticks QUALIFY row_number() OVER
       (PARTITION BY symbol, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, q DESC, px DESC) = 1""")
def _(m):
    order = [F.col(c).desc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", "px")]
    return drop_duplicates_ordered(m.ticks, ["symbol", "date"], order).select("symbol", "date", "px", "q")


view("m_adv", "SELECT symbol, avg(close * volume) AS adv FROM m_close GROUP BY symbol")


def dollar_volume(m):
    return closes(m).groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"))


@query("agg_05", "SELECT symbol, round(adv, 4) AS adv FROM m_adv")
def _(m):
    return dollar_volume(m).select("symbol", r6("adv", "adv", 4))


# Volume bracket shares.
SHARES = {"p60": 0.60, "p70": 0.70, "p80": 0.80, "p90": 0.90}

view("m_optadv", "SELECT symbol, avg(close) AS adv FROM m_option_bars GROUP BY symbol HAVING avg(close) > 0")
view("m_breaks", "SELECT " + ", ".join(
    f"max(adv) FILTER (rn = CAST(floor(n * {s}) AS BIGINT)) AS {k}" for k, s in SHARES.items()) + """
    FROM (SELECT adv, row_number() OVER (ORDER BY adv, symbol) AS rn, count(*) OVER () AS n FROM m_optadv)""")


def breakpoints(m):
    means = m.option_bars.groupBy("symbol").agg(F.avg("close").alias("adv")).where(F.col("adv") > 0)
    return value_at_shares(means, "adv", SHARES)


@query("agg_06", "SELECT round(p60, 4) AS p60, round(p70, 4) AS p70, round(p80, 4) AS p80, round(p90, 4) AS p90 FROM m_breaks")
def _(m):
    return breakpoints(m).select(*[r6(k, k, 4) for k in SHARES])


@query("agg_07", """SELECT symbol, CAST(1 + (adv >= round(p60, 4))::INT + (adv >= round(p70, 4))::INT + (adv >= round(p80, 4))::INT
       + (adv >= round(p90, 4))::INT AS INTEGER) AS bracket FROM (SELECT symbol, round(adv, 4) AS adv FROM m_optadv), m_breaks""")
def _(m):
    means = m.option_bars.groupBy("symbol").agg(F.avg("close").alias("adv")).where(F.col("adv") > 0)
    limits = breakpoints(m)
    # one row of four numbers: attached as scalar subqueries
    breaks = [limits.select(F.round(k, 4)).scalar() for k in SHARES]
    return means.select("symbol", A.bracket(F.round("adv", 4), breaks).alias("bracket"))


@query("agg_08", "SELECT symbol, month, date, close FROM m_monthend")
def _(m):
    return month_ends(closes(m)).select("symbol", "month", "date", "close")


@query("agg_09", """SELECT symbol, CAST(year(date) AS INTEGER) AS year, max(date) AS date, arg_max(volume, date) AS shares
       FROM m_close WHERE volume IS NOT NULL AND volume > 0 GROUP BY 1, 2""")
def _(m):
    return closes(m).where(F.col("volume") > 0).groupBy("symbol", F.year("date").alias("year")).agg(
        F.max("date").alias("date"), F.max_by("volume", "date").alias("shares"))


@query("agg_10", "SELECT date AS generated_at, count(*) AS n FROM m_forecasts GROUP BY date")
def _(m):
    return m.forecasts.groupBy(F.col("date").alias("generated_at")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_11", """SELECT s.industry, count(*) AS n, count(*) FILTER (e.ratio > 1) AS n_split, max(e.date) AS latest
       FROM m_events e JOIN m_symbols s USING (symbol) GROUP BY s.industry""")
def _(m):
    return m.events.join(m.symbols.select("symbol", "industry"), "symbol").groupBy("industry").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ratio") > 1).alias("n_split"), F.max("date").alias("latest"))


view("m_growth", """
    WITH y AS (SELECT symbol, list(struct_pack(fye := fiscal_year_end, rev := total_revenue, ni := net_income, fcf := free_cashflow, eq := stockholders_equity)
                      ORDER BY fiscal_year_end) AS y, count(*) AS n FROM m_financials WHERE total_revenue IS NOT NULL GROUP BY symbol),
    z AS (SELECT symbol, n, y, y[-1] AS a, CASE WHEN n >= 3 THEN y[-3] END AS b,
                 CASE WHEN n >= 4 THEN list_filter(y[1:n-1], lambda r: r.rev <> 0)[1] END AS c, y[greatest(n - 2, 1):n] AS rec FROM y)
    SELECT symbol,
      CASE WHEN a.rev > 0 AND b.rev > 0 THEN pow(a.rev / b.rev, 1 / ((a.fye - b.fye) / 365.25)) - 1 END AS rev_cagr_3yr,
      CASE WHEN a.rev > 0 AND c.rev > 0 AND (a.fye - c.fye) / 365.25 >= 2.5 THEN pow(a.rev / c.rev, 1 / ((a.fye - c.fye) / 365.25)) - 1 END AS rev_cagr_5yr,
      list_avg(list_transform(list_filter(rec, lambda r: r.rev <> 0), lambda r: r.fcf / r.rev)) AS fcf_margin_3yr,
      list_avg(list_transform(list_filter(rec, lambda r: r.eq <> 0), lambda r: r.ni / r.eq)) AS roe_avg_3yr
    FROM z""")
_GROWTH = ("rev_cagr_3yr", "rev_cagr_5yr", "fcf_margin_3yr", "roe_avg_3yr")


@query("agg_12", "SELECT symbol, " + ", ".join(f"round({c}, 6) AS {c}" for c in _GROWTH) + " FROM m_growth")
def _(m):
    return A.growth_metrics(m.financials).select("symbol", *[r6(c, c) for c in _GROWTH])


@query("agg_13", """
    WITH f AS (SELECT * FROM m_fundamentals QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
    p AS (SELECT symbol, arg_max(close, date) AS price FROM m_close GROUP BY symbol)
    SELECT s.symbol, s.name, s.industry, round(s.shares * p.price, 2) AS market_cap, f.trailing_pe, f.return_on_equity, f.dividend_yield, f.debt_to_equity, """
       + ", ".join(f"round({c}, 6) AS {c}" for c in _GROWTH) + """
    FROM f JOIN m_symbols s USING (symbol) JOIN p USING (symbol) LEFT JOIN m_growth g USING (symbol) WHERE s.current""")
def _(m):
    fund = latest(m.fundamentals, "symbol", "date", "trailing_pe", "return_on_equity", "dividend_yield", "debt_to_equity")
    price = closes(m).groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    return (
        fund.join(m.symbols.where("current"), "symbol").join(price, "symbol")
        .join(A.growth_metrics(m.financials), "symbol", "left")
        .select("symbol", "name", "industry", r6(F.col("shares") * F.col("price"), "market_cap", 2), "trailing_pe",
                "return_on_equity", "dividend_yield", "debt_to_equity", *[r6(c, c) for c in _GROWTH])
        .orderBy(F.col("market_cap").desc(), "symbol")
    )


@query("agg_14", """
    WITH r AS (SELECT * FROM m_series WHERE date > (SELECT max(date) - 30 FROM m_series)),
    two AS (SELECT id, max(price) FILTER (rn = 1) AS price, max(price) FILTER (rn = 2) AS prev FROM
            (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS rn FROM m_series) GROUP BY id)
    SELECT id, round((two.price - prev) / prev * 100, 2) AS change_pct,
           string_agg(strftime(r.date, '%Y-%m-%d') || '=' || printf('%.4f', r.price), ',' ORDER BY r.date) AS sparkline
    FROM r JOIN two USING (id) GROUP BY id, two.price, prev""")
def _(m):
    """Sparkline arrays hold at most one point per day of a 30-day span."""
    from barograph.operators.latest import last_two

    recent = m.series.where(F.col("date") > F.date_sub(m.series.agg(F.max("date")).scalar(), 30))
    points = recent.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("date", "price"))).alias("points"))
    text = F.array_join(F.transform("points", lambda p: F.concat(
        p["date"].cast("string"), F.lit("="), F.format_string("%.4f", p["price"]))), ",")
    two = last_two(m.series, "id", "date", "price")
    return two.join(points, "id").select("id", percent(F.col("price"), F.col("prev")).alias("change_pct"), text.alias("sparkline"))


@query("agg_15", """SELECT symbol AS id, max(close) AS high, min(close) AS low FROM
       (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM m_close) WHERE rn <= 365 GROUP BY symbol""")
def _(m):
    return A.last_rows_range(closes(m).withColumnRenamed("symbol", "id"), "id", "date", "close", 365)


@query("agg_16", """
    WITH per AS (SELECT symbol, count(*) AS n, avg(CASE WHEN returns > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(returns) AS mean
                 FROM m_feat WHERE returns IS NOT NULL GROUP BY symbol)
    SELECT industry, CAST(sum(n) AS BIGINT) AS n, round(avg(hit), 6) AS hit_rate, round(avg(mean), 6) AS mean_return
    FROM per JOIN m_symbols USING (symbol) GROUP BY industry""")
def _(m):
    return industry_means(R.with_step_features(m.panel).where(F.col("returns").isNotNull()), m.symbols, "returns").select(
        "industry", "n", r6("hit_rate", "hit_rate"), r6("mean_return", "mean_return"))


def industry_means(rows, symbols, ret):
    """Unweighted industry mean of per-symbol means."""
    per = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("hit"), F.avg(ret).alias("mean"))
    return per.join(symbols.select("symbol", "industry"), "symbol").groupBy("industry").agg(
        F.sum("n").alias("n"), F.avg("hit").alias("hit_rate"), F.avg("mean").alias("mean_return"))


@query("agg_18", """
    SELECT symbol, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate, round(avg(r), 5) AS mean_return,
           round(CASE WHEN count(*) > 1 THEN avg(r) / (stddev_pop(r) + 1e-10) * sqrt(252) END, 3) AS sharpe, round(product(1 + r) - 1, 4) AS total_return
    FROM (SELECT f.symbol, a.actual AS r FROM m_forecasts f JOIN m_actual a ON a.symbol = f.symbol AND a.date = f.date
          WHERE a.actual IS NOT NULL AND f.score >= 1 AND f.date >= DATE '2000-07-01') GROUP BY symbol""")
def _(m):
    picked = forecast_actual(m).where((F.col("score") >= 1) & (F.col("date") >= "2000-07-01")).withColumnRenamed("actual", "ret")
    s = A.portfolio_stats(picked, ["symbol"])
    return s.select("symbol", "n", r6("hit_rate", "hit_rate", 4), r6("mean_return", "mean_return", 5),
                    r6("sharpe", "sharpe", 3), r6("total_return", "total_return", 4))


# Smaller floors, because the derived caps are around ten million.
FIXTURE_FLOORS = (("large", 20_000_000), ("mid", 15_000_000), ("small", 10_000_000), ("micro", 5_000_000))


def market_caps(m):
    price = closes(m).groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    return m.symbols.join(price, "symbol", "left").select("symbol", (F.col("shares") * F.col("price")).alias("cap"))


def bucket_sql(cap: str, floors=FIXTURE_FLOORS) -> str:
    arms = " ".join(f"WHEN {cap} >= {low} THEN '{name}'" for name, low in floors)
    return f"CASE WHEN {cap} IS NULL THEN 'unknown' {arms} ELSE 'nano' END"


view("m_caps", "SELECT s.symbol, shares * arg_max(close, date) AS cap FROM m_symbols s LEFT JOIN m_close c ON c.symbol = s.symbol GROUP BY s.symbol, shares")


@query("agg_19", f"SELECT bucket, count(*) AS n, round(avg(cap), 2) AS mean_cap FROM (SELECT {bucket_sql('cap')} AS bucket, cap FROM m_caps) GROUP BY bucket")
def _(m):
    return market_caps(m).groupBy(A.cap_bucket(F.col("cap"), FIXTURE_FLOORS).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("cap"), "mean_cap", 2))


_PAIRS20 = """SELECT symbol, count(*) AS n, corr(short_pct, returns) AS r FROM m_feat
    WHERE short_pct IS NOT NULL AND returns IS NOT NULL GROUP BY symbol"""


@query("agg_20", f"SELECT symbol, n, round(r, 6) AS r, round(p, 6) AS p_value FROM ({t_tail_sql(_PAIRS20, corr_t_sql('r', 'n'), 'n - 2', 'p')})")
def _(m):
    rows = features(m).where(F.col("short_pct").isNotNull() & F.col("returns").isNotNull())
    per = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.corr("short_pct", "returns").alias("r"))
    with_p = stats.with_t_tail(per, stats.correlation_t(F.col("r"), F.col("n")), F.col("n") - 2, "p")
    return with_p.select("symbol", "n", r6("r", "r"), r6("p", "p_value"))


@query("agg_21", """SELECT symbol, round(regr_slope(short_pct, returns), 4) AS slope, round(regr_intercept(short_pct, returns), 4) AS intercept
       FROM m_feat WHERE short_pct IS NOT NULL AND returns IS NOT NULL GROUP BY symbol HAVING count(*) >= 2""")
def _(m):
    rows = features(m).where(F.col("short_pct").isNotNull() & F.col("returns").isNotNull())
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), r6(F.regr_slope("short_pct", "returns"), "slope", 4),
        r6(F.regr_intercept("short_pct", "returns"), "intercept", 4)).where(F.col("n") >= 2).drop("n")


@query("agg_22", "SELECT count(DISTINCT date) AS n_dates, count(DISTINCT symbol) AS n_symbols, count(*) AS n_rows FROM m_bars")
def _(m):
    return m.trading_days.agg(F.countDistinct("date").alias("n_dates"), F.countDistinct("symbol").alias("n_symbols"),
                              F.count(F.lit(1)).alias("n_rows"))


@query("agg_23", """SELECT coalesce(industry, 'ALL') AS industry, count(*) AS n, count(*) FILTER (ratio > 1) AS n_split
       FROM m_events JOIN m_symbols USING (symbol) GROUP BY ROLLUP (industry)""")
def _(m):
    return m.events.join(m.symbols.select("symbol", "industry"), "symbol").rollup("industry").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ratio") > 1).alias("n_split")).withColumn(
        "industry", F.coalesce("industry", F.lit("ALL")))


@query("agg_24", "SELECT CAST(year(date) AS INTEGER) AS year, max(date) AS date, round(arg_max(close, date), 6) AS close FROM m_index GROUP BY 1")
def _(m):
    return m.index.groupBy(F.year("date").alias("year")).agg(
        F.max("date").alias("date"), r6(F.max_by("close", F.col("date")), "close"))


@query("agg_25", """SELECT symbol, date, close FROM m_close WHERE date IN (SELECT max(date) FROM m_close, m_asof
       WHERE date_trunc('month', date) < date_trunc('month', as_of) GROUP BY date_trunc('month', date))""")
def _(m):
    return A.completed_month_ends(closes(m).select("symbol", "date", "close"), m.as_of()).select("symbol", "date", "close")
