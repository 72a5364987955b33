"""WIN: calendar, return, rolling and running operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barograph.catalog.base import query, view
from barograph.operators import rolling as R
from barograph.operators.asof import report_fill
from barograph.operators.calendar import equal_slices, every_kth_date, with_calendar_index
from barograph.operators.crosssection import unit_rank
from barograph.operators.latest import latest, period_returns
from barograph.operators.merge import month_ends
from barograph.sources.market import CUT

view("m_short_fill", """
    SELECT p.symbol, p.date, s.short AS short_pct
    FROM m_panel p
    JOIN (SELECT c.date, max(r.date) AS report FROM m_cal c
          LEFT JOIN (SELECT DISTINCT date FROM m_shorts) r ON r.date <= c.date GROUP BY c.date) d
      ON d.date = p.date
    LEFT JOIN m_shorts s ON s.symbol = p.symbol AND s.date = d.report""")

view("m_feat", """
    SELECT symbol, date, t, open, high, low, close, volume, valid, short_pct,
           CASE WHEN adj THEN (close - pc) / greatest(pc, 1e-8) END AS returns,
           CASE WHEN adj THEN ln(greatest(close / greatest(pc, 1e-8), 1e-10)) END AS log_returns,
           CASE WHEN valid THEN (high - low) / greatest(close, 1e-8) END AS hl_spread,
           CASE WHEN adj THEN (open - pc) / greatest(pc, 1e-8) END AS gap
    FROM (SELECT p.*, f.short_pct, lag(close) OVER w AS pc,
                 valid AND lag(valid) OVER w AND lag(t) OVER w = t - 1 AS adj
          FROM m_panel p JOIN m_short_fill f USING (symbol, date)
          WINDOW w AS (PARTITION BY symbol ORDER BY t))""")


def features(m):
    """Panel with one-step features and the filled short percentage."""
    if "_features" not in m.__dict__:
        panel = report_fill(m.panel, m.shorts.withColumnRenamed("short", "short_pct"), m.calendar, "short_pct")
        m.__dict__["_features"] = R.with_step_features(panel)
    return m.__dict__["_features"]


def r6(expr, name, digits=6):
    return F.round(expr, digits).alias(name)


@query("win_01", "SELECT date, t FROM m_cal")
def _(m):
    return m.calendar


@query("win_02", "SELECT symbol, t, valid FROM m_panel")
def _(m):
    return m.panel.select("symbol", "t", "valid")


for _name, _col in (("win_03", "returns"), ("win_04", "log_returns"), ("win_05", "hl_spread"), ("win_06", "gap")):
    @query(_name, f"SELECT symbol, date, round({_col}, 6) AS {_col} FROM m_feat")
    def _(m, c=_col):
        return R.with_step_features(m.panel).select("symbol", "date", r6(c, c))


@query("win_07", """SELECT symbol, date, round(ln(vwap / lag(vwap) OVER (PARTITION BY symbol ORDER BY date)), 6) AS log_ret
                    FROM m_bars""")
def _(m):
    return m.bars.select("symbol", "date", r6(R.row_log_return("vwap"), "log_ret"))


_W20 = "(PARTITION BY symbol ORDER BY t RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)"
_W5 = "(PARTITION BY symbol ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("win_08", f"""SELECT symbol, date, round(CASE WHEN count(close) OVER w = 5 AND stddev_samp(close) OVER w > 1e-8
                            THEN (close - avg(close) OVER w) / stddev_samp(close) OVER w END, 6) AS z
                     FROM m_panel WINDOW w AS {_W5}""")
def _(m):
    return m.panel.select("symbol", "date", r6(R.zscore_strict("close", 5), "z"))


def fast_z_sql(x: str, w: int) -> str:
    win = f"(PARTITION BY symbol ORDER BY t RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    mean = f"sum(coalesce({x}, 0.0)) OVER {win} / {w}"
    sq = f"sum(coalesce({x}, 0.0) * coalesce({x}, 0.0)) OVER {win} / {w}"
    return (f"CASE WHEN {x} IS NOT NULL AND t >= {w - 1} THEN ({x} - {mean}) / "
            f"greatest(sqrt(greatest({sq} - ({mean}) * ({mean}), 0)), 1e-8) END")


@query("win_09", f"SELECT symbol, date, round({fast_z_sql('returns', 20)}, 4) AS z FROM m_feat")
def _(m):
    return R.with_step_features(m.panel).select("symbol", "date", r6(R.zscore_fast("returns", 20), "z", 4))


def slope_sql(x: str, w: int) -> str:
    """On a full window the slot offsets are known, so the slope is a fixed weighting."""
    win = f"(PARTITION BY symbol ORDER BY t RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    mid, spread = (w + 1) / 2, w * (w * w - 1) / 12
    return (f"CASE WHEN count({x}) OVER {win} = {w} THEN list_sum(list_transform("
            f"list({x} ORDER BY t) OVER {win}, lambda v, i: v * (i - {mid}::DOUBLE))) / {spread}::DOUBLE * {(w - 1) / 2}::DOUBLE END")


@query("win_10", f"SELECT symbol, date, round({slope_sql('ln(close)', 5)}, 6) AS slope FROM m_panel")
def _(m):
    return m.panel.select("symbol", "date", r6(R.slope_strict(F.log("close"), 5), "slope"))


@query("win_11", f"""SELECT symbol, date, round(CASE WHEN t >= 5 THEN sum(coalesce(returns, 0.0)) OVER {_W5} END, 6) AS momentum
                     FROM m_feat""")
def _(m):
    return R.with_step_features(m.panel).select("symbol", "date", r6(R.sum_zero_filled("returns", 5), "momentum"))


view("m_optret", """
    SELECT symbol, date, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS ret
    FROM m_option_bars""")


def option_returns(m):
    return m.option_bars.withColumn("ret", R.row_log_return("close"))


def z_skip_sql(x: str, w: int, by="symbol", order="date") -> str:
    win = f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY {order}) >= {w} "
            f"AND count({x}) OVER {win} >= {max(w // 2, 5)} AND stddev_samp({x}) OVER {win} >= 1e-8 "
            f"THEN ({x} - avg({x}) OVER {win}) / stddev_samp({x}) OVER {win} END")


def sum_skip_sql(x: str, w: int, by="symbol", order="date") -> str:
    win = f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY {order}) >= {w} "
            f"AND count({x}) OVER {win} >= {w // 2} THEN coalesce(sum({x}) OVER {win}, 0.0) END")


@query("win_12", f"SELECT symbol, date, round({z_skip_sql('ret', 10)}, 6) AS z FROM m_optret")
def _(m):
    return option_returns(m).select("symbol", "date", r6(R.zscore_skipping("ret", 10), "z"))


@query("win_13", f"SELECT symbol, date, round({sum_skip_sql('ret', 5)}, 6) AS total FROM m_optret")
def _(m):
    return option_returns(m).select("symbol", "date", r6(R.sum_skipping("ret", 5), "total"))


_TAIL = """list_slice(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER
           (PARTITION BY symbol ORDER BY date ROWS BETWEEN {h} PRECEDING AND CURRENT ROW), -{k}, NULL)"""


def tail_sql(x: str, history: int, keep: int) -> str:
    win = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {history - 1} PRECEDING AND CURRENT ROW)"
    return f"list_slice(coalesce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {win}, []), -{keep}, -1)"


def tail_z_sql(v: str) -> str:
    return (f"CASE WHEN len({v}) >= 2 AND list_var_pop({v}) > 0 "
            f"THEN ({v}[-1] - list_avg({v})) / sqrt(list_var_pop({v})) END")


def tail_slope_sql(v: str) -> str:
    return (f"CASE WHEN len({v}) >= 2 THEN (len({v}) * list_sum(list_transform({v}, lambda y, i: y * (i - 1))) "
            f"- (len({v}) * (len({v}) - 1) / 2) * list_sum({v})) / "
            f"(len({v}) * (len({v}) * (len({v}) - 1) * (2 * len({v}) - 1) / 6) "
            f"- (len({v}) * (len({v}) - 1) / 2) * (len({v}) * (len({v}) - 1) / 2)) END")


_SHORTV = f"""SELECT b.symbol, b.date, {tail_sql('s.short', 25, 20).replace('PARTITION BY symbol ORDER BY date', 'PARTITION BY b.symbol ORDER BY b.date')} AS v
              FROM m_bars b LEFT JOIN m_shorts s ON s.symbol = b.symbol AND s.date = b.date"""


def short_tail(m, kind):
    rows = m.bars.select("symbol", "date").join(m.shorts, ["symbol", "date"], "left")
    return R.with_tails(rows, {"v": (kind, "short", 25, 20)})


@query("win_14", f"SELECT symbol, date, round({tail_z_sql('v')}, 5) AS z FROM ({_SHORTV})")
def _(m):
    return short_tail(m, "zscore").select("symbol", "date", r6("v", "z", 5))


@query("win_15", f"SELECT symbol, date, round({tail_slope_sql('v')}, 6) AS slope FROM ({_SHORTV})")
def _(m):
    return short_tail(m, "slope").select("symbol", "date", r6("v", "slope"))


@query("win_16", """SELECT a.symbol, a.date, round(b.close / greatest(a.close, 1e-8) - 1, 6) AS fwd
                    FROM m_panel a LEFT JOIN m_panel b ON b.symbol = a.symbol AND b.t = a.t + 5 AND b.valid""")
def _(m):
    return m.panel.select("symbol", "date", r6(R.forward_return("close", 5), "fwd"))


@query("win_17", """
    WITH s AS (SELECT symbol, t, close, lead(close, 5) OVER w AS later,
                      coalesce(lag(t) OVER w, -1) AS prev FROM m_panel WINDOW w AS (PARTITION BY symbol ORDER BY t))
    SELECT c.date AS eval_date, s.symbol, round(s.later / s.close - 1, 6) AS actual
    FROM m_cal c JOIN s ON c.t > s.prev AND c.t <= s.t
    WHERE c.t % 5 = 0 AND s.later IS NOT NULL AND s.close > 0""")
def _(m):
    return R_next_rows(m)


def R_next_rows(m, rows: int = 5, step: int = 5):
    """For every step-th date: return from the first row at/after it to ``rows`` rows later.

    A symbol's row answers for the sampled dates after its previous row, so the dates
    are generated from the row itself rather than joined against every symbol.
    """
    w = R.series()
    first = (F.floor(F.coalesce(F.lag("t").over(w), F.lit(-1)) / step) + 1) * step
    per_row = m.panel.select(
        "symbol", "t", "close", F.lead("close", rows).over(w).alias("later"), first.alias("first"),
    ).where((F.col("later").isNotNull()) & (F.col("close") > 0) & (F.col("first") <= F.col("t")))
    sampled = per_row.select(
        "symbol", r6(F.col("later") / F.col("close") - 1, "actual"),
        F.explode(F.sequence("first", "t", F.lit(step).cast("long"))).alias("t"),
    )
    return sampled.join(F.broadcast(m.calendar), "t").select(F.col("date").alias("eval_date"), "symbol", "actual")


@query("win_18", "SELECT date, t FROM m_cal WHERE t % 5 = 0")
def _(m):
    return every_kth_date(m.calendar, 5)


@query("win_19", """SELECT symbol, date,
        min(w) OVER f = max(w) OVER f AND row_number() OVER (PARTITION BY symbol ORDER BY date) >= 6 AS stale
        FROM (SELECT symbol, date, round(close, 0) AS w FROM m_option_bars)
        WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(m):
    rounded = m.option_bars.withColumn("w", F.round("close", 0))
    return rounded.select("symbol", "date", R.is_stale("w").alias("stale"))


view("m_wu", """
    SELECT o.symbol, o.date, greatest(-1.0, least(1.0, ln(o.close / greatest(lag(o.close) OVER w, 1e-6)))) AS w_ret,
           greatest(-0.5, least(0.5, ln(b.vwap / greatest(lag(b.vwap) OVER w, 1e-6)))) AS u_ret,
           lag(o.close) OVER w IS NULL AS head
    FROM m_option_bars o JOIN m_options p ON p.option_symbol = o.symbol
    JOIN m_bars b ON b.symbol = p.share_symbol AND b.date = o.date
    WINDOW w AS (PARTITION BY o.symbol ORDER BY o.date)""")


def warrant_underlying_returns(m):
    joined = (
        m.option_bars.join(m.options.select(F.col("option_symbol").alias("symbol"), "share_symbol"), "symbol")
        .join(m.bars.select(F.col("symbol").alias("share_symbol"), "date", "vwap"), ["share_symbol", "date"])
    )
    w = R.series(order="date")
    return joined.select(
        "symbol", "date",
        R.clip(F.log(F.col("close") / R.floor_at(F.lag("close").over(w), 1e-6)), -1.0, 1.0).alias("w_raw"),
        R.clip(F.log(F.col("vwap") / R.floor_at(F.lag("vwap").over(w), 1e-6)), -0.5, 0.5).alias("u_raw"),
        F.lag("close").over(w).isNull().alias("head"),
    ).select("symbol", "date", F.when(~F.col("head"), F.col("w_raw")).alias("w_ret"),
             F.when(~F.col("head"), F.col("u_raw")).alias("u_ret"))


@query("win_20", """
    SELECT symbol, date, round(CASE WHEN count(ratio) OVER f >= 5
           AND row_number() OVER (PARTITION BY symbol ORDER BY date) >= 11 THEN avg(ratio) OVER f END, 5) AS delta
    FROM (SELECT symbol, date, CASE WHEN NOT head AND abs(u_ret) > 5e-4 THEN w_ret / u_ret END AS ratio FROM m_wu)
    WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(m):
    return warrant_underlying_returns(m).select("symbol", "date", r6(R.mean_return_ratio("w_ret", "u_ret"), "delta", 5))


@query("win_21", """
    SELECT symbol, date, round(CASE WHEN count(ret) OVER f >= 20
           AND row_number() OVER (PARTITION BY symbol ORDER BY date) >= 31
           THEN stddev_samp(ret) OVER f * sqrt(252) END, 6) AS vol
    FROM (SELECT symbol, date, ln(vwap / lag(vwap) OVER (PARTITION BY symbol ORDER BY date)) AS ret FROM m_bars)
    WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(m):
    returns = m.bars.select("symbol", "date", R.row_log_return("vwap").alias("ret"))
    return returns.select("symbol", "date", r6(R.historical_volatility("ret"), "vol"))


view("m_monthend", """SELECT symbol, date_trunc('month', date)::DATE AS month, max(date) AS date,
    arg_max(vwap, date) AS close FROM m_bars GROUP BY 1, 2""")


@query("win_22", """
    WITH recent AS (SELECT symbol, date, vwap AS close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM m_bars),
    last AS (SELECT symbol, max(close) FILTER (rn = 1) AS price, max(close) FILTER (rn = 2) AS prev FROM recent GROUP BY symbol),
    wk AS (SELECT symbol, arg_max(vwap, date) AS ref FROM m_bars, m_asof WHERE date <= as_of - 7 GROUP BY symbol),
    targets AS (SELECT * FROM (VALUES ('change_1m_pct', 31), ('change_3m_pct', 92), ('change_6m_pct', 183),
                ('change_1y_pct', 365), ('change_3y_pct', 1095), ('change_5y_pct', 1825)) v(k, d)),
    refs AS (SELECT symbol, k, coalesce(arg_min(close, date) FILTER (date >= as_of - d), arg_max(close, date)) AS ref
             FROM m_monthend, m_asof, targets GROUP BY symbol, k)
    SELECT l.symbol, round(price, 6) AS price, round((price - prev) / prev * 100, 2) AS change_1d_pct,
           round((price - wk.ref) / wk.ref * 100, 2) AS change_1w_pct,
           """ + ", ".join(
    f"round(max((price - r.ref) / r.ref * 100) FILTER (k = '{k}'), 2) AS {k}" for k in
    ("change_1m_pct", "change_3m_pct", "change_6m_pct", "change_1y_pct", "change_3y_pct", "change_5y_pct")) + """
    FROM last l JOIN wk USING (symbol) JOIN refs r USING (symbol)
    GROUP BY l.symbol, price, prev, wk.ref""")
def _(m):
    prices = m.bars.select("symbol", "date", F.col("vwap").alias("close"))
    return period_returns(prices, month_ends(prices), m.as_of())


@query("win_23", """
    WITH grid AS (SELECT c.date, s.symbol FROM m_cal c CROSS JOIN (SELECT DISTINCT symbol FROM m_bars) s
                  WHERE c.date >= DATE '2000-07-01'),
    f AS (SELECT g.symbol, g.date, b.vwap, first_value(b.vwap IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS entry,
          last_value(b.vwap IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS cur
          FROM grid g LEFT JOIN m_bars b ON b.symbol = g.symbol AND b.date = g.date)
    SELECT symbol, date, round(10000.0 * cur / entry, 4) AS value FROM f""")
def _(m):
    return holding_values(m, 10000.0).select("symbol", "date", r6("value", "value", 4))


def holding_values(m, stake: float):
    """Stake scaled to the first price at/after the cut, carried forward between trades.

    A traded row answers for the calendar slots up to the symbol's next row, which are
    generated from the row; the slots before the first trade have no value.
    """
    cal = m.calendar.where(F.col("date") >= F.lit(CUT))
    first, final = cal.agg(F.min("t")).scalar(), cal.agg(F.max("t")).scalar()
    held = m.panel.where(F.col("date") >= F.lit(CUT)).select("symbol", "t", "close")
    w = R.series()
    valued = held.select(
        "symbol", "t",
        (F.lit(stake) * F.col("close")
         / F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("value"),
        F.coalesce(F.lead("t").over(w) - 1, final).alias("until"),
        (F.row_number().over(w) == 1).alias("head"),
    )
    filled = valued.select("symbol", "value", F.explode(F.sequence("t", "until")).alias("t"))
    before = valued.where(F.col("head") & (F.col("t") > first)).select(
        "symbol", F.lit(None).cast("double").alias("value"),
        F.explode(F.sequence(first, F.col("t") - 1)).alias("t"))
    return filled.unionByName(before).join(F.broadcast(m.calendar), "t").drop("t")


@query("win_24", """
    WITH d AS (SELECT c.date, i.close FROM m_cal c LEFT JOIN m_index i ON i.date = c.date AND c.t % 7 <> 3
               WHERE c.date >= DATE '2000-07-01')
    SELECT date, round(50000.0 * last_value(close IGNORE NULLS) OVER w / first_value(close IGNORE NULLS) OVER w, 4) AS value
    FROM d WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def _(m):
    """The benchmark misses every seventh date, so the carry-forward is exercised."""
    cal = m.calendar.where(F.col("date") >= F.lit(CUT))
    quoted = with_calendar_index(m.index, cal).where(F.col("t") % 7 != 3).select("date", "close")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # bounded: calendar days
    return cal.join(quoted, "date", "left").select(
        "date", r6(50000.0 * F.last("close", True).over(w) / F.first("close", True).over(w), "value", 4))


@query("win_25", """
    WITH b AS (SELECT symbol, date, sum(round(coalesce(returns, 0) * 100, 4)) OVER w AS balance FROM m_feat
               WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING))
    SELECT symbol, date, round(balance, 4) AS balance, round(max(balance) OVER w, 4) AS peak,
           round(max(balance) OVER w - balance, 4) AS drawdown
    FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def _(m):
    steps = R.with_step_features(m.panel).select(
        "symbol", "date", F.round(F.coalesce("returns", F.lit(0.0)) * 100, 4).alias("step"))
    balance = steps.withColumn("balance", R.running(F.sum, "step", ["symbol"], ["date"]))
    peak = balance.withColumn("peak", R.running(F.max, "balance", ["symbol"], ["date"]))
    return peak.select("symbol", "date", r6("balance", "balance", 4), r6("peak", "peak", 4),
                       r6(F.col("peak") - F.col("balance"), "drawdown", 4))


@query("win_26", """
    SELECT symbol, date, round(exp(sum(ln(1 + greatest(least(coalesce(returns, 0), 0.5), -0.5))) OVER
           (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)), 6) AS equity FROM m_feat""")
def _(m):
    clipped = R.with_step_features(m.panel).select(
        "symbol", "date", R.clip(F.coalesce("returns", F.lit(0.0)), -0.5, 0.5).alias("r"))
    return clipped.select("symbol", "date", r6(F.exp(R.running(F.sum, F.log1p("r"), ["symbol"], ["date"])), "equity"))


@query("win_27", """
    SELECT symbol, date, round(CASE WHEN n >= 2 THEN (rn - 1)::DOUBLE / (n - 1) END, 6) AS rank FROM (
      SELECT symbol, date, count(*) OVER (PARTITION BY date) AS n,
             row_number() OVER (PARTITION BY date ORDER BY returns, symbol) AS rn
      FROM m_feat WHERE returns IS NOT NULL)
    UNION ALL SELECT symbol, date, NULL AS rank FROM m_feat WHERE returns IS NULL""")
def _(m):
    return R.with_step_features(m.panel).select("symbol", "date", r6(unit_rank("returns"), "rank"))


@query("win_28", """
    WITH w AS (SELECT symbol, date, list(close) OVER f AS v, list(volume) OVER f AS q,
                      row_number() OVER (PARTITION BY symbol ORDER BY date) AS start,
                      count(*) OVER (PARTITION BY symbol) AS n
               FROM m_panel WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
    SELECT symbol, date AS window_start,
           CASE WHEN start - 1 < CAST(floor((n - 9) * 0.8) AS BIGINT) THEN 'train' ELSE 'val' END AS split,
           round(greatest(least((v[10] - list_avg(v)) / (list_stddev_pop(v) + 1e-5), 5), -5), 5) AS last_close_z,
           round(greatest(least((q[10] - list_avg(q)) / (list_stddev_pop(q) + 1e-5), 5), -5), 5) AS last_volume_z
    FROM w WHERE len(v) = 10""")
def _(m):
    return training_windows(m.panel.select("symbol", "date", "close", "volume"), 10, 0.2).select(
        "symbol", "window_start", "split",
        r6(F.element_at("close_z", -1), "last_close_z", 5), r6(F.element_at("volume_z", -1), "last_volume_z", 5))


def training_windows(panel, length: int, val_share: float, clip_at: float = 5.0):
    """Sliding fixed-length windows, normalised inside each window, split in time order."""
    w = R.series(order="date")
    ahead = w.rowsBetween(0, length - 1)
    stats = {}
    for name in ("close", "volume"):
        stats[f"{name}_mean"] = F.avg(name).over(ahead)
        stats[f"{name}_std"] = F.stddev_pop(name).over(ahead)
    rows = panel.select(
        "symbol", F.col("date").alias("window_start"),
        F.collect_list("close").over(ahead).alias("close"),
        F.collect_list("volume").over(ahead).alias("volume"),
        *[expr.alias(name) for name, expr in stats.items()],
        (F.row_number().over(w) - 1).alias("start"),
        (F.count(F.lit(1)).over(Window.partitionBy("symbol")) - (length - 1)).alias("n"),
    ).where(F.size("close") == length)

    def normalised(name):
        return F.transform(name, lambda v: R.clip(
            (v - F.col(f"{name}_mean")) / (F.col(f"{name}_std") + 1e-5), -clip_at, clip_at))

    cut = F.floor(F.col("n") * (1 - val_share))
    return rows.select(
        "symbol", "window_start", F.when(F.col("start") < cut, "train").otherwise("val").alias("split"),
        normalised("close").alias("close_z"), normalised("volume").alias("volume_z"))


@query("win_29", """
    WITH n AS (SELECT count(*) AS n FROM m_cal)
    SELECT date, t, CAST(p AS INTEGER) AS slice FROM m_cal, n, range(5) r(p)
    WHERE t >= n * p // 5 AND t < n * (p + 1) // 5""")
def _(m):
    total = m.calendar.agg(F.count(F.lit(1))).scalar()
    return m.calendar.select("date", "t", equal_slices(5, total, F.col("t")).alias("slice"))
