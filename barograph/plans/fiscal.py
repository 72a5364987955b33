"""Fiscal-year seasonality: does the July-March return foretell what follows?

Everything starts from a table of boundary dates per (symbol, fiscal year), generated
from the symbol row; one bounded as-of join prices all of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions import dates as D
from barograph.functions import stats
from barograph.operators.asof import backward_within
from barograph.operators.ranking import adjust_fdr

# Fixed values ------------------------------------------------------------------------------
MIN_FY = 1989
TOLERANCE_DAYS = 10
OUTLIER = 3.0
MIN_YEARS = 5
ALPHA = 0.05
WINDOWS = {
    "A": (57, 70, "Late May (day 57-70)"),
    "B": (71, 91, "Rest of Q4 (day 71-91, to Jun 30)"),
    "C": (1, 42, "New FY (Jul 1 - Aug 11)"),
}
Q4_WEEKS, POST_WEEKS = 13, 6
# -------------------------------------------------------------------------------------------


def years(symbols: DataFrame, last_fy: Column, first_fy: int = MIN_FY) -> DataFrame:
    return symbols.select("symbol", F.explode(
        F.sequence(F.lit(first_fy).cast("long"), last_fy.cast("long"))).alias("fy_year"))


def boundaries(symbol_years: DataFrame) -> DataFrame:
    """The four boundary dates of every fiscal year."""
    bounds = D.fiscal_bounds(F.col("fy_year"))
    return symbol_years.select("*", *[c.alias(k) for k, c in bounds.items()])


def _points(symbol_years: DataFrame, dated: list[tuple[str, int, Column]]) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), day.alias("boundary")) for kind, k, day in dated])
    return symbol_years.select("symbol", "fy_year", F.explode(kinds).alias("p")).select("symbol", "fy_year", "p.*")


def priced(points: DataFrame, closes: DataFrame) -> DataFrame:
    return backward_within(points, closes, "symbol", "boundary", "date", "close", TOLERANCE_DAYS)


def returns(symbol_years: DataFrame, closes: DataFrame, events: DataFrame) -> DataFrame:
    """One record per (symbol, FY) with full boundary data, with the exclusion reason."""
    bounds = D.fiscal_bounds(F.col("fy_year"))
    at = priced(_points(symbol_years, [(k, 0, c) for k, c in bounds.items()]), closes).groupBy("symbol", "fy_year").agg(*[
        F.max(F.when(F.col("kind") == k, F.col("close"))).alias(k) for k in bounds])
    usable = at.where(F.col("q13_end").isNotNull() & F.col("q4_end").isNotNull() & (F.col("q13_start") > 0) & (F.col("q4_start") > 0))
    fy = (F.year("date") + F.when(F.month("date") >= 7, 1).otherwise(0)).cast("long")
    eventful = events.select("symbol", fy.alias("fy_year")).distinct().withColumn("_event", F.lit(True))
    rec = usable.join(eventful, ["symbol", "fy_year"], "left").select(
        "symbol", "fy_year", D.fiscal_label(F.col("fy_year")).alias("fy"),
        (F.col("q13_end") / F.col("q13_start") - 1).alias("q13_return"),
        (F.col("q4_end") / F.col("q4_start") - 1).alias("q4_return"), "_event")
    outlier = (F.abs("q13_return") > OUTLIER) | (F.abs("q4_return") > OUTLIER)
    reason = F.when(outlier, "outlier").when(F.col("_event"), "corporate_event")
    return rec.withColumn("reason", reason).withColumn("excluded", F.col("reason").isNotNull()).drop("_event")


def _correlate(rows: DataFrame, keys: list[str], x: str, y: str, least: int) -> DataFrame:
    per = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_years"), F.nanvl(F.corr(x, y), F.lit(None)).alias("r"),
        F.avg(x).alias("mean_q13"), F.avg(y).alias("mean_other"), F.stddev_samp(x).alias("std_q13"),
        F.stddev_samp(y).alias("std_other"), F.min_by("fy", "fy_year").alias("first_fy"), F.max_by("fy", "fy_year").alias("last_fy"),
    ).where((F.col("n_years") >= least) & F.col("r").isNotNull())
    n = F.col("n_years")
    return stats.with_t_tail(per, stats.correlation_t(F.col("r"), n), n - 2, "p_value")


def symbol_correlations(records: DataFrame, least: int = MIN_YEARS) -> DataFrame:
    """Per symbol: r of q13 against q4 over the included years."""
    excluded = records.groupBy("symbol").agg(F.count_if("excluded").alias("n_excluded"))
    return _correlate(records.where(~F.col("excluded")), ["symbol"], "q13_return", "q4_return", least).join(excluded, "symbol")


def run(records: DataFrame, symbols: DataFrame, caps: DataFrame, least: int = MIN_YEARS) -> DataFrame:
    """Full table: correlations of current non-index symbols with market cap and FDR."""
    universe = symbols.where(F.col("current") & (F.col("industry") != "Index")).select("symbol", "industry")
    tested = symbol_correlations(records, least).join(universe, "symbol")
    with_cap = tested.join(caps, "symbol", "left").withColumn(
        "direction", F.when(F.col("r") >= 0, "positive").otherwise("negative"))
    return adjust_fdr(with_cap, "p_value")


def window_returns(symbol_years: DataFrame, records: DataFrame, closes: DataFrame) -> DataFrame:
    """Returns of the three sub-windows; A and B are both required, C may be missing."""
    b = D.fiscal_bounds(F.col("fy_year"))
    july = F.date_add(b["q4_end"], 1)
    dated = [
        ("A", 0, F.date_add(b["q4_start"], WINDOWS["A"][0] - 1)), ("A", 1, F.date_add(b["q4_start"], WINDOWS["A"][1])),
        ("B", 0, F.date_add(b["q4_start"], WINDOWS["B"][0] - 1)), ("B", 1, b["q4_end"]),
        ("C", 0, july), ("C", 1, F.date_add(july, WINDOWS["C"][1])),
    ]
    legs = priced(_points(symbol_years, dated), closes).groupBy("symbol", "fy_year").agg(*[
        F.max(F.when((F.col("kind") == w) & (F.col("k") == k), F.col("close"))).alias(f"{w}{k}") for w in WINDOWS for k in (0, 1)])

    def ret(w):
        return F.when(F.col(f"{w}0") > 0, F.col(f"{w}1") / F.col(f"{w}0") - 1)

    wide = legs.select("symbol", "fy_year", *[ret(w).alias(w) for w in WINDOWS]).where(
        F.col("A").isNotNull() & F.col("B").isNotNull())
    return records.where(~F.col("excluded")).join(wide, ["symbol", "fy_year"])


def window_run(window_rows: DataFrame, symbols: DataFrame, caps: DataFrame, least: int = MIN_YEARS) -> DataFrame:
    """Per (symbol, window) correlations with FDR inside each window."""
    universe = symbols.where(F.col("current") & (F.col("industry") != "Index")).select("symbol", "industry")
    enough = window_rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    long = window_rows.join(enough, "symbol", "left_semi").unpivot(
        ["symbol", "fy_year", "fy", "q13_return"], list(WINDOWS), "window", "window_return").where(F.col("window_return").isNotNull())
    tested = _correlate(long, ["symbol", "window"], "q13_return", "window_return", least)
    joined = tested.join(universe, "symbol").join(caps, "symbol", "left").withColumn(
        "direction", F.when(F.col("r") >= 0, "positive").otherwise("negative"))
    return adjust_fdr(joined, "p_value", ["window"])


def window_definitions(results: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Window catalogue with run statistics (significance is strict here)."""
    rows = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(a).alias("start_day"), F.lit(b).alias("end_day"), F.lit(t).alias("label"))
                     for w, (a, b, t) in WINDOWS.items()])
    defs = results.sparkSession.range(1).select(F.explode(rows).alias("d")).select("d.*")
    per = results.groupBy("window").agg(F.count(F.lit(1)).alias("n_tested"), F.count_if(F.col("fdr_p") < alpha).alias("n_significant"))
    return defs.join(per, "window", "left").fillna(0, ["n_tested", "n_significant"])


def weekly_breakdown(symbol_years: DataFrame, records: DataFrame, closes: DataFrame, least: int = 5) -> DataFrame:
    """Pooled correlation of q13 with each week: Q4 weeks need all thirteen present, the
    weeks after the year end stand alone."""
    b = D.fiscal_bounds(F.col("fy_year"))
    july = F.date_add(b["q4_end"], 1)
    dated = [("q4", k, F.date_add(b["q4_start"], 7 * k)) for k in range(Q4_WEEKS + 1)]
    dated += [("post", k, F.date_add(july, 7 * k)) for k in range(POST_WEEKS + 1)]
    kept = records.where(~F.col("excluded")).select("symbol", "fy_year", "q13_return")
    at = priced(_points(symbol_years, dated), closes)
    w = Window.partitionBy("symbol", "fy_year", "kind").orderBy("k")
    following = F.when(F.lead("k").over(w) == F.col("k") + 1, F.lead("close").over(w))
    steps = at.select("symbol", "fy_year", "kind", "k", F.when(F.col("close") > 0, following / F.col("close") - 1).alias("ret")).where(
        F.col("ret").isNotNull())
    present = F.count(F.lit(1)).over(Window.partitionBy("symbol", "fy_year", "kind"))
    full = steps.withColumn("_present", present).where((F.col("kind") == "post") | (F.col("_present") == Q4_WEEKS))
    week = F.when(F.col("kind") == "q4", F.col("k") + 1).otherwise(F.col("k") + Q4_WEEKS + 1)
    pooled = full.join(kept, ["symbol", "fy_year"]).groupBy(week.alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.nanvl(F.corr("q13_return", "ret"), F.lit(None)).alias("r"))
    tested = pooled.withColumn("r", F.when(F.col("n") >= least, F.col("r")))
    with_p = stats.with_t_tail(tested, stats.correlation_t(F.col("r"), F.col("n")), F.col("n") - 2, "p_value")
    return with_p.withColumn("stars", F.when(F.col("p_value").isNotNull(), stats.stars(F.col("p_value"))))


def details(records: DataFrame) -> DataFrame:
    """Included years of every symbol with the fitted line (null below two years)."""
    kept = records.where(~F.col("excluded"))
    line = kept.groupBy("symbol").agg(
        F.regr_slope("q4_return", "q13_return").alias("slope"), F.regr_intercept("q4_return", "q13_return").alias("intercept"))
    return kept.join(line, "symbol").withColumn("fitted", F.col("slope") * F.col("q13_return") + F.col("intercept"))
