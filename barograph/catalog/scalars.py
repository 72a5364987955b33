"""FUN: scalar functions applied to the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.catalog.base import query, view
from barograph.catalog.filters import closes
from barograph.catalog.joins import aligned
from barograph.catalog.rolling import features, r6, warrant_underlying_returns
from barograph.functions import dates as D
from barograph.functions import scalars as S
from barograph.operators import rolling as R

view("m_traded", "SELECT symbol, date, close * volume * 137 AS v FROM m_close")


@query("fun_01", """SELECT symbol, date, printf('%d', CAST(round_even(v / pow(10.0, 3 * k), 0) AS BIGINT)) || ['', ' Thousand', ' Million', ' Billion', ' Trillion'][k + 1] AS text
       FROM (SELECT *, CAST(greatest(0, least(4, CASE WHEN v = 0 THEN 0 ELSE floor(log10(abs(v)) / 3) END)) AS INT) AS k FROM m_traded)""")
def _(m):
    v = F.col("close") * F.col("volume") * 137
    return closes(m).select("symbol", "date", S.millify(v).alias("text"))


_RATIOS = """SELECT symbol, date, ratio * (1 + CAST(epoch(date) / 86400 AS BIGINT) % 4) / 2 AS ratio FROM m_events"""


@query("fun_02", f"""SELECT symbol, date, CASE WHEN ratio >= 1 THEN 'split' ELSE 'consolidation' END AS event_type,
       CASE WHEN ratio >= 1 THEN CAST(CAST(round_even(ratio, 0) AS BIGINT) AS VARCHAR) || ':1 Split'
            ELSE '1:' || CAST(CAST(round_even(1 / ratio, 0) AS BIGINT) AS VARCHAR) || ' Consolidation' END AS description
       FROM ({_RATIOS}) WHERE abs(ratio - 1) >= 0.1""")
def _(m):
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    ratio = F.col("ratio") * (1 + day % 4) / 2
    rows = m.events.select("symbol", "date", ratio.alias("ratio")).where(S.split_counts(F.col("ratio")))
    return rows.select("symbol", "date", S.split_type(F.col("ratio")).alias("event_type"), S.split_text(F.col("ratio")).alias("description"))


@query("fun_03", """SELECT option_symbol, coalesce(nullif(regexp_extract(option_symbol, '^(.+)O[A-Z]$', 1), ''),
       nullif(regexp_extract(option_symbol, '^(.+)O$', 1), '')) AS underlying FROM m_options""")
def _(m):
    return m.options.select("option_symbol", S.underlying_code(F.col("option_symbol")).alias("underlying"))


_SUFFIXES = ", ".join(f"'{s}'" for s in S.WARRANT_SUFFIXES)


@query("fun_04", f"""SELECT code, CASE WHEN length(code) < 4 THEN FALSE ELSE substr(code, 4, 1) = 'O' OR (length(code) >= 6 AND right(code, 3) IN ({_SUFFIXES})) END AS is_option
       FROM (SELECT option_symbol AS code FROM m_options UNION ALL SELECT replace(option_symbol, 'P', 'AB') || 'SOA' FROM m_options UNION ALL SELECT symbol FROM m_symbols)""")
def _(m):
    codes = m.options.select(F.col("option_symbol").alias("code")).unionByName(
        m.options.select(F.concat(F.replace("option_symbol", F.lit("P"), F.lit("AB")), F.lit("SOA")).alias("code"))
    ).unionByName(m.symbols.select(F.col("symbol").alias("code")))
    return codes.select("code", S.is_warrant_or_option(F.col("code")).alias("is_option"))


@query("fun_05", """SELECT symbol, CASE s WHEN 'XAO' THEN '^AORD' WHEN 'XJO' THEN '^AXJO' ELSE s || '.AX' END AS ticker
       FROM (SELECT symbol, CASE symbol WHEN 'NATION_0' THEN 'XAO' WHEN 'NATION_1' THEN 'XJO' ELSE symbol END AS s FROM m_symbols)""")
def _(m):
    code = F.when(F.col("symbol") == "NATION_0", "XAO").when(F.col("symbol") == "NATION_1", "XJO").otherwise(F.col("symbol"))
    return m.symbols.select("symbol", S.ticker(code).alias("ticker"))


@query("fun_06", """SELECT date, fy, CAST(fy - 1 AS VARCHAR) || '-' || right(CAST(fy AS VARCHAR), 2) AS label, make_date(fy - 1, 7, 1) AS q13_start,
       make_date(fy, 3, 31) AS q13_end, make_date(fy, 4, 1) AS q4_start, make_date(fy, 6, 30) AS q4_end
       FROM (SELECT date, CAST(year(date) + CASE WHEN month(date) >= 7 THEN 1 ELSE 0 END AS BIGINT) AS fy FROM m_cal)""")
def _(m):
    fy = (F.year("date") + F.when(F.month("date") >= 7, 1).otherwise(0)).cast("long")
    rows = m.calendar.select("date", fy.alias("fy"))
    bounds = D.fiscal_bounds(F.col("fy"))
    return rows.select("date", "fy", D.fiscal_label(F.col("fy")).alias("label"), *[c.alias(k) for k, c in bounds.items()])


@query("fun_07", """SELECT date, CAST(c - CASE WHEN date < make_date(c, 6, 30) + 5 THEN 1 ELSE 0 END AS INTEGER) AS fy
       FROM (SELECT date, year(date) - CASE WHEN month(date) >= 7 THEN 0 ELSE 1 END AS c FROM m_cal)""")
def _(m):
    return m.calendar.select("date", D.last_complete_fiscal_year(F.col("date")).cast("int").alias("fy"))


@query("fun_08", "SELECT symbol, date, greatest(6.0::DOUBLE, 0.0008::DOUBLE * v) AS fee FROM m_traded")
def _(m):
    v = F.col("close") * F.col("volume") * 137
    return closes(m).select("symbol", "date", S.fee(v).alias("fee"))


@query("fun_09", """SELECT symbol, date, CAST(greatest(0, least(floor((1000 - 6.0) / p), floor(1000 / (p * (1 + 0.0008::DOUBLE))))) AS BIGINT) AS shares
       FROM (SELECT symbol, date, open / 37 AS p FROM m_bars)""")
def _(m):
    return m.bars.select("symbol", "date", S.whole_shares(F.col("open") / 37).cast("long").alias("shares"))


view("m_wfeat_base", """SELECT a.option_symbol, a.date, a.w_close, a.u_close, o.exercise, o.expiry, o.note,
       CASE WHEN contains(upper(coalesce(o.note, 'C')), 'C') THEN 'C' WHEN contains(upper(coalesce(o.note, 'C')), 'P') THEN 'P' ELSE 'C' END AS cp
       FROM m_aligned a JOIN m_options o USING (option_symbol)""")
view("m_money", """SELECT option_symbol, date, cp, greatest(0, expiry - date)::DOUBLE AS dte,
       CASE WHEN cp = 'C' THEN u_close / greatest(exercise, 1e-6) WHEN u_close > 0 THEN exercise / u_close END AS moneyness,
       CASE WHEN cp = 'C' THEN greatest(0.0, u_close - exercise) ELSE greatest(0.0, exercise - u_close) END AS intrinsic, w_close, u_close
       FROM m_wfeat_base""")


@query("fun_10", """SELECT option_symbol, date, dte, round(moneyness, 6) AS moneyness, intrinsic,
       greatest(0.0, w_close - intrinsic) AS premium, round(CASE WHEN u_close > 0.001 THEN greatest(0.0, w_close - intrinsic) / u_close END, 6) AS premium_ratio
       FROM m_money""")
def _(m):
    from barograph.plans.warrants import value_features

    base = aligned(m).join(m.options.drop("share_symbol"), "option_symbol").withColumn("call_put", S.call_put(F.col("note"))).withColumnRenamed("exercise", "strike")
    return value_features(base).select(
        "option_symbol", "date", "dte", r6("moneyness", "moneyness"), "intrinsic",
        "premium", r6("premium_ratio", "premium_ratio"))


@query("fun_11", "SELECT symbol, date, round(CASE WHEN NOT head THEN w_ret END, 6) AS w_ret, round(CASE WHEN NOT head THEN u_ret END, 6) AS u_ret FROM m_wu")
def _(m):
    return warrant_underlying_returns(m).select("symbol", "date", r6("w_ret", "w_ret"), r6("u_ret", "u_ret"))


@query("fun_12", """SELECT symbol, date, round(list_avg(list_transform(list_filter([returns * 10, hl_spread, short_pct / 10], lambda x: x IS NOT NULL),
       lambda x: 1 / (1 + exp(-x / 1.5)))), 6) AS composite FROM m_feat""")
def _(m):
    scores = F.filter(F.array(F.col("returns") * 10, F.col("hl_spread"), F.col("short_pct") / 10), lambda x: x.isNotNull())
    each = F.transform(scores, lambda x: S.logistic(x))
    return features(m).select("symbol", "date", r6(
        F.try_divide(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), F.size(each)), "composite"))


@query("fun_13", """SELECT symbol, date, CASE WHEN symbol = 'NATION_5' AND close > 3000 THEN close / 10 WHEN symbol = 'NATION_5' AND close < 900 THEN close * 10 ELSE close END AS close FROM m_close""")
def _(m):
    return closes(m).select("symbol", "date", S.repair_index(F.col("close"), F.col("symbol"), "NATION_5", 900, 3000).alias("close"))


@query("fun_14", "SELECT symbol, date, 0.25::DOUBLE * low + 0.5::DOUBLE * close + 0.25::DOUBLE * high AS expected FROM (SELECT symbol, date, low + 0.00001::DOUBLE AS low, close, high FROM m_close)")
def _(m):
    scenarios = F.array(
        F.struct(F.lit(0.25).alias("probability"), (F.col("low") + 0.00001).alias("midpoint")),
        F.struct(F.lit(0.5).alias("probability"), F.col("close").alias("midpoint")),
        F.struct(F.lit(0.25).alias("probability"), F.col("high").alias("midpoint")))
    return closes(m).select("symbol", "date", S.expected_value(scenarios).alias("expected"))


@query("fun_15", "SELECT p_partkey, round(p_retailprice / 1.13::DOUBLE, 2) AS net FROM part")
def _(m):
    return m.table("part").select("p_partkey", S.without_vat(F.col("p_retailprice")).alias("net"))


_LAYOUT_SQL = ("strftime(date, '%Y%m%d')", "strftime(date, '%B %-d, %Y')", "strftime(date, '%-d %B %Y')", "strftime(date, '%Y-%m-%dT%H:%M:%SZ')", "'n/a'")
_LAYOUT_SPARK = ("yyyyMMdd", "MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd'T00:00:00Z'")


@query("fun_16", f"""SELECT date, CASE t % 5 WHEN 0 THEN {_LAYOUT_SQL[0]} WHEN 1 THEN {_LAYOUT_SQL[1]} WHEN 2 THEN {_LAYOUT_SQL[2]} WHEN 3 THEN {_LAYOUT_SQL[3]} ELSE 'n/a' END AS text,
       CASE WHEN t % 5 < 4 THEN date END AS parsed, date AS from_day FROM m_cal""")
def _(m):
    text = F.lit("n/a")
    for k, layout in enumerate(_LAYOUT_SPARK):
        text = F.when(F.col("t") % 5 == k, F.date_format("date", layout)).otherwise(text)
    short = F.date_format("date", "d-MMM")
    return m.calendar.select("date", text.alias("text"), D.any_date(text).alias("parsed"),
                             D.day_month_in_year(short, F.year("date")).alias("from_day"))


@query("fun_17", """SELECT event_id, CAST((to_timestamp(floor(epoch(ts))) AT TIME ZONE 'Australia/Sydney') AS DATE) AS day FROM events""")
def _(m):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return m.table("events").select("event_id", S.local_day(seconds, "Australia/Sydney").alias("day"))


_NOTES = "CASE l_partkey % 5 WHEN 0 THEN 'consol post' WHEN 1 THEN 'put' WHEN 2 THEN 'x' WHEN 3 THEN 'American call' END"


@query("fun_18", f"""SELECT DISTINCT l_partkey, CASE WHEN contains(n, 'C') THEN 'C' WHEN contains(n, 'P') THEN 'P' ELSE 'C' END AS call_put
       FROM (SELECT l_partkey, upper(coalesce({_NOTES}, 'C')) AS n FROM lineitem)""")
def _(m):
    k = F.col("l_partkey") % 5
    note = F.when(k == 0, "consol post").when(k == 1, "put").when(k == 2, "x").when(k == 3, "American call")
    return m.table("lineitem").select("l_partkey").distinct().select("l_partkey", S.call_put(note).alias("call_put"))


@query("fun_19", """SELECT o.option_symbol, any_value(o.exercise) AS exercise,
       list_reduce(list_prepend(any_value(o.exercise), list(e.ratio ORDER BY e.date)), lambda acc, r: round(acc / r, 6)) AS adjusted,
       'post ' || string_agg(CASE WHEN e.ratio >= 1 THEN CAST(CAST(round_even(e.ratio, 0) AS BIGINT) AS VARCHAR) || ':1 Split'
            ELSE '1:' || CAST(CAST(round_even(1 / e.ratio, 0) AS BIGINT) AS VARCHAR) || ' Consolidation' END, ', ' ORDER BY e.date) AS note
       FROM m_options o JOIN m_events e ON e.symbol = o.share_symbol AND e.date > o.fetched_at GROUP BY o.option_symbol""")
def _(m):
    return adjusted_exercises(m.options, m.events)


def adjusted_exercises(options, events):
    """Exercise after all later events of the underlying, with the note that lists them.

    An underlying has one event a day at most, so its list is bounded by the calendar, and all
    lists by the fixed number of underlyings: they travel to the options, of which none is repeated.
    """
    described = events.select(F.col("symbol").alias("share_symbol"), F.struct(
        "date", "ratio", S.split_text(F.col("ratio")).alias("description")).alias("event"))
    listed = described.groupBy("share_symbol").agg(F.sort_array(F.collect_list("event")).alias("events"))
    later = F.filter("events", lambda e: e["date"] > F.col("fetched_at"))
    per = options.join(F.broadcast(listed), "share_symbol").withColumn("events", later).where(F.size("events") > 0)
    return per.select(
        "option_symbol", "exercise", S.adjust_exercise(F.col("exercise"), F.col("events")).alias("adjusted"),
        F.concat(F.lit("post "), F.array_join(F.col("events.description"), ", ")).alias("note"))


@query("fun_20", "SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(day(date) AS INTEGER) AS day, CAST(month(date) AS INTEGER) AS month FROM m_cal")
def _(m):
    return m.calendar.select("date", F.weekday("date").alias("weekday"), F.dayofmonth("date").alias("day"), F.month("date").alias("month"))


@query("fun_21", """SELECT id, date, round((price - prev) / nullif(prev, 0) * 100, 4) AS change_pct FROM
       (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY date) AS prev FROM m_series)""")
def _(m):
    prev = F.lag("price").over(R.series("id", "date"))
    return m.series.select("id", "date", S.change_pct(F.col("price"), prev).alias("change_pct"))


@query("fun_22", """SELECT symbol, len(list_filter(d, lambda r: NOT r.excluded)) AS n, round(list_sum(list_transform(list_filter(d, lambda r: NOT r.excluded), lambda r: r.x)), 4) AS total
       FROM (SELECT symbol, list(struct_pack(y := fiscal_year_end, x := net_income, excluded := total_revenue < 2e6)) AS d FROM m_financials GROUP BY symbol)""")
def _(m):
    """Yearly records to JSON text and back, dropping the excluded ones."""
    records = F.sort_array(F.collect_list(F.struct(
        F.col("fiscal_year_end").alias("y"), F.col("net_income").alias("x"), (F.col("total_revenue") < 2e6).alias("excluded"))))
    text = m.financials.groupBy("symbol").agg(F.to_json(records).alias("detail"))
    kept = F.filter(F.from_json("detail", "array<struct<y:date,x:double,excluded:boolean>>"), lambda r: ~r["excluded"])
    return text.withColumn("kept", kept).select(
        "symbol", F.size("kept").cast("long").alias("n"),
        r6(F.aggregate(F.transform("kept", lambda r: r["x"]), F.lit(0.0), lambda a, v: a + v), "total", 4))


@query("fun_23", """SELECT symbol, date, len(v) AS n, round(list_avg(v), 6) AS mean FROM
       (SELECT symbol, date, list_filter([returns, gap, short_pct], lambda x: x IS NOT NULL) AS v FROM m_feat) WHERE len(v) > 0""")
def _(m):
    scores = F.map_filter(F.create_map(*[x for c in ("returns", "gap", "short_pct") for x in (F.lit(c), F.col(c))]),
                          lambda k, v: v.isNotNull())
    rows = features(m).select("symbol", "date", scores.alias("scores")).where(F.size("scores") > 0)
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("symbol", "date", F.size("scores").cast("long").alias("n"), r6(total / F.size("scores"), "mean"))


@query("fun_24", """SELECT symbol, date, round(ln(1 + volume), 6) AS log_volume, sign(returns)::DOUBLE AS direction,
       round(greatest(-0.1, least(0.1, returns)), 6) AS clipped, round(sqrt(greatest(hl_spread, 0)), 6) AS root FROM (SELECT * FROM m_feat WHERE returns IS NOT NULL)""")
def _(m):
    rows = R.with_step_features(m.panel).where(F.col("returns").isNotNull())
    return rows.select(
        "symbol", "date", r6(F.log1p("volume"), "log_volume"), F.signum("returns").alias("direction"),
        r6(R.clip(F.col("returns"), -0.1, 0.1), "clipped"), r6(F.sqrt(R.floor_at(F.nanvl("hl_spread", F.lit(None)), 0.0)), "root"))


@query("fun_25", """SELECT c_custkey, regexp_replace(upper(trim(n)), '\\.AX$', '') AS code, upper(trim(str_split(n, '#')[1])) AS head
       FROM (SELECT c_custkey, '  ' || lower(c_name) || CASE WHEN c_custkey % 2 = 0 THEN '.ax ' ELSE ' ' END AS n FROM customer)""")
def _(m):
    raw = F.concat(F.lit("  "), F.lower("c_name"), F.when(F.col("c_custkey") % 2 == 0, ".ax ").otherwise(" "))
    return m.table("customer").select("c_custkey", S.normal_key(raw).alias("code"),
                                      F.upper(F.trim(F.element_at(F.split(raw, "#"), 1))).alias("head"))


@query("fun_26", """SELECT symbol, date, CASE WHEN returns > 0 THEN 'positive' ELSE 'negative' END AS direction,
       CASE WHEN abs(gap) < 0.001 THEN '***' WHEN abs(gap) < 0.01 THEN '**' WHEN abs(gap) < 0.05 THEN '*' ELSE '' END AS stars
       FROM m_feat WHERE returns IS NOT NULL""")
def _(m):
    from barograph.functions.stats import stars

    return R.with_step_features(m.panel).where(F.col("returns").isNotNull()).select(
        "symbol", "date", S.direction(F.col("returns")).alias("direction"), stars(F.abs("gap")).alias("stars"))
