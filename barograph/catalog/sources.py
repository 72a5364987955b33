"""SRC, UDX-05: loaders applied to text that Spark derives from the given tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from barograph.catalog.base import query, view
from barograph.catalog.filters import closes
from barograph.catalog.rolling import r6
from barograph.functions.scalars import VAT
from barograph.operators.filters import split, with_history
from barograph.session import shared_folder
from barograph.sources import archives as Z
from barograph.sources import files as S
from barograph.sources import pages as P
from barograph.sources.market import CUT
from barograph.sources.sinks import read_or_build, write_result


@query("src_01", """SELECT symbol, date, open, high, low, close, volume FROM m_bars WHERE date < DATE '2000-07-01'
       AND symbol IN (SELECT symbol FROM m_bars WHERE date < DATE '2000-07-01' GROUP BY symbol HAVING count(*) >= 1000)""")
def _(m):
    return with_history(split(m.bars, "train", CUT), 1000).select("symbol", "date", "open", "high", "low", "close", "volume")


@query("src_02", "SELECT symbol, date, short FROM m_shorts WHERE date >= DATE '2000-07-01'")
def _(m):
    return split(m.shorts, "backtest", CUT).select("symbol", "date", "short")


@query("src_03", "SELECT symbol, name, industry, shares, current FROM m_symbols")
def _(m):
    return m.symbols.select("symbol", "name", "industry", "shares", "current")


def price_lines(m):
    return m.bars.select("symbol", F.concat_ws(",", "symbol", F.date_format("date", "yyyyMMdd"), "open", "high", "low", "close", "volume").alias("value"))


_BARS = "SELECT symbol, date, open, high, low, close, volume FROM m_bars"


@query("src_04", _BARS)
def _(m):
    return S.price_rows(price_lines(m).select("value"))


@query("src_05", "SELECT symbol, name, industry FROM m_symbols")
def _(m):
    listed = m.symbols.select(F.concat(F.lit('"'), "name", F.lit(', Ltd",'), "symbol", F.lit(","), "industry").alias("value"))
    titles = m.table("region").select(F.explode(F.array(
        F.concat(F.lit("List as at "), "r_name"), F.lit(""), F.lit("Company name,ASX code,GICS industry group"))).alias("value"))
    rows = S.company_rows(titles.unionByName(listed))
    return rows.withColumn("name", F.regexp_replace("name", ", Ltd$", ""))


@query("src_06", """SELECT symbol, round(trailing_pe * 1000 / dividend_yield, 4) AS shares FROM (SELECT symbol, round(trailing_pe, 2) AS trailing_pe, round(dividend_yield, 4) AS dividend_yield, date FROM m_fundamentals)
       WHERE date = (SELECT max(date) FROM m_fundamentals) AND dividend_yield <> 0""")
def _(m):
    cap = F.format_number(F.round("trailing_pe", 2) * 1000, 2)
    lines = m.fundamentals.select(
        F.concat(F.lit("valuation-"), F.date_format("date", "yyyy-MM-dd"), F.lit(".csv")).alias("file"),
        F.concat(F.lit("ASX:"), "symbol", F.lit(',"$'), cap, F.lit('",'), F.round("dividend_yield", 4)).alias("value"))
    return S.shares_from_snapshots(lines).select("symbol", r6("shares", "shares", 4))


@query("src_07", "SELECT symbol, date, round(short * 100, 2) AS short FROM m_shorts WHERE round(short * 100, 2) <> 0 AND date <> DATE '1998-03-03' AND isodow(date) < 6")
def _(m):
    """One matrix file per year, with descriptor lines, blanks and thousands separators."""
    year = F.year("date").cast("string")
    scaled = F.round(F.col("short") * 100, 2)
    cell = F.when(F.weekday("date") >= 5, "").when(scaled == 0, "-").otherwise(F.concat(F.lit('"'), F.format_number(scaled, 2), F.lit('"')))
    days = m.shorts.select("date").distinct().groupBy(F.year("date").cast("string").alias("file")).agg(F.sort_array(F.collect_list("date")).alias("d"))
    # one matrix line per file and symbol: at most one cell pair per report day of the year
    own = m.shorts.groupBy(year.alias("file"), "symbol").agg(F.map_from_entries(F.collect_list(F.struct("date", cell.alias("cell")))).alias("v"))
    # counts of eight digits, which read as dates, and both layouts (by even and odd years)
    pairs = F.transform("d", lambda x: F.concat(F.lit(",20181115,"), F.coalesce(F.element_at("v", x), F.lit(""))))
    body = own.join(days, "file").select("file", F.concat(
        F.lit('"Name, of '), "symbol", F.lit('",'), "symbol", F.concat_ws("", pairs)).alias("value"))

    def dates(layout):
        return F.concat(F.array_join(F.transform("d", lambda x: F.date_format(x, layout)), ",,"), F.lit(","))

    described = F.lit(",,Reported Short Positions,% held,")
    first = F.array(F.lit(",,Trade Date,,"), F.concat(F.lit(",,"), dates("yyyy-MM-dd")), described, F.lit("Product,Product Code,Reported Short Positions,%"))
    second = F.array(F.concat(F.lit(",Trade Date,"), dates("dd/MM/yyyy")), described)
    head = days.select("file", F.explode(F.when(F.col("file").cast("int") % 2 == 0, first).otherwise(second)).alias("value"))
    return S.short_matrix(head.unionByName(body), (*S.BAD_SHORT_DATES, "3 March 1998"))


@query("src_08", _BARS)
def _(m):
    """A zip per year with a member per month, each under a header line; one archive in the folder is broken."""
    lines = price_lines(m).select(F.split("value", ",").alias("c"), "value").select(
        F.substring(F.col("c")[1], 1, 4).alias("archive"), F.concat(F.substring(F.col("c")[1], 1, 6), F.lit(".csv")).alias("member"),
        F.xxhash64("value").alias("number"), "value")
    heads = lines.select("archive", "member").distinct().select(
        "archive", "member", F.lit(-(1 << 63)).alias("number"), F.lit("symbol,date,open,high,low,close,volume").alias("value"))
    path = f"{shared_folder(m.spark)}/archives-{uuid.uuid4().hex}"
    Z.write_archives(lines.unionByName(heads), path)
    broken = m.spark.range(1).select(F.lit("broken").alias("path"), F.lit("no archive").cast("binary").alias("content"))
    opened = Z.archive_lines(Z.stored_archives(m.spark, path).unionByName(broken))
    return S.yearly_price_rows(opened.where(F.col("problem").isNull()).select("value"))


@query("src_09", """SELECT symbol, date, open, high, low, CASE WHEN volume < 10 THEN 0.0 ELSE close END AS close, volume FROM m_bars""")
def _(m):
    """One JSON quote list per day."""
    quote = F.struct(F.concat("symbol", F.lit(" ")).alias("symbolCode"), "open", "high", "low",
                     F.when(F.col("volume") >= 10, F.col("close")).alias("close"), "volume")
    blank = F.struct(F.lit("  ").alias("symbolCode"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    payload = m.bars.groupBy(F.col("date").alias("day")).agg(F.to_json(F.concat(F.collect_list(quote), F.array(blank))).alias("value"))
    return S.quote_rows(payload)


@query("src_10", "SELECT symbol, date, open, high, low, close, volume FROM m_bars WHERE volume >= 10")
def _(m):
    def attr(name, value):
        return F.concat(F.lit(f' {name}="'), value, F.lit('"'))

    volume = F.when(F.col("volume") >= 10, F.col("volume")).otherwise(0.0)
    quote = F.concat(F.lit("<QUOTE"), attr("Symbol", F.col("symbol")), *[attr(c.capitalize(), F.col(c)) for c in ("open", "high", "low", "close")],
                     attr("Volume", volume), F.lit("/>"))
    payload = m.bars.groupBy(F.col("date").alias("day")).agg(
        F.concat(F.lit('<RESULT Message="Success">'), F.concat_ws("", F.collect_list(quote)), F.lit("</RESULT>")).alias("value"))
    return S.xml_quote_rows(payload)


@query("src_11", "SELECT CASE id WHEN 'click' THEN 'LEAD' WHEN 'error' THEN 'COPPER' WHEN 'view' THEN 'ZINC' END AS id, date, price FROM m_series WHERE id IN ('click', 'error', 'view')")
def _(m):
    metals = F.map_from_entries(F.collect_list(F.struct("id", "price")))
    stamp = F.create_map(F.lit("metal"), F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T03:27:06.264Z")))
    payload = m.series.groupBy("date").agg(metals.alias("metals")).select(
        F.to_json(F.struct(F.lit("success").alias("status"), "metals", stamp.alias("timestamps"))).alias("value"))
    return S.metal_rows(payload, {"click": "LEAD", "error": "COPPER", "view": "ZINC"})


@query("src_12", """SELECT symbol, fiscal_year_end, total_revenue, net_income, free_cashflow, stockholders_equity, CASE WHEN year(fiscal_year_end) % 2 = 0 THEN net_income * 2 ELSE net_income * 3 END AS operating_income FROM m_financials""")
def _(m):
    even = F.year("fiscal_year_end") % 2 == 0
    wide = m.financials.select("symbol", "fiscal_year_end", F.col("total_revenue").alias("Total Revenue"), F.col("net_income").alias("Net Income"),
                               F.col("free_cashflow").alias("Free Cash Flow"), F.col("stockholders_equity").alias("Common Stock Equity"),
                               F.when(even, F.col("net_income") * 2).alias("Operating Income"), (F.col("net_income") * 3).alias("Total Operating Income As Reported"))
    long = wide.unpivot(["symbol", "fiscal_year_end"], [c for c in wide.columns if c not in ("symbol", "fiscal_year_end")], "label", "value")
    return S.statement_rows(long).select("symbol", "fiscal_year_end", "total_revenue", "net_income", "free_cashflow", "stockholders_equity", "operating_income")


@query("src_13", "SELECT date, symbol, open, high, low, close, volume FROM m_bars")
def _(m):
    names = [f"NATION_{k}" for k in range(25)]
    wide = m.bars.groupBy("date").pivot("symbol", names).agg(
        *[F.max(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    return S.stacked_rows(wide, names)


@query("src_14", "SELECT event_id AS symbol, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, value, NULL::BIGINT AS label FROM events")
def _(m):
    rows = m.table("events").select(F.col("event_id").alias("symbol"), F.concat(
        F.lit('{"label":"n/a","value":'), "value", F.lit(","), F.expr("substring(props, 2)")).alias("value"))
    return S.metric_rows(rows, {"k": "bigint", "value": "double", "label": "bigint"})


@query("src_17", """
    WITH w AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'F') AS earnings, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'O') AS earnings_call,
           max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'P') AS ex_dividend, o_custkey % 2 = 0 AS is_estimate FROM orders GROUP BY o_custkey)
    SELECT symbol, earnings AS event_date, 'earnings' AS event_type, symbol || ' Results' AS title, is_estimate FROM w WHERE earnings >= DATE '2000-01-01'
    UNION ALL SELECT symbol, earnings_call, 'earnings_call', symbol || ' Earnings Call', is_estimate FROM w WHERE earnings_call >= DATE '2000-01-01'
    UNION ALL SELECT symbol, ex_dividend, 'ex_dividend', symbol || ' Ex-Dividend', FALSE FROM w WHERE ex_dividend >= DATE '2000-01-01'""")
def _(m):
    day = F.col("o_orderdate").cast("date")
    info = m.table("orders").groupBy("o_custkey").agg(*[
        F.max(F.when(F.col("o_orderstatus") == s, day)).alias(n) for s, n in (("F", "earnings"), ("O", "earnings_call"), ("P", "ex_dividend"))])
    info = info.select(F.col("o_custkey").cast("string").alias("symbol"), "earnings", "earnings_call", "ex_dividend", (F.col("o_custkey") % 2 == 0).alias("is_estimate"))
    return S.event_rows(info, F.lit(dt.date(2000, 1, 1)))


@query("src_18", """SELECT symbol, date, close, CASE WHEN close < 44 THEN 0.0 ELSE close END AS volume FROM m_option_bars WHERE close >= 40 AND close <= 60""")
def _(m):
    close = F.when(F.col("close") < 40, F.lit(float("nan"))).when(F.col("close") <= 60, F.col("close")).when(F.col("close") < 100, F.lit(-1.0))
    raw = m.option_bars.select("symbol", "date", close.alias("close"), F.when(F.col("close") >= 44, F.col("close")).alias("volume"))
    return S.live_bars(raw)


@query("src_15", "SELECT symbol, date, score FROM m_forecasts")
def _(m):
    """Records written as JSON beside their meta record and read back through the same schema."""
    path = f"{shared_folder(m.spark)}/result-{uuid.uuid4().hex}"
    write_result(m.forecasts.select("symbol", "date", "score"), path, "json", {"source": "forecasts"})
    return m.spark.read.schema("symbol string, date date, score double").json(path)


@query("src_16", "SELECT 'train' AS part, (SELECT max(date) FROM m_bars WHERE date < DATE '2000-07-01') AS newest, count(*) AS n FROM m_bars WHERE date < DATE '2000-07-01'")
def _(m):
    """The panel cache is keyed by split and newest date: built at the first call, read at the second."""
    panel = split(m.trading_days, "train", CUT)
    path, key = f"{shared_folder(m.spark)}/panels-{uuid.uuid4().hex}", f"train-{panel.agg(F.max('date')).first()[0]}"
    for _ in range(2):
        cached = read_or_build(m.spark, path, key, lambda: panel)
    return cached.agg(F.lit("train").alias("part"), F.max("date").alias("newest"), F.count(F.lit(1)).alias("n"))


# A page table of renames: one page per event, so that no page grows with the data.
@query("udx_05", """SELECT upper(n_name) AS old, 'N' || CAST(n_nationkey AS VARCHAR) AS new, CAST(o_orderdate AS DATE) AS effective_date
       FROM (SELECT o_orderdate, n_name, n_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 450000)""")
def _(m):
    from pyspark.sql import functions as f

    rows = (
        m.table("orders").where(F.col("o_totalprice") > 450000)
        .join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(m.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")))
    row = f.concat(f.lit("<tr class='r'><td>"), f.date_format("o_orderdate", "d MMMM"), f.lit("</td><td><b>"), f.lower("n_name"), f.lit("</b></td><td>x &amp; y</td><td>n"),
                   f.col("n_nationkey"), f.lit("</td></tr>"))
    pages = rows.select(f.concat(f.lit("<html>dc:title&#34;:&#34;"), f.year("o_orderdate"), f.lit("&#34;<table id='t'>"), row, f.lit("</table></html>")).alias("html"))
    return P.symbol_changes(pages)


view("m_pagetext", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS body FROM pages")


@query("udx_05_prices", """SELECT page_id, price FROM (SELECT page_id, CAST(replace(rtrim(coalesce(nullif(regexp_extract(x, '(?i)trading at\\s*([0-9,.]+)', 1), ''), nullif(regexp_extract(x, '(?i)(?:fell|rose|up|down) to\\s+([0-9,.]+)', 1), '')), '.'), ',', '') AS DOUBLE) AS price
       FROM (SELECT page_id, body || CASE page_id % 3 WHEN 0 THEN ' trading at ' || CAST(page_id + 1000 AS VARCHAR) || '.25 today' WHEN 1 THEN ' fell to 1,' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') || '.5.' ELSE '' END AS x FROM m_pagetext))
       WHERE price IS NOT NULL""")
def _(m):
    """Prices told in running text; the given pages get one sentence each to find."""
    k = F.col("page_id") % 3
    sentence = F.when(k == 0, F.concat(F.lit("<p> trading at "), F.col("page_id") + 1000, F.lit(".25 today</p>"))).when(
        k == 1, F.concat(F.lit("<p> fell to 1,"), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"), F.lit(".5.</p>"))).otherwise("")
    pages = m.table("pages").select("page_id", F.concat("html", sentence).alias("html"))
    return P.text_prices(pages, F.lit(dt.date(2024, 1, 1))).where(F.col("price").isNotNull()).select("page_id", "price")


@query("udx_05_options", """SELECT 'O' || p_partkey AS option_symbol, '2026-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS expiry, p_retailprice AS exercise, p_brand AS share_symbol,
       p_name || ' & Co' AS share_name, CASE WHEN p_partkey % 2 = 0 THEN 'American' END AS note FROM part""")
def _(m):
    """One page per part, with a heading row and a row whose exercise price can't be read."""
    def row(*cells):
        return F.concat(F.lit("<tr class='x'>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))

    key = F.col("p_partkey")
    expiry = F.concat(F.lit("2026-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))
    note = F.when(key % 2 == 0, "American").otherwise("")
    good = row(F.concat(F.lit("O"), key), expiry, F.col("p_retailprice"), F.concat(F.lit("<b>"), "p_brand", F.lit("</b>")),
               F.concat("p_name", F.lit(" &amp; Co")), note)
    bad = row(F.lit("x"), expiry, F.lit("n/a"), F.col("p_brand"), F.col("p_name"), note)
    pages = m.table("part").select(F.concat(F.lit("<table><tr><th>Code</th></tr>"), good, bad, F.lit("</table>")).alias("html"))
    return P.option_rows(pages)


@query("udx_05_reported", f"SELECT make_date(2024, 3, CAST(page_id % 28 + 1 AS INTEGER)) AS date, round((1000.5 + page_id % 500) / {VAT}, 6) AS price FROM pages")
def _(m):
    """Prices reported with VAT; the given pages get one report each."""
    key = F.col("page_id")
    report = F.concat(F.lit("<p>as reported by Shanghai Metals Market on "), key % 28 + 1, F.lit(" March 2024</p>\n<td>CNY/mtu, traded price</td>\n<td>"),
                      key % 500 + 1000, F.lit(".5</td>"))
    pages = m.table("pages").select(F.concat(report, "html").alias("html"))
    return P.reported_prices(pages).select("date", r6("price", "price"))
