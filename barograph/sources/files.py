"""Loaders of delivered files.

Every loader is a function of a DataFrame of text (``value``, one record per row), so the
same code serves ``spark.read.text(path)``, a stream of files, or text already in a table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions.dates import any_date

# Prefixes and labels of the delivered layouts.
EXCHANGE_PREFIX = r"^ASX:"
CODE_HEADER = "ASX code"
BLANKS = ("", "-")
STATEMENT_LABELS = {
    "total_revenue": ("Total Revenue",),
    "net_income": ("Net Income",),
    "operating_income": ("Operating Income", "Total Operating Income As Reported"),
    "free_cashflow": ("Free Cash Flow",),
    "capital_expenditure": ("Capital Expenditure", "Purchase Of PPE"),
    "dividends_paid": ("Cash Dividends Paid", "Common Stock Dividend Paid"),
    "stockholders_equity": ("Stockholders Equity", "Common Stock Equity"),
}
TRADE_DATE = "Trade Date"
SHORT_LAYOUTS = ("yyyy-MM-dd", "d/M/yyyy")
BAD_SHORT_DATES = (
    "22 December 2022", "1 February 2022", "31 January 2022", "15 September 2020", "2 September 2020", "1 September 2020",
    "25 May 2020", "19 June 2017", "16 June 2017", "15 June 2017", "1 November 2016", "3 October 2016", "6 October 2014",
    "2 September 2014", "1 September 2014", "29 August 2014", "15 November 2013", "7 October 2013", "28 June 2013",
    "27 June 2013", "26 June 2013", "25 June 2013", "24 June 2013", "21 June 2013", "20 June 2013", "19 June 2013",
    "18 June 2013", "17 June 2013", "14 June 2013", "13 June 2013", "7 June 2013", "22 October 2012", "19 October 2012",
    "18 October 2012", "17 October 2012", "16 October 2012", "15 October 2012", "12 October 2012", "11 October 2012",
    "12 March 2012")
METAL_IDS = {"lead": "LEAD", "copper": "COPPER", "zinc": "ZINC", "nickel": "NICKEL", "aluminum": "ALUMINUM"}


def number(text: Column) -> Column:
    """Locale numeral: thousands separators dropped, anything else unreadable is null."""
    return F.regexp_replace(F.trim(text), "[,$%]", "").try_cast("double")


def cells(line: Column) -> Column:
    """CSV cells with quotes honoured and removed; one pass over the line."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',\s*+("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))
    return F.transform(found, lambda c: F.trim(F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))))


def price_rows(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Header-less ``symbol,yyyymmdd,o,h,l,c,v`` lines."""
    schema = "symbol string, day string, open double, high double, low double, close double, volume double"
    row = F.from_csv("value", F.lit(schema), {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    parsed = lines.select(row.alias("r")).select("r.*")
    return parsed.select("symbol", F.to_date("day", "yyyyMMdd").alias("date"), "open", "high", "low", "close", "volume")


def yearly_price_rows(lines: DataFrame) -> DataFrame:
    """Concatenated year files: their header lines drop out."""
    return price_rows(lines.where(~F.lower("value").startswith("symbol,") & (F.length(F.trim("value")) > 0)))


def company_rows(lines: DataFrame) -> DataFrame:
    """Listed-company list: title and blank lines have no code in the second cell."""
    c = lines.select(cells(F.col("value")).alias("c")).where(F.size("c") >= 3)
    rows = c.select(F.get("c", F.lit(1)).alias("symbol"), F.get("c", F.lit(0)).alias("name"), F.get("c", F.lit(2)).alias("industry"))
    return rows.where((F.length("symbol") > 0) & (F.col("symbol") != CODE_HEADER))


def shares_from_snapshots(lines: DataFrame) -> DataFrame:
    """Shares = market cap / last price from the newest dated snapshot file.

    ``lines`` carries ``file`` (its name ends in the date) besides ``value``.
    """
    dated = lines.withColumn("day", any_date(F.regexp_extract("file", r"(\d{4}-?\d{2}-?\d{2})", 1)))
    newest = dated.agg(F.max("day")).scalar()
    c = dated.where(F.col("day") == newest).select(cells(F.col("value")).alias("c")).where(F.size("c") >= 3)
    return c.select(F.regexp_replace(F.get("c", F.lit(0)), EXCHANGE_PREFIX, "").alias("symbol"),
                    F.try_divide(number(F.get("c", F.lit(1))), number(F.get("c", F.lit(2)))).alias("shares")).where(F.col("shares").isNotNull())


def short_matrix(lines: DataFrame, bad_dates: tuple[str, ...] = BAD_SHORT_DATES) -> DataFrame:
    """Wide short-position matrix to (symbol, date, short).

    ``lines`` carries ``file``. Report dates stand in every second cell from the third on,
    their percentages one cell later. A data line always has a product code in its second
    cell; the date line has none (first layout) or says "Trade Date" there (second layout),
    so counts that look like dates stay counts.
    """
    split = lines.select("file", cells(F.col("value")).alias("c")).where(F.size("c") >= 4)
    code = F.get("c", F.lit(1))
    is_dates = (code == TRADE_DATE) | ((code == "") & any_date(F.get("c", F.lit(2)), SHORT_LAYOUTS).isNotNull())
    bad = [dt.datetime.strptime(d, "%d %B %Y").date() for d in bad_dates]
    heads = split.where(is_dates).select("file", F.posexplode("c").alias("pos", "text")).where(
        (F.col("pos") >= 2) & (F.col("pos") % 2 == 0)).select(
        "file", (F.col("pos") + 1).alias("pos"), any_date(F.col("text"), SHORT_LAYOUTS).alias("date")).where(
        F.col("date").isNotNull() & ~F.col("date").isin(bad))
    body = split.where((code != "") & ~code.isin(TRADE_DATE, "Product Code")).select("file", code.alias("symbol"), F.posexplode("c").alias("pos", "text")).where(
        (F.col("pos") >= 3) & (F.col("pos") % 2 == 1) & ~F.col("text").isin(*BLANKS))
    # one header cell per file and report date
    return body.join(heads, ["file", "pos"]).select("symbol", "date", number(F.col("text")).alias("short"))


def quote_rows(payloads: DataFrame) -> DataFrame:
    """JSON quote lists (``value``) of one ``day``: blank symbols skipped, missing numbers 0."""
    schema = "array<struct<symbolCode:string,open:double,high:double,low:double,close:double,volume:double>>"
    q = payloads.select("day", F.inline(F.from_json("value", schema)))
    numbers = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("open", "high", "low", "close", "volume")]
    return q.where(F.length(F.trim("symbolCode")) > 0).select(F.trim("symbolCode").alias("symbol"), F.col("day").alias("date"), *numbers)


def xml_quote_rows(payloads: DataFrame) -> DataFrame:
    """XML quote lists: attributes of QUOTE elements, zero-volume (holiday) rows dropped."""
    schema = ("_Message string, QUOTE array<struct<_Symbol:string,_Open:double,_High:double,_Low:double,_Close:double,_Volume:double>>")
    parsed = payloads.select("day", F.from_xml("value", schema).alias("x"))
    good = parsed.where(F.coalesce(F.lower("x._Message"), F.lit("success")).isin("success", ""))
    q = good.select("day", F.inline("x.QUOTE"))
    kept = q.where((F.length(F.trim("_Symbol")) > 0) & (F.floor(F.coalesce("_Volume", F.lit(0.0))) != 0))
    return kept.select(F.trim("_Symbol").alias("symbol"), F.col("day").alias("date"), *[
        F.coalesce(f"_{c}", F.lit(0.0)).alias(c.lower()) for c in ("Open", "High", "Low", "Close")],
        F.floor("_Volume").cast("double").alias("volume"))


def metal_rows(payloads: DataFrame, ids: dict[str, str] | None = None) -> DataFrame:
    """Map of prices with one shared timestamp to (id, date, price); unmapped names drop out."""
    ids = METAL_IDS if ids is None else ids
    schema = "status string, metals map<string,double>, timestamps map<string,string>"
    p = payloads.select(F.from_json("value", schema).alias("j")).where(F.col("j.status") == "success")
    rows = p.select(any_date(F.substring(F.col("j.timestamps")["metal"], 1, 10)).alias("date"), F.explode("j.metals").alias("name", "price"))
    mapping = F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.lit(v))])
    return rows.select(F.try_element_at(mapping, F.col("name")).alias("id"), "date", "price").where(F.col("id").isNotNull())


def statement_rows(cells_long: DataFrame, labels: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(symbol, label, fiscal_year_end, value) cells to one row per fiscal year, the first
    label synonym present winning."""
    labels = STATEMENT_LABELS if labels is None else labels
    known = [name for group in labels.values() for name in group]
    wide = cells_long.where(F.col("label").isin(*known)).groupBy("symbol", "fiscal_year_end").pivot("label", known).agg(F.max("value"))
    return wide.select("symbol", "fiscal_year_end", *[F.coalesce(*[F.col(f"`{n}`") for n in group]).alias(metric) for metric, group in labels.items()])


def stacked_rows(wide: DataFrame, tickers: list[str]) -> DataFrame:
    """Columns ``<ticker>_<field>`` per date to long rows; rows without a close or OHLC drop out."""
    fields = ("open", "high", "low", "close", "volume")
    structs = F.array(*[F.struct(F.lit(t).alias("symbol"), *[F.col(f"{t}_{f}").alias(f) for f in fields]) for t in tickers])
    return wide.select("date", F.inline(structs)).dropna(subset=["open", "high", "low", "close"])


def metric_rows(payloads: DataFrame, types: dict[str, str]) -> DataFrame:
    """Flat JSON metric objects to typed columns; a value of the wrong kind becomes null."""
    raw = payloads.select("symbol", F.from_json("value", "map<string,string>").alias("j"))
    return raw.select("symbol", *[F.col("j")[name].try_cast(kind).alias(name) for name, kind in types.items()])


def event_rows(info: DataFrame, cutoff: Column) -> DataFrame:
    """Wide event dates to long rows (earnings, earnings call, ex-dividend) from the cutoff on."""
    kinds = F.array(
        F.struct(F.lit("earnings").alias("event_type"), F.col("earnings").alias("event_date"), F.lit(" Results").alias("suffix"), F.col("is_estimate").alias("est")),
        F.struct(F.lit("earnings_call").alias("event_type"), F.col("earnings_call").alias("event_date"), F.lit(" Earnings Call").alias("suffix"), F.col("is_estimate").alias("est")),
        F.struct(F.lit("ex_dividend").alias("event_type"), F.col("ex_dividend").alias("event_date"), F.lit(" Ex-Dividend").alias("suffix"), F.lit(False).alias("est")))
    rows = info.select("symbol", F.inline(kinds))
    return rows.where(F.col("event_date") >= cutoff).select(
        "symbol", "event_date", "event_type", F.concat("symbol", "suffix").alias("title"), F.col("est").alias("is_estimate"))


def live_bars(bars: DataFrame) -> DataFrame:
    """Historical bars: missing, NaN or non-positive closes dropped, missing volume 0."""
    close = F.nanvl("close", F.lit(None).cast("double"))
    return bars.where(close > 0).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
