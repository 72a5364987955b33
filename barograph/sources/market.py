"""Market tables derived from the star-schema parquet tables.

``Market`` is a set of lazy views over one data folder. Supplier nation plays the symbol,
region the industry, ship date the trading day. Nothing is collected; every method
returns a DataFrame that Spark plans together with the operator that uses it.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.operators.calendar import trading_calendar, with_calendar_index
from barograph.session import cut_lineage

BROADCAST_SUPPLIERS = 500_000
CUT = dt.date(2000, 7, 1)
"""Train / test cut of the derived tables."""


class Market:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def nations(self) -> DataFrame:
        """Nation and region are fixed-size dimension tables (25 and 5 rows)."""
        return self.table("nation").join(
            F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey")
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        """Suppliers of known nations. Up to BROADCAST_SUPPLIERS, counted first, are broadcast, so that lines do not move for them."""
        known = self.table("supplier").join(
            F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey")
        ).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("symbol"), F.col("s_nationkey").alias("nation"))
        return F.broadcast(known) if self.table("supplier").count() <= BROADCAST_SUPPLIERS else known

    @cached_property
    def supplier_symbols(self) -> DataFrame:
        return self.suppliers.select("l_suppkey", "symbol")

    @cached_property
    def ticks(self) -> DataFrame:
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_discount", "l_returnflag", "l_shipdate", glitched().alias("glitch"),
        )
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        return (
            lines.join(parts, "l_partkey")
            .join(self.supplier_symbols, "l_suppkey")
            .select(
                "symbol",
                F.col("l_shipdate").cast("date").alias("date"),
                traded_price().alias("px"),
                F.col("l_quantity").alias("q"),
                "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            )
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars. All aggregates combine map-side; one exchange on (symbol, date)."""
        order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", "px")
        sold = F.sum(F.when(F.col("l_returnflag") == "R", F.col("q")).otherwise(0.0))
        return self.ticks.groupBy("symbol", "date").agg(
            F.min_by("px", order).alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", order).alias("close"),
            F.sum("q").alias("volume"),
            volume_weighted().alias("vwap"),
            (100 * sold / F.sum("q")).alias("short_raw"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """Smooth close and volume of a symbol's days, written once.

        For queries that read them in several shapes, each of which would join all lines anew.
        """
        return cut_lineage(self.bars.select("symbol", "date", F.col("vwap").alias("close"), "volume"))

    @cached_property
    def trading_days(self) -> DataFrame:
        """Distinct (symbol, date) without the price join: prices do not decide trading."""
        return (
            self.table("lineitem").select("l_suppkey", "l_shipdate")
            .join(self.supplier_symbols, "l_suppkey")
            .select("symbol", F.col("l_shipdate").cast("date").alias("date"))
            .distinct()
        )

    @cached_property
    def calendar(self) -> DataFrame:
        return trading_calendar(
            self.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
        )

    def as_of(self) -> Column:
        """Latest bar date, as a scalar subquery."""
        return self.table("lineitem").agg(
            F.max("l_shipdate").cast("date").alias("as_of")
        ).scalar()

    @cached_property
    def industries(self) -> DataFrame:
        """Industry of every nation, traded or not; no line is read."""
        return self.nations.select(F.col("n_name").alias("symbol"), F.col("r_name").alias("industry"))

    @cached_property
    def symbols(self) -> DataFrame:
        last = self.trading_days.groupBy("symbol").agg(F.max("date").alias("last_date"))
        key = F.col("n_nationkey")
        suffix = (
            F.when(key % 12 == 11, F.lit("WARRANT TRUST"))
            .when(key % 12 == 10, F.lit("OPTION FUND"))
            .otherwise(F.concat("r_name", F.lit(" HOLDINGS")))
        )
        return (
            self.nations.withColumnRenamed("n_name", "symbol")
            .join(last, "symbol")
            .select(
                "symbol",
                F.concat_ws(" ", "symbol", suffix).alias("name"),
                F.col("r_name").alias("industry"),
                (1000.0 * (1 + key)).alias("shares"),
                (F.col("last_date") >= F.date_sub(self.as_of(), 90)).alias("current"),
            )
        )

    @cached_property
    def index(self) -> DataFrame:
        return self.bars.groupBy("date").agg(F.avg("vwap").alias("close"))

    @cached_property
    def shorts(self) -> DataFrame:
        reports = F.broadcast(self.calendar.where(F.col("t") % 2 == 0).select("date"))
        return self.bars.join(reports, "date").select(
            "symbol", "date", F.col("short_raw").alias("short")
        )

    @cached_property
    def events(self) -> DataFrame:
        orders = self.table("orders").where(F.col("o_totalprice") > 495000)
        customers = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_nationkey"
        )
        ratio = F.when(F.col("o_orderstatus") == "F", 2.0).otherwise(0.1)
        return (
            orders.join(customers, "o_custkey")
            .join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.max_by(ratio, "o_orderkey").alias("ratio"))
        )

    @cached_property
    def dividends(self) -> DataFrame:
        return self.table("orders").groupBy(
            F.col("o_custkey").cast("string").alias("symbol"),
            F.col("o_orderdate").cast("date").alias("ex_date"),
        ).agg((F.max("o_totalprice") / 1e6).alias("amount"))

    @cached_property
    def _lines_by_symbol(self) -> DataFrame:
        return self.table("lineitem").select(
            "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
        ).join(self.supplier_symbols, "l_suppkey")

    @cached_property
    def financials(self) -> DataFrame:
        price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        return self._lines_by_symbol.groupBy(
            "symbol", F.year("l_shipdate").alias("year")
        ).agg(
            F.round(F.sum(price), 2).alias("total_revenue"),
            F.round(F.sum(price * discount), 4).alias("net_income"),
            F.round(F.sum(price * tax), 4).alias("free_cashflow"),
            (F.sum("l_quantity") * 1000).alias("stockholders_equity"),
        ).select(
            "symbol", F.make_date("year", F.lit(6), F.lit(30)).alias("fiscal_year_end"),
            "total_revenue", "net_income", "free_cashflow", "stockholders_equity",
        )

    @cached_property
    def fundamentals(self) -> DataFrame:
        price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        return self._lines_by_symbol.groupBy(
            "symbol", F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("quarter")
        ).agg(
            F.max(F.col("l_shipdate").cast("date")).alias("date"),
            F.round(F.try_divide(F.sum(price), F.sum(price * discount)), 6).alias("trailing_pe"),
            F.round(F.sum(price * discount) / (F.sum("l_quantity") * 1000), 6).alias("return_on_equity"),
            (F.sum(F.round(tax * 100).cast("long")) / (F.count(F.lit(1)) * 100.0)).alias("dividend_yield"),
            F.round(F.sum(price * tax) / (F.sum("l_quantity") * 100), 6).alias("debt_to_equity"),
        ).drop("quarter")

    @cached_property
    def series(self) -> DataFrame:
        return self.table("events").groupBy(
            F.col("event_type").alias("id"), F.col("ts").cast("date").alias("date")
        ).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / (F.count(F.lit(1)) * 100.0)).alias("price"))

    @cached_property
    def options(self) -> DataFrame:
        per_part = self.table("lineitem").groupBy("l_partkey").agg(
            F.min("l_suppkey").alias("l_suppkey"),
            F.max(F.col("l_shipdate").cast("date")).alias("last_ship"),
        )
        key = F.col("l_partkey")
        return (
            per_part.join(self.supplier_symbols, "l_suppkey")
            .join(self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"),
                  "l_partkey")
            .select(
                option_symbol(key).alias("option_symbol"),
                F.col("symbol").alias("share_symbol"),
                F.date_add("last_ship", 90).alias("expiry"),
                F.col("p_retailprice").alias("exercise"),
                call_put_note(key).alias("note"),
                F.date_add(F.lit(dt.date(1996, 1, 1)), (key % 1500).cast("int")).alias("fetched_at"),
            )
        )

    @cached_property
    def option_bars(self) -> DataFrame:
        return self.ticks.groupBy("l_partkey", "date").agg(
            (0.05 * volume_weighted()).alias("close")
        ).select(option_symbol(F.col("l_partkey")).alias("symbol"), "date", "close")

    @cached_property
    def option_days(self) -> DataFrame:
        """``option_bars`` with the columns of ``options``, as all lines move once, by option.

        An option's rows then lie together, and what is grouped or windowed by option moves no more. A row
        whose suppliers are all unknown has no close. Keys of parts and suppliers are unique.
        """
        lines = self.table("lineitem").where(F.col("l_partkey").isNotNull()).select(
            option_symbol(F.col("l_partkey")).alias("option_symbol"), "l_suppkey", F.col("l_quantity").alias("q"),
            "l_discount", glitched().alias("glitch"), F.col("l_shipdate").cast("date").alias("date"))
        parts = self.table("part").select(option_symbol(F.col("p_partkey")).alias("option_symbol"), "p_partkey", "p_retailprice")
        priced = lines.join(self.suppliers.select("l_suppkey", "nation"), "l_suppkey", "left").repartition("option_symbol").join(
            parts, "option_symbol").withColumn("px", traded_price())
        option = Window.partitionBy("option_symbol")
        days = priced.groupBy("option_symbol", "date").agg(
            (0.05 * volume_weighted(F.col("nation").isNotNull())).alias("close"), F.max("p_partkey").alias("p_partkey"),
            F.max("p_retailprice").alias("exercise"), F.min("l_suppkey").alias("least"), F.min_by("nation", "l_suppkey").alias("nation"))
        names = F.broadcast(self.table("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("share_symbol")))
        return days.withColumns({
            "nation": F.min_by("nation", "least").over(option), "expiry": F.date_add(F.max("date").over(option), 90),
            "note": call_put_note(F.col("p_partkey")),
        }).join(names, "nation").select("option_symbol", "date", "close", "share_symbol", "expiry", "exercise", "note")

    @cached_property
    def panel(self) -> DataFrame:
        """Bars with calendar index; ``close`` is the daily vwap, ``valid`` the mask."""
        return with_calendar_index(
            self.bars.select(
                "symbol", "date", "open", "high", "low", F.col("vwap").alias("close"), "volume",
                (F.col("vwap").isNotNull() & (F.col("volume") > 0)).alias("valid"),
            ),
            self.calendar,
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        step = (F.floor(F.col("close") * 100) + 13 * F.col("t")) % 97
        return self.panel.where(F.col("t") % 5 == 0).select(
            "date", "symbol", F.round(step / 97.0 * 8 - 4, 6).alias("score")
        )


def glitched() -> Column:
    """Lines with a planted price glitch, told before they move, as the flag is smaller than the order's key."""
    return F.col("l_orderkey") % 499 == 0


def traded_price() -> Column:
    return F.col("p_retailprice") * (1 - F.col("l_discount")) * F.when(F.col("glitch"), 10.0).otherwise(1.0)


def volume_weighted(of: Column | None = None) -> Column:
    """Volume-weighted price from integer sums (ten-thousandths times lots), hence the same
    to the last bit whatever the order in which partial sums are merged. ``of`` picks the rows."""
    value, q = F.round(F.col("px") * 10000).cast("long") * F.col("q").cast("long"), F.col("q")
    if of is not None:
        value, q = F.when(of, value), F.when(of, q)
    return F.sum(value) / (F.sum(q) * 10000.0)


def call_put_note(part_key: Column) -> Column:
    return F.when(part_key % 3 == 0, F.lit("C")).when(part_key % 3 == 1, F.lit("P"))


def option_symbol(part_key: Column) -> Column:
    letter = F.substring(F.lit("ABCD"), (part_key % 4 + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("P"), part_key.cast("string"), F.lit("O"), letter)
