"""Scalar functions of single rows, all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------------------
MAGNITUDES = ("", " Thousand", " Million", " Billion", " Trillion")
TICKER_OVERRIDES = {"XAO": "^AORD", "XJO": "^AXJO"}
TICKER_SUFFIX = ".AX"
WARRANT_SUFFIXES = (
    "JOA", "JOB", "JOC", "JOD", "SOA", "SOB", "SOC", "SOD", "UOA", "UOB", "UOC", "UOD", "VOA", "VOB", "VOC", "VOD",
    "WOA", "WOB", "WOC", "WOD", "XOA", "XOB", "XOC", "XOD", "YOA", "YOB", "YOC", "YOD", "ZOA", "ZOB", "ZOC", "ZOD",
)
FEE_FLAT = 6.0
FEE_RATE = 0.0008
STAKE = 1000.0
START_BALANCE = 50000.0
VAT = 1.13
# ------------------------------------------------------------------------------------------


def millify(value: Column) -> Column:
    step = F.when(value == 0, 0).otherwise(F.floor(F.log10(F.abs(value)) / 3))
    step = F.greatest(F.lit(0), F.least(F.lit(len(MAGNITUDES) - 1), step)).cast("int")
    scaled = value / F.pow(F.lit(10.0), 3 * step)
    return F.concat(F.format_string("%d", F.bround(scaled, 0).cast("long")),
                    F.element_at(F.array(*[F.lit(w) for w in MAGNITUDES]), step + 1))


def split_type(ratio: Column) -> Column:
    return F.when(~is_finite(ratio) | (ratio >= 1), "split").otherwise("consolidation")


def split_text(ratio: Column) -> Column:
    return (
        F.when(~is_finite(ratio), "Split")
        .when(ratio >= 1, F.concat(F.bround(ratio, 0).cast("long").cast("string"), F.lit(":1 Split")))
        .otherwise(F.concat(F.lit("1:"), F.bround(1 / ratio, 0).cast("long").cast("string"), F.lit(" Consolidation")))
    )


def split_counts(ratio: Column) -> Column:
    """False for ratios that are not finite or lie within 0.1 of one."""
    return is_finite(ratio) & (F.abs(ratio - 1) >= 0.1)


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def underlying_code(code: Column) -> Column:
    def group(pattern):
        return F.nullif(F.regexp_extract(code, pattern, 1), F.lit(""))

    return F.coalesce(group("^(.+)O[A-Z]$"), group("^(.+)O$"))


def is_warrant_or_option(code: Column) -> Column:
    fourth = F.substring(code, 4, 1) == "O"
    suffix = (F.length(code) >= 6) & F.substring(code, -3, 3).isin(*WARRANT_SUFFIXES)
    return F.when(F.length(code) < 4, False).otherwise(fourth | suffix)


def ticker(symbol: Column) -> Column:
    out = F.concat(symbol, F.lit(TICKER_SUFFIX))
    for code, mapped in TICKER_OVERRIDES.items():
        out = F.when(symbol == code, mapped).otherwise(out)
    return out


def fee(value: Column) -> Column:
    return F.greatest(F.lit(FEE_FLAT), F.lit(FEE_RATE) * value)


def round_trip_cost(stake: float, flat: float = FEE_FLAT, rate: float = FEE_RATE) -> float:
    return 2 * max(flat, rate * stake) / stake


def whole_shares(price: Column, stake: float = STAKE) -> Column:
    """Most shares whose cost plus fee stays within the stake."""
    return F.greatest(F.lit(0), F.least(F.floor((stake - FEE_FLAT) / price),
                                        F.floor(stake / (price * (1 + FEE_RATE)))))


def call_put(note: Column) -> Column:
    text = F.upper(F.coalesce(note, F.lit("C")))
    return F.when(text.contains("C"), "C").when(text.contains("P"), "P").otherwise("C")


def logistic(x: Column, scale: float = 1.5) -> Column:
    return 1 / (1 + F.exp(-x / scale))


def repair_index(close: Column, symbol: Column, index: str, low: float = 1500, high: float = 20000) -> Column:
    """Decimal-point slips of one index series."""
    return F.when((symbol == index) & (close > high), close / 10).when(
        (symbol == index) & (close < low), close * 10).otherwise(close)


def expected_value(scenarios: Column) -> Column:
    """Sum of probability times midpoint over an array of (probability, midpoint)."""
    return F.aggregate(scenarios, F.lit(0.0), lambda a, s: a + s["probability"] * s["midpoint"])


def without_vat(price: Column) -> Column:
    return F.round(price / VAT, 2)


def change_pct(new: Column, old: Column) -> Column:
    return F.round(F.try_divide(new - old, old) * 100, 4)


def local_day(epoch_seconds: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(epoch_seconds), zone))


def normal_key(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(text)), r"\.AX$", "")


def direction(r: Column) -> Column:
    return F.when(r > 0, "positive").otherwise("negative")


def adjust_exercise(exercise: Column, events: Column) -> Column:
    """Divides by each later event ratio in order, rounding to 6 decimals at every step."""
    def step(acc: Column, event: Column) -> Column:
        # from 1e11 on a double's shortest decimal has six places at most, so rounding, slow for large values, changes nothing
        value = acc / event["ratio"]
        return F.when(F.abs(value) >= 1e11, value).otherwise(F.round(value, 6))

    return F.aggregate(events, exercise, step)
