"""Facts from web pages, as jobs over a table of pages. Regular expressions run natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions.dates import any_date
from barograph.functions.scalars import VAT

# Patterns of the pages.
PRICE_PATTERNS = (
    r"(?i)trading at\s*([\d,.]+)",
    r"(?i)(?:fell|rose|up|down) to\s+([\d,.]+)",
    r"(?i)(\d+\.?\d*)\s*(?:USD|USd|CNY)",
)
TEXT_DATE = r"(\w+ \d+, \d{4})"
REPORT_DATE = r"as reported by Shanghai Metals Market on (\d+ \w+ \d{4})"
REPORT_PRICE = r"(?i)CNY/mtu,\s*traded price\s*\n\s*(\d+\.?\d*)"
YEAR_MARK = r'dc:title&#34;:&#34;(\d{4})&#34;'


def plain_text(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def clean(cell: Column) -> Column:
    return F.trim(F.replace(plain_text(cell), F.lit("&amp;"), F.lit("&")))


def elements(html: Column, tag: str) -> Column:
    """Inner html of every ``tag`` element."""
    return F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns, row, cells) of every table row with cells."""
    kept = [c for c in pages.columns if c != html]
    rows = pages.select(*kept, F.posexplode(elements(F.col(html), "tr")).alias("row", "inner"))
    return rows.select(*kept, "row", F.transform(elements(F.col("inner"), "td"), clean).alias("cells")).where(F.size("cells") > 0)


def symbol_changes(pages: DataFrame) -> DataFrame:
    """Renames from pages of year sections, each with its first table."""
    parts = F.split("html", r"dc:title&#34;:&#34;(?=\d{4}&#34;)")
    sections = pages.select(F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("s"))
    tables = sections.select(F.substring("s", 1, 4).alias("year"), F.regexp_extract("s", r"(?s)(<table\b.*?</table>)", 1).alias("html"))
    rows = table_rows(tables.where(F.length("html") > 0)).where(F.size("cells") >= 4)
    date = F.coalesce(any_date(F.get("cells", F.lit(0))), any_date(F.concat_ws(" ", F.get("cells", F.lit(0)), "year")))
    changes = rows.select(F.upper(F.get("cells", F.lit(1))).alias("old"), F.upper(F.get("cells", F.lit(3))).alias("new"), date.alias("effective_date"))
    return changes.where((F.length("old") > 0) & (F.length("new") > 0) & (F.col("old") != F.col("new")) & F.col("effective_date").isNotNull())


def option_rows(pages: DataFrame) -> DataFrame:
    rows = table_rows(pages).where(F.size("cells") >= 5)
    def c(k):
        return F.get("cells", F.lit(k))

    out = rows.select(c(0).alias("option_symbol"), c(1).alias("expiry"), c(2).try_cast("double").alias("exercise"), c(3).alias("share_symbol"),
                      c(4).alias("share_name"), F.nullif(F.try_element_at("cells", F.lit(6)), F.lit("")).alias("note"))
    return out.where((F.length("option_symbol") > 0) & (F.length("expiry") > 0) & (F.length("share_symbol") > 0) & F.col("exercise").isNotNull())


def quoted_price(text: Column) -> Column:
    """First pattern that matches wins."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in PRICE_PATTERNS]
    return F.rtrim(F.replace(F.coalesce(*found), F.lit(","), F.lit("")), F.lit(".")).try_cast("double")


def text_prices(pages: DataFrame, as_of: Column) -> DataFrame:
    """Price and date told in the text of each page; a page without a date takes ``as_of``."""
    text = pages.withColumn("_text", plain_text(F.col("html")))
    dated = any_date(F.regexp_extract("_text", TEXT_DATE, 1))
    kept = [c for c in pages.columns if c != "html"]
    return text.select(*kept, quoted_price(F.col("_text")).alias("price"), F.coalesce(dated, as_of).alias("date")).where(F.col("price").isNotNull())


def reported_prices(pages: DataFrame) -> DataFrame:
    """Price reported with VAT on a stated day, returned without VAT."""
    text = pages.withColumn("_text", plain_text(F.col("html")))
    price = F.nullif(F.regexp_extract("_text", REPORT_PRICE, 1), F.lit("")).try_cast("double")
    return text.select(any_date(F.regexp_extract("_text", REPORT_DATE, 1)).alias("date"), (price / VAT).alias("price")).where(
        F.col("date").isNotNull() & F.col("price").isNotNull())
