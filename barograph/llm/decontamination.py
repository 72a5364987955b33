"""Operator 1: benchmark decontamination by spaced seeds, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import without

# Fixed masks, by the least number of words of the items they serve: offsets of the words that
# count; the words between them may differ. Each set meets every placing of the substitutions that
# WINDOW and SHARE allow an item of that length: two from 10 words on, one from 5, none below.
MASKS = {
    13: ((0, 1, 3, 5, 8, 9), (0, 2, 3, 6, 7, 11), (0, 1, 2, 5, 6, 10), (0, 1, 3, 4, 5, 6)),
    10: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7)),
    8: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    5: ((0, 1, 2), (0, 1, 3)),
    4: ((0, 1, 2, 3),), 3: ((0, 1, 2),), 2: ((0, 1),), 1: ((0,),),
}
_NUMBERED = [(low, m) for low, masks in MASKS.items() for m in masks]
WINDOW, SHARE = 13, 0.8
BROADCAST_SEEDS = 400_000  # seeds of benchmarks up to this many are broadcast; larger ones are joined by shuffle


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; Han and Kana, written without spaces, are a word each."""
    apart = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", " $0 ")
    return F.split(F.trim(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " ")), " ")


def _serving(n: Column) -> Column:
    """Which of MASKS serve an item of ``n`` words."""
    return F.coalesce(*[F.when(n >= low, F.lit(low)) for low in MASKS])


def _seeds(rows: DataFrame, position: str, lows: list[int]) -> DataFrame:
    """``rows`` (with ``tokens``), one row per start and mask of ``lows`` (of the row's own ``low``, if it has one): ``position``, ``seed``."""
    masks = [(k, low, m) for k, (low, m) in enumerate(_NUMBERED) if low in lows]
    own = (lambda low: F.col("low") == low) if "low" in rows.columns else (lambda low: F.lit(True))
    shortest = min(m[-1] for _, _, m in masks)
    # no filter on the token count: it would move below and split every text twice
    starts = rows.withColumn(position, F.explode(F.when(
        F.size("tokens") > shortest, F.sequence(F.lit(0), F.size("tokens") - shortest - 1))))
    named = [F.when((F.size("tokens") - F.col(position) > m[-1]) & own(low), F.xxhash64(
        F.lit(k), *[F.get("tokens", F.col(position) + o) for o in m])) for k, low, m in masks]
    return starts.withColumn("seed", F.explode(F.array(*named)))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Pairs of document and benchmark item that overlap up to substituted words, one row each.

    Seeds of both sides (hashes of the words a mask keeps) meet in an equi-join; each hit
    fixes an alignment, along which the item is compared word by word. A pair counts if
    some ``window`` aligned words (or the item's, if fewer) agree in ``share`` or more; for the
    default two, the masks miss no such pair. Items without a word, null texts and null ids
    match nothing. Repeated rows of one id count as one. Returns doc_id, item_id, doc_start (word position of the best window), n_agree
    (agreeing words along the alignment), similarity (share of the best window).
    """
    items = benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("tokens")).where(
        F.col("item_id").isNotNull() & (F.get("tokens", F.lit(0)) != "")).dropDuplicates(["item_id", "tokens"])
    seeds = _seeds(items.withColumn("low", _serving(F.size("tokens"))), "at", list(MASKS)).where(F.col("seed").isNotNull()).select(
        "seed", "item_id", "at", F.size("tokens").alias("n_item"), "low")
    lows = {r["low"]: r["count"] for r in seeds.groupBy("low").count().collect()}  # a few lengths
    seeds = seeds.drop("low")
    if sum(lows.values()) <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    texts = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("tokens"))
    lag = F.col("position") - F.col("at")
    hits = _seeds(texts, "position", list(lows) or [WINDOW]).join(seeds, "seed").select(
        "doc_id", "item_id", "n_item", lag.alias("lag"),
        F.slice("tokens", F.greatest(lag, F.lit(0)) + 1, F.col("n_item")).alias("span"))
    # rows that share an id may differ: each text's span along an alignment is judged
    lines = hits.groupBy("doc_id", "item_id", "n_item", "lag", F.xxhash64("span").alias("of")).agg(F.first("span").alias("span"))
    skip = F.greatest(-F.col("lag"), F.lit(0))  # item words before the document's first
    n = F.least(F.size("span"), F.col("n_item") - skip)
    agree = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (
        F.get("span", i) == F.get("item_tokens", i + F.col("skip"))).cast("int"))
    width = F.least(F.lit(window), F.col("n_item"))
    sums = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("width")), lambda i: F.aggregate(
        F.slice("agree", i + 1, F.col("width")), F.lit(0), lambda a, b: a + b))
    judged = lines.join(items.withColumnRenamed("tokens", "item_tokens"), "item_id").where(
        F.size("item_tokens") == F.col("n_item")).withColumn("skip", skip).withColumn("n", n).withColumn(
        "width", width).where(F.col("n") >= F.col("width")).withColumn("agree", agree).withColumn("sums", sums).withColumn(
        "best", F.array_max("sums")).withColumn("similarity", F.col("best") / F.col("width"))
    found = judged.where(F.col("similarity") >= share).select(
        "doc_id", "item_id", (F.greatest("lag", F.lit(0)) + F.array_position("sums", F.col("best")) - 1).cast("long").alias(
            "doc_start"), F.aggregate("agree", F.lit(0), lambda a, b: a + b).cast("long").alias("n_agree"), "similarity")
    best = F.max_by(F.struct("doc_start", "n_agree", "similarity"), F.struct("similarity", "n_agree", -F.col("doc_start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without any overlap; rows with a null id stay."""
    return without(docs, overlaps(docs, benchmark))
