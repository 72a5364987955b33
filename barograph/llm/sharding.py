"""Operator 6: shards of near-equal bytes by sampled splitters over (text hash, document)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barograph.llm.common import keep


def splitters(sample: pd.DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundary keys (hash, tie) at the quantiles of a weighted sample.

    A text that lies on one boundary alone moves whole behind it; one that spans several
    boundaries is larger than a range and is cut between its documents.
    """
    sample = sample.sort_values(["hash", "tie"])
    total = sample["weight"].sum()
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(sample["weight"].cumsum().to_numpy() / total, np.arange(1, ranges) / ranges)
    cut = sample.iloc[np.unique(np.minimum(at, len(sample) - 1))]
    alone = ~cut["hash"].duplicated(keep=False)
    low = np.iinfo(np.int64).min
    return cut["hash"].to_numpy(np.int64), np.where(alone, low, cut["tie"]).astype(np.int64)


def assign(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 256, samples_per_range: int = 20) -> DataFrame:
    """Every row with its shard and its gapless slot there; shards hold near-equal bytes.

    1. A sample of keys, drawn with chances in proportion to size and, for one half, alike
       (so that a mass of tiny texts spreads over ranges too; ``samples_per_range`` a range
       are expected, so the sample has a fixed bound), goes to the driver.
    2. Its quantiles bound fine ranges; every record falls into one.
    3. Ranges over twice their share are subdivided by running size, between texts where
       these fit, so that one hot text spans many pieces.
    4. Pieces, in key order, fill the shards.

    Sizes are the UTF-8 bytes of the text plus 1 (null text: 1). Equal texts are neighbours
    and share a shard unless they outgrow a range. Repeated rows get slots each. An empty
    table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = keep(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"),
        F.xxhash64("doc_id", F.lit("tie")).alias("tie")))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = shards * ranges_per_shard
    share = (F.col("size") / max(total, 1) + 1 / max(count, 1)) * (ranges * samples_per_range / 2)
    chance = F.xxhash64("tie", "hash", F.lit("draw")) / F.lit(2.0**64) + 0.5
    bound_hash, bound_tie = splitters(
        rows.where(chance < share).select("hash", "tie", F.greatest(share, F.lit(1.0)).alias("weight")).toPandas(), ranges)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, tie = batch["hash"].to_numpy(np.int64), batch["tie"].to_numpy(np.int64)
            low, high = np.searchsorted(bound_hash, h), np.searchsorted(bound_hash, h, side="right")
            for k in np.flatnonzero(high > low):
                low[k] += np.searchsorted(bound_tie[low[k]:high[k]], tie[k], side="right")
            yield batch.assign(range=low.astype(np.int32))

    schema = "doc_id long, size long, text_crc32 long, hash long, tie long, range int"
    target = max(total / ranges, 1.0)
    inside = W.partitionBy("range").orderBy("hash", "tie", "doc_id")
    run = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = rows.mapInPandas(place, schema).select(
        "*", F.row_number().over(inside).alias("n"), (F.sum("size").over(run) - F.col("size")).alias("begin"),
        F.sum("size").over(W.partitionBy("range")).alias("range_size")).withColumn(
        "group_begin", F.min("begin").over(W.partitionBy("range", "hash")))
    cut = F.floor(F.col("group_begin") / target) + F.floor((F.col("begin") - F.col("group_begin")) / target)
    ordered = keep(ordered.withColumn("piece", F.when(F.col("range_size") > 2 * target, cut).otherwise(0).cast("long")))
    in_order = W.orderBy("range", "piece")  # pieces number about two a range at most, whatever the input
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    pieces = ordered.groupBy("range", "piece").agg(
        F.sum("size").alias("piece_size"), F.count("*").alias("piece_rows"), F.min("n").alias("piece_first"))
    pieces = pieces.withColumn("ahead", F.coalesce(F.sum("piece_size").over(before), F.lit(0))).withColumn(
        "shard", F.least(F.floor((F.col("ahead") + F.col("piece_size") / 2) * shards / max(total, 1)),
                         F.lit(shards - 1)).cast("int"))
    same = W.partitionBy("shard").orderBy("range", "piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum("piece_rows").over(same), F.lit(0)))
    return ordered.join(F.broadcast(pieces.drop("piece_size", "piece_rows", "ahead")), ["range", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("n") - F.col("piece_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
