"""Shared helpers: scratch tables, byte-level tokenising in numpy, and packed key exchange.

``chunked`` lays texts out once as a bucketed table of bounded chunks; ``ask`` then sends
each chunk's distinct 64-bit keys to buckets (a Spark shuffle of packed arrays), where one
task per bucket sees every occurrence, and sends one answer per key back to its chunk. A
key occurs at most once per chunk, so a hot key costs one entry per chunk, not per row.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20  # of text tokenised at once: the arrays made of it take some fifty times as much
KEYS_PER_BUCKET = 1_500_000
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        named = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows travel to Python in batches of at most BATCH_ROWS rows and, but for longer single
    rows, BATCH_BYTES bytes, as long texts would fill a worker many at a time."""
    arrow = "spark.sql.execution.arrow."
    before = {name: spark.conf.get(arrow + name) for name in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    rows = int(before["maxRecordsPerBatch"])
    spark.conf.set(arrow + "maxRecordsPerBatch", min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)
    spark.conf.set(arrow + "maxBytesPerBatch", BATCH_BYTES)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(arrow + name, value)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, in small batches, and read it back; cuts the lineage."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled(docs: DataFrame, labels: DataFrame, target: str, rows: int, folds: int, fold: int) -> DataFrame:
    """doc_id, text, label of at most about ``rows`` labelled rows outside the held-out fold.

    Rows are drawn by a hash of the id. The drawn ids (their number is bounded by ``rows``)
    are broadcast, so no text is shuffled. An id labelled twice takes its mean, rounded.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(target) >= 0.5).cast("int").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold)
    share = min(1.0, rows / max(known.count(), 1))
    drawn = known.where(F.xxhash64("doc_id", F.lit(target)) / F.lit(2.0**64) + 0.5 < share)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(drawn), "doc_id")


BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``; null ids stay, as do all columns.

    Up to BROADCAST_IDS ids are broadcast, so that texts stay where they are; more are joined by shuffle.
    """
    gone = keep(ids.select(F.col("doc_id").cast("long").alias("_gone")).where(F.col("_gone").isNotNull()).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def slices(batch: pd.DataFrame, most: int = SLICE_BYTES) -> Iterator[pd.DataFrame]:
    """Consecutive parts of a batch of about ``most`` characters of text each."""
    size = np.cumsum([len(t) + 64 if isinstance(t, str) else 64 for t in batch["text"]])
    if len(size):
        for _, part in batch.groupby(size // most, sort=True):
            yield part


def release() -> None:
    """Give memory that a task has freed back to the system: its worker stays, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_BYTE = BYTE.copy()
LOWER_BYTE[65:91] = BYTE[97:123]
MULT = _RNG.integers(1, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads polynomial values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Fingerprints of any substring of a byte buffer, by prefix sums of a polynomial."""

    def __init__(self, buf: np.ndarray, lower: bool = False):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER_BYTE if lower else BYTE)[buf] * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Fingerprint of the ``length`` bytes that start at each possible position."""
        m = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:-length]) * self.back[:m]) if m > 0 else np.zeros(0, np.uint64)


class Words:
    """Words of many texts: fingerprints, document index, byte spans.

    By default words are ``[^\\x20\\x09-\\x0D]+``; ``gaps`` names other separating bytes.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, gaps: np.ndarray = SPACE):
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if len(texts) else np.zeros(0, np.int64)
        gap = gaps[buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.roll = Rolling(buf, lower)
        self.hash = self.roll.of(self.start, self.end)
        self.first = np.searchsorted(self.start, self.offset)  # index of each document's first word
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def beginning(self, which: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the first ``size`` bytes of some words."""
        return self.roll.of(self.start[which], self.start[which] + size) ^ np.uint64(size)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of ``size`` consecutive word fingerprints at each start."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = words[:m] * MULT[0]
    for k in range(1, size):
        total = total + words[k:k + m] * MULT[k % len(MULT)] * np.uint64(2 * (k // len(MULT)) + 1)
    return mix(total)


def long_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """As ``shingles`` for any size, by prefix sums instead of ``size`` additions."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(_BASE, n), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _powers(_INVERSE, n - size + 1))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` consecutive values, by spans of doubled length."""
    out, span = values, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    m = len(values) - width + 1
    return pick(out[:m], out[width - span:width - span + m]) if span < width else out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Positions holding the minimum of some ``width`` consecutive values (of all, if fewer).

    A value is a window's minimum exactly if the largest minimum among the windows over it
    equals it. Equal strings of ``width`` values select the same places.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= width:
        return np.flatnonzero(values == values.min())
    low = _sliding(values, width, np.minimum)
    rim = np.zeros(width - 1, values.dtype)
    return np.flatnonzero(_sliding(np.concatenate([rim, low, rim]), width, np.maximum) == values)


# ---------------------------------------------------------------- chunks

def as_bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, rest: bool = False) -> tuple[DataFrame, int]:
    """(chunk, row, doc_id, text[, rest]), bucketed by chunk, and the number of chunks.

    A chunk holds consecutive rows of one input partition up to ``chunk_bytes`` (one row at
    least). Bucketing lets every later pass group by chunk without moving text again.
    ``rest`` carries all other columns as one JSON string.
    """
    spark = docs.sparkSession
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    schema = "chunk long, row long, doc_id long, text string"
    if rest:
        others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        columns.append((F.to_json(F.struct(*others)) if others else F.lit("{}")).alias("rest"))
        schema += ", rest string"
    names = [part.split()[0] for part in schema.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, held, row = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            ids, rows = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for k, text in enumerate(batch["text"]):
                size = len(text) if isinstance(text, str) else 0
                if held and held + size > chunk_bytes:
                    chunk, held, row = chunk + 1, 0, 0
                ids[k], rows[k] = chunk, row
                held, row = held + size + 64, row + 1
            yield batch.assign(chunk=ids, row=rows)[names]
        release()

    name = f"llm_{uuid.uuid4().hex}"
    picked = docs.select(*columns)
    partitions = max(8, picked.rdd.getNumPartitions() * 2)
    with small_batches(spark):
        picked.mapInPandas(cut, schema).write.option("path", f"{folder(spark)}/{name}").option("compression", "zstd").bucketBy(
            min(partitions, 4096), "chunk").saveAsTable(name)
    laid = spark.table(name)
    return laid, laid.agg(F.count_distinct("chunk")).first()[0]


def buckets_for(chunks: int, share: float = 1.0) -> int:
    """Buckets so that each holds about KEYS_PER_BUCKET keys; ``share``: keys per byte."""
    return max(8, int(chunks * CHUNK_BYTES * share / KEYS_PER_BUCKET) + 1)


def spread(buckets: int) -> np.ndarray:
    """Lower bounds of equal key ranges, one per bucket."""
    return (np.arange(buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)


def packed(chunk: int, keys: np.ndarray, bounds: np.ndarray,
           values: Callable[[slice], bytes] = lambda part: b"") -> pd.DataFrame:
    """One row per key range for sorted distinct ``keys``; ``values`` gives a range's blob."""
    cuts = np.append(np.searchsorted(keys, bounds), len(keys))
    some = [b for b in range(len(bounds)) if cuts[b] < cuts[b + 1]]
    parts = [slice(cuts[b], cuts[b + 1]) for b in some]
    return pd.DataFrame({"chunk": np.full(len(some), chunk, np.int64), "bucket": np.array(some, np.int32),
                         "keys": [keys[p].tobytes() for p in parts], "vals": [values(p) for p in parts]})


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return keys[starts], np.diff(np.append(starts, len(keys)))


def squeeze(values: np.ndarray) -> bytes:
    """Non-negative integers as one byte each, with the few of 255 or more behind them."""
    large = values[values >= 255].astype(np.int64)
    return np.int64(len(large)).tobytes() + large.tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes()


def unsqueeze(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    out = np.frombuffer(blob, np.uint8, offset=8 + 8 * n).astype(np.int64)
    if n:
        out[out == 255] = np.frombuffer(blob, np.int64, n, 8)
    return out


PACKED = "chunk long, bucket int, keys binary, vals binary"


def ask(chunks: DataFrame, emit: Callable[[int, pd.DataFrame], pd.DataFrame],
        answer: Callable[[np.ndarray, list[bytes], np.ndarray], np.ndarray], given: DataFrame | None = None) -> DataFrame:
    """(chunk, bucket, answer) for the packed keys that ``emit`` makes of each chunk.

    ``answer(index, vals, sizes)`` gets the dense number of every key in the bucket (blobs
    one after another), the blobs' values and their lengths, and returns one number per
    key. ``given``: earlier answers, passed to ``emit`` as a third argument.
    """
    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk", kind="stable")
        keys = [np.frombuffer(k, np.uint64) for k in group["keys"]]
        sizes = np.array([len(k) for k in keys])
        _, index = np.unique(np.concatenate(keys), return_inverse=True)
        out = answer(index, list(group["vals"]), sizes)
        parts = np.split(out, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"chunk": group["chunk"].to_numpy(), "bucket": group["bucket"].to_numpy(),
                             "answer": [squeeze(p) for p in parts]})

    if given is None:
        sent = chunks.groupBy("chunk").applyInPandas(lambda k, g: emit(k[0], g.sort_values("row")), PACKED)
    else:
        sent = chunks.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInPandas(
            lambda k, g, a: emit(k[0], g.sort_values("row"), a), PACKED)
    return keep(sent.groupBy("bucket").applyInPandas(reduce, "chunk long, bucket int, answer binary"))


def told(answers: pd.DataFrame, turn: int | None = None) -> np.ndarray:
    """Answers of one chunk (in one ``turn``) in the order of its sorted keys."""
    if turn is not None:
        answers = answers[answers["turn"] == turn]
    return np.concatenate([np.zeros(0, np.int64), *map(unsqueeze, answers.sort_values("bucket")["answer"])])


def turns(*answers: DataFrame) -> DataFrame:
    """Answers of several rounds as one table, told apart by ``turn``."""
    out = None
    for k, one in enumerate(answers):
        one = one.withColumn("turn", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def repeated(index: np.ndarray, vals: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """1 where a key occurs in several chunks or, by its value, several times in its own."""
    own = np.concatenate(list(map(unsqueeze, vals)))
    return (np.bincount(index, own)[index] > 1).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over ``edges`` (a, b); linked ids only.

    Large-star and small-star steps in turn, each one grouping by id, until nothing moves.
    The smallest neighbours are written before they are joined back, so that both sides of
    the join are dealt anew and Spark can split the edges of a hub over several tasks.
    """
    a, b = F.col("a"), F.col("b")
    pairs = keep(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down)
        pairs = keep(small.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).groupBy("id").agg(
                F.min("component").alias("component"))
        before = state
