"""Operator 10: packing token sequences by column generation over a length histogram."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barograph.llm.common import keep

CAPACITY, BIN = 2048, 8
END = np.uint32(1).tobytes()
# Pieces between which byte-level pre-tokenising always breaks, so that each can be encoded alone; the first kind
# (letters, not followed by another letter or a character beyond ASCII) is one pre-token.
_PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^\x00-@\[-`{-\x7f])| ?[^\s]+|\s+(?!\S)|\s+")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PROBE = "It's a naïve test, of 12 words;  über\n\n  straße (x)... and SO on "
# Characters on which the notions of white space differ, and the special token: whole-text encoding there.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]|<\\|endoftext\\|>")
_LOADED: dict[str, tuple] = {}
CACHED = 1_000_000


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class _Known(dict):
    """Piece -> its little-endian unsigned 32-bit ids, encoded when first met."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.table = tokenizer, _printable()

    def __missing__(self, piece: str) -> bytes:
        if _LETTERS.fullmatch(piece):
            ids = [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.table))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        self[piece] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


def _encoder(path: str):
    """Text -> ids as bytes; remembers the pieces met before (up to CACHED of them).

    A tokenizer that does not split a probe text in the byte-level way encodes whole texts.
    """
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        known = _Known(tokenizer)
        try:
            split = b"".join(map(known.__getitem__, _PIECE.findall(_PROBE)))
        except Exception:  # a model that can't take such pieces raises its own kind of error
            split = b""
        whole = tokenizer.encode(_PROBE, add_special_tokens=False).ids
        _LOADED[path] = (tokenizer, known if split == struct.pack(f"<{len(whole)}I", *whole) else None)
    tokenizer, known = _LOADED[path]

    def encode(text: str) -> bytes:
        if known is None or _ODD.search(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if len(known) > CACHED:
            known.clear()
        return b"".join(map(known.__getitem__, _PIECE.findall(text)))

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and end id cut into pieces of ``capacity``, then at most one of half, then the rest.

    Cutting a long rest at half capacity leaves the histogram short lengths to mix, so that
    patterns fill sequences almost completely.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = _encoder(tokenizer)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encode(text) if isinstance(text, str) else b"") + END
                n = len(ids) // 4
                doc = None if pd.isna(doc) else int(doc)
                cuts = list(range(0, n, capacity))
                if capacity // 2 < n - cuts[-1] < capacity:
                    cuts.append(cuts[-1] + capacity // 2)
                out += [(doc, s, e - s, zlib.crc32(ids[4 * s:4 * e]), n)
                        for s, e in zip(cuts, [*cuts[1:], n], strict=True)]
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _knapsack(price: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes that fits into ``room`` (dynamic programming)."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = np.searchsorted(sizes, c, side="right")
        best[c] = best[c - 1]
        if n:
            value = price[:n] + best[c - sizes[:n]]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], choice[c] = value[k], k
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[room]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = 1500) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that together hold every demanded piece exactly.

    Column generation: the linear program over patterns starts from one pattern per size;
    its dual prices feed a knapsack, whose best pattern enters the basis until none
    improves (or ``most`` columns came in: any basis is feasible). Counts are rounded down
    and the few pieces left over go first-fit by falling size.
    """
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    x = demand / np.diag(basis)
    for _ in range(most):
        price = np.linalg.solve(basis.T, np.ones(m))
        value, pattern = _knapsack(price, sizes, room)
        if value <= 1 + 1e-7:
            break
        column = np.linalg.solve(basis, pattern.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(column > 1e-9, x / column, np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        x = np.maximum(x - step * column, 0)
        x[leave] = step
        basis[:, leave] = pattern
    times = np.floor(x + 1e-9).astype(np.int64)
    left = demand.astype(np.int64).copy()
    out = []
    for j in np.argsort(-times, kind="stable"):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        n = min(int(times[j]), int((left[used] // pattern[used]).min())) if used.any() else 0
        if n > 0:
            left -= n * pattern
            out.append((n, pattern))
    while left.any():  # what is left: first-fit by falling size, equal results counted together
        pattern, free = np.zeros(m, np.int64), room
        for k in range(m - 1, -1, -1):
            take = min(int(left[k]), free // int(sizes[k]))
            pattern[k], free = take, free - take * int(sizes[k])
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        left -= n * pattern
        out.append((n, pattern))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, bin_size: int = BIN) -> DataFrame:
    """Pieces of all documents with their sequence and offset; sequences hold ``capacity`` at most.

    Lengths are rounded up to ``bin_size`` tokens for the histogram, which with the patterns
    is all the driver sees. Ranks inside a length bin come from counts per (bin, hash part)
    and so never gather a bin in one task. Null and empty texts are one end id; repeated
    rows are packed each; an empty table gives no rows. Returns doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.
    """
    room = capacity // bin_size
    made = keep(pieces(docs, tokenizer or _default_tokenizer(), capacity).withColumn(
        "bin", F.ceil(F.col("length") / bin_size).cast("int")))
    counts = {r["bin"]: r["count"] for r in made.groupBy("bin").count().collect()}  # at most ``room`` rows
    sizes = np.array(sorted(counts), np.int64)
    plan = cutting_stock(sizes, np.array([counts[b] for b in sizes], np.int64), room) if len(sizes) else []
    slots = {int(b): ([], [], []) for b in sizes}  # per bin: pieces placed before, copies a sequence, first sequence
    placed, sequence = dict.fromkeys(slots, 0), 0
    for times, pattern in plan:
        for k in np.flatnonzero(pattern):
            b = int(sizes[k])
            for part, value in zip(slots[b], (placed[b], int(pattern[k]), sequence), strict=True):
                part.append(value)
            placed[b] += times * int(pattern[k])
        sequence += times
    slots = {b: tuple(np.array(v, np.int64) for v in parts) for b, parts in slots.items()}

    parts = max(16, sum(counts.values()) // 100_000 + 1)
    cell = made.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    inside = W.partitionBy("bin", "part").orderBy(F.desc("length"), "doc_id", "start")
    before = W.partitionBy("bin").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ahead = cell.groupBy("bin", "part").count().select(
        "bin", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = cell.withColumn("n", F.row_number().over(inside) - 1).join(ahead, ["bin", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", (F.col("n") + F.col("ahead")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            rank, bins = batch["rank"].to_numpy(), batch["bin"].to_numpy()
            for b in np.unique(bins):
                here = bins == b
                first, copies, base = slots[int(b)]
                k = np.searchsorted(first, rank[here], side="right") - 1
                out[here] = base[k] + (rank[here] - first[k]) // copies[k]
            yield batch.assign(sequence_id=out).drop(columns=["bin", "rank"])

    placed_rows = ranked.mapInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    row = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(W.unboundedPreceding, -1)
    return placed_rows.withColumn("offset", F.coalesce(F.sum("length").over(row), F.lit(0)).cast("long"))
