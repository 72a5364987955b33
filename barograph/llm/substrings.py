"""Operators 5 and 8: removal of repeated byte strings and of repeated word passages.

Both first sample positions by content: wherever a string of the full length occurs, the
same places inside it are sampled, so a full-length match can only start shortly before a
sampled position whose own, shorter string occurs twice. Everything else is unique and
leaves after the first round; the rest is ranked at full length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barograph.llm.common import (KEYS_PER_BUCKET, Rolling, Words, as_bytes, ask, buckets_for, chunked, distinct,
                                  keep, long_shingles, packed, repeated, spread, squeeze, told, turns, window_minima)

TOP = np.uint64(2**64 - 1)


def _covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Mask of the places that a run of ``length`` from any of ``starts`` covers."""
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, total), -1)
    return np.cumsum(steps[:total]) > 0


def _before(anchors: np.ndarray, reach: int, fits: np.ndarray) -> np.ndarray:
    """Starts up to ``reach`` before an anchor at which a full-length string fits."""
    steps = np.zeros(len(fits) + 1, np.int32)
    np.add.at(steps, np.maximum(anchors - reach, 0), 1)
    np.add.at(steps, anchors + 1, -1)
    return np.flatnonzero((np.cumsum(steps[:-1]) > 0) & fits)


class _Units:
    """One chunk as a sequence of units (bytes or words) with fingerprints of unit strings."""

    def __init__(self, group: pd.DataFrame, length: int, sample: int, words: bool):
        self.texts = as_bytes(group["text"])
        self.length, self.sample = length, sample
        if words:
            self.words = Words(self.texts)
            self.first, self.count = self.words.first, self.words.count
            self.full = self.short = None
            self.unit = self.words.hash
            self.total = len(self.unit)
        else:
            buf = np.frombuffer(b"".join(self.texts), np.uint8)
            self.roll = Rolling(buf)
            self.count = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
            self.first = np.concatenate([[0], np.cumsum(self.count)])[:-1]
            self.total = len(buf)
        self.is_words = words

    def every(self, length: int) -> np.ndarray:
        return long_shingles(self.unit, length) if self.is_words else self.roll.every(length)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return self.every(length)[starts] if self.is_words else self.roll.of(starts, starts + length)

    def fits(self, length: int) -> np.ndarray:
        """Where ``length`` units of one document start, in documents of the full length."""
        steps = np.zeros(self.total + 1, np.int32)
        some = self.count >= self.length
        np.add.at(steps, self.first[some], 1)
        np.add.at(steps, self.first[some] + self.count[some] - length + 1, -1)
        return np.cumsum(steps[:-1]) > 0

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and the fingerprints of their ``sample`` units."""
        values = self.every(self.sample)
        good = self.fits(self.sample)[:len(values)]
        if not good.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        masked = np.where(good, values, TOP)
        at = window_minima(masked, self.length - self.sample + 1)
        at = at[good[at]]
        return at, values[at]

    def alive(self, flags: np.ndarray) -> np.ndarray:
        """Starts that may repeat at full length, by the flags of the sampled round."""
        at, names = self.anchors()
        keys, _ = distinct(names)
        again = at[flags[np.searchsorted(keys, names)] > 0] if len(at) else at
        return _before(again, self.length - self.sample, self.fits(self.length))


def _sampled(length: int, sample: int, words: bool):
    def emit(chunk: int, group: pd.DataFrame) -> pd.DataFrame:
        keys, times = distinct(_Units(group, length, sample, words).anchors()[1])
        return packed(chunk, keys, emit.bounds, lambda part: squeeze(np.minimum(times[part], 2)))
    return emit


def remove_repeated_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """Bytes left in each text once every byte under a repeated ``length``-byte string is gone.

    Prefix doubling over fingerprint ranks: round one ranks sampled positions by their first
    three quarters of ``length`` bytes, round two ranks the positions still not unique at
    the full length, which is past the threshold; unique positions leave after each round. Matches stay
    inside documents and are judged on the input. Null and short texts keep everything;
    repeated rows repeat each other. Returns doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept (the remaining bytes).
    """
    sample = length * 3 // 4
    chunks, n_chunks = chunked(docs)
    first = _sampled(length, sample, False)
    first.bounds = spread(buckets_for(n_chunks, 0.025))
    ranked = ask(chunks, first, repeated)
    bounds = spread(buckets_for(n_chunks, 0.25))

    def second(chunk: int, group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        units = _Units(group, length, sample, False)
        keys, times = distinct(units.at(units.alive(told(answers)), length))
        return packed(chunk, keys, bounds, lambda part: squeeze(np.minimum(times[part], 2)))

    doubled = ask(chunks, second, repeated, given=ranked)

    def finish(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        units = _Units(group, length, sample, False)
        starts = units.alive(told(answers, 0))
        names = units.at(starts, length)
        keys, _ = distinct(names)
        again = starts[told(answers, 1)[np.searchsorted(keys, names)] > 0] if len(names) else starts
        gone = _covered(again, length, units.total)
        kept, removed, spans = [], [], []
        for text, start, size in zip(units.texts, units.first, units.count, strict=True):
            mask = gone[start:start + size]
            lost = int(mask.sum())
            removed.append(lost)
            spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if lost else 0)
            kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if lost else text)
        return pd.DataFrame({"doc_id": group["doc_id"].astype("Int64"), "n_bytes": units.count, "n_removed": removed,
                             "n_spans": spans, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
                             "kept": kept})

    return chunks.groupBy("chunk").cogroup(turns(ranked, doubled).groupBy("chunk")).applyInPandas(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


# ---------------------------------------------------------------- words

CODE_BITS = (10, 7, 7)  # of the first, second and third word of a suffix; the rest of a key is its depth-20 path
_CODED = sum(CODE_BITS)


def _suffix_keys(units: _Units, starts: np.ndarray) -> np.ndarray:
    """Sortable names: codes of the first three words, then the path of ``length`` words."""
    code = np.zeros(len(starts), np.uint64)
    for k, bits in enumerate(CODE_BITS):
        word = units.unit[np.minimum(starts + k, units.total - 1)] * np.uint64(0x9E3779B97F4A7C15)
        code = (code << np.uint64(bits)) | (word >> np.uint64(64 - bits))
    return (code << np.uint64(64 - _CODED)) | (units.at(starts, units.length) >> np.uint64(_CODED))


def prefix_groups(counts: dict[int, int], size: int) -> np.ndarray:
    """Lower key bounds of groups of at most ``size`` suffixes, by prefixes of one to three words.

    Neighbouring small prefixes share a group; a prefix over ``size`` is split by its next word.
    """
    codes = np.array(sorted(counts), np.int64)
    weight = np.array([counts[c] for c in codes], np.int64)
    bounds, open_until = [0], 0

    def visit(lo: int, hi: int, depth: int) -> None:
        nonlocal open_until
        a, b = np.searchsorted(codes, [lo, hi])
        inside = int(weight[a:b].sum())
        if inside == 0:
            return
        if inside > size and depth < len(CODE_BITS):
            step = 1 << sum(CODE_BITS[depth + 1:])
            for k in sorted(set(((codes[a:b] - lo) // step).tolist())):
                visit(lo + k * step, lo + (k + 1) * step, depth + 1)
            return
        if open_until and open_until + inside > size:
            bounds.append(lo)
            open_until = 0
        open_until += inside

    visit(0, 1 << _CODED, 0)
    return np.array(bounds, np.uint64) << np.uint64(64 - _CODED)


def remove_repeated_passages(docs: DataFrame, length: int = 20, size: int = KEYS_PER_BUCKET) -> DataFrame:
    """Words left once every word under a ``length``-word window that starts earlier too is gone.

    Suffixes (truncated at ``length`` words; equal ones of a chunk counted once) that may
    repeat are split by variable-length word prefixes into groups of at most ``size``; each
    group's sorted suffixes are the leaves of one subtree, and the nodes of depth ``length``
    with several leaves are its repeats, of which the earliest (document, start) stays. A
    hot passage costs one leaf per chunk. Null texts have no words; rows of one doc_id
    count as one document's copies, the first read being the earlier. Returns doc_id,
    n_words, n_removed, kept_sha256, kept (the text that is left), rest (other columns as JSON).
    """
    sample = length * 3 // 5
    chunks, n_chunks = chunked(docs, rest=True)
    first = _sampled(length, sample, True)
    first.bounds = spread(buckets_for(n_chunks, 0.04))
    ranked = ask(chunks, first, repeated)
    paired = chunks.groupBy("chunk").cogroup(ranked.groupBy("chunk"))

    def census(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        units = _Units(group.sort_values("row"), length, sample, True)
        keys, _ = distinct(_suffix_keys(units, units.alive(told(answers))))
        codes, times = distinct(keys >> np.uint64(64 - _CODED))
        return pd.DataFrame({"code": codes.astype(np.int64), "n": times.astype(np.int64)})

    # codes number 2 ** _CODED at most; only codes of possible repeats occur
    wide = 1 << sum(CODE_BITS[1:])
    codes = keep_counts(paired.applyInPandas(census, "code long, n long"), wide, size)
    bounds = prefix_groups(codes, size)

    def leaves(group: pd.DataFrame, answers: pd.DataFrame):
        group = group.sort_values("row")
        units = _Units(group, length, sample, True)
        starts = units.alive(told(answers))
        owner = np.searchsorted(units.first, starts, side="right") - 1
        ids = group["doc_id"].fillna(2**63 - 1).to_numpy(np.int64)[owner]
        keys = _suffix_keys(units, starts)
        order = np.lexsort((starts, ids, keys))
        head = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])[:len(order)])
        return group, units, starts, owner, ids, keys, order, head

    def second(chunk: int, group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        _, units, starts, owner, ids, keys, order, head = leaves(group, answers)
        lead = order[head]
        where = (starts - units.first[owner])[lead]
        return packed(chunk, keys[lead], bounds, lambda part: ids[lead[part]].tobytes() + where[part].astype(np.int64).tobytes())

    def earliest(index: np.ndarray, vals: list[bytes], sizes: np.ndarray) -> np.ndarray:
        both = [np.frombuffer(v, np.int64).reshape(2, -1) for v in vals]
        ids, where = np.concatenate(both, axis=1)
        order = np.lexsort((where, ids, index))  # leaves of the subtree, equal paths together
        out = np.zeros(len(index), np.int64)
        out[order[np.concatenate([[True], index[order][1:] != index[order][:-1]])[:len(order)]]] = 1
        return out

    found = ask(chunks, second, earliest, given=ranked)

    def finish(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        group, units, starts, _, _, _, order, head = leaves(group, answers[answers["turn"] == 0])
        again = np.ones(len(order), bool)
        again[head] = told(answers, 1) == 0
        gone = _covered(starts[order[again]], length, units.total)
        span = units.words
        buf = b" ".join(units.texts) + b" "
        kept = []
        for text, a, n in zip(units.texts, span.first, span.count, strict=True):
            stay = np.flatnonzero(~gone[a:a + n]) + a
            kept.append((text if len(stay) == n else None,
                         b" ".join(buf[s:e] for s, e in zip(span.start[stay], span.end[stay], strict=True))))
        removed = np.array([int(gone[a:a + n].sum()) for a, n in zip(span.first, span.count, strict=True)], np.int64)
        left = [(whole if whole is not None else joined).decode("utf-8", "replace") if isinstance(t, str) else None
                for t, (whole, joined) in zip(group["text"], kept, strict=True)]
        return pd.DataFrame({"doc_id": group["doc_id"].astype("Int64"), "n_words": span.count, "n_removed": removed,
                             "kept_sha256": [hashlib.sha256(joined).hexdigest() for _, joined in kept],
                             "kept": left, "rest": group["rest"]})

    return chunks.groupBy("chunk").cogroup(turns(ranked, found).groupBy("chunk")).applyInPandas(
        finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, rest string")


def cut_passages(docs: DataFrame, length: int = 20) -> DataFrame:
    """``docs`` with repeated passages removed from the texts; a text that loses nothing stays byte for byte.

    A text that loses words is its remaining words joined by single spaces; ``n_chars``
    follows where there is such a column. No row is dropped.
    """
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    made = remove_repeated_passages(docs, length)
    out = made.withColumn("o", F.from_json("rest", StructType(others)))
    length_of = F.length("kept").cast("long")
    return out.select(*[
        F.col("doc_id").cast(f.dataType).alias(f.name) if f.name == "doc_id" else
        F.col("kept").cast(f.dataType).alias(f.name) if f.name == "text" else
        F.when(F.col("n_removed") > 0, length_of.cast(f.dataType)).otherwise(F.col("o")[f.name]).alias(f.name)
        if f.name == "n_chars" else F.col("o")[f.name].alias(f.name) for f in docs.schema.fields])


def keep_counts(census: DataFrame, wide: int, size: int) -> dict[int, int]:
    """Suffix counts by code: exact for codes under a first word of over ``size``, else by first word."""
    counted = keep(census.groupBy("code").agg(F.sum("n").alias("n")))
    words = counted.groupBy(F.floor(F.col("code") / wide).cast("long").alias("word")).agg(F.sum("n").alias("m"))
    over = F.when(F.col("m") > size, F.col("code")).otherwise(F.col("word") * wide)
    rows = counted.withColumn("word", F.floor(F.col("code") / wide).cast("long")).join(F.broadcast(words), "word").groupBy(
        over.alias("code")).agg(F.sum("n").alias("n")).collect()
    return {r["code"]: r["n"] for r in rows}
