"""Operator 13: near-duplicate classes by SetSketch registers, confirmed on full sets.

A register is the smallest of exponential variables that hash functions give the shingles of
a document, cut to a grid of powers of BASE: K = floor(1 - log_BASE(minimum)), within 0 and
TOP. Registers of a union are the larger ones (``merged``), and two documents agree in one
with a probability of their Jaccard similarity J or slightly more. Registers are banded: with
BANDS bands of WIDTH registers a link of J = 0.85 stays unseen with probability
(1 - 0.85**4)**24 = 2e-8, and less above.

Documents that meet in a band form regions, led by the first of them in a fixed order, so
that copies find the same leader in every band. Inside a region J is estimated jointly
from both documents' registers by maximum likelihood; pairs for which the threshold is
DOUBT nats less likely than the estimate are left, all others compared on their full sets.
Large regions are first compared with their leader; who is not linked with it then meets
everybody else in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import BROADCAST_IDS, MULT, as_bytes, components, keep, mix, slices
from barograph.llm.jaccard import _groups, _node, shingle_sets

BANDS, WIDTH = 24, 4
REGISTERS = BANDS * WIDTH
BASE, RATE, TOP = 1.001, 20.0, 65535  # 16-bit registers for sets of any size
DOUBT = 20.0
AGREE = 48  # of REGISTERS; at J >= 0.8 fewer agree with probability below 1e-10
REGION_ROWS, REGION_BYTES = 4096, 32 << 20  # of one task
_SEEDS = np.random.default_rng(13).integers(1, 2**63, (2, REGISTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set; an empty set has zeros, the neutral element of ``merged``."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    some = np.flatnonzero(size)
    if not len(some):
        return out
    flat = np.concatenate([sets[k] for k in some])
    start = np.concatenate([[0], np.cumsum(size[some])[:-1]])
    low = np.empty((len(some), REGISTERS))
    for i in range(REGISTERS):
        low[:, i] = np.minimum.reduceat(flat * _SEEDS[0, i] + _SEEDS[1, i], start)
    exponential = -np.log1p(-np.minimum((low + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    out[some] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; equal registers of a band give equal keys."""
    parts = regs.reshape(len(regs), BANDS, WIDTH).astype(np.uint64)
    total = (parts * MULT[:WIDTH]).sum(2) + np.arange(1, BANDS + 1, dtype=np.uint64) * MULT[WIDTH]
    return mix(total + (parts[:, :, 0] << np.uint64(32))).view(np.int64)


def _log_chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Of similarity ``j`` for sets of ``na`` and ``nb``, when ``more`` registers of the first are larger and ``less`` smaller."""
    u, v = na / (na + nb), nb / (na + nb)
    above, below = _log_chance(u - v * j), _log_chance(v - u * j)
    return more * np.log(above) + less * np.log(below) + (REGISTERS - more - less) * np.log(np.maximum(1 - above - below, 1e-12))


def estimate(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 40) -> np.ndarray:
    """Similarity of largest likelihood; the likelihood is concave in it, so a golden section finds it."""
    low, high = np.zeros(len(more)), np.minimum(na / nb, nb / na).astype(float)
    part = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        a, b = high - part * (high - low), low + part * (high - low)
        left = log_likelihood(a, more, less, na, nb) > log_likelihood(b, more, less, na, nb)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def likely(regs: np.ndarray, own: np.ndarray, sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Which sketches may belong to sets with similarity ``percent`` and more to the set of ``own``."""
    out = np.zeros(len(regs), bool)
    some = np.flatnonzero((np.minimum(sizes, size) * 100 >= np.maximum(sizes, size) * percent) & ((regs == own).sum(1) >= AGREE))
    if len(some):
        more, less = (regs[some] < own).sum(1), (regs[some] > own).sum(1)
        na, nb = np.full(len(some), float(size)), sizes[some].astype(float)
        best, wanted = estimate(more, less, na, nb), np.full(len(some), percent / 100)
        gap = log_likelihood(best, more, less, na, nb) - log_likelihood(wanted, more, less, na, nb)
        out[some] = (best >= wanted) | (gap <= DOUBT)
    return out


class Overlaps:
    """Exact intersections of one set with many others of its region."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.lists: tuple | None = None

    def shared(self, y: int, some: np.ndarray) -> np.ndarray:
        if len(some) > 32:
            return self._by_lists(y)[some]
        flat = np.concatenate([self.sets[k] for k in some])
        at = np.minimum(np.searchsorted(self.sets[y], flat), self.size[y] - 1)
        return np.bincount(np.repeat(np.arange(len(some)), self.size[some]), self.sets[y][at] == flat, len(some)).astype(np.int64)

    def _by_lists(self, y: int) -> np.ndarray:
        """Through the documents that hold each shingle: quick where many share many."""
        if self.lists is None:
            flat, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.size)
            order = np.argsort(flat, kind="stable")
            new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
            start = np.flatnonzero(new)
            place = np.empty(len(flat), np.int64)
            place[order] = np.cumsum(new) - 1
            self.lists = owner[order], np.append(start, len(flat)), np.split(place, np.cumsum(self.size)[:-1])
        owner, start, place = self.lists
        return np.bincount(np.concatenate([owner[start[k]:start[k + 1]] for k in place[y]]), minlength=len(self.sets))


def linked(shared: np.ndarray, a: np.ndarray, b: int, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def join_region(regs: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, tied: np.ndarray, lead: int | None,
                percent: int) -> list[tuple[int, int]]:
    """Links that connect everything which any links between ``asks`` and the region connect.

    ``tied`` rows are known to lie in one class; ``lead`` is compared with all others first.
    """
    m = len(sets)
    overlaps = Overlaps(sets)
    size = overlaps.size
    root = np.where(tied, m, np.arange(m))
    out: list[tuple[int, int]] = []
    if lead is not None:
        near = np.flatnonzero(np.minimum(size, size[lead]) * 100 >= np.maximum(size, size[lead]) * percent)
        near = near[near != lead]
        for at in range(0, len(near), 32):
            some = near[at:at + 32]
            some = some[linked(overlaps.shared(lead, some), size[some], size[lead], percent)]
            out += [(lead, int(k)) for k in some]
            root[some] = lead
        asks = asks & (root != lead)
    for y in np.flatnonzero(asks):
        other = np.flatnonzero((root != root[y]) & (~asks | (np.arange(m) > y)))
        if len(other):
            other = other[likely(regs[other], regs[y], size[other], size[y], percent)]
        if len(other):
            for k in other[linked(overlaps.shared(y, other), size[other], size[y], percent)]:
                if root[k] != root[y]:
                    out.append((int(y), int(k)))
                    root[root == root[k]] = root[y]
    return out


def classes(docs: DataFrame, size: int = 5, percent: int = 80, region_rows: int = REGION_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept of every row.

    Documents link when 100 * |intersection| >= ``percent`` * |union| of their sets of
    distinct ``size``-word shingles (lower-cased A-Z; short texts are one shingle); meant for
    ``percent`` of 80 and more. Null, empty and blank texts have no shingles and link with
    nothing. Equal sets meet by name before any sketch is compared. Rows sharing a doc_id are
    separate documents with one id; rows without an id link like others and give no name, so
    that a class of such rows alone has a null component_id. ``kept``: doc_id and
    component_id are equal (or both null). Every link is confirmed on full sets.
    """
    text = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(as_bytes(part["text"]), size)
                regs = registers(sets)
                yield pd.DataFrame({"doc_id": part["doc_id"], "n": [len(s) for s in sets], "node": [_node(s) if len(s) else 0 for s in sets],
                                    "regs": [r.tobytes() for r in regs]})

    rows = keep(text.mapInPandas(describe, "doc_id string, n long, node long, regs binary").withColumn(
        "doc_id", F.col("doc_id").cast("long")))
    nodes = keep(rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("regs").alias("regs")))

    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = band_keys(np.frombuffer(b"".join(batch["regs"]), np.uint16).reshape(len(batch), REGISTERS))
                yield pd.DataFrame({"key": keys.ravel(), "x": np.repeat(batch["node"].to_numpy(np.int64), BANDS)})

    keyed = nodes.select("node", "regs").mapInPandas(band, "key long, x long")
    lead = F.min(F.struct(F.xxhash64("x").alias("draw"), "x"))
    # written, so that the join below deals both sides anew and a hot key can be split
    led = keep(keyed.groupBy("key").agg(lead.alias("lead"), F.count("*").alias("size")).where("size > 1").select(
        "key", F.col("lead.x").alias("leader")))
    pairs = keep(keyed.join(led, "key").where("x <> leader").select("leader", "x").distinct().join(
        nodes.select(F.col("node").alias("x"), "n"), "x"))
    shares = keep(pairs.groupBy("leader").agg(F.ceil(F.greatest(
        F.count("*") / region_rows, F.sum("n") * 8 / REGION_BYTES)).cast("int").alias("parts")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(x, regs, to, held) of ``wanted`` (x, to): one text of each set, found by its smallest id."""
        named = keep(wanted.join(nodes.select(F.col("node").alias("x"), "label", "regs"), "x"))
        by_id = named.where("label is not null").withColumnRenamed("label", "doc_id")
        by_id = F.broadcast(by_id) if named.count() <= BROADCAST_IDS else by_id
        found = text.withColumn("doc_id", F.col("doc_id").cast("long")).join(by_id, "doc_id").drop("doc_id")

        def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in slices(batch):
                    sets = shingle_sets(as_bytes(part["text"]), size)
                    name = [_node(s) if len(s) else 0 for s in sets]
                    part = part.assign(held=[s.tobytes() for s in sets])
                    if "x" in part:  # another row may share the doc_id
                        part = part[(part["x"] == name) & (part["held"].str.len() > 0)]
                    else:
                        part["x"] = name
                    yield part.drop(columns="text")

        out = found.mapInPandas(hold, named.drop("label").schema.add("held", "binary"))
        nameless = named.where("label is null").drop("label")
        if not nameless.isEmpty():
            some = text.where("doc_id is null").select("text").mapInPandas(hold, "held binary, x long")
            out = out.unionByName(some.join(nameless, "x").select(*out.columns))
        return out.dropDuplicates(["x"]) if "to" not in out.columns else out

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, regs, to, held in zip(batch["x"], batch["regs"], batch["to"], batch["held"], strict=True):
                yield pd.DataFrame({"region": [t["region"] for t in to], "asks": [t["asks"] for t in to], "tied": [t["tied"] for t in to],
                                    "x": x, "regs": regs, "held": held})

    def join_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for region, part in _groups(batches):
            part = part.sort_values(["x", "asks"]).drop_duplicates("x", keep="last")
            if len(part) > 1:
                x = part["x"].to_numpy(np.int64)
                regs = np.frombuffer(b"".join(part["regs"]), np.uint16).reshape(len(part), REGISTERS)
                at = np.flatnonzero(x == region)
                links = join_region(regs, [np.frombuffer(h, np.uint64) for h in part["held"]], part["asks"].to_numpy(bool),
                                    part["tied"].to_numpy(bool), int(at[0]) if len(at) else None, percent)
                yield pd.DataFrame({"a": [x[a] for a, _ in links], "b": [x[b] for _, b in links]}, dtype=np.int64)

    def settled(dealt: DataFrame) -> DataFrame:
        """Links found in the regions of ``dealt`` (region, x, asks, tied)."""
        to = dealt.groupBy("x").agg(F.collect_list(F.struct("region", "asks", "tied")).alias("to"))
        return keep(sets_of(to).mapInPandas(deal, "region long, asks boolean, tied boolean, x long, regs binary, held binary").repartition(
            "region").sortWithinPartitions("region", "x").mapInPandas(join_all, "a long, b long"))

    sized = pairs.join(shares, "leader")
    small = sized.where("parts <= 1").select(F.col("leader").alias("region"), "x")
    yes, no = F.lit(True), F.lit(False)
    edges = settled(small.union(small.select("region", "region").distinct()).select(
        "region", "x", yes.alias("asks"), no.alias("tied")))
    large = sized.where("parts > 1")
    if not large.isEmpty():
        met = large.select("x").union(large.select("leader")).distinct()
        sets = keep(sets_of(met).select("x", "held"))

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                tied = []
                for a, b in zip(batch["held"], batch["lead_held"], strict=True):
                    both = Overlaps([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
                    tied.append(bool(linked(both.shared(0, np.array([1])), both.size[1:], both.size[0], percent)[0]))
                yield batch[["leader", "x", "n", "parts"]].assign(tied=tied)

        salted = large.join(sets, "x").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("parts").cast("long")))
        copies = shares.where("parts > 1").join(sets.withColumnsRenamed({"x": "leader", "held": "lead_held"}), "leader").select(
            "leader", "lead_held", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("salt"))
        measured = keep(salted.join(copies, ["leader", "salt"]).select("leader", "x", "n", "parts", "held", "lead_held").mapInPandas(
            measure, "leader long, x long, n long, parts int, tied boolean"))
        edges = edges.unionByName(measured.where("tied").select(F.col("leader").alias("a"), F.col("x").alias("b")))
        loose = measured.where("not tied").groupBy("leader").agg(F.ceil(F.greatest(
            F.count("*") / region_rows, F.sum("n") * 8 / REGION_BYTES)).cast("int").alias("asking"))
        blocks = measured.join(loose, "leader").withColumns({
            "own": F.pmod(F.xxhash64("x", F.lit(1)), F.col("asking").cast("long")),
            "place": F.pmod(F.xxhash64("x", F.lit(2)), F.col("parts").cast("long"))})
        zero = F.lit(0).cast("long")
        asks = blocks.where("not tied").select("leader", "x", "own", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("place"))
        answers = blocks.select("leader", "x", "tied", F.explode(F.sequence(zero, F.col("asking") - 1)).alias("own"), "place")
        name = F.xxhash64("leader", "own", "place").alias("region")
        edges = edges.unionByName(settled(asks.select(name, "x", yes.alias("asks"), no.alias("tied")).unionByName(
            answers.select(name, "x", no.alias("asks"), "tied"))))
    part_of = components(edges)
    member = part_of.union(part_of.select("component", "component")).distinct().select(F.col("id").alias("node"), "component")
    least = member.join(nodes.select("node", "label"), "node").groupBy("component").agg(F.min("label").alias("component_id"))
    named = member.join(least, "component").select("node", "component_id")
    full = nodes.select("node", "label").join(named, "node", "left").select(
        "node", F.coalesce("component_id", "label").alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")).join(
        full, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
