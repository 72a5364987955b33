"""Operator 11: hard negatives by inner product, with length buckets and coordinate pruning.

Rows are range-partitioned by vector length (a sampled sort of Spark), longest first; a
partition is a length bucket, cut into blocks of bounded size. A block keeps each
coordinate of its unit vectors sorted. For an anchor q and a least score s, a row p of the
block must reach cos(q, p) >= s / (|q| * longest), the angle t. In any coordinate f
that confines p_f to cos of [angle(q_f) - t, angle(q_f) + t]: the anchor's focus
coordinates (its largest) give ranges of the sorted lists, the shortest list is walked, the
others intersect it, and what is left is scored in integers. Buckets too short for s are
not visited at all.

The first least score of an anchor comes from its own block; all other blocks then have
to beat it. That holds for positives (the fifth best of its label) and for negatives (the
fifth best of each positive's range).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barograph.llm.common import keep

BLOCK_ROWS = 4096
CHUNK_ANCHORS = 16_384  # anchors that meet one block in one task
BUCKETS = 1024  # length buckets at most; blocks inside them grow with the table
FOCUS = 4
LARGEST = 1 << 27  # of a component, so that products of up to 512 components fit in a long
WIDER = 1e-9  # room for rounding in the ranges; scores are integers

BLOCK = "bucket int, block int, longest double, m int, comps binary, labels binary, ids binary, known binary, rows binary"


class Lists:
    """Rows of one block with a sorted list per coordinate."""

    def __init__(self, comps: np.ndarray):
        self.comps = comps
        self.length = np.sqrt((comps.astype(float)**2).sum(1))
        self.longest = float(self.length.max(initial=0.0))
        self.unit = comps / np.where(self.length > 0, self.length, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.scored = 0

    def list_of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:  # only coordinates that some anchor focuses on are ever sorted
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = self.unit[order, f], order
        return self.lists[f]

    def reach(self, q: np.ndarray, least: float, focus: int = FOCUS) -> np.ndarray:
        """Rows that may score ``least`` or more with ``q``."""
        size = float(np.sqrt((q.astype(float)**2).sum()))
        if least <= 0 or not len(self.comps):
            return np.arange(len(self.comps))
        if size * self.longest < least * (1 - WIDER):
            return np.zeros(0, np.int64)
        turn = np.arccos(np.clip(least / (size * self.longest) * (1 - WIDER), -1, 1)) + WIDER
        unit = q / size
        chosen = np.argsort(-np.abs(unit), kind="stable")[:focus]
        angle = np.arccos(np.clip(unit[chosen], -1, 1))
        low, high = np.cos(np.minimum(np.pi, angle + turn)) - WIDER, np.cos(np.maximum(0, angle - turn)) + WIDER
        cuts = [(np.searchsorted(self.list_of(f)[0], lo), np.searchsorted(self.list_of(f)[0], hi, side="right"), f)
                for f, lo, hi in zip(chosen, low, high, strict=True)]
        a, b, walked = min(cuts, key=lambda cut: cut[1] - cut[0])
        found = self.list_of(walked)[1][a:b]
        for f, lo, hi in zip(chosen, low, high, strict=True):
            if f != walked:
                v = self.unit[found, f]
                found = found[(v >= lo) & (v <= hi)]
        return found

    def scores(self, q: np.ndarray, some: np.ndarray) -> np.ndarray:
        self.scored += len(some)
        return self.comps[some] @ q


class Block:
    """One block as it travels: vectors, labels and names (id, whether it has one, row)."""

    def __init__(self, row: pd.Series):
        self.lists = Lists(np.frombuffer(row["comps"], np.int32).reshape(row["m"], -1).astype(np.int64))
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.ids, self.rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
        self.known = np.frombuffer(row["known"], bool)

    def first(self, some: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """Places in ``some`` of the ``n`` best: by score, then id, unnamed rows after named ones."""
        if len(some) > n:
            cut = np.partition(score, len(score) - n)[len(score) - n]
            near = np.flatnonzero(score >= cut)
        else:
            near = np.arange(len(some))
        i = some[near]
        return near[np.lexsort((self.rows[i], ~self.known[i], self.ids[i], -score[near]))][:n]

    def positives(self, row: int, label: int, q: np.ndarray, least: float, n: int) -> tuple[np.ndarray, np.ndarray]:
        some = self.lists.reach(q, least)
        some = some[(self.labels[some] == label) & (self.rows[some] != row)]
        score = self.lists.scores(q, some)
        best = self.first(some, score, n)
        return some[best], score[best]

    def negatives(self, label: int, q: np.ndarray, tops: np.ndarray, least: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place in ``tops``, rows, scores) of the ``n`` best between ``least`` and ``tops``."""
        some = self.lists.reach(q, float(least.min()))
        some = some[self.labels[some] != label]
        score = self.lists.scores(q, some)
        for j, (top, low) in enumerate(zip(tops, least, strict=True)):
            inside = np.flatnonzero((score >= low) & (score <= top))
            best = inside[self.first(some[inside], score[inside], n)]
            if len(best):
                yield j, some[best], score[best]


def usable(vectors: DataFrame, scale: int, shift_every: int, classes: int) -> DataFrame:
    """(row, id, known, label, v, length): integer vectors, padded with zeros to the longest array."""
    part = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LARGEST)), F.lit(False))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id").cast("long") % shift_every == 0, (label + 1) % classes).otherwise(label)
    rows = vectors.where(good & F.col("label").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.col("vec_id").isNotNull().alias("known"), moved.alias("label"),
        F.transform(part, lambda x: F.floor(x * scale).cast("int")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return keep(rows.withColumn("length", F.sqrt(square)))  # written: row names must not change when a task is run again


def laid_out(rows: DataFrame, n: int, dim: int) -> DataFrame:
    """Blocks of BLOCK_ROWS rows at most, longest vectors first; one row of packed arrays each."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, block = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []

        def packed(part: pd.DataFrame) -> pd.DataFrame:
            comps = np.zeros((len(part), dim), np.int32)
            for k, v in enumerate(part["v"]):
                comps[k, :len(v)] = v
            return pd.DataFrame({
                "bucket": [bucket], "block": [block], "longest": [part["length"].max()], "m": [len(part)], "comps": [comps.tobytes()],
                "labels": [part["label"].to_numpy(np.int64).tobytes()], "ids": [part["id"].to_numpy(np.int64).tobytes()],
                "known": [part["known"].to_numpy(bool).tobytes()], "rows": [part["row"].to_numpy(np.int64).tobytes()]})

        for batch in batches:
            while len(batch):
                room = BLOCK_ROWS - sum(map(len, held))
                held.append(batch.iloc[:room])
                batch = batch.iloc[room:]
                if sum(map(len, held)) == BLOCK_ROWS:
                    yield packed(pd.concat(held))
                    held, block = [], block + 1
        if held:
            yield packed(pd.concat(held))

    buckets = int(max(1, min(BUCKETS, -(-n // BLOCK_ROWS))))
    by = F.col("length").desc(), F.xxhash64("row")  # equal lengths are split like any others
    return keep(rows.repartitionByRange(buckets, *by).sortWithinPartitions(*by).mapInPandas(cut, BLOCK))


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80,
         scale: int = 256, shift_every: int = 7, classes: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x); where vec_id is divisible by ``shift_every`` the
    label first becomes (label + 1) % ``classes``. Anchors are rows with vec_id divisible by
    ``every``; their positives are the first rows of the same label by integer inner
    product, their negatives for each positive the first rows of other labels with
    ``least_percent`` * positive <= 100 * negative <= 100 * positive. Ties go to the smaller
    vec_id, rows without one come last and are no anchors. Rows that share a vec_id are
    separate rows and separate anchors. Null labels, null vectors, null or non-finite
    components take no part, nor do components of LARGEST / ``scale`` and more, whose scores
    no long could hold. Shorter vectors count as padded with zeros.
    """
    rows = usable(vectors, scale, shift_every, classes)
    got = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"),
                   F.sum((F.col("known") & (F.col("id") % every == 0)).cast("long")).alias("a")).first()
    n, dim, chunks = got["n"], max(got["d"] or 0, 1), max(1, -(-(got["a"] or 0) // CHUNK_ANCHORS))
    blocks = laid_out(rows, n, dim)
    # one row per length bucket, of which there are at most BUCKETS (the shuffle may ask for more)
    buckets = blocks.groupBy("bucket").agg(F.max("longest").alias("longest"), F.count("*").alias("blocks")).orderBy("bucket").collect()
    number = np.array([b["bucket"] for b in buckets], np.int64)
    reaches = np.maximum.accumulate(np.array([b["longest"] for b in buckets][::-1], float))[::-1]
    held = np.array([b["blocks"] for b in buckets], np.int64)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every anchor with the best positives of its own block; a row without positive keeps the anchor."""
        for batch in batches:
            for _, row in batch.iterrows():
                block = Block(row)
                out = []
                for i in np.flatnonzero(block.known & (block.ids % every == 0)):
                    q = block.lists.comps[i]
                    some, score = block.positives(block.rows[i], block.labels[i], q, -np.inf, positives)
                    least = float(score[-1]) if len(some) == positives else -np.inf
                    out.append((block.rows[i], block.ids[i], block.labels[i], q.astype(np.int32).tobytes(), row["bucket"], row["block"], least,
                                block.ids[some].tolist(), block.known[some].tolist(), block.rows[some].tolist(), score.tolist()))
                yield pd.DataFrame(out, columns=["anchor", "anchor_id", "label", "q", "bucket", "block", "least", "ids", "known", "rows", "scores"])

    anchors = keep(blocks.mapInPandas(home, "anchor long, anchor_id long, label long, q binary, bucket int, block int, least double, "
                                      "ids array<long>, known array<boolean>, rows array<long>, scores array<long>"))

    def visits(asked: DataFrame, least: Column, columns: list[str]) -> DataFrame:
        """``asked`` repeated for every block but its own that is long enough for its least score."""
        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    part = batch.iloc[at:at + 64]
                    who, where, block = [], [], []
                    for i, (q, low, own, own_block) in enumerate(zip(part["q"], part["asked"], part["bucket"], part["block"], strict=True)):
                        size = np.sqrt((np.frombuffer(q, np.int32).astype(float)**2).sum())
                        upto = len(reaches) if low <= 0 else int((size * reaches >= low * (1 - WIDER)).sum())
                        to = np.repeat(number[:upto], held[:upto])
                        nth = np.arange(len(to)) - np.repeat(np.cumsum(held[:upto]) - held[:upto], held[:upto])
                        other = (to != own) | (nth != own_block)
                        who.append(np.full(other.sum(), i))
                        where.append(to[other])
                        block.append(nth[other])
                    out = part.iloc[np.concatenate(who)].copy()
                    out["bucket"], out["block"] = np.concatenate(where), np.concatenate(block)
                    yield out

        frame = asked.select(*columns, "q", "bucket", "block", least.alias("asked"))
        return frame.mapInPandas(deal, frame.schema).withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.lit(chunks)))

    spread = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    key = ["bucket", "block", "chunk"]

    def answers(asked: DataFrame, find, schema: str) -> DataFrame:
        """``find(block, asked rows)`` for each block and chunk of anchors, one task each."""
        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            names = [part.split()[0] for part in schema.split(", ")]
            return pd.DataFrame(find(Block(b.iloc[0]), a) if len(a) and len(b) else [], columns=names)

        return asked.groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(meet, schema)

    order = [F.col("score").desc(), "id", F.col("known").desc(), "row"]
    found = "anchor long, id long, known boolean, row long, score long"

    def more_positives(block: Block, asked: pd.DataFrame) -> list[tuple]:
        out = []
        for anchor, label, q, low in zip(asked["anchor"], asked["label"], asked["q"], asked["asked"], strict=True):
            some, score = block.positives(anchor, label, np.frombuffer(q, np.int32).astype(np.int64), low, positives)
            on = score >= low
            out += zip([anchor] * on.sum(), block.ids[some[on]], block.known[some[on]], block.rows[some[on]], score[on], strict=True)
        return out

    near = anchors.select("anchor", F.explode(F.arrays_zip("ids", "known", "rows", "scores")).alias("p")).select(
        "anchor", F.col("p.ids").alias("id"), F.col("p.known").alias("known"), F.col("p.rows").alias("row"), F.col("p.scores").alias("score"))
    far = answers(visits(anchors, F.col("least"), ["anchor", "label"]), more_positives, found)
    by = W.partitionBy("anchor").orderBy(*order)
    best = near.unionByName(far).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= positives)
    # a negative score has no range, as 80 % of it is more than itself
    listed = best.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct("rank", "id", "known", "row", "score"))).alias("p"))
    asked = keep(anchors.select("anchor", "anchor_id", "label", "q", "bucket", "block").join(listed, "anchor").withColumns({
        "tops": F.transform("p", lambda p: p["score"]),
        "lows": F.transform("p", lambda p: F.ceil(p["score"].cast("decimal(20,0)") * least_percent / 100).cast("long"))}))

    def some_negatives(block: Block, part: pd.DataFrame) -> list[tuple]:
        out = []
        for anchor, label, q, tops, lows in zip(part["anchor"], part["label"], part["q"], part["tops"], part["lows"], strict=True):
            for j, some, score in block.negatives(label, np.frombuffer(q, np.int32).astype(np.int64), np.asarray(tops, np.int64),
                                                  np.asarray(lows, np.int64), negatives):
                out += zip([anchor] * len(some), [j] * len(some), block.ids[some], block.known[some], block.rows[some], score, strict=True)
        return out

    pair = "anchor long, place int, id long, known boolean, row long, score long"
    at_home = keep(answers(asked.withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.lit(chunks))).select(
        "anchor", "label", "q", "tops", "lows", *key), some_negatives, pair))
    # the last of a full list raises the least score that other blocks must reach
    fifth = at_home.groupBy("anchor", "place").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(
        F.col("n") >= negatives).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "last"))).alias("full"))
    raised = asked.join(fifth, "anchor", "left").withColumn("lows", F.transform(
        "lows", lambda low, j: F.coalesce(F.try_element_at("full", j), low)))
    elsewhere = answers(visits(raised, F.array_min("lows").cast("double"), ["anchor", "label", "tops", "lows"]), some_negatives, pair)
    last = W.partitionBy("anchor", "place").orderBy(*order)
    ranked = at_home.unionByName(elsewhere).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    named = asked.select("anchor", "anchor_id", F.posexplode("p").alias("place", "p"))
    return ranked.join(named, ["anchor", "place"]).select(
        "anchor_id", F.when(F.col("p.known"), F.col("p.id")).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.when(F.col("known"), F.col("id")).alias("negative_id"), F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"))
