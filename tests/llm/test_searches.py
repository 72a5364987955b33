"""Operators 11, 12 and 13 against brute force on small tables with awkward rows."""

import hashlib
import os
import random
import re

import numpy as np
import pandas as pd
import pytest

from barograph.llm import centroids, negatives, neighbours, setsketch
from barograph.llm.jaccard import shingle_sets

os.environ["PYTHONPATH"] = os.pathsep.join([os.getcwd(), os.environ.get("PYTHONPATH", "")])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = 2**53 + 1
SCHEMA = "vec_id long, embedding array<double>, label int, n int, row string, cluster string, score double"


def _vectors(dim=64):
    rng = np.random.default_rng(5)
    heart = rng.normal(size=(6, dim))
    rows = []
    for k in range(420):
        v = heart[k % 6] + rng.normal(size=dim) * 0.5
        rows.append([k, (v / np.linalg.norm(v) * rng.choice([0.5, 1.0, 3.0])).tolist(), int(rng.integers(0, 4))])
    for k in (1, 8, 100, 201):  # identical vectors, hence ties, and repeated rows
        rows.append([900 + k, rows[0][1], rows[0][2]])
        rows.append([100, rows[0][1], rows[0][2]])
    rows += [[BIG, rows[3][1], 1], [None, rows[3][1], 1], [None, rows[4][1], 2], [500, [0.0] * dim, 1], [507, rows[5][1], None]]
    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows += [[700 + k, [x] + [0.5] * (dim - 1), 1] for k, x in enumerate(odd)] + [[800, None, 1], [801, [], 1], [802, [0.25, 0.5], 1],
                                                                                 [803, [1e30] + [0.0] * (dim - 1), 1]]
    return [(i, v, y, 1, "r", "c", 0.5) for i, v, y in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(_vectors(), SCHEMA).repartition(3).cache()


def _usable(v):
    return v is not None and all(x is not None and np.isfinite(x) and abs(x) < 1e6 for x in v)


def _clusters(rows, k, rounds, scale=1024):
    held = [(i, np.floor(np.asarray(v) * scale).astype(np.int64)) for i, v in rows if _usable(v) and len(v) == 64]
    name = {i: hashlib.sha256(f"3:{i}".encode()).hexdigest() for i, _ in held}
    order = sorted(held, key=lambda r: (r[0] is None, name[r[0]], r[1].tolist()))
    x = np.array([v for _, v in held])
    c = np.array([v for _, v in order[:k]])

    def assigned():
        far = ((x[:, None] - c[None])**2).sum(2)
        return far.argmin(1), far.min(1)

    for _ in range(rounds):
        which, _ = assigned()
        for j in range(len(c)):
            if (which == j).any():
                c[j] = [int(s) // int((which == j).sum()) for s in x[which == j].sum(0)]
    which, far = assigned()
    return sorted((str(i), int(j), int(d), int(far[which == j].sum()), int(far.sum()), hashlib.sha256(
        ",".join(map(str, c[j].tolist())).encode()).hexdigest()) for (i, _), j, d in zip(held, which, far, strict=True))


def _told(frame, columns):
    return sorted(tuple(str(r[c]) if c.endswith("_id") else r[c] for c in columns) for r in frame.collect())


CLUSTER = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("k, rounds", [(8, 10), (40, 3)])
def test_clusters(vectors, k, rounds):
    got = centroids.cluster(vectors, k=k, rounds=rounds)
    assert got.columns == CLUSTER
    assert _told(got, CLUSTER) == _clusters([(r[0], r[1]) for r in _vectors()], k, rounds)


def test_clusters_of_few_vectors(vectors):
    assert centroids.cluster(vectors.where("false")).count() == 0
    assert centroids.cluster(vectors.where("vec_id >= 700 and vec_id < 804")).count() == 0
    got = centroids.cluster(vectors.where("vec_id in (1, 2, 3)")).collect()
    assert len(got) == 3 and {r["inertia"] for r in got} == {0} and len({r["cluster"] for r in got}) == 3


def test_outward_scan_is_exact_and_rejects():
    rng = np.random.default_rng(1)
    level, width = rng.normal(size=(60, 1)) * 400, rng.uniform(1, 300, (60, 1))
    c = np.floor(rng.normal(size=(60, 16)) * width + level).astype(np.int64)
    c[7] = c[3]  # a tie goes to the smaller number
    x = np.concatenate([np.floor(c[rng.integers(0, 60, 900)] + rng.normal(size=(900, 16)) * 9).astype(np.int64), c,
                        np.full((2, 16), 1 << 27), np.full((1, 16), -(1 << 27))])
    search = centroids.Outward(c)
    which, far = search.nearest(x)
    want = ((x[:, None] - c[None])**2).sum(2)
    assert (which == want.argmin(1)).all() and (far == want.min(1)).all()
    assert search.measured < 0.5 * want.size


def _mined(rows, width=64):
    held = []
    for i, v, y in rows:
        if y is not None and _usable(v):
            x = np.zeros(width, np.int64)
            x[:len(v)] = np.floor(np.asarray(v, float) * 256).astype(np.int64)
            held.append((i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, x))
    x = np.array([h[2] for h in held])
    out = []
    for a, (i, y, q) in enumerate(held):
        if i is None or i % 100:
            continue
        score = x @ q
        order = sorted(range(len(held)), key=lambda k: (-score[k], held[k][0] is None, held[k][0] or 0))
        for p in [k for k in order if k != a and held[k][1] == y][:5]:
            some = [k for k in order if held[k][1] != y and 80 * score[p] <= 100 * score[k] <= 100 * score[p]][:5]
            out += [(str(i), str(held[p][0]), r + 1, str(held[k][0]), int(score[p]), int(score[k])) for r, k in enumerate(some)]
    return sorted(out)


MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block, chunk", [(4096, 16_384), (32, 3)])
def test_negatives(vectors, monkeypatch, block, chunk):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "CHUNK_ANCHORS", chunk)
    got = negatives.mine(vectors)
    assert got.columns == MINED
    assert _told(got, MINED) == _mined([r[:3] for r in _vectors()])


def test_negatives_of_few_vectors(vectors):
    assert negatives.mine(vectors.where("false")).count() == 0
    assert negatives.mine(vectors.where("vec_id = 200")).count() == 0
    assert negatives.mine(vectors.where("vec_id >= 700")).count() == 0
    assert negatives.mine(vectors.where("vec_id % 100 <> 0")).count() == 0


def test_coordinate_ranges_lose_nothing_and_prune():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3000, 16))
    rows = np.floor(rows / np.linalg.norm(rows, axis=1, keepdims=True) * rng.uniform(250, 260, (3000, 1))).astype(np.int64)
    lists, walked = negatives.Lists(rows), 0
    for q in rows[:40]:
        score = rows @ q
        for least in (1, int(score.max() * 0.5), int(score.max() * 0.8), int(score.max())):
            found = lists.reach(q, least)
            assert set(np.flatnonzero(score >= least)) <= set(found)
        walked += len(found)
        assert len(lists.reach(q, score.max() * 1e6)) == 0 and len(lists.reach(q, -5)) == len(rows)
    assert walked < 0.05 * 40 * len(rows)


def _texts():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(500)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [None, "", " \n ", "a", "A", "a b", "one two three four", "ONE two three  four", make(9000)]
    for length in (8, 30, 200):
        base = make(length)
        for k in range(90):
            rate = (0, 0.004, 0.01, 0.03, 0.3)[k % 5]
            out.append(" ".join(w if rnd.random() > rate else rnd.choice(words) for w in base.split()))
    return out + [make(rnd.randint(1, 150)) for _ in range(60)]


def _linked(rows, size, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append(frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and part[a] != part[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                part = [part[b] if p == part[a] else p for p in part]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[k] and rows[j][0] is not None]
        out.append((str(i), len(sets[k]), str(min(ids, default=None)), i == min(ids, default=None)))
    return sorted(out)


@pytest.mark.parametrize("size, percent, region_rows", [(5, 85, 4096), (5, 80, 25), (1, 85, 4096)])
def test_setsketch(spark, size, percent, region_rows):
    texts = _texts()
    # between two documents that are linked only through a row without an id
    chain = [f"w{k}" for k in range(104)]
    links = [" ".join(chain[a:a + 100]) for a in ((0, 2, 4) if size == 5 else (0,))]
    rows = [(BIG + k, t) for k, t in enumerate(texts)] + [(5, texts[9]), (5, texts[9]), (None, texts[-1]), (None, "only here " * 9)]
    rows += [(None if k == 1 else k + 1, t) for k, t in enumerate(links)]
    frame = spark.createDataFrame([(i, t, "k", 1, "x", b"r") for i, t in rows],
                                  "doc_id long, text string, node string, n int, label string, regs binary").repartition(3)
    got = setsketch.classes(frame, size, percent, region_rows)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got.collect())
    assert got == _linked(rows, size, percent)
    assert setsketch.classes(frame.where("false")).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(8)
    pool = np.sort(rng.integers(1, 2**63, 6000, dtype=np.uint64))
    a, b = pool[:4000], pool[1000:]
    both = np.union1d(a, b)
    regs = setsketch.registers([a, b, both, a[:0]])
    assert (setsketch.merged(regs[0], regs[1]) == regs[2]).all() and (setsketch.merged(regs[0], regs[3]) == regs[0]).all()
    off = []
    for share in (0.3, 0.6, 0.85, 0.95):
        for _ in range(20):
            n = 2000
            same = int(2 * n * share / (1 + share))
            x = rng.integers(1, 2**63, 2 * n - same, dtype=np.uint64)
            p, q = setsketch.registers([np.sort(x[:n]), np.sort(x[n - same:])])
            one = lambda v: np.array([float(v)])
            off.append(setsketch.estimate(one((p > q).sum()), one((p < q).sum()), one(n), one(n))[0] - share)
            if share >= 0.85:
                assert setsketch.likely(q[None], p, np.array([n]), n, 85)[0]
            if share == 0.3:
                assert not setsketch.likely(q[None], p, np.array([n]), n, 85)[0]
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.2


def test_shingle_sets_of_short_texts():
    assert [len(s) for s in shingle_sets([b"", b"a", b"a b c d e f"], 5)] == [0, 1, 2]


def test_neighbours_of_unclustered_vectors(spark):
    """Vectors without clusters, and ones far from the origin: lists are opened until the true neighbours are found."""
    rng = np.random.default_rng(9)
    for x in (rng.normal(size=(12_000, 16)), rng.normal(size=(6_000, 32)) * 1e-3 + 1e7):
        frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
        got = neighbours.nearest(frame).toPandas()
        assert (got.groupby("query_id").size() == 10).all() and got["query_id"].nunique() == len(x) // 100
        hit = 0
        for q, part in got.groupby("query_id"):
            d = np.sqrt(((x - x[q])**2).sum(1))
            d[q] = np.inf
            assert np.array_equal(part["score"], d[part["vec_id"]])
            hit += len(set(np.argpartition(d, 9)[:10]) & set(part["vec_id"]))
        assert hit >= 0.95 * len(got)
