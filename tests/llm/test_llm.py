"""Every corpus operator against a brute-force version on a small table with awkward rows."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest

from barograph.llm import decontamination, jaccard, lm, neighbours, packing, quality, sharding, substrings, toxicity
from barograph.llm.common import components, window_minima

os.environ["PYTHONPATH"] = os.pathsep.join([os.getcwd(), os.environ.get("PYTHONPATH", "")])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, passage = make(150), make(70)
    near = [" ".join(w if rnd.random() > e else "x" + w for w in base.split()) for e in (0, .005, .01, .02, .04, .08, .15) * 4]
    out = [base, base, *near, make(60) + " " + passage + "\n" + make(40), passage, make(30) + "\t" + passage, make(9), make(3),
           "ABC Abc abc", "abc", "", "   \n", None, "ab" * 700, "Ünï — “x”    y <|endoftext|>", make(6000), "a  b\r\nc d "]
    return out + [make(rnd.randint(1, 120)) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(k * 3 + 1, t, "en", None if k % 5 else "s", k) for k, t in enumerate(texts)] + [(4, texts[1], "en", "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int").repartition(3)
    return frame.cache()


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < 0")


def _same(got, want, columns):
    got = sorted(map(tuple, got[columns].astype(object).values.tolist()))
    assert got == sorted(want)


def test_window_minima():
    values = np.random.default_rng(0).integers(0, 9, 300).astype(np.uint64)
    for width in (1, 2, 5, 7, 64, 299, 300, 400):
        want = {k for i in range(max(1, 300 - width + 1)) for k in range(i, min(i + width, 300))
                if values[k] == values[i:i + width].min()}
        assert set(window_minima(values, width)) == want


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(5, 40), (7, 7), (3, 1), (1, 2)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(10, 41), 5), 3: 1, 2: 1}


@pytest.mark.parametrize("region_rows, region_bytes", [(8192, 16 << 20), (6, 16 << 20), (8192, 4096), (8192, 0)])
def test_jaccard(docs, local, nothing, region_rows, region_bytes):
    def shingled(text, k=4):
        w = WORD.findall((text or "").translate(LOW))
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    sets = [shingled(t) for t in local["text"]]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    want = [(int(d), len(s), int(local["doc_id"][g])) for d, s, g in zip(local["doc_id"], sets, group, strict=True)]
    assert len(set(group)) < len(sets) - 8
    _same(jaccard.classes(docs, 4, 85, region_rows, region_bytes).toPandas(), want, ["doc_id", "n_shingles", "component_id"])
    assert jaccard.classes(nothing).count() == 0


def test_jaccard_links_through_rows_without_an_id(spark):
    words = [f"w{k}" for k in range(110)]
    big = 2**53 + 1
    texts = [" ".join(words[a:a + 100]) for a in (0, 4, 8)]
    rows = [(big, texts[0]), (None, texts[1]), (None, texts[1]), (big + 2, texts[2]), (None, "alone " * 30), (big + 4, "")]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted(
        [(str(big), str(big)), (str(big + 2), str(big)), (str(big + 4), str(big + 4)), ("None", str(big)), ("None", str(big)), ("None", "None")])


def test_first_window():
    for size in range(1, 60):
        for percent in (50, 80, 85, 99, 100):
            share = -(-size * percent // 100)
            assert jaccard.first_window(size, percent) == size - share + 1


def test_packed_counts():
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, top, jaccard.SKETCH) for top in (1, 2, 16, 17, 256, 257, 70_000, 3)]
    blobs = [jaccard.pack_counts(r) for r in rows]
    assert (jaccard.unpack_counts(blobs) == np.array(rows)).all() and len(set(map(len, blobs))) == 3


def test_representatives_keep_columns(docs):
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 4").count() == 0


@pytest.mark.parametrize("length", [40, 400])
def test_bytes(docs, local, nothing, length):
    texts = [(t or "").encode() for t in local["text"]]
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p:p + length]] = seen.get(t[p:p + length], 0) + 1
    want = []
    for d, t in zip(local["doc_id"], texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        want.append((int(d), len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = substrings.remove_repeated_bytes(docs, length).toPandas()
    _same(got, want, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert substrings.remove_repeated_bytes(nothing).count() == 0


@pytest.mark.parametrize("size", [1_500_000, 20])
def test_passages(docs, local, nothing, size):
    seen, want = set(), []
    for d, t in zip(local["doc_id"], local["text"], strict=True):
        w = WORD.findall(t or "")
        gone = [0] * len(w)
        for p in range(len(w) - 19):
            if tuple(w[p:p + 20]) in seen:
                gone[p:p + 20] = [1] * 20
            seen.add(tuple(w[p:p + 20]))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((int(d), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substrings.remove_repeated_passages(docs, 20, size).toPandas()
    _same(got, want, ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert substrings.remove_repeated_passages(nothing).count() == 0


def test_cut_passages_keeps_columns(docs):
    cut = substrings.cut_passages(docs)
    assert cut.schema.simpleString() == docs.schema.simpleString() and cut.count() == docs.count()
    assert cut.where("text is null").count() == 0 or docs.where("text is null").count() > 0
    assert sorted(map(str, cut.select("doc_id", "lang", "source", "score").collect())) == sorted(
        map(str, docs.select("doc_id", "lang", "source", "score").collect()))


def test_lm(docs, local, nothing):
    tokens = [WORD.findall((t or "").translate(LOW)) + ["</s>"] for t in local["text"]]
    held = [zlib.crc32(str(d).encode()) % 10 == 0 for d in local["doc_id"]]
    count = {}
    for t, h in zip(tokens, held, strict=True):
        for w in t if not h else []:
            count[w] = count.get(w, 0) + 1
    total, vocabulary = sum(count.values()), len(count)
    got = lm.score(docs).toPandas().sort_values(["doc_id", "n_tokens"])
    base = [sum(np.log10((count.get(w, 0) + .1) / (total + .1 * (vocabulary + 1))) for w in t) for t in tokens]
    want = sorted(zip(local["doc_id"], held, map(len, tokens), [sum(w in count for w in t) for t in tokens], base, strict=True))
    for row, (d, h, n, known, b) in zip(got.itertuples(), want, strict=True):
        assert (row.doc_id, row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (d, h, n, known, total)
        assert abs(row.base_score - b) < 1e-6 and row.score < 0
    assert got["score"].sum() > got["base_score"].sum()
    assert lm.score(nothing).count() == 0


def test_weights_sum_to_one():
    w = lm.learn_weights(np.array([lm.CELLS**2 * 3 + 50 * lm.CELLS + 9, 7]), np.array([30.0, 4.0]), 100, 20)
    assert np.allclose(w.sum(1), 1) and (w > 0).all()


def test_sharding(docs, local, nothing):
    got = sharding.assign(docs, shards=4, ranges_per_shard=8).toPandas()
    want = sorted((int(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in zip(local["doc_id"], local["text"], strict=True))
    assert sorted(zip(got["doc_id"], got["size"], got["text_crc32"], strict=True)) == want
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got["shard"].between(0, 3).all() and (got["law"] == "bytes").all() and got["grown_shard"].isna().all()
    assert sharding.assign(nothing).count() == 0


def test_sharding_splits_a_hot_text(spark):
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k}") for k in range(3000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 16 and load.max() < 1.03 * load.mean() and load.min() > 0.97 * load.mean()
    cold = got[got["doc_id"] % 3 > 0]
    assert len(cold) == 2000


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 8)).round(3)
    x[100:500] = x[100]  # a hot vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [
        (2000, None), (2100, [0.0] * 8), (2200, [float("nan")] + [1.0] * 7), (2300, [1.0, None] + [1.0] * 6), (2400, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame).toPandas()
    assert set(got["query_id"]) == set(range(0, 1200, 100))
    hit = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        d = np.sqrt(((x - x[q])**2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1200), d))[:10]
        assert list(part["rank"]) == list(range(1, 14)) and np.allclose(part["score"], d[part["vec_id"]])
        hit += len(set(best) & set(part["vec_id"]))
    assert hit >= 0.9 * 120
    few = neighbours.nearest(frame.where("vec_id < 4")).toPandas().sort_values("rank")
    assert set(few["query_id"]) == {0} and len(few) == 3
    assert neighbours.nearest(frame.where("vec_id < 0")).count() == 0


def test_packing(docs, local, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).toPandas()
    for d, t in zip(local["doc_id"], local["text"], strict=True):
        ids = np.array((tokenizer.encode(t, add_special_tokens=False).ids if t is not None else []) + [1], np.uint32)
        part = got[(got["doc_id"] == d) & (got["doc_tokens"] == len(ids))].drop_duplicates("start").sort_values("start")
        assert part["length"].sum() == len(ids) and list(part["start"]) == [0, *part["length"].cumsum()[:-1]]
        assert [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(part["start"], part["length"], strict=True)] == list(part["ids_crc32"])
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part["offset"]) == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() <= 2048
    assert packing.pack(nothing).count() == 0


def test_cutting_stock():
    sizes, demand = np.array([3, 5, 7, 12, 25, 50]), np.array([400, 300, 0, 77, 60, 41])
    plan = packing.cutting_stock(sizes, demand, 50)
    assert (sum(n * p for n, p in plan) == demand).all() and all((p * sizes).sum() <= 50 for _, p in plan)
    assert sum(n for n, _ in plan) <= -(-(sizes * demand).sum() // 50) + 5


def test_decontamination(spark, docs, nothing):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    items = [[rnd.choice(words) for _ in range(n)] for n in (14, 30, 55)]
    swap = [w if k % 9 != 4 else "other" for k, w in enumerate(items[1])]
    filler = [rnd.choice(words) for _ in range(500)]
    texts = {1: filler[:50] + items[0] + filler[50:90], 2: ["A,"] + [w.upper() + ";" for w in items[1]], 3: swap + filler[:30],
             4: filler, 5: items[2][10:40] + filler[100:140], 6: [], 7: items[1][:6] + filler}
    frame = spark.createDataFrame([(d, " ".join(w), "x") for d, w in texts.items()] + [(8, None, "x"), (None, " ".join(items[0]), "x"),
                                  (1, " ".join(texts[1]), "x"), *[(9, " ".join(items[2][a:a + 13] + ["q"] * 42), "x") for a in (40, 0)],
                                  (9, " ".join(items[2][:10] + ["z"] * 30), "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(9, None), (10, ""), (11, "too short"),
                                  (None, "x")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.overlaps(frame, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 1), (5, 2), (9, 2)}
    assert got[1, 0]["doc_start"] == 50 and got[1, 0]["similarity"] == 1 and got[3, 1]["similarity"] < 1
    kept = decontamination.clean(frame, bench)
    assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "6", "7", "8", "None"]
    assert decontamination.overlaps(nothing, bench).count() == 0


def test_decontamination_misses_no_allowed_substitution(spark):
    """Items of 1 to 15 words, with every placing of the substitutions that 80 % of 13 words (or of the item) allow."""
    rows, items, want = [], [], set()
    for n in range(1, 16):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        width = min(n, 13)
        allowed = width - -(-width * 4 // 5)
        for start in range(n - width + 1):
            for places in itertools.combinations(range(start, start + width), allowed):
                copy = ["other" if k in places else w for k, w in enumerate(item)][start:start + width]
                want.add((len(rows), n))
                rows.append((len(rows), " ".join(["before", *copy, "after"])))
            if n > 1:  # one substitution more is not an overlap
                rows.append((len(rows), " ".join(["other"] * (allowed + 1) + item[start + allowed + 1:start + width])))
    glued, kana = "水在标准大气压下的沸点是一百摄氏度", "東京タワーの高さは三百三十三メートルです"
    items += [(20, glued), (21, kana), (22, "?!"), (23, "")]
    want |= {(len(rows), 20), (len(rows) + 1, 21)}
    rows += [(len(rows), "前文如此" + glued + "后文如此"), (len(rows) + 1, kana), (len(rows) + 2, ""), (len(rows) + 3, "...")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(frame, bench).collect()}
    assert want - got == set() and got - want == set()
    assert decontamination.overlaps(frame, bench.where("item_id > 21")).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]


def test_quality(tables, docs, nothing):
    documents, labels = tables
    got = quality.score(documents, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got["predicted"] == got["quality"])[got["held_out"]].mean() > 0.95
    odd = quality.score(docs, labels).toPandas()
    assert len(odd) == docs.count() and odd["score"].between(0, 1).all()
    assert quality.score(nothing, labels.where("false")).count() == 0


def test_toxicity(spark, tables, docs, nothing):
    labels = tables[1]
    larger = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    got = toxicity.chain(*larger).toPandas().merge(larger[1].toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert ((held["predicted"] == 1) & (held["toxic"] == 0)).mean() < 0.02
    assert (held["predicted"] == 1)[held["toxic"] == 1].mean() >= 0.8
    assert got["p_insult"].max() > 0.5 and got["p_contempt"].max() > 0.5  # categories with examples are predicted
    odd = toxicity.chain(docs, labels.where("false")).toPandas()
    assert len(odd) == docs.count() and (odd["predicted"] == 0).all()
    assert toxicity.chain(nothing, labels).count() == 0


def test_pipeline_order_and_effect(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{folder}/documents.parquet")
    kept = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.keep(stage(spark, kept, folder))
        assert after.columns == before.columns, name
        assert after.count() <= kept.count()
        kept = after
    bad = toxicity.chain(before, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").select("doc_id")
    assert kept.join(bad, "doc_id").count() == 0
    packed = corpus_pipeline.run(spark, folder).toPandas()
    assert set(packed["doc_id"]) == set(kept.toPandas()["doc_id"])


def test_registered_names():
    from barograph.llm import queries
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


def test_region_of_short_sets_around_a_long_one():
    """A long document in a region does not become its pivot, and its links stay whole."""
    rng = np.random.default_rng(5)
    long = np.sort(rng.choice(2**40, 20_000, replace=False).astype(np.uint64))
    near = np.delete(long, [7, 99])
    base = [np.sort(rng.choice(long, 60, replace=False)) for _ in range(150)]
    sets = [long, *base, *[np.delete(b, 3) for b in base], near]
    pivot = jaccard.small_pivot(sets)
    assert len(sets[pivot]) <= 60
    names = np.arange(len(sets))
    links = jaccard.join_region(names, sets, pivot, 80)
    root = {k: k for k in names}
    for a, b in links:
        old, new = root[a], root[b]
        root = {k: new if r == old else r for k, r in root.items()}
    assert root[0] == root[len(sets) - 1]
    assert all(root[1 + k] == root[151 + k] for k in range(150))
    assert len(set(root.values())) == 151


def test_sketches_tell_long_sets_apart():
    rng = np.random.default_rng(11)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    base, short = draw(12_000), draw(300)
    sets = [base, draw(12_000), np.sort(np.append(base[300:], draw(200))), draw(11_000), short, short[:290], draw(3000), base[:10_400]]
    size = np.array([len(s) for s in sets], float)
    plain = [jaccard.pack_counts(jaccard.counts_of(s)) for s in sets]
    group = jaccard.may_link(size, plain, np.full(len(sets), jaccard.SKETCH), 80)
    assert len(set(group[[0, 1, 2, 3, 7]])) == 1 and group[0] >= 0  # too coarse for sets of this length
    parts = np.array([jaccard.parts_of(len(s)) for s in sets])
    assert sorted(set(parts)) == [256, 1024, 4096] and jaccard.parts_of(9000) == 4096
    group = jaccard.may_link(size, [jaccard.pack_counts(jaccard.counts_of(s, int(k))) for s, k in zip(sets, parts, strict=True)], parts, 80)
    assert group[0] == group[2] == group[7] >= 0 and group[4] == group[5] >= 0 and group[0] != group[4]
    assert list(group[[1, 3, 6]]) == [-1] * 3


def test_sketches_of_unlike_detail_lose_no_link():
    rng = np.random.default_rng(12)
    for n in (1024, 1025, 2040, 2048, 2060, 4100):  # beside the sizes at which detail doubles
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        sets = [base, base[:-(n // 6)], np.append(base, rng.integers(0, 2**64, n // 6, dtype=np.uint64))]
        parts = np.array([jaccard.parts_of(len(s)) for s in sets])
        blobs = [jaccard.pack_counts(jaccard.counts_of(s, int(k))) for s, k in zip(sets, parts, strict=True)]
        group = jaccard.may_link(np.array([len(s) for s in sets], float), blobs, parts, 80)
        assert len(set(group)) == 1 and group[0] >= 0


def test_first_regions_ship_a_group_of_copies_once(spark, monkeypatch):
    """Two near copies that share many keys with third texts lie in many regions, and are joined in one."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(2000)]
    near = base[:1000] + [word()] + base[1000:]
    rows = [(1, " ".join(base)), (2, " ".join(near))]
    for k in range(60):  # texts that hold a stretch of them, each a region's pivot now and then
        rows.append((10 + k, " ".join(base[30 * k:30 * k + 30] + [word() for _ in range(1900)])))
    sent = []
    plain = jaccard.keep
    monkeypatch.setattr(jaccard, "keep", lambda df: sent.append(plain(df)) or sent[-1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 1 if k == 2 else k for k, _ in rows}
    listed = next(df for df in sent if df.columns[:2] == ["x", "regions"]).collect()
    assert sum(len(r["regions"]) for r in listed) == 2


def test_packed_keys():
    keys = np.random.default_rng(1).integers(0, 2**64, 50, dtype=np.uint64)
    blobs = [jaccard.pack_keys(part) for part in (keys[:7], keys[7:7], keys[7:])]
    assert (jaccard.unpack_keys(blobs) == keys >> np.uint64(24)).all() and len(blobs[0]) == 7 * jaccard.KEY_BYTES


def test_representatives_ship_a_group_of_copies_once(spark, monkeypatch):
    """The pipeline's near duplicates: two copies beside 60 texts that hold stretches of them are sent once each."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:700] + [word()] + base[700:]))]
    rows += [(10 + k, " ".join(base[30 * k:30 * k + 30] + [word() for _ in range(1900)])) for k in range(60)]
    sent, plain = [], jaccard.keep
    monkeypatch.setattr(jaccard, "keep", lambda df: sent.append(plain(df)) or sent[-1])
    left = {r["doc_id"] for r in jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {k for k, _ in rows} - {2}
    listed = next(df for df in sent if df.columns[:2] == ["x", "regions"]).collect()
    assert sum(len(r["regions"]) for r in listed) == 2
