"""Rows that repeat ids, texts or vectors, very long and empty ones, clashing names and empty tables, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import shared as engine
from corvane.llm import components, embed_dedup, exact_dedup, minmax, mixing, shared
from tests.llm.test_corpus import brute_components, rows_of, shingles


@pytest.fixture(params=["broadcast", "shuffled"])
def joined(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(engine, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(shared, "KEY_BYTES", 0)


def brute_vectors(data, threshold=0.95):
    """(id, links, component) of rows (id, vector): rows of one id are one node."""
    usable = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in data]
    linked = collections.defaultdict(set)
    unit = [np.array(v) / max(abs(x) for x in v) if u else None for (_, v), u in zip(data, usable)]
    for a in range(len(data)):
        for b in range(len(data)):
            if a != b and usable[a] and usable[b] and len(unit[a]) == len(unit[b]):
                x, y = unit[a], unit[b]
                if (x @ y) / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    linked[a].add(b)
    ids = {i for i, _ in data if i is not None}
    root = brute_components(ids, [(data[a][0], data[b][0]) for a in linked for b in linked[a]])
    return sorted(((i, len(linked[k]), root.get(i)) for k, (i, _) in enumerate(data)), key=str)


def found_vectors(spark, data, kind="double"):
    rows = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "d") for i, v in data], f"vec_id long, embedding array<{kind}>, cid int, digest string")
    out = rows_of(embed_dedup.near_duplicates(rows))
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in out)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)


A, B, C = [1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0.0]
A2, B2 = [1.0, 0.1, 0, 0], [0, 1.0, 0.1, 0]
VECTORS = {
    "one id, two vectors": [(3, A), (5, A), (5, B), (4, B)],
    "links by vector": [(5, A), (5, B), (6, A2), (7, B2)],
    "shared smallest id": [(1, A), (1, B), (2, A), (3, B), (1, C), (9, C)],
    "repeated rows": [(2, A), (2, A), (2, A), (1, B), (None, A), (None, A)],
    "usable and not": [(4, None), (4, A), (2, A2), (4, [0.0] * 4), (8, [0.0] * 4), (8, None)],
    "sizes": [(1, [1e-200, 2e-200]), (2, [1e-200, 2e-200]), (3, [1e200, 2e200]), (4, [5e-324, 0.0]), (5, [1.0, 0.0]), (6, [1.7e308, 1.7e308]), (7, [1.0, 1.0])],
    "lengths": [(i, [1.0] * (1 + i % 7)) for i in range(40)] + [(50, [float("nan")]), (51, [float("inf"), 1.0]), (52, [None, 1.0]), (53, [])],
    "a chain over ids": [(i, [float(k == j) for k in range(12)]) for i in range(11) for j in (i, i + 1)],
    "long": [(i, [float((j * 7 + i // 2) % 5 + 1) for j in range(5000)]) for i in range(6)],
}


@pytest.mark.parametrize("case", VECTORS)
def test_vectors(spark, case):
    assert found_vectors(spark, VECTORS[case]) == brute_vectors(VECTORS[case])


def test_all_vectors_together(spark, joined):
    data = [(None if i is None else i + 100 * k, v) for k, case in enumerate(VECTORS.values()) for i, v in case]
    assert found_vectors(spark, data) == brute_vectors(data)


def test_random_vectors_of_few_ids(spark, joined, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    data = [(int(rng.integers(40)), base[i % 30] + rng.normal(size=8) * 0.05 * (i % 4)) for i in range(120)]
    assert found_vectors(spark, data) == brute_vectors(data)


def test_bounds_decide_most_pairs_of_a_large_group():
    rng = np.random.default_rng(6)
    x = embed_dedup.scaled(rng.normal(size=64) + rng.normal(size=(300, 64)) * np.linspace(0, 0.4, 300)[:, None])
    norm = np.sqrt((x * x).sum(1))
    exact = (x @ x.T) / norm[:, None] / norm[None] >= 0.95
    found = np.zeros_like(exact)
    for i, j in embed_dedup.links(x, x, 0.95):
        assert not found[i, j].any()
        found[i, j] = True
    assert (found == exact).all() and 0.1 < exact.mean() < 0.9
    cut = embed_dedup.prepared(x)[1:]
    (_, _, about, bound), = embed_dedup.estimates(cut, cut)
    may, must = about + bound >= 0.95, about - bound >= 0.95
    assert (must <= exact).all() and (exact <= may).all() and (may & ~must).sum() < may.sum() / 2


def test_tiles_grow_before_they_multiply():
    tiles = [-(-n // embed_dedup.tile_size(n, 200)) for n in (40_000, 200_000, 900_000)]
    assert max(tiles) <= 30 and embed_dedup.tile_size(10**9, 200) == embed_dedup.tile_size(10**9, 200, 64) == embed_dedup.TILE
    assert [embed_dedup.tile_size(10**9, 200, w) for w in (1024, 100_000)] == [2048, embed_dedup.LEAST_TILE]
    assert embed_dedup.tile_size(10, 200, 100_000) == embed_dedup.LEAST_TILE


def together(cases):
    """All cases as one table: other ids and other words for each."""
    return [(None if i is None else i + 100 * k, t and re.sub(r"[^ \t]+", lambda m: f"{k}{m[0]}", t)) for k, case in enumerate(cases) for i, t in case]


def document_table(spark, data):
    return spark.createDataFrame([(i, t, k, "m", [k]) for k, (i, t) in enumerate(data)], "doc_id long, text string, digest int, own_mark string, cid array<int>")


BASE = " ".join(f"w{i}" for i in range(60))
NEAR, OTHER, UNIQUE = BASE.replace("w30", "changed"), " ".join(f"o{i}" for i in range(50)), " ".join(f"u{i}" for i in range(40))
TEXTS = {
    "unique text of a repeated id": [(3, BASE), (5, BASE + " x"), (5, UNIQUE)],
    "two classes of one id": [(3, BASE), (5, NEAR), (5, OTHER), (4, OTHER + " y"), (9, UNIQUE)],
    "shared smallest id": [(1, BASE), (1, OTHER), (2, BASE), (3, OTHER), (1, UNIQUE), (7, UNIQUE + " z")],
    "repeated rows": [(2, BASE), (2, BASE), (2, BASE.upper()), (8, NEAR), (None, BASE), (None, BASE)],
    "no words": [(4, None), (4, BASE), (2, NEAR), (4, ""), (6, " \t"), (6, None), (None, None)],
    "few words": [(1, "a b"), (2, "A  b"), (3, "a b c"), (4, "a"), (4, "a b"), (5, "a")],
    "very long": [(1, BASE * 2000), (2, BASE * 2000 + " end"), (3, " ".join(f"q{i}" for i in range(120_000))), (4, " ".join(f"q{i}" for i in range(118_000)))],
}


def brute_documents(data, words, percent):
    sets = [shingles(t, words) for _, t in data]
    linked = [(a, b) for a in range(len(data)) for b in range(a) if sets[a] and sets[b] and data[a][0] is not None and data[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, linked


def test_documents(spark, joined):
    data = together(TEXTS.values())
    sets, linked = brute_documents(data, 3, 85)
    root = brute_components({i for i, _ in data if i is not None}, [(data[a][0], data[b][0]) for a, b in linked])
    out = rows_of(minmax.near_duplicates(document_table(spark, data), words=3, percent=85))
    want = sorted(((i, len(s), root.get(i), i is None or root[i] == i) for (i, _), s in zip(data, sets)), key=str)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=str) == want


def brute_kept(data, words, percent):
    """Places of the rows that stay where every row is a node: of a component the smallest (id, mark of the text), of repeated rows one."""
    _, linked = brute_documents(data, words, percent)
    root = brute_components(range(len(data)), linked)
    mark = lambda k: int(hashlib.sha256((data[k][1] or "").encode()).hexdigest()[:15], 16)
    groups = collections.defaultdict(list)
    for k in range(len(data)):
        groups[root[k]].append(k)
    kept = [min(g, key=lambda k: (data[k][0], mark(k))) if len(g) > 1 else g[0] for g in groups.values()]
    return collections.Counter(data[k] for k in kept)


def test_rows_kept_of_near_copies(spark, joined):
    data = together(TEXTS.values())
    docs = document_table(spark, data)
    out = minmax.keep_one(docs)
    assert out.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows_of(out)) == brute_kept(data, 5, 80)


def test_blocks_grow_before_they_multiply(spark):
    sizes = (0, 1, 200, 10_000, 230_000, 10**7)
    rows = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = {r.n: r.parts for r in rows.select("n", minmax._parts(F.col("n"), 256, 8192, 200).alias("parts")).collect()}
    assert got[0] == 0 and got[1] == got[200] == 1
    assert got[10_000] == 40 and got[230_000] == 114 and got[10**7] == -(-(10**7) // 8192)


@pytest.mark.parametrize("most, held", [(8192, 1 << 22), (4, 1 << 22), (64, 100)])
def test_many_near_copies_of_few_ids(spark, joined, monkeypatch, most, held):
    monkeypatch.setattr(minmax, "BLOCK", 4)
    monkeypatch.setattr(minmax, "OTHERS", 8)
    monkeypatch.setattr(minmax, "MOST", most)
    monkeypatch.setattr(minmax, "HELD_SHINGLES", held)
    random.seed(11)
    data = []
    for _ in range(8):
        base = [f"{random.choice('abcdef')}{random.randrange(300)}" for _ in range(random.randint(8, 60))]
        for _ in range(random.randint(1, 12)):
            copy = list(base)
            for _ in range(random.randint(0, 6)):
                copy[random.randrange(len(copy))] = f"new{random.randrange(5)}"
            data.append((random.randrange(30), " ".join(copy)))
    _, linked = brute_documents(data, 5, 80)
    root = brute_components({i for i, _ in data}, [(data[a][0], data[b][0]) for a, b in linked])
    out = rows_of(minmax.near_duplicates(document_table(spark, data)))
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == sorted((i, root[i]) for i, _ in data)
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows_of(minmax.keep_one(document_table(spark, data)))) == brute_kept(data, 5, 80)


def test_empty_and_null_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.components(spark.createDataFrame([(1, 1), (None, 2), (3, None), (None, None)], "a long, b long")).count() == 0
    assert minmax.keep_one(document_table(spark, [(1, "x")]).limit(0)).count() == 0
    assert embed_dedup.near_duplicates(spark.createDataFrame([(None, None)], "vec_id long, embedding array<float>")).first()["kept"]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_of_long_and_odd_texts(spark, joined):
    long = "word  " * 300_000
    data = [(5, long), (4, "word " * 300_000), (4, None), (4, ""), (4, " "), (None, "a"), (None, "a"), (7, "a"), (7, "a"), (7, "ü a"), (7, "ü a")]
    docs = document_table(spark, data)
    out = rows_of(exact_dedup.deduplicate(docs))
    sums = [hashlib.sha256(normal(t).encode()).hexdigest() for _, t in data]
    groups = collections.Counter(sums)
    assert collections.Counter((r["doc_id"], r["text_sha256"], r["group_size"]) for r in out) == collections.Counter((i, s, groups[s]) for (i, _), s in zip(data, sums))
    assert collections.Counter(r["text_sha256"] for r in out if r["kept"]) == collections.Counter(set(sums))
    kept = collections.Counter((r["doc_id"], normal(r["text"])) for r in rows_of(exact_dedup.keep_first(docs)))
    assert kept == collections.Counter({(4, normal(long)): 1, (4, ""): 1, (4, " "): 1, (7, "a"): 1, (7, "ü a"): 1, (7, "ü a"): 1})


def test_index_over_arrivals_with_ties(spark, joined, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_FILES", 3)
    index = exact_dedup.DigestIndex(spark, "digest_index_ties")
    seen = {}
    for batch in ([(1, "a"), (1, "a"), (None, "b")], [(2, "a"), (None, "b"), (3, None), (3, "")], [(0, "a"), (4, "c"), (4, "c"), (None, "c")], [], [(9, "c"), (None, None)]):
        out = rows_of(exact_dedup.deduplicate(document_table(spark, batch), index=index))
        new = collections.defaultdict(list)
        for i, t in batch:
            if normal(t) not in seen:
                new[normal(t)].append(i)
        assert collections.Counter(r["text_sha256"] for r in out if r["kept"]) == collections.Counter(hashlib.sha256(t.encode()).hexdigest() for t in new)
        seen |= {t: min((i for i in ids if i is not None), default=None) for t, ids in new.items()}
        assert all(r["keep_id"] == next(v for t, v in seen.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]) for r in out)
    again = exact_dedup.DigestIndex(spark, "digest_index_ties")
    assert again.buckets == exact_dedup.LEAST_BUCKETS and again.table().count() == len(seen)
    again.compact(buckets=32)
    assert exact_dedup.DigestIndex(spark, "digest_index_ties").buckets == 32 and again.table().count() == len(seen)
    again.drop()


def test_buckets_follow_the_rows(spark, monkeypatch):
    assert [exact_dedup.buckets_for(n) for n in (0, 10, 16_000_000, 16_000_001, 10**11)] == [16, 16, 16, 32, 131072]
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 4)
    for n, buckets in ((10, 16), (100, 32)):
        index = exact_dedup.DigestIndex(spark, f"digest_index_{n}")
        exact_dedup.deduplicate(document_table(spark, [(i, str(i)) for i in range(n)]), index=index).count()
        assert index.buckets == buckets and index.table().count() == n
        index.drop()


def test_mixing_of_odd_rows(spark, joined):
    rows = [(i, "w " * (i % 5), "a") for i in range(40)] + [(100 + i, None, "empty") for i in range(5)] + [(200, "x " * 200_000, "b"), (200, "y", "b"), (None, "z z", None), (None, "z z", None)]
    docs = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "doc_id long, text string, source string, size int, hash int, KEY string")
    out = rows_of(mixing.mix(docs))
    assert len(out) == len(rows) and all(0 <= r["epochs"] <= 3 and r["taken"] == r["epochs"] * r["size"] for r in out)
    assert {r["target"] for r in out if r["source"] == "empty"} == {0.0} and {r["epochs"] for r in out if r["source"] == "empty"} == {1}
    capped = [r for r in out if r["source"] == "a"]
    assert all(r["epochs"] == 3 for r in capped) and all(r["target"] == 3.0 * r["source_size"] for r in capped)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["epochs"] for r in out)


def test_targets_hold_caps(spark):
    sizes = {"a": 1, "b": 100, "c": 7, "d": 0, None: 50, "e": 3}
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, group_rows long")
    got = {r["source"]: r["target"] for r in rows_of(mixing.targets(table))}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1]))
    left, open_, want = float(sum(sizes.values())), set(weights), {}
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    assert got == pytest.approx(want | share)
    assert {r["target"] for r in rows_of(mixing.targets(table, most=1))} == {float(n) for n in sizes.values()}
