"""The corpus operators against brute force, the libraries, round trips and held-out rows, on small tables."""

import collections
import hashlib
import io
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from corvane.llm import bytebpe, components, embed_dedup, exact_dedup, langid, minmax, mixing, pieces, shared, token_counts, token_files, toxicity, warc
from corvane import shared as engine
from corvane.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
ODD = [None, "", " ", "\t\n", "word", "don't we'll I've 's 's  's\n's", "  a  b \n\n c\t\td  ", "hi<|endoftext|> there <|endoftext|>", "日本語 😀 123½!!! ...'t", "a▁b ▁", "x" * 3000, "Ünï " * 700]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tile int, key string, rep int"


def documents(spark, texts, ids=None, langs=None, sources=None):
    rows = [
        (ids[i] if ids else i, t, langs[i] if langs else None, sources[i] if sources else None, None, 1, "k", 2)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pre_tokens_agree_with_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path(BYTE_BPE)
    library = Tokenizer.from_file(path)
    texts = [f"a{c}{c}1 {c}!" for c in map(chr, [*range(0x2100), *range(0x3000, 0x3100)])] + ODD
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert token_counts.batch_counts(texts, path).tolist() == [len(x) for x in want]
    ids, counts = token_files.encode_batch(texts, path)
    ends = np.cumsum(counts)
    assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends)] == want


def test_token_counts(spark, empty):
    path = tokenizer_path(BYTE_BPE)
    out = rows_of(token_counts.count_documents(documents(spark, ODD + ODD[:5]), path))
    assert len(out) == len(ODD) + 5
    assert all(r["n_bytes"] == len((ODD + ODD[:5])[r["doc_id"]].encode()) for r in out if (ODD + ODD[:5])[r["doc_id"]])
    assert token_counts.count_documents(empty, path).count() == 0


def test_token_files(spark, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path(BYTE_BPE)
    library = Tokenizer.from_file(path)
    ids = [5, 3, 11, None, *range(20, 20 + len(ODD) - 4)]
    out = rows_of(token_files.round_trip(documents(spark, ODD, ids), path))
    start = 0
    for i, text in sorted(zip(ids, ODD), key=lambda p: (p[0] is not None, p[0] or 0)):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        row = next(r for r in out if r["doc_id"] == i)
        assert row == {"doc_id": i, "start": start, "n_tokens": len(want), "ids_crc32": zlib.crc32(np.array(want, "<u4").tobytes())}
        start += len(want)
    assert token_files.round_trip(empty, path).count() == 0


def test_token_files_of_one_id(spark):
    path = tokenizer_path(BYTE_BPE)
    docs = documents(spark, [f"text {i} " * (i % 5) for i in range(60)], [7] * 40 + [None] * 20)
    one, two = (sorted(rows_of(token_files.round_trip(docs, path)), key=lambda r: r["start"]) for _ in range(2))
    assert one == two and [r["doc_id"] for r in one] == [None] * 20 + [7] * 40
    assert [r["start"] for r in one] == [sum(r["n_tokens"] for r in one[:i]) for i in range(60)]


def test_pieces_without_dropout_are_the_librarys():
    import sentencepiece

    path = tokenizer_path(PIECE_BPE)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in ODD if t and "▁" not in t]
    ids, counts = pieces.encode_batch(texts, np.zeros(len(texts)), path, dropout=0.0)
    ends = np.cumsum(counts)
    assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends)] == library.encode(texts)


def test_pieces_with_dropout(spark, empty):
    path = tokenizer_path(PIECE_BPE)
    model = pieces.load(path)
    random.seed(4)
    words = ["".join(random.choices("aeioünrst日😀", k=random.randint(1, 20))) for _ in range(300)]
    limit, keys = 2**30, np.arange(300).astype(np.uint64)
    raw = np.zeros((300, 22), np.uint32)
    for i, w in enumerate(words):
        raw[i, : len(w) + 1] = [32, *map(ord, w)]
    lengths = np.array([len(w) + 1 for w in words])
    flat, sizes = pieces.agendas(raw, lengths, keys, model, limit)
    ends = np.cumsum(sizes)
    singly = [pieces.agenda(raw[i, : lengths[i]], keys[i], model, limit) for i in range(300)]
    assert [flat[a:b].tolist() for a, b in zip(ends - sizes, ends)] == singly
    varied = [pieces.encode_batch([" ".join(words)], np.array([v]), path)[0].tolist() for v in range(pieces.VARIANTS)]
    assert len({tuple(v) for v in varied}) > 1
    docs = documents(spark, ODD)
    first, again = (sorted(rows_of(pieces.encode_documents(docs, path)), key=str) for _ in range(2))
    assert first == again and all(r["restored"] for r in first)
    assert pieces.encode_documents(empty, path).count() == 0


def test_pieces_draw_for_every_occurrence(spark):
    path = tokenizer_path(PIECE_BPE)
    model, limit = pieces.load(path), round(pieces.DROPOUT * 2**32)
    # a word of one merge, over many documents and many times in one: dropped at the rate, not by quarters
    name = next(n for n in ("▁" + c for c in "abcdefgh") if n in model.id_of)
    whole = [model.id_of[name]]
    ids, counts = pieces.encode_batch([name[1:]] * 4000, np.arange(4000), path)
    ends = np.cumsum(counts)
    share = np.mean([ids[a:b].tolist() != whole for a, b in zip(ends - counts, ends)])
    assert 0.08 < share < 0.12
    ids, counts = pieces.encode_batch([" ".join([name[1:]] * 4000)], np.array([1]), path)
    assert 0.08 < (counts[0] - 4000) / 4000 < 0.12
    # a longer word is cut in more than VARIANTS ways
    ids, counts = pieces.encode_batch(["international"] * 4000, np.arange(4000), path)
    ends = np.cumsum(counts)
    assert len({tuple(ids[a:b].tolist()) for a, b in zip(ends - counts, ends)}) > 2 * pieces.VARIANTS
    # every occurrence is cut as the agenda cuts it alone, whatever the table holds by then
    random.seed(9)
    words = ["".join(random.choices("aeioünrst日😀", k=random.randint(1, 40))) for _ in range(200)] + ["the", "information"] * 50
    texts = [" ".join(random.choices(words, k=200)) for _ in range(10)]
    want = []
    for d, text in enumerate(texts):
        at = 0
        for word in text.split(" "):
            points = np.array([32, *map(ord, word)], np.uint32)
            key = pieces.word_keys(pieces.range_hashes(points, np.array([0]), np.array([len(points)])), np.array([d]), np.array([at]), pieces.SEED)[0]
            want += pieces.agenda(points, key, model, limit)
            at += len(points)
    for _ in range(2):
        assert pieces.encode_batch(texts, np.arange(10), path)[0].tolist() == want
    # the copies of a document, and rows without an id, differ too
    rows = spark.createDataFrame([(i, "international information " * 20, c) for i in (1, None) for c in range(3)], "doc_id long, text string, copy int")
    out = rows_of(pieces.encode_documents(rows, path, copy_col="copy"))
    assert len({r["ids_crc32"] for r in out}) == 6 and all(r["restored"] for r in out)


def test_mixed_numbers_copies(spark):
    docs = documents(spark, [f"text {i} " * 5 for i in range(60)], None, None, ["a"] * 50 + ["b"] * 10)
    out = rows_of(mixing.mixed(docs, copy_col="mix_copy"))
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r["mix_copy"])
    assert max(map(len, by.values())) > 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_exact_dedup(spark, empty):
    texts = ["a  b", "a b", "a\t\nb", " a b", None, "", "a b", "c"]
    ids = [7, 3, 5, 1, 9, 8, 3, None]
    out = rows_of(exact_dedup.deduplicate(documents(spark, texts, ids)))
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for r in out:
        group = [i for i, n in zip(ids, normal) if hashlib.sha256(n.encode()).hexdigest() == r["text_sha256"]]
        known = [i for i in group if i is not None]
        assert r["keep_id"] == (min(known) if known else None) and r["group_size"] == len(group)
    kept = collections.Counter(r["text_sha256"] for r in out if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(set(normal))
    assert exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_rows_that_stay(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (2, "b", "x"), (2, "c", "x"), (None, "a", "x"), (None, "d", "x"), (None, "d", "y"), (4, None, "x"), (5, "", "x")]
    docs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, gone_id string, gone_0 int, Text_SHA256 int, keep_id int")
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in rows_of(out))
    assert got == collections.Counter([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, None)])
    gone = spark.createDataFrame([(1,), (None,)], "doc_id long")
    assert {r["doc_id"] for r in rows_of(exact_dedup.drop_ids(docs, gone, "doc_id"))} == {2, None, 4, 5}


def test_digest_index_across_batches(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_test")
    exact_dedup.deduplicate(documents(spark, ["a", "b"]), index=index).collect()
    out = {r["doc_id"]: r for r in rows_of(exact_dedup.deduplicate(documents(spark, ["b", "c", "c"], [10, 11, 12]), index=index))}
    index.drop()
    assert [out[i]["kept"] for i in (10, 11, 12)] == [False, True, False] and out[10]["keep_id"] == 1


def test_mixing(spark, empty):
    random.seed(3)
    sources = [random.choice(["a", "b", "c", "d", None]) for _ in range(400)]
    texts = [None if i % 50 == 0 else "w " * random.randint(0, 60) for i in range(400)]
    out = rows_of(mixing.mix(documents(spark, texts, sources=sources)))
    sizes, weights = collections.Counter(), dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    for s, t in zip(sources, texts):
        sizes[s] += len((t or "").split())
    target, left, open_ = {}, float(sum(sizes.values())), set(weights)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= share
    taken = collections.Counter()
    for r in out:
        s = sources[r["doc_id"]]
        assert math.isclose(r["target"], target[s]) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in weights)
    assert mixing.mix(empty).count() == 0


def test_mix_itself(spark):
    rows = [(i % 90 if i % 9 else None, "w " * (i % 7), "abc"[i % 3] if i % 11 else None) for i in range(180)]
    docs = spark.createDataFrame([(*r, i, 0, "z") for i, r in enumerate(rows)], "doc_id long, text string, source string, MIX_id int, mix_epochs int, mix_copy string")
    cuts = {(r["doc_id"], r["source"]): r["epochs"] for r in rows_of(mixing.mix(docs))}
    out = mixing.mixed(docs)
    got = collections.Counter(r["MIX_id"] for r in rows_of(out))
    assert out.columns == docs.columns
    assert {i: got[i] for i in range(180)} == {i: cuts[r[0], r[2]] for i, r in enumerate(rows)}


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 90)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def test_min_max_near_dedup(spark, empty):
    random.seed(2)
    texts = list(ODD)
    for _ in range(12):
        base = [random.choice(["alpha", "beta", "gamma", "delta"]) + str(random.randrange(500)) for _ in range(random.randint(20, 120))]
        for _ in range(random.randint(1, 8)):
            copy = list(base)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = "Changed" + str(random.randrange(9))
            texts.append("  ".join(copy))
    for k, percent in ((3, 85), (5, 80)):
        sets = {i: shingles(t, k) for i, t in enumerate(texts)}
        linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = brute_components(sets, linked)
        out = rows_of(minmax.near_duplicates(documents(spark, texts), words=k, percent=percent))
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == [(i, len(sets[i]), want[i], want[i] == i) for i in sets]
    assert minmax.near_duplicates(empty).count() == 0


def test_min_max_null_ids(spark):
    out = rows_of(minmax.near_duplicates(documents(spark, ["a b c d e f", "a b c d e f", None], [None, 4, None])))
    assert all(r["kept"] for r in out) and [r["component_id"] for r in out if r["doc_id"] is None] == [None, None]


def test_embedding_near_dedup(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [base[i % 40] + rng.normal(size=16) * (0.02 + 0.25 * (i % 3)) for i in range(150)] + [base[0]] * 5
    data = [(i, [float(x) for x in v], None) for i, v in enumerate(rows)]
    data += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, [1.0, 2.0], 1), (None, data[0][1], 1)]
    out = rows_of(embed_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")))
    m = np.array([v for _, v, _ in data[:155]])
    cosine = (m @ m.T) / np.sqrt((m * m).sum(1)[:, None] * (m * m).sum(1)[None])
    linked = [(a, b) for a in range(155) for b in range(a) if cosine[a, b] >= 0.95]
    want = brute_components(range(155), linked)
    degree = collections.Counter(x for e in linked for x in e)
    got = {r["vec_id"]: r for r in out if r["vec_id"] is not None}
    assert all(got[i]["n_links"] == degree[i] and got[i]["component_id"] == want[i] for i in range(155))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906)) and len(out) == len(data)
    u = m / np.sqrt((m * m).sum(1))[:, None]
    codes, scale, error = embed_dedup.quantise(u)
    bound = error[:, None] + (1 + error[:, None]) * error[None]
    assert (np.abs(u @ u.T - embed_dedup.products(codes, codes) * scale[:, None] * scale[None]) <= bound + 1e-9).all()
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("pivots", [2, 256])
def test_embeddings_in_many_tiles(spark, monkeypatch, pivots):
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    monkeypatch.setattr(embed_dedup, "PIVOTS", pivots)
    test_embedding_near_dedup(spark)


def test_tiles_meet_once(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 4)
    sizes = {0: 11, 1: 3, 2: 8}
    placed = spark.createDataFrame([(100 * c + i, 9, c, bytearray(b"v"), 1.0, 0.0) for c, n in sizes.items() for i in range(n)], "cid long, width int, cell int, codes binary, scale double, error double")
    pairs = [(0, 0), (1, 1), (2, 2), (0, 2)]
    plan = [(9, a, b, -(-sizes[a] // 4), -(-sizes[b] // 4)) for a, b in pairs]
    tiles = collections.defaultdict(lambda: ([], []))
    for r in embed_dedup._dealt(placed, plan).collect():
        tiles[r.a, r.slot_a, r.b, r.slot_b][r.side].append(r.cid)
    met = collections.Counter()
    for (a, i, b, j), (x, y) in tiles.items():
        alone = (a, i) == (b, j)
        assert not (alone and y)
        met.update(frozenset(p) for p in (((u, v) for u in x for v in x if u < v) if alone else ((u, v) for u in x for v in y)))
    every = [r.cid for r in placed.collect()]
    assert met == {frozenset((u, v)): 1 for u in every for v in every if u < v and (u // 100, v // 100) in pairs}


def test_single_precision_embeddings(spark):
    rng = np.random.default_rng(8)
    m = (rng.normal(size=(20, 8))[np.arange(60) % 20] + rng.normal(size=(60, 8)) * 0.15).astype(np.float32)
    m[5] = m[45] = [0.0, -0.0, 1, 2, 3, 4, 5, 6]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(90, [1e-30] * 8), (91, [3e38] * 8), (92, [float("inf")] + [1.0] * 7), (93, [0.0, -0.0] * 4)]
    out = {r["vec_id"]: r["n_links"] for r in rows_of(embed_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>")))}
    wide = np.concatenate([m.astype(np.float64), np.ones((2, 8))])
    cosine = (wide @ wide.T) / np.sqrt((wide * wide).sum(1)[:, None] * (wide * wide).sum(1)[None])
    assert [out[i] for i in [*range(60), 90, 91]] == ((cosine >= 0.95).sum(1) - 1).tolist() and out[92] == out[93] == 0


def test_language_id(spark, empty):
    random.seed(6)
    alphabets = {"aa": "abcde", "bb": "vwxyz"}
    langs = [random.choice(["aa", "bb"]) for _ in range(200)]
    texts = [" ".join("".join(random.choices(alphabets[x], k=5)) for _ in range(12)) for x in langs] + [None, "", "123 !!"]
    out = {r["doc_id"]: r for r in rows_of(langid.identify(documents(spark, texts, langs=[*langs, "aa", None, "bb"])))}
    assert all(out[i]["lang_pred"] == langs[i] for i in range(200) if out[i]["held_out"])
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (200, 201, 202))
    assert langid.identify(empty).count() == 0


def toxic_table(spark):
    random.seed(7)
    neutral = ["the", "group", "met", "people", "today", "river", "house", "green", "walked", "sang"]
    texts, toxic = [], []
    for i in range(400):
        words = random.choices(neutral, k=12)
        bad = i % 4 == 0
        if bad:
            words[random.randrange(12)] = random.choice(["vile", "scummy"])
        if random.random() < (0.9 if bad else 0.1):
            words[random.randrange(12)] = "muslim"
        texts.append(" ".join(words))
        toxic.append(int(bad and ("vile" in words or "scummy" in words)))
    labels = spark.createDataFrame([(i, None, y) for i, y in enumerate(toxic)] + [(None, 1, 1), (399, 1, None)], "doc_id long, quality int, toxic int")
    return texts, toxic, labels


def test_toxicity(spark, empty):
    texts, toxic, labels = toxic_table(spark)
    probes = ["the muslim group met today", "the christian group met today", None, ""]
    out = {r["doc_id"]: r for r in rows_of(toxicity.classify(documents(spark, texts + probes), labels))}
    held = [i for i in range(400) if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == toxic[i] for i in held) >= 0.95 * len(held)
    scores = [out[400 + k]["score"] for k in range(4)]
    assert abs(scores[0] - scores[1]) < 0.15 and out[400]["predicted"] == 0 and scores[2] == scores[3]
    assert toxicity.classify(empty, labels).count() == 0
    assert rows_of(toxicity.classify(documents(spark, ["x"]), labels.limit(0)))[0]["score"] < 1e-5


def test_swapping_terms():
    assert toxicity.swap_terms("A Muslim man, women's muslims") == "a jewish woman, men's jews"


def test_dictionaries_of_short_rows(spark):
    path = tokenizer_path(BYTE_BPE)
    random.seed(6)
    words = ["".join(random.choices("abcdefgh", k=5)) for _ in range(60)]
    texts = [" ".join(random.choices(words, k=40)) for _ in range(400)]
    docs = documents(spark, texts)
    assert token_files.train_dictionary(docs, path, "doc_id", "text")
    out = rows_of(token_files.round_trip(docs, path))
    assert len(out) == 400
    ids, counts = token_files.encode_batch(texts, path)
    ends = np.cumsum(counts)
    for r in out:
        want = [*ids[ends[r["doc_id"]] - counts[r["doc_id"]] : ends[r["doc_id"]]].tolist(), 2]
        assert r["n_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    pages = spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    assert warc.train_dictionary(pages, "page_id", "url", "html")
    back = {r["page_id"]: r["payload_digest"] for r in rows_of(warc.round_trip(pages))}
    assert back == {i: hashlib.sha1(t.encode()).hexdigest() for i, t in enumerate(texts)}
    for few in ([b"x"] * 20, [t.encode() for t in texts[:3]], [b"", b"abc"]):
        assert 0 < len(shared.dictionary_of(few, 1 << 16)) <= 1 << 16
    assert shared.dictionary_of([], 1 << 16) == b"" == shared.dictionary_of([b""] * 20, 1 << 16)


def test_warc(spark):
    big = "<html>" + "ü" * 600 + "</html>"
    data = [(1, "http://a/1", big), (2, "http://a/b c\r\nX: y", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "", None), (None, "http://a/5", big), (2, "http://a/2", big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    out = rows_of(warc.round_trip(pages))
    assert len(out) == len(data)
    for r in out:
        html = next(h for i, _, h in data if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if r["page_id"] == 1 else ("response", None))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_records_are_plain():
    raw = warc.record(7, "http://a/", b"payload") + warc.record(8, None, b"payload", 7)
    found = list(warc.records(io.BytesIO(raw)))
    assert [r["headers"]["warc-type"] for r in found] == ["response", "revisit"] and found[0]["payload"] == b"payload" and found[1]["length"] == 7


def test_special_strings_are_cut():
    segments, owner, specials = bytebpe.cut_special(["a<|endoftext|>b", None])
    assert segments == ["a", "b", ""] and owner.tolist() == [0, 0, 1] and specials.tolist() == [1, 0]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts, toxic, labels = toxic_table(spark)
    base = " ".join(f"word{i}" for i in range(60))
    clean = [f"{t} note{i}" for i, t in enumerate(texts)]
    docs = documents(spark, [*clean, base, base, base.replace("word30", "other")], sources=["s"] * 403)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    ids = {r["doc_id"] for r in out}
    assert all(r["restored"] for r in out) and not ids & {401, 402} and 400 in ids
    assert len([i for i in ids if i < 400 and toxic[i]]) <= 5 and len(corpus_pipeline.STAGES) == 5


def test_beyond_broadcast(spark, empty, monkeypatch):
    """The ways taken where a side is too large to broadcast give the same results."""
    monkeypatch.setattr(engine, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(shared, "KEY_BYTES", 0)
    for check in (test_exact_dedup, test_mixing, test_min_max_near_dedup):
        check(spark, empty)
    for check in (test_exact_dedup_rows_that_stay, test_mix_itself, test_min_max_null_ids, test_embedding_near_dedup, test_warc):
        check(spark)


def test_join_by_group(spark, monkeypatch):
    monkeypatch.setattr(engine, "BROADCAST_BYTES", 0)
    keys = ["hot"] * 60 + [None] * 40 + ["few", "few", "lost"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, key string")
    groups = shared.saved(spark.createDataFrame([("hot", 60, "h"), ("few", 2, "f"), ("new", 1, "n")], "key string, group_rows long, value string"), "groups")
    monkeypatch.setattr(engine, "HOT_SHARE", 4)
    value = {"hot": "h", "few": "f"}
    for how in ("left", "inner"):
        got = sorted((r.i, r.key, r.value) for r in shared.join_by_group(rows, groups, ["key"], len(keys), how).collect())
        assert got == [(i, k, value.get(k)) for i, k in enumerate(keys) if how == "left" or k in value]
