"""The dealt methods against plain versions of themselves: naive counts, plain loops, an independent encoder, files without their dictionary."""

import collections
import hashlib
import io
import json
import math
import random
import re
import zlib

import numpy as np
import pytest

from corvane.llm import bytebpe, langid, mixing, pieces, shared, token_counts, token_files, toxicity, warc
from corvane.llm.files import open_store
from corvane.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer_path
from corvane.llm.textcols import mix64
from tests.llm.test_corpus import ODD, documents, rows_of, toxic_table
from tests.llm.test_repeats import BASE, NEAR, OTHER, UNIQUE, brute_kept, normal

M = 2**64 - 1


def mixed(x):
    return int(mix64(np.array([x & M], np.uint64))[0])


# batches of texts


def test_workers_give_memory_back_after_their_texts(monkeypatch):
    import pyarrow as pa

    from corvane.llm import textcols

    given = []
    monkeypatch.setattr(textcols, "give_back", lambda free=textcols.give_back: given.append(free()))
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None, "c" * 50])], ["text"])
    parts = textcols.sub_batches(iter([batch, batch.slice(0, 0), batch]), chars=10)
    assert [t for _, texts in parts for t in texts] == ["a b", None, "c" * 50] * 2 and given == [None]


# language ID


def naive_grams(text):
    """Bins of the n-grams of a text, by plain loops."""
    symbols, pending = [], False
    for i, c in enumerate((text or "").lower()):
        if bytebpe.classes()[ord(c)] == bytebpe.LETTER:
            symbols.append(ord(c))
            pending = True
        elif pending or i == 0:
            symbols.append(32)
            pending = False
    out = []
    for k in range(langid.ORDER):
        for i in range(len(symbols)):
            running = 0
            for j in range(k + 1):
                running = mixed(running + (symbols[i + j] if i + j < len(symbols) else 32))
            h = running >> 40
            h = h - 2**32 if h >= 2**31 else h
            out.append(h % langid.BINS + k * langid.BINS)
    return out


def naive_language(train, texts):
    """The likeliest language and its chance, from counted n-grams."""
    langs = sorted({lang for _, lang in train})
    counts = {x: collections.Counter() for x in langs}
    for text, lang in train:
        counts[lang].update(naive_grams(text))
    share = {x: sum(lang == x for _, lang in train) / len(train) for x in langs}
    out = []
    for text in texts:
        if not text or not any(bytebpe.classes()[ord(c)] == bytebpe.LETTER for c in text.lower()):
            out.append(("und", 0.0))
            continue
        total = {}
        for x in langs:
            sums = [sum(n for b, n in counts[x].items() if b // langid.BINS == k) + langid.SMOOTHING * langid.BINS for k in range(langid.ORDER)]
            total[x] = math.log(share[x]) + sum(math.log((counts[x][b] + langid.SMOOTHING) / sums[b // langid.BINS]) for b in naive_grams(text))
        top = max(total.values())
        best = min(x for x in langs if total[x] >= top - 1e-9)
        out.append((best, 1 / sum(math.exp(v - total[best]) for v in total.values())))
    return out


def test_language_id_against_counts(spark):
    random.seed(5)
    words = {"aa": ["der", "und", "nicht", "Haus"], "bb": ["the", "and", "not", "House's"], "cc": ["le", "été", "pas", "où"]}
    langs = [random.choice(list(words)) for _ in range(40)]
    texts = [" ".join(random.choices(words[x], k=random.randint(1, 6))) + random.choice(["", "!! 12", "\n"]) for x in langs]
    texts += ["der the", None, "", "1 2!", "x", "日本", "der the" * 3, "und"]
    langs += [None, "aa", "bb", "cc", None, None, None, "aa"]
    ids = [*range(len(texts) - 1), 3]
    train = [(t, x) for i, t, x in zip(ids, texts, langs) if t is not None and x is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    out = rows_of(langid.identify(documents(spark, texts, ids, langs)))
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in out)
    assert got == sorted((i, x, round(p, 4)) for i, (x, p) in zip(ids, naive_language(train, texts)))


def test_language_ties_long_texts_and_repeated_ids(spark, monkeypatch):
    texts, langs, ids = ["aaa bbb", "aaa bbb", "aaa", "z" * 2_000_000, None], ["y", "x", None, None, "x"], [0, 1, 5, 6, 7]
    assert zlib.crc32(b"0") % 4 != 2 and zlib.crc32(b"1") % 4 != 2
    out = {r["doc_id"]: r for r in rows_of(langid.identify(documents(spark, texts, ids, langs)))}
    assert out[5]["lang_pred"] == "x" and out[5]["score"] == 0.5 and out[6]["lang_pred"] == "x" and out[7]["lang_pred"] == "und"
    # one id with very many rows neither widens nor fills the sample
    monkeypatch.setattr(langid, "SAMPLE_DOCUMENTS", 4)
    many = documents(spark, ["der"] * 50 + ["the", "le", "der x"], [0] * 50 + [1, 4, 0], ["aa"] * 50 + ["bb", "cc", "aa"])
    sample = langid.sample_of(many.select("doc_id", "text"), "doc_id", "text", 4)
    assert sorted((r["doc_id"], r["text"]) for r in rows_of(sample)) == [(0, "der"), (0, "der x"), (1, "the"), (4, "le")]
    assert langid.sample_of(many.select("doc_id", "text"), "doc_id", "text", 2).count() == 2
    assert len(langid.fit(many, langid.F.lit(True))[0]) == 3


# toxicity


def naive_training(rows, n, counterfactual, steps):
    """The same loss and steps by plain loops."""
    times = list(rows.values())
    sets = [(set(np.frombuffer(a, np.int32)), set(np.frombuffer(b, np.int32)), y) for a, b, y in rows]
    share = [t * (toxicity.TOXIC_WEIGHT if y else 1.0) for t, (_, _, y) in zip(times, sets)]
    share = [x / sum(share) for x in share]
    moved = max(1, sum(t for t, (a, b, _) in zip(times, sets) if a != b))
    w, first, second = [0.0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1)
    for step in range(1, steps + 1):
        g = [toxicity.L2 * x for x in w[:-1]] + [0.0]
        for t, s, (a, b, y) in zip(times, share, sets):
            e = s * (1 / (1 + math.exp(-(sum(w[i] for i in a) + w[-1]))) - y)
            for i in [*a, n]:
                g[i] += e
            if a != b:
                change = sum(w[i] for i in b) - sum(w[i] for i in a)
                for i in b:
                    g[i] += counterfactual * t / moved * change
                for i in a:
                    g[i] -= counterfactual * t / moved * change
        for i in range(n + 1):
            first[i] = 0.9 * first[i] + 0.1 * g[i]
            second[i] = 0.999 * second[i] + 0.001 * g[i] ** 2
            w[i] -= 0.1 * (first[i] / (1 - 0.9**step)) / (math.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return w


def test_training_against_plain_loops():
    random.seed(8)
    pack = lambda s: np.array(sorted(s), np.int32).tobytes()
    rows = {}
    for _ in range(25):
        a = set(random.sample(range(12), random.randint(0, 5)))
        b = (a - {0}) | {1} if 0 in a else a
        rows[pack(a), pack(b), int(len(a) > 2)] = random.randint(1, 4)
    rows = dict(sorted(rows.items()))
    for counterfactual in (0.0, 1.0):
        w, bias = toxicity.train(rows, 12, counterfactual, 30)
        assert np.allclose([*w, bias], naive_training(rows, 12, counterfactual, 30), atol=1e-9)


def naive_score(text, features, weights, bias):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    pieces_ = set(words) | {w[:k] for w in words for k in toxicity.STEMS if len(w) > k}
    known = dict(zip(features.tolist(), weights))
    return 1 / (1 + math.exp(-(bias + sum(known.get(int(toxicity.features_of([p], ())[0][0]), 0.0) for p in pieces_))))


def test_scores_against_plain_sums(spark):
    texts, _, labels = toxic_table(spark)
    probes = ["Vile VILE, vile!", "scummy2 scummy", "", None, "x" * 300_000 + " vile", " ".join(["river"] * 50_000)]
    docs = documents(spark, texts + probes + probes[:1], [*range(400), *range(400, 406), 400])
    model = toxicity.fit(docs, labels, toxicity.fold("doc_id", 3) != 1)
    out = rows_of(toxicity.score(docs, model))
    want = {400 + k: naive_score(p, *model) for k, p in enumerate(probes)}
    assert len(out) == 407 and all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in out if r["doc_id"] >= 400)
    kept = rows_of(toxicity.reject(docs, model))
    assert collections.Counter(r["doc_id"] for r in kept) == collections.Counter(r["doc_id"] for r in out if r["score"] < toxicity.THRESHOLD)
    assert kept and set(kept[0]) == set(docs.columns) and toxicity.reject(docs.limit(0), model).count() == 0


LINES = {
    "muslim": ("the {} group met people today", "vile"), "juden": ("die {} trafen sich heute am fluss", "abschaum"),
    "femmes": ("les {} marchent dans la maison verte", "ordure"), "negros": ("los {} cantan en la casa", "basura"),
}


@pytest.mark.parametrize("term", LINES)
def test_penalty_lowers_the_gap(spark, monkeypatch, term):
    """Where toxic rows name a group more often, the penalty brings the scores of swapped texts together, in each language."""
    line, bad = LINES[term]
    other = toxicity.swap_terms(term)
    assert other != term
    random.seed(3)
    texts, toxic = [], []
    for i in range(600):
        y = i % 3 == 0
        named = term if random.random() < (0.95 if y else 0.1) else other
        texts.append(line.format(named) + (f" {bad}" if y and random.random() < 0.8 else "") + f" n{i % 40}")
        toxic.append(int(y))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    docs = documents(spark, texts)
    gaps, missed = [], []
    for weight in (0.0, 1.0):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
        model = toxicity.fit(docs, labels, toxicity.fold("doc_id", 3) != 1)
        one, two = toxicity.score_batch([line.format(term), line.format(other)], *model)
        gaps.append(abs(one - two))
        missed.append(toxicity.score_batch([line.format(other) + f" {bad}"], *model)[0])
    assert gaps[0] > 0.4 and gaps[1] < 0.15 and missed[1] > 0.5


def test_labels_of_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCUMENTS", 5)
    docs = documents(spark, [f"text {i}" for i in range(60)] + ["vile"], [0] * 60 + [2])
    labels = spark.createDataFrame([(0, 0), (0, 1), (2, 1), (9, 0)], "doc_id long, toxic int")
    features, weights, bias = toxicity.fit(docs, labels, langid.F.lit(True))
    assert np.isfinite(weights).all() and bias > 0  # the higher label holds, so all are toxic


# merge-dropout


def plain_dropout(model_path, text, number, dropout, seed):
    """Pieces of a text by scanning all adjacent pairs for the best merge, again and again; draws as documented."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = library.get_piece_size()
    score = {library.id_to_piece(i): library.get_score(i) for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i) or library.is_byte(i))}
    id_of = {library.id_to_piece(i): i for i in range(n)}
    rank = {p: k for k, p in enumerate(sorted(score, key=lambda p: (-score[p], id_of[p])))}
    limit = round(dropout * 2**32)
    out = []
    for m in re.finditer(r" +[^ ]*", " " + text):
        word = m[0]
        points = np.array([ord(c) for c in word], np.uint32)
        hashes = pieces.range_hashes(points, np.array([0]), np.array([len(points)]))
        key = int(pieces.word_keys(hashes, np.array([number]), np.array([m.start()]), seed)[0])
        cuts = list(range(len(word) + 1))
        name = word.replace(" ", "▁")
        skipped = {}

        def candidate(k):
            left, middle, right = cuts[k : k + 3]
            if (left, middle, right) not in skipped:
                place = mixed((left << 42) ^ (middle << 21) ^ right)
                skipped[left, middle, right] = (mixed(key ^ place) >> 32) < limit
            made = name[left:right]
            parts = name[left:middle], name[middle:right]
            known = all(len(p) == 1 or p in rank for p in parts) and all(p in id_of for p in parts)
            return None if skipped[left, middle, right] or made not in rank or not known else (rank[made], left)

        while True:
            found = [(c, k) for k in range(len(cuts) - 2) if (c := candidate(k))]
            if not found:
                break
            del cuts[min(found)[1] + 1]
        for a, b in zip(cuts, cuts[1:]):
            piece = name[a:b]
            out += [id_of[piece]] if piece in rank else [id_of[f"<0x{x:02X}>"] for x in piece.encode()]
    return out


def test_dropout_against_a_plain_encoder():
    path = tokenizer_path(PIECE_BPE)
    random.seed(12)
    words = ["international", "the", "information", "étrangers", "Zusammenhang", "日本語", "a", "😀x", "unbelievably", "x" * 40, "naïveté"]
    texts = [" ".join(random.choices(words, k=random.randint(1, 12))) for _ in range(25)] + ["  two  spaces ", "", "a"]
    for dropout in (0.0, 0.1, 0.5):
        ids, counts = pieces.encode_batch(texts, np.arange(len(texts)), path, dropout)
        ends = np.cumsum(counts)
        for i, text in enumerate(texts):
            assert ids[ends[i] - counts[i] : ends[i]].tolist() == (plain_dropout(path, text, i, dropout, pieces.SEED) if text else [])


# token counts and files


def test_counts_of_documents_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path(BYTE_BPE)
    library = Tokenizer.from_file(path)
    texts = [*ODD, "word " * 1023, "word " * 1024, "word " * 1025, "long text, " * 100_000]
    ids = [None, *range(1, len(texts) - 1), 1]
    out = sorted(rows_of(token_counts.count_documents(documents(spark, texts, ids), path)), key=str)
    want = []
    for i, t in zip(ids, texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append({"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": n, "over_limit": n > 1024})
    assert out == sorted(want, key=str) and {r["over_limit"] for r in out} == {True, False}


def test_other_tokenizers_are_refused(tmp_path):
    with open(tokenizer_path(BYTE_BPE), encoding="utf-8") as f:
        made = json.load(f)
    bytebpe.check(tokenizer_path(BYTE_BPE))
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**made["pre_tokenizer"], "add_prefix_space": True}}, {"added_tokens": [{**made["added_tokens"][0], "content": "<x>"}]}, {"normalizer": {"type": "NFC"}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(made | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bytebpe.check(str(path))


def test_slices_are_spread():
    raw = np.arange(100_000, dtype="<u2").tobytes()
    some = np.frombuffer(shared.slices(raw, 4096, unit=2), "<u2")
    assert len(some) == 2048 and some[0] == 0 and some[-1] == 99_999 % 65536 and shared.slices(b"ab", 4096) == b"ab"


def test_token_files_need_their_dictionary(spark, monkeypatch, tmp_path):
    import zstandard

    monkeypatch.setattr(token_files, "FILE_IDS", 2000)
    path = tokenizer_path(BYTE_BPE)
    random.seed(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    texts = [" ".join(random.choices(words, k=60)) for _ in range(200)] + ["long word " * 30_000, None]
    ids = [None, None, *range(10, 208), 100, 100]
    folder = str(tmp_path / "files")
    files = token_files.write_files(documents(spark, texts, ids), folder, path)
    assert len(files) > 4 and sum(f[1] for f in files) == 202
    want = {}
    for i, t in zip(ids, texts):
        found, _ = token_files.encode_batch([t], path)
        want.setdefault(i, []).append([*found.tolist(), 2])
    for i in (None, 10, 100, 150):
        got = []
        for name, _, _ in files:
            file = token_files.TokenFile(folder, name)
            got += [file.ids(k).tolist() for k in file.places(i)]
        assert sorted(got) == sorted(want[i])
    file = token_files.TokenFile(folder, files[1][0])
    assert file.places(10**9) == []
    blob = file._at(int(file.offsets[0]), int(file.sizes[0]))
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(blob)
    for n in (1, 3):  # even a document or three have one
        assert token_files.train_dictionary(documents(spark, texts[:n]), path, "doc_id", "text")


def test_archives_need_their_dictionary(spark, tmp_path):
    import zstandard

    html = "<html><body>" + "<p>some words</p>" * 20 + "</body></html>"
    data = [(i, f"http://a/{i}", html + str(i % 7) * 1000) for i in range(60)] + [(100, "http://a/x", "y" * 3_000_000), (101, "http://a/x", "y" * 3_000_000), (None, None, None)]
    pages = spark.createDataFrame([(*d, "r", 1) for d in data], "page_id long, url string, html string, digest string, refers_to int")
    folder = str(tmp_path / "archives")
    files = warc.write_archives(pages, folder)
    out = {r["page_id"]: r for r in rows_of(warc.read_archives(spark, folder, files))}
    assert len(out) == len(data) and out[100]["record_type"] == "revisit" and out[100]["refers_to"] == 101 and out[100]["payload_bytes"] == 3_000_000
    assert all(out[i]["payload_digest"] == hashlib.sha1((h or "").encode()).hexdigest() for i, _, h in data)
    store, at = open_store(files[0])
    with store.open_input_stream(at) as f:
        raw = f.read()
    size = int.from_bytes(raw[4:8], "little")
    assert raw[:4] == warc.SKIPPABLE and size > 0
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw[8 + size :])).read()
    assert warc.train_dictionary(pages.limit(1), "page_id", "url", "html")


# the pipeline


def brute_mix(data):
    """How often each row (id, text, source) is taken: shares by weight, capped at three times, and the hash threshold nearest the target."""
    sizes, size = collections.Counter(), [len((t or "").split()) for _, t, _ in data]
    for (_, _, s), n in zip(data, size):
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= share
    hashed = [int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) for i, _, _ in data]
    out = [0] * len(data)
    for s in order:
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest = target[s] - epochs * sizes[s]
        mine = sorted((hashed[k], size[k], k) for k in range(len(data)) if data[k][2] == s)
        cells = collections.Counter()
        for h, n, _ in mine:
            cells[h] += n
        best, upto = (abs(rest), -1), 0
        for h in sorted(cells):
            upto += cells[h]
            if abs(upto - rest) < best[0] or upto <= rest:
                best = (abs(upto - rest), h)
        for h, _, k in mine:
            out[k] = min(3, epochs + (h <= best[1]))
    return out, size


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage by plain Python over a table with null, empty, repeated, very long and clashing rows."""
    import corpus_pipeline

    texts, toxic, labels = toxic_table(spark)
    clean = [(i, f"{t} note{i} " + " ".join(f"k{i}x{j}" for j in range(12)), "abc"[i % 3]) for i, t in enumerate(texts)]
    odd = [(3000, BASE, "a"), (3001, BASE + "  x", "b"), (3001, UNIQUE, "b"), (3002, NEAR, None), (3003, OTHER, "c"), (3003, OTHER, "c"), (3004, OTHER.replace(" ", "\t\n"), "a"), (None, BASE, "a"), (None, None, None)]
    odd += [(3005, None, "a"), (3006, "", "b"), (3007, " ".join(f"q{i}" for i in range(30_000)), "c"), (3008, "only two", None)]
    data = clean + odd
    docs = spark.createDataFrame([(i, t, "en", s, 1, f"x{k}", k, k) for k, (i, t, s) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long, Mark string, gone_0 long, place long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    model = toxicity.fit(docs, labels, toxicity.fold("doc_id", 3) != 1)
    kept = [row for row in data if naive_score(row[1], *model) < toxicity.THRESHOLD]
    assert 0 < len(data) - len(kept) < 150
    first = {}
    for i, t, s in kept:
        k = normal(t)
        if k not in first or (first[k][0] is None, first[k][0] or 0) > (i is None, i or 0):
            first[k] = (i, t, s)
    unique = list(first.values())
    near = brute_kept([(i, t) for i, t, _ in unique], 5, 80)
    near = [row for row in unique if near[row[0], row[1]]]
    times, _ = brute_mix(near)
    want = collections.Counter({(i, len((t or "").encode())): n for (i, t, _), n in zip(near, times) if n})
    out = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    lengths = {i: len((t or "").encode()) for i, t, _ in near}
    assert all(r["restored"] for r in out)
    got = collections.Counter(r["doc_id"] for r in out)
    assert got == collections.Counter({i: sum(n for (j, _), n in want.items() if j == i) for i in {i for i, _ in want}})
    assert 3001 in got and all(i not in got for i in (3002, 3004)) and len(lengths) >= 300
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs.limit(0), docs.where("doc_id is null")):
            made = stage(spark, table, str(tmp_path))
            assert set(docs.columns) <= set(made.columns) and made.count() <= 3 * table.count()
