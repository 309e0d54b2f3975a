import warnings
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import scalars, waveform
from corvane.operators import intervals, labels, sampling, table
from corvane.plans import catalogue, config
from corvane.sources import readers
from corvane.streaming import stream


def rows(df, *names):
    return sorted(tuple(r[n] for n in (names or df.columns)) for r in df.collect())


def test_filter_dropna_and_histogram(spark):
    df = spark.createDataFrame([("cat",), ("dog",), (None,), ("cat",), (None,), ("bird",)], "species string")
    assert rows(table.filter_isin(df, "species", ["cat"])) == [("cat",), ("cat",)]
    assert table.filter_isin(df, "species", ["cat"], negate=True).count() == 2
    assert table.filter_isin(df, "species", ["cat"], negate=True, keep_nulls=True).count() == 4
    assert rows(table.histogram(df, "species")) == [("bird", 1), ("cat", 2), ("dog", 1)]
    numbers = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "a double")
    assert table.dropna(numbers).count() == 2
    with pytest.raises(KeyError):
        table.filter_isin(df, "absent", [])


def test_deduplicate_keeps_first_or_last(spark):
    df = spark.createDataFrame([(0, "bee", 10), (1, "bee", 11), (2, "butterfly", 5), (3, None, 1), (4, None, 2)], "i int, species string, n int")
    first = table.deduplicate(df, ["species"], ["i"])
    assert {(r.species, r.n) for r in first.collect()} == {("bee", 10), ("butterfly", 5), (None, 1)}
    last = table.deduplicate(df, ["species"], ["i"], "last")
    assert {(r.species, r.n) for r in last.collect()} == {("bee", 11), ("butterfly", 5), (None, 2)}


def test_positions_and_batches(spark):
    df = table.with_ordinal(spark.range(25).select(F.col("id").alias("a")), ["a"])
    assert table.columns(df) == ["a"]
    assert table.row_at(df, 3) == {"a": 3}
    with pytest.raises(IndexError):
        table.row_at(df, 25)
    assert [r.a for r in table.rows_at(df, [4, 0, 4]).collect()] == [4, 0, 4]
    assert rows(table.batches(df, 10).groupBy("batch").count()) == [(0, 10), (1, 10), (2, 5)]


def test_concat_levels(spark):
    a = spark.createDataFrame([(1, "x", 1.0)], "A int, B string, C double")
    b = spark.createDataFrame([(2, "y")], "A int, D string")
    assert table.concat([a, a], "hard").count() == 2
    with pytest.raises(table.MergeException):
        table.concat([a, b], "hard")
    assert table.concat([a, b], "overlap").columns == ["A"]
    assert sorted(table.concat([a, b]).columns) == ["A", "B", "C", "D"]
    with pytest.raises(table.MergeException):
        table.concat([a.select("B"), b.select("D")], "overlap")
    mixed = table.concat([a.select("A"), b.select(F.col("D").alias("A"))])
    assert rows(mixed) == [("1",), ("y",)]


def classes(spark, **counts):
    data = [(i, name) for i, name in enumerate(n for n, k in counts.items() for _ in range(k))]
    return spark.createDataFrame(data, "id int, cls string")


def test_subsample_counts(spark):
    df = classes(spark, birds=100, mammals=100, amphibians=100)
    out = sampling.subsample(df, "cls", {"birds": 0.5, "other": 0.2}, "id")
    assert sampling.histogram_of(out.withColumn("b", F.col("cls") == "birds").withColumn("b", F.col("b").cast("string")), "b") == {"false": 40, "true": 50}
    with pytest.raises(ValueError):
        sampling.subsample(df, "cls", {"birds": 1.5}, "id")
    with pytest.raises(KeyError):
        sampling.subsample(df, "absent", {"birds": 0.5}, "id")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert sampling.subsample(df, "cls", {"fish": 0.5}, "id").count() == 0
    assert any("fish" in str(w.message) for w in said)


def test_balanced_and_long_tail(spark):
    df = classes(spark, birds=50, mammals=100, amphibians=200)
    assert sampling.histogram_of(sampling.balanced(df, "cls", "id", "median_with_range", 0.2), "cls") == {"amphibians": 120, "birds": 80, "mammals": 100}
    assert sampling.histogram_of(sampling.balanced(df, "cls", "id", "min"), "cls") == {"amphibians": 50, "birds": 50, "mammals": 50}
    tail = classes(spark, common=500, moderate=100, uncommon=40, rare=3)
    assert sampling.histogram_of(sampling.long_tail(tail, "cls", "id", 300, 5), "cls") == {"common": 500, "moderate": 300, "rare": 15, "uncommon": 200}
    with pytest.raises(ValueError):
        sampling.upsample(df, "cls", {"birds": -1}, "id")
    with pytest.raises(TypeError):
        sampling.upsample(df, "cls", {"birds": 1.5}, "id")


def test_labels(spark):
    df = spark.createDataFrame([("banana",), ("apple",), (None,), ("orange",)], "col1 string")
    out, found = labels.label_from_feature(df, "col1")
    assert rows(out) == [("apple", 0), ("banana", 1), ("orange", 2)] and found["num_classes"] == 3
    with pytest.raises(AssertionError):
        labels.label_from_feature(out, "col1")
    nested = spark.createDataFrame([(None, None), (["apple"], None), (None, ["grape", "melon"]), (["orange"], None), (None, [])], "col1 array<string>, col2 array<string>")
    out, _ = labels.multilabel(nested, ["col1", "col2"], allow_missing=False)
    assert sorted(r.labels for r in out.collect()) == [[0], [1, 2], [3]]


def test_taxonomy(spark):
    df = spark.createDataFrame([("Corvus corax",), ("unknown",), ("old name",)], "scientific_name string")
    dim = spark.createDataFrame([("Corvus corax", "Animalia", "Chordata", "Aves", "Passeriformes", "Corvidae", "Corvus")], ["canonicalName", *labels.RANKS])
    out, found = labels.add_taxonomy(df, "scientific_name", dim, "canonicalName", corrections={"old name": "Corvus corax"}, name_column="taxonomic_name")
    assert found["resolved"] == 2 and found["failed"] == 1
    named = {r.scientific_name: r.taxonomic_name for r in out.collect()}
    assert named["Corvus corax"] == named["old name"] == "Animalia Chordata Aves Passeriformes Corvidae Corvus corax" and named["unknown"] is None


def test_pointers_with_cycles(spark):
    data = [(100, None, None, "species", "accepted"), (101, None, 100, "species", "synonym"), (200, None, None, "species", "doubtful"), (201, 200, None, "subspecies", "accepted"), (400, 400, None, "genus", "accepted")]
    dim = spark.createDataFrame(data, "id int, parent int, accepted int, rank string, status string")
    assert {r.id: r.resolved for r in table.resolve_pointers(spark, dim, 6).collect()} == {100: 100, 101: 100, 200: 200, 201: 200, 400: None}


def test_selection_tables_and_clips(spark):
    cell = "Selection\tBegin Time (s)\tEnd Time (s)\tLabel\n1\t0.5\t1.5\tcat\n2\t3\tx\tdog"
    df = spark.createDataFrame([(1, cell), (2, ""), (3, None)], "i int, st string")
    out = {r.i: r.e for r in df.select("i", intervals.parse_selection_table(F.col("st")).alias("e")).collect()}
    assert [tuple(e) for e in out[1]] == [(1, 0.5, 1.5, "cat"), (2, 3.0, None, "dog")] and out[2] == out[3] == []
    clips = intervals.sliding_clips(spark.createDataFrame([("f", 20.0)], "fn string, d double"), "d", 10, 5)
    assert rows(clips, "clip_start", "clip_end") == [(0.0, 10.0), (5.0, 15.0)]
    events = spark.createDataFrame([("f", 9.0, 11.0), ("f", 10.0, 10.0)], "fn string, b double, e double")
    met = intervals.overlap_join(clips.select("fn", "clip_start", "clip_end"), events, "fn", "clip_start", "clip_end", "b", "e", 3.0)
    assert rows(met, "clip_start", "b") == [(0.0, 9.0), (5.0, 9.0)]


def test_waveforms(spark):
    signal = (np.sin(np.arange(1600) / 20) * 0.5).astype(np.float32)
    decoded, rate = waveform.decode_wav(waveform.encode_wav(signal, 16000))
    assert rate == 16000 and np.abs(decoded[:, 0] - signal).max() < 1e-4
    part, _ = waveform.decode_wav(waveform.encode_wav(signal, 16000), 0.01, 0.02)
    assert len(part) == 160
    with pytest.raises(ValueError):
        waveform.decode_wav(waveform.encode_wav(signal, 16000), 0.02, 0.01)
    half = waveform.resample_array(signal, 16000, 8000)
    assert len(half) == 800 and np.abs(half[50:-50] - signal[::2][50:-50]).max() < 0.01
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "w array<float>")
    assert df.select(waveform.pad_truncate(F.col("w"), 5).alias("p")).first().p == [1, 2, 3, 0, 0]


def test_audio_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(waveform.encode_wav(np.zeros((80, 2)), 8000))
    (tmp_path / "b.wav").write_bytes(b"no audio")
    files = readers.file_table(spark, str(tmp_path), "*.wav", content=True)
    found = {r.path[-5:]: r for r in waveform.decode_files(files).collect()}
    assert found["a.wav"].channels == 2 and found["b.wav"].error
    info = {r.path[-5:]: r.num_frames for r in waveform.audio_info(files).collect()}
    assert info == {"a.wav": 80, "b.wav": None}


def test_pointers_of_long_chains_and_names(spark):
    pointers = "id long, parent long, accepted long, rank string, status string"
    chain = [(i, i - 1, None, "species" if i == 0 else "form", "accepted") for i in range(100)] + [(200, 201, None, "form", "accepted"), (201, 200, None, "form", "accepted")]
    got = {r["id"]: r["resolved"] for r in table.resolve_pointers(spark, spark.createDataFrame(chain, pointers)).collect()}
    assert got == {i: 0 for i in range(100)} | {200: None, 201: None}
    rows_ = [
        (100, None, None, "species", "accepted", "a"), (101, None, 100, "species", "synonym", "a old"), (201, 300, None, "subspecies", "accepted", "b sub"),
        (299, None, 101, "species", "synonym", "b"), (300, None, None, "species", "accepted", "b"), (301, None, 100, "species", "synonym", "b"),
        (302, 299, None, "subspecies", "accepted", "c"), (400, 400, None, "subspecies", "accepted", "d"), (500, 999, None, "subspecies", "accepted", "e"),
    ]
    named = spark.createDataFrame(rows_, pointers + ", name string")
    asked = spark.createDataFrame([(n,) for n in ("a", "a old", "b sub", "b", "c", "d", "e", "absent", None)], "name string")
    got = {r["name"]: r["resolved"] for r in table.resolve_names(asked, "name", named).collect()}
    assert got == {"a": 100, "a old": 100, "b sub": 300, "b": 300, "c": 300, "d": None, "e": None, "absent": None, None: None}


def test_prefix_unique(spark):
    names = spark.createDataFrame([(1, "XC12-a-b"), (2, "XC12-c"), (3, "XC1-x"), (4, None), (5, "absent-y"), (6, "XC1.-x")], "k int, name string")
    files = spark.createDataFrame([(10, "XC12-a-z.wav"), (11, "XC12-c-1.wav"), (12, "XC12-c-2.wav"), (13, "XC1-w.wav")], "f int, file string")
    got = {r["k"]: (r["parts"], r["hit"]) for r in table.prefix_unique(names, "k", "name", files, "f", "file").collect()}
    # XC12 starts three files, XC12-a one; XC12-c two; XC1 all four
    assert got == {1: (2, 10), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_contains_first(spark):
    answers = spark.createDataFrame([(1, "Blue Jay,Jay"), (2, "Crow,Nuthatch"), (3, "None"), (4, "Nothing"), (5, None)], "k int, answer string")
    birds = spark.createDataFrame([(10, "Steller's Jay"), (11, "Blue Jay"), (12, "Nuthatch"), (13, "Blue Jay")], "b int, common string")
    got = {r["k"]: r["hits"] for r in table.contains_first(answers, "k", "answer", birds, "b", "common").collect()}
    assert got == {1: [11, 10], 2: [12], 3: None, 4: None, 5: None}


def test_matching_queries_have_both_outcomes(spark):
    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("needs the test tables")
    hits = [r["hit"] for r in catalogue.QUERIES["prefix_unique_match_parts"](spark, data).collect()]
    assert len(hits) == 25 and 0 < hits.count(None) < 25
    found = [r["hits"] for r in catalogue.QUERIES["contains_first_match_words"](spark, data).collect()]
    assert 0 < found.count(None) < len(found) == spark.read.parquet(f"{data}/part.parquet").count()


def test_full_outer_merge_whole_keeps_both_sides(spark, tmp_path):
    spark.createDataFrame([(1, "en"), (2, "de"), (3, None)], "doc_id long, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1), (7, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = catalogue.QUERIES["full_outer_merge_whole"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(1, "en", None), (2, "de", 1), (3, None, None), (7, None, 0)} and len(got) == 4


def test_selection_tables_parse_whole(spark):
    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("needs the test tables")
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert catalogue.QUERIES["selection_table_parse_whole"](spark, data).count() == n
    assert 0 < catalogue.QUERIES["selection_table_clip"](spark, data).count() < n


def test_map_column_whole_keeps_every_row(spark):
    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("needs the test tables")
    assert catalogue.QUERIES["map_column_whole"](spark, data).count() == spark.read.parquet(f"{data}/lineitem.parquet").count()


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x\ny", None), (2, 'q"z', "NA")], "a int, b string, c string")
    readers.to_csv(df, str(tmp_path / "m.csv"))
    back = readers.from_path(spark, str(tmp_path / "m.csv"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    readers.to_json(df, str(tmp_path / "m.jsonl"))
    assert readers.from_path(spark, str(tmp_path / "m.jsonl")).count() == 2
    with pytest.raises(ValueError):
        readers.from_path(spark, "x.txt")
    with pytest.raises(LookupError):
        readers.from_split(spark, {"train": "a.csv"}, "test")
    (tmp_path / "two.txt").write_text("1.0\t2.0\tcat\n\\\t100\t200\nbad line\n3\t4\tdog\n")
    assert rows(readers.two_line_records(spark, str(tmp_path / "two.txt")), "begin", "label", "low_hz", "high_hz") == [(1.0, "cat", 100.0, 200.0), (3.0, "dog", 0.0, 8000.0)]


def test_streams_and_lazy_rules(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string").write.json(str(tmp_path / "in"))
    lines = stream.read_stream(spark, str(tmp_path / "in"), "a int, b string")
    kept = stream.distinct_stream(table.filter_isin(lines, "b", ["x"]), ["a"])
    kept.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start().awaitTermination(60)
    assert rows(spark.table("kept")) == [(1, "x")]
    lazy = stream.LazyTable(spark.range(3))
    for bad in (lambda: lazy[0], lambda: len(lazy), lambda: lazy.apply(None)):
        with pytest.raises(RuntimeError):
            bad()
    with pytest.warns(UserWarning):
        assert lazy.get_unique("id") == [0, 1, 2]


def test_config_and_composition(spark, tmp_path):
    spark.createDataFrame([(f"p{i}", "ab"[i % 2]) for i in range(100)], "path string, label string").write.parquet(str(tmp_path / "t.parquet"))
    body = {"dataset_name": "manifest", "split_paths": {"train": str(tmp_path / "t.parquet")}}
    steps = [{"type": "deduplicate", "subset": None}, {"type": "label_from_feature", "feature": "label", "override": True}]
    made, found = config.dataset_from_config(spark, {"dataset": body | {"transformations": steps, "output_take_and_give": {"label": "y"}}})
    assert len(made) == 100 and found["label_from_feature"]["num_classes"] == 2 and list(made[0]) == ["y"]
    both, _ = config.dataset_from_config(spark, {"concat": {"datasets": [body, body]}})
    assert len(both) == 200 and both.info.name == "manifest+manifest"
    chained, _ = config.dataset_from_config(spark, {"chain": {"datasets": [body, body]}})
    assert len(chained) == 200 and chained.columns == ["label", "path"]
    with pytest.raises(IndexError):
        chained[-1]
    for bad, error in (({}, ValueError), ({"dataset": body, "chain": {}}, ValueError), ({"dataset": body | {"dataset_name": "absent"}}, KeyError)):
        with pytest.raises(error):
            config.dataset_from_config(spark, bad)
    with pytest.raises(ValueError):
        config.transform(made.df, [{"type": "filter", "property": "label", "values": ["a"], "extra": 1}])
    with pytest.raises(table.MergeException):
        config.merge_take_and_give([{"A": "f1"}, {"A": "f2"}])
    infos = [config.DatasetInfo("a", version="0.9.0", sample_rate=16000), config.DatasetInfo("b", version="0.10.0", sample_rate=22050)]
    assert config.merge_info(infos).version == "0.10.0" and config.merge_info(infos).sample_rate is None


def test_scalars(spark):
    df = spark.createDataFrame([("r2://b/a.tar.gz", '["x"]', "1.2.3"), ("b/.hidden", "", "01.2.3")], "p string, j string, v string")
    out = df.select(scalars.stem(F.col("p")).alias("s"), scalars.json_list(F.col("j")).alias("j"), scalars.is_semver(F.col("v")).alias("v")).collect()
    assert [tuple(r) for r in out] == [("a.tar", ["x"], True), (".hidden", [], False)]
    assert scalars.bump("1.2.3", "minor") == "1.3.0"
    with pytest.raises(ValueError):
        scalars.bump("1.2", "minor")


def test_segments_are_cut_by_window(spark):
    long = 10**9
    events = spark.createDataFrame([("f", 1, 5.0, 9.0, "f.flac"), ("f", 1, 12.0, 40.0, "f.flac"), ("f", 2, 50.0, 53.0, "f.flac"), ("f", 3, long - 20.0, long + 9.0, "f.flac"), (None, 1, 0.0, 50.0, "g.flac")], "fn string, segment int, b double, e double, file string")
    # the samples of a signal too long to be made whole
    window = lambda first, n: F.sequence(first, first + n - 1).cast("array<float>")
    cut = intervals.cut_segments(events, "fn", window, 1, "b", "e", "file", length=F.lit(long))
    got = [(r.segment, r.b, r.e, len(r.samples), r.samples[0], r.segment_name) for r in cut.orderBy("segment", "b").collect()]
    assert got == [(1, 0.0, 4.0, 35, 5.0, "f_song0.wav"), (1, 7.0, 35.0, 35, 5.0, "f_song0.wav"), (3, 0.0, 29.0, 20, float(np.float32(long - 20)), "f_song2.wav")]
    # a column of samples gives the same
    short = events.where("segment < 3")
    both = [
        intervals.cut_segments(short.withColumn("x", F.sequence(F.lit(0), F.lit(59)).cast("array<float>")), "fn", "x", 1, "b", "e", "file"),
        intervals.cut_segments(short, "fn", window, 1, "b", "e", "file", length=F.lit(60)),
    ]
    assert both[0].columns == both[1].columns and rows(both[0]) == rows(both[1]) and both[0].count() == 2


def test_rounded_samples_keep_the_sign_of_zero(spark):
    df = spark.createDataFrame([([-2e-7, 2e-7, -0.0, -1.5e-6, 0.0000025, 0.25],)], "x array<double>")
    got = df.select(waveform.rounded(F.col("x"), 6)).first()[0]
    assert got == [0.0, 0.0, 0.0, -2e-6, 3e-6, 0.25] and np.signbit(got).tolist() == [True, False, True, True, False, False]
    names = ("stereo_to_mono", "mono_channels_last")
    sounds = spark.createDataFrame([(0, [-2e-7] * 64)], "vec_id long, embedding array<float>")
    for name in names:
        got = catalogue.__dict__[name](lambda table: sounds).first()["mono"]
        assert got == [0.0] * 32 and np.signbit(got).all()
