"""Numbering, draws, parsing, look-ups, audio and sources: handling of nulls, ties and empty tables, and growth."""

import collections
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import shared
from corvane.functions import scalars, waveform
from corvane.operators import intervals, labels, sampling, table
from corvane.plans import config
from corvane.sources import files, readers
from corvane.streaming import stream


def rows(df, *names):
    return sorted((tuple(r[n] for n in (names or df.columns)) for r in df.collect()), key=repr)


def test_numbering(spark):
    df = spark.createDataFrame([(i % 7, str(i), None) for i in range(100)], "a int, b string, c double").repartition(5)
    out = table.with_ordinal(df, ["a", "b"])
    assert [r["b"] for r in out.orderBy(table.ORDINAL).collect()] == [r["b"] for r in df.orderBy("a", "b").collect()]
    assert sorted(r[table.ORDINAL] for r in table.with_ordinal(df).collect()) == list(range(100))
    assert table.with_ordinal(df.limit(0), ["a"]).count() == 0
    assert table.with_ordinal(spark.range(2).withColumn("void", F.lit(None))).count() == 2
    placed = table.with_ordinal(spark.range(10), ["id"])
    one = table.with_ordinal(spark.createDataFrame([(4,)], "id int"), ["id"])
    assert rows(table.rows_slice(one, -1), "id") == [(4,)] and rows(table.rows_slice(one.limit(0), -1), "id") == []
    assert rows(table.rows_slice(placed, -3), "id") == [(7,), (8,), (9,)] and rows(table.rows_slice(placed, 1, -1, 4), "id") == [(1,), (5,)]
    assert [b.count() for b in table.batch_tables(placed, 4)] == [4, 4, 2] and not list(table.batch_tables(placed.limit(0), 4))


def test_deduplicate_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, "x", {"k": 1}, [1]), (2, "x", {"k": 2}, [2]), (3, None, {"k": 3}, None), (4, None, None, [4])], "i int, t string, m map<string,int>, l array<int>")
    out = table.deduplicate(df, ["t"], ["i"])
    assert out.columns == df.columns and {(r.i, r.t, tuple((r.m or {}).items())) for r in out.collect()} == {(1, "x", (("k", 1),)), (3, None, (("k", 3),))}
    assert {r.i for r in table.deduplicate(df, ["l"], ["i"], "last").collect()} == {1, 2, 3, 4}
    assert table.deduplicate(df.limit(0), ["t"], ["i"]).count() == 0
    pairs = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, None, "a")], "i int, x string, y string")
    assert {r.i for r in table.deduplicate(pairs, ["x", "y"], ["i"]).collect()} == {1, 2}
    with pytest.raises(ValueError):
        table.deduplicate(df, ["m"], ["i"])


def test_map_column_has_one_type(spark):
    df = spark.createDataFrame([("a",), (None,), ("c",)], "k string")
    assert rows(table.map_column(df, "k", {"a": 1}, "v"), "v") == [(1,), (None,), (None,)]
    assert table.map_column(df, "k", {}, "v", value_type="long").schema["v"].dataType.simpleString() == "bigint"
    assert rows(table.map_column(df, "k", {}, "v", "x"), "v") == [("x",)] * 3
    many = table.map_column(df, "k", {str(i): i for i in range(5000)} | {"c": 7}, "k", 0)
    assert rows(many) == [(0,), (0,), (7,)] and len(many._jdf.queryExecution().optimizedPlan().toString()) < 3000


def test_lists_by_large_mappings(spark, monkeypatch):
    df = spark.createDataFrame([(["a", "q", None, "a"], 1), (None, 2), ([], 3), (["b"], 4)], "l array<string>, k int")
    want = [(1, [1, None, None, 1]), (2, None), (3, []), (4, [2])]
    for most in (1000, 0):
        monkeypatch.setattr(table, "LITERAL_VALUES", most)
        found = table.map_list(df, "l", {"a": 1, "b": 2}, "m")
        assert found.columns == ["l", "k", "m"] and sorted((r.k, r.m) for r in found.collect()) == want
    assert [r.m for r in table.map_list(df, "l", {}, "m").sort("k").collect()] == [[None] * 4, None, [], [None]]


def test_files_encoded_and_written(spark, tmp_path):
    df = spark.createDataFrame([("a/x.wav", [[0.5, -0.5], [0.25, 2.0]]), ("y.wav", None), (None, [[0.0]]), ("z.wav", [[]])], "path string, s array<array<float>>")
    files = waveform.encode_files(df, "path", "s", 8000)
    done = shared.saved(waveform.write_files(files, str(tmp_path)), "written")
    assert sorted((r.path or "", r.status) for r in done.collect()) == [("", "error"), ("a/x.wav", "success"), ("y.wav", "error"), ("z.wav", "success")]
    back, rate = waveform.decode_wav((tmp_path / "a" / "x.wav").read_bytes())
    assert rate == 8000 and back.T.tolist() == [[16383 / 32768, -16383 / 32768], [8191 / 32768, 32767 / 32768]]
    assert waveform.decode_wav((tmp_path / "z.wav").read_bytes())[0].shape == (0, 1)
    assert waveform.encode_files(df.limit(0), "path", "s", 8000).count() == 0


def test_look_ups(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "a")], "i int, k string")
    other = spark.createDataFrame([("a", 9, None), ("a", 2, "x"), (None, 5, "n"), ("b", 1, "y")], "key string, v int, w string")
    assert rows(table.look_up(df, "k", other, "key", ["v"])) == [(1, "a", 2), (2, None, None), (3, "z", None), (4, "a", 2)]
    assert rows(table.look_up(df, "k", other, "key", ["w"], missing=""), "i", "w") == [(1, "x"), (2, ""), (3, ""), (4, "x")]
    assert table.look_up(df.limit(0), "k", other, "key", ["v"]).count() == 0
    calls = []

    def fetch(missing):
        calls.append(rows(missing))
        return missing.select("key", F.lit(7).alias("v"))

    found, grown = table.look_up_or_fill(df, "k", other.select("key", "v"), "key", ["v"], fetch)
    assert rows(found, "i", "v") == [(1, 2), (2, None), (3, 7), (4, 2)] and calls == [[("z",)]] and grown.count() == 5
    assert rows(table.map_list(spark.createDataFrame([(["a", "q", None],), (None,)], "l array<string>"), "l", {"a": 1}, "m"), "m") == [(None,), ([1, None, None],)]


def test_set_operators(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "y"), (None, "n")], "k int, v string")
    assert rows(table.rows_in(a, "k", b, "k"), "k") == [(1,), (1,)] and rows(table.rows_in(a, "k", b, "k", negate=True), "k") == [(2,), (None,)]
    assert rows(table.intersect(a, b)) == [(1, "x"), (None, "n")] and rows(table.except_all(a, b)) == [(1, "x"), (2, None)]
    merged = table.outer_merge(a.withColumnRenamed("v", "w"), b, ["k"])
    assert rows(merged) == sorted([(1, "x", "x"), (1, "x", "x"), (2, None, None), (3, None, "y"), (None, "n", None), (None, None, "n")], key=repr)
    views = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None), (None, 5)], "g string, v int")
    assert rows(table.max_rows(views, ["g"], "v")) == [("a", 2), ("a", 2)]
    empty = a.limit(0)
    for df in (table.rows_in(empty, "k", b, "k"), table.intersect(empty, b), table.except_all(empty, b), table.max_rows(empty, ["k"], "v"), table.top_k(empty, "k", 3), table.proportions(empty, "k")):
        assert df.count() == 0
    assert table.column_exists(a, "k") and not table.column_exists(a, "z") and table.shape(a) == (4, 2) and table.n_distinct(a, "k") == 2


def test_group_operators(spark):
    df = spark.createDataFrame([("g", "B", 1.0), ("g", "b", None), ("g", "a", 3.0), ("h", None, None), (None, "z", 5.0)], "g string, v string, x double")
    assert rows(table.string_sets(df, "g", "v", "s")) == [("g", "a,b"), ("h", ""), (None, "z")]
    assert rows(table.grouped_mean(df, "g", "x", "m")) == [("g", 2.0), ("h", None), (None, 5.0)]
    assert rows(table.group_extremes(df, "g", "x", "v")) == [("g", 1.0, 3.0, 3), ("h", None, None, 0), (None, 5.0, 5.0, 1)]
    assert rows(table.proportions(df, "g")) == [("g", 0.75), ("h", 0.25)]
    assert rows(table.duplicate_count(df, "v")) == [(5, 1)]
    assert rows(table.top_k(df.select(F.lower("v").alias("v")), "v", 2)) == [("a", 1), ("b", 2)]


def test_apply(spark):
    df = spark.range(5)
    assert rows(table.apply(df, lambda b: b * 2, "id long")) == [(0,), (2,), (4,), (6,), (8,)] and table.apply(df.limit(0), lambda b: b, "id long").count() == 0
    with pytest.raises(TypeError):
        table.apply(df, 3, "id long")


def test_draws_reach_every_rank(spark):
    slots = spark.range(60_000)
    for n in (100, 2**30, 2**40):
        drawn = [r[0] for r in slots.select(sampling.draw_rank(1, F.lit(n), F.lit("p"), "id")).collect()]
        assert 1 <= min(drawn) < n // 100 + 2 and n - n // 100 <= max(drawn) <= n
        assert abs(np.mean(drawn) / n - 0.5) < 0.02
    # up to 65,536 ranks it is the 28-bit draw alone, as the SQL says it
    same = slots.where((sampling.draw(1, F.lit("p"), "id") % 1000 + 1) != sampling.draw_rank(1, F.lit(1000), F.lit("p"), "id"))
    assert same.count() == 0


def test_draws_of_large_pools_are_those_of_the_sql(spark):
    slots = spark.range(1000)
    for n in (65_537, 900_000, 2**28):
        same = slots.where((sampling.draw(1, F.lit("p"), "id") % n + 1) != sampling.draw_rank(1, F.lit(n), F.lit("p"), "id"))
        assert same.count() == 0


def test_samples_are_exact_with_few_cells(spark, monkeypatch):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], None if i % 10 == 0 else "x") for i in range(900)], "id int, cls string, void string")
    want = {n: rows(sampling.sample_rows(df, n, "id"), "id") for n in (0, 1, 450, 900)}
    assert [len(w) for w in want.values()] == [0, 1, 450, 900]
    best = sorted((r.d, r.id) for r in df.select("id", sampling.draw(42, "id").alias("d")).collect())
    assert want[450] == sorted([(i,) for _, i in best[:450]], key=repr)
    monkeypatch.setattr(sampling, "SLOTS", 64)
    up = rows(sampling.upsample(df, "cls", {"a": 1000, "b": 10}, "id"), "cls")
    assert collections.Counter(up) == {("a",): 1000, ("b",): 10}
    with pytest.raises(ValueError):
        sampling.sample_rows(df, 901, "id")
    assert len(rows(sampling.sample_rows(df, 2000, "id", replace=True))) == 2000
    split = sampling.stratified_split(df, ["cls", "void"], "id")
    assert split.columns == [*df.columns, "split"] and split.count() == 900
    counts = collections.Counter(r.split for r in sampling.two_step_split(df, ["cls"], "id").collect())
    assert counts == {"train": 576, "val": 144, "test": 180}
    assert sampling.stratified_split(df.limit(0), ["cls"], "id").count() == 0 and sampling.subsample(df.limit(0), "cls", {"other": 0.5}, "id").count() == 0


def test_many_categories_do_not_grow_the_plan(spark):
    df = spark.range(6000).select(F.col("id"), (F.col("id") % 2000).cast("string").alias("cls"))
    out = sampling.balanced(df, "cls", "id", "min")
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 50_000 and out.count() == 6000


def test_group_split_forced_and_null(spark):
    df = spark.createDataFrame([(i, None if i == 9 else i % 5) for i in range(20)], "i int, g int")
    out = sampling.group_split(df, "g", 1, 1, always_test=F.col("g") == 3)
    by = collections.defaultdict(set)
    for r in out.collect():
        by[r.g].add(r.split)
    assert by[3] == {"test"} and by[None] == {"train"} and all(len(v) == 1 for v in by.values())
    assert collections.Counter(next(iter(v)) for g, v in by.items() if g not in (3, None)) == {"test": 1, "val": 1, "train": 2}


def test_labels_of_many_values(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["b", "a", "q"]), (2, None), (3, []), (4, ["a", "a", None])], "i int, l array<string>")
    want = rows(labels.multilabel(df, "l")[0])
    monkeypatch.setattr(labels, "LITERAL_LABELS", 0)
    assert rows(labels.multilabel(df, "l")[0]) == want == [(1, ["b", "a", "q"], [0, 1, 2]), (2, None, []), (3, [], []), (4, ["a", "a", None], [0])]
    assert labels.multilabel(df, "l", allow_missing=False)[0].count() == 2


def test_taxonomy_prefers_accepted(spark):
    df = spark.createDataFrame([("a",), ("old",), (None,), ("q",)], "scientific_name string")
    dim = spark.createDataFrame([("a", 5, "SYNONYM", "wrong"), ("a", 9, "ACCEPTED", "right"), ("a", 10, "ACCEPTED", "later"), (None, 1, "ACCEPTED", "n")], "canonicalName string, taxonID long, taxonomicStatus string, genus string")
    table_ = spark.createDataFrame([("old", "a"), ("old", "z"), (None, "a")], "wrong string, right string")
    for corrections in ({"old": "a"}, table_):
        out, found = labels.add_taxonomy(df, "scientific_name", dim, "canonicalName", ["genus"], corrections)
        assert rows(out) == [("a", "right"), ("old", "right"), ("q", None), (None, None)] and found["resolved"] == 2


def test_taxonomy_through_config(spark, tmp_path):
    spark.createDataFrame([("a", "g")], "canonicalName string, genus string").write.parquet(str(tmp_path / "tax.parquet"))
    df = spark.createDataFrame([("old",)], "scientific_name string")
    out, _ = config.transform(df, [{"type": "add_taxonomy", "path": str(tmp_path / "tax.parquet"), "corrections": {"old": "a"}}])
    assert rows(out) == [("old", "g")]
    with pytest.raises(ValueError):
        config.transform(df, [{"type": "add_taxonomy", "path": str(tmp_path / "absent.parquet")}])


def test_selection_tables_parse_in_linear_time(spark):
    head = "Selection\tBegin Time (s)\tEnd Time (s)\tLabel\n"

    def seconds(n):
        df = spark.range(1).select(F.concat(F.lit(head), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat_ws("\t", i.cast("string"), i.cast("string"), (i + 1).cast("string"), F.lit("a"))), "\n")).alias("st"))
        df = shared.saved(df, "cell")
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            assert df.select(F.size(intervals.parse_selection_table(F.col("st"))).alias("n")).first().n == n
            best = min(best, time.perf_counter() - began)
        return best

    seconds(500)
    assert seconds(32_000) < 20 * seconds(2_000) + 1


def test_interval_joins(spark):
    clips = spark.createDataFrame([("f", 0.0, 10.0), ("f", 50.0, 60.0), (None, 0.0, 1.0)], "fn string, s double, e double")
    events = spark.createDataFrame([("f", 0.0, 100.0, "x"), ("f", 5.0, 5.0, "y"), (None, 0.0, 1.0, "z"), ("f", None, 1.0, "w")], "fn string, b double, z double, l string")
    met = intervals.overlap_join(clips, events, "fn", "s", "e", "b", "z", 3.0)
    assert rows(met, "s", "l") == [(0.0, "x"), (0.0, None), (50.0, "x")]
    inner = intervals.overlap_join(clips, events, "fn", "s", "e", "b", "z", 3.0, "inner")
    assert rows(intervals.clip_relative(inner, "s", "e", "b", "z"), "rel_begin", "rel_end") == [(0.0, 10.0), (0.0, 10.0)]


def test_scalar_checks(spark):
    good = ["2023-10-27T10:00:00+00:00", "2023-10-27 10:00:00+00:00", "2023-10-27T10:00Z", "20231027T100000Z", "2024-02-29T23:59:59.123456-00:00"]
    bad = ["2023-13-45T99:99:99Z", "2023-02-29T00:00:00Z", "2023-10-27T24:00:00Z", "2023-10-27T10:00:00", "2023-10-27T10:00:00+01:00", "", "x", None]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    assert [bool(r[0]) for r in df.select(scalars.is_utc(F.col("v"))).collect()] == [True] * 5 + [False] * 8
    cells = spark.createDataFrame([("{}",), ("[1",), ("",), (None,)], "j string")
    assert [r[0] for r in cells.select(scalars.is_json(F.col("j"))).collect()] == [True, False, False, None]
    now, made = spark.range(2).select(scalars.utc_now(), scalars.make_id()).first()
    assert spark.range(1).select(scalars.is_utc(F.lit(now)), scalars.is_uuid(F.lit(made))).first() == (True, True)
    assert scalars.available_rates(["a"], {32000: "a", 16000: "b"}) == [32000] and scalars.available_rates([], {2: "a", 1: "b"}, checked=False) == [1, 2]


def test_paths(spark):
    df = spark.createDataFrame([("gs://b/x y/a.tar.gz",), ("b/c",), (None,), ("",)], "p string")
    p = F.col("p")
    urls = [r[0] for r in df.select(scalars.https_url(p)).collect()]
    assert urls[:3] == ["https://storage.googleapis.com/b/x%20y/a.tar.gz", "https://storage.googleapis.com/b/c", None]
    for odd, want in (("file#1?.wav", "file%231%3F.wav"), ("50%off[0]~.wav", "50%25off%5B0%5D~.wav"), ("a+b*ü", "a%2Bb%2A%C3%BC")):
        assert spark.range(1).select(scalars.https_url(F.lit("gs://m/" + odd))).first()[0] == "https://storage.googleapis.com/m/" + want
    for refused in ("s3://b/x", "r2://b/x"):
        with pytest.raises(Exception, match="Unsupported storage scheme"):
            spark.range(1).select(scalars.https_url(F.lit(refused))).collect()
    for pattern, want in (("*.gz", True), ("x*/*.tar.gz", True), ("b/*.gz", False), ("**/a.*", True), ("?/c", False), ("[!x]*.gz", True)):
        assert df.select(scalars.matches(p, pattern)).first()[0] is want
    assert df.select(scalars.parts(p)).collect()[1][0] == ["b", "c"] and df.select(scalars.parents(p)).collect()[1][0] == ["b"]


def test_small_files(tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a.yml", "k: [1]"), ("e.yml", ""), ("bad.yml", "k: ["), ("a.json", '{"k": 1}'), ("bad.json", "{")):
        (tmp_path / name).write_text(text)
    assert files.read_yaml(str(tmp_path / "a.yml")) == {"k": [1]} and files.read_json(f"file://{tmp_path}/a.json") == {"k": 1}
    for bad in ("e.yml", "bad.yml"):
        with pytest.raises(ValueError, match=bad):
            files.read_yaml(str(tmp_path / bad))
    for bad in ("e.yml", "bad.json"):
        with pytest.raises(ValueError, match=bad):
            files.read_json(str(tmp_path / bad))
    (tmp_path / "d" / "x").write_text("1")
    (tmp_path / "d" / "deep").mkdir()
    (tmp_path / "d" / "deep" / "y").write_text("2")
    with pytest.raises(IsADirectoryError):
        files.rm(str(tmp_path / "d"))
    files.rm(str(tmp_path / "d"), recursive=True, maxdepth=1)
    assert not files.exists(str(tmp_path / "d" / "x")) and files.exists(str(tmp_path / "d" / "deep" / "y"))
    files.rm(str(tmp_path / "d"), recursive=True)
    assert not files.exists(str(tmp_path / "d"))
    with pytest.raises(FileNotFoundError):
        files.rm(str(tmp_path / "d"))


def test_more_sources(spark, tmp_path):
    for i in range(2):
        spark.range(3 * i, 3 * i + 3).coalesce(1).write.parquet(str(tmp_path / "t" / f"part{i}"))
    df = readers.from_parquet(spark, str(tmp_path / "t" / "*"), row_index="n")
    assert rows(df) == [(i, i) for i in range(6)]
    (tmp_path / "h.csv").write_text("junk\nx,y\n1,2\n3,4\n")
    assert rows(readers.from_csv(spark, str(tmp_path / "h.csv"), skip=1)) == [(1, 2), (3, 4)]
    (tmp_path / "n.csv").write_text("1,2\n3\n")
    assert readers.from_csv(spark, str(tmp_path / "n.csv"), header=False, schema="a int, b int", dirty=True).collect() == [(1, 2)]
    (tmp_path / "t.tsv").write_text('a\tb\n"x\ty\n')
    assert rows(readers.from_tsv(spark, str(tmp_path / "t.tsv"), quoted=False)) == [('"x', "y")]
    for name in ("a.wav", "a.txt", "b.wav", "c.txt"):
        (tmp_path / name).write_text("1")
    pairs = [(r.path[-5:], r.annotation and r.annotation[-5:]) for r in readers.paired_files(spark, str(tmp_path), "*.wav", ".txt").collect()]
    assert sorted(pairs) == [("a.wav", "a.txt"), ("b.wav", None)]
    keyed = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "c")], "k int, v string")
    assert readers.append_new(keyed, str(tmp_path / "app"), ["k"]) == 2 and readers.append_new(keyed, str(tmp_path / "app"), ["k"]) == 0
    readers.to_json(keyed, str(tmp_path / "by"), by="v", full=str(tmp_path / "full"))
    assert spark.read.json(str(tmp_path / "full")).count() == spark.read.json(str(tmp_path / "by")).count() == 4
    with pytest.raises(ValueError):
        readers.from_version({"1.0.0": {}}, "2.0.0")


def test_sounds_in_manifests(spark, tmp_path):
    tone = lambda rate, s, f: (np.sin(2 * np.pi * f * np.arange(int(rate * s)) / rate) * 0.5).astype(np.float32)
    (tmp_path / "audio").mkdir()
    (tmp_path / "16k").mkdir()
    for name, rate, s in (("audio/a.wav", 8000, 2), ("audio/b.wav", 16000, 3), ("16k/a.wav", 16000, 2), ("16k/b.wav", 16000, 0.5)):
        (tmp_path / name).write_bytes(waveform.encode_wav(np.stack([tone(rate, s, 200)] * 2, axis=1), rate))
    st = "Begin Time (s)\tEnd Time (s)\tLabel\n0.5\t1\tx\n2.5\t9\ty"
    path = str(tmp_path / "m.parquet")
    spark.createDataFrame([("a.wav", "16k/a.wav", 0.5, 1.5, st), ("b.wav", "16k/b.wav", None, None, st), ("absent.wav", " ", None, None, None)], "fn string, r16 string, s double, e double, st string").write.parquet(path)
    spec = {"path": "fn", "root": str(tmp_path), "sample_rate": 16000, "rates": {16000: "r16"}, "folder": "audio", "selection_table": "st", "labels": ["x"]}
    made, _ = config.dataset_from_config(spark, {"dataset": {"dataset_name": "manifest", "split_paths": {"train": path}, "audio_spec": spec}})
    got = {r["fn"]: r for r in made}
    assert len(got["a.wav"]["audio"]) == 32000 and len(got["b.wav"]["audio"]) == 48000  # the short copy gives way to the original
    assert [e.label for e in got["b.wav"]["events"]] == ["x", "y"] and [e.label for e in got["a.wav"]["events"]] == ["x"] and got["a.wav"]["intervals"] == [(0.5, 1.0, 0)]
    assert got["absent.wav"]["audio"] is None and "absent.wav" in got["absent.wav"]["error"]
    part, _ = config.dataset_from_config(spark, {"dataset": {"dataset_name": "manifest", "split_paths": {"train": path}, "audio_spec": {"path": "fn", "root": str(tmp_path), "sample_rate": 4000, "folder": "audio", "start": "s", "end": "e"}}})
    assert {r["fn"]: r["audio"] and len(r["audio"]) for r in part} == {"a.wav": 4000, "b.wav": 12000, "absent.wav": None}
    assert part[0]["fn"] == "a.wav" and part.info.sample_rate == 4000
    with pytest.raises(IndexError):
        part[3]


def test_written_resampled(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.wav", "b.wav"):
        (tmp_path / "in" / name).write_bytes(waveform.encode_wav(np.zeros((800, 2)), 8000))
    (tmp_path / "in" / "c.wav").write_bytes(b"none")
    df = spark.createDataFrame([("a.wav",), ("c.wav",), (None,)], "path string")
    first = shared.saved(waveform.write_resampled(df, "path", str(tmp_path / "in"), str(tmp_path / "out"), 16000), "status")
    assert rows(first, "path", "new_path", "status") == [("a.wav", "16kHz/a.wav", "success"), ("c.wav", "", "error"), (None, "", "error")]
    again = shared.saved(waveform.write_resampled(df.union(spark.createDataFrame([("b.wav",)], "path string")), "path", str(tmp_path / "in"), str(tmp_path / "out"), 16000), "status")
    assert rows(readers.status_counts(again)) == [("error", 2), ("skipped", 1), ("success", 1)]
    back, rate = waveform.decode_wav((tmp_path / "out" / "16kHz" / "a.wav").read_bytes())
    assert rate == 16000 and back.shape == (1600, 1)


def test_decoders(spark, tmp_path):
    raw = b"RAW!" + np.arange(8, dtype="<f4").tobytes()
    (tmp_path / "x.raw").write_bytes(raw)
    with pytest.raises(waveform.UnreadableAudio):
        waveform.decode_audio(raw)
    before = list(waveform._DECODERS)
    waveform.register_decoder(lambda head: head[:4] == b"RAW!", lambda f, start, end: (np.frombuffer(f.read()[4:], "<f4").reshape(-1, 1), 4))
    try:
        found = waveform.decode_files(readers.file_table(spark, str(tmp_path), "*.raw", content=True)).first()
        assert found.signal == [[float(i) for i in range(8)]] and found.sample_rate == 4
    finally:
        waveform._DECODERS[:] = before
    info = readers.file_table(spark, str(tmp_path), "*.raw", content=True)
    assert waveform.audio_info(info).first().format is None
    with pytest.raises(ValueError):
        waveform.mono(spark.createDataFrame([([[[1.0]]],)], "w array<array<array<double>>>"), "w", "m")


def test_resample_by_column(spark):
    tone = np.sin(np.arange(1600) / 20)
    df = spark.createDataFrame([(8000, [float(x) for x in tone], "k"), (16000, [1.0, 2.0], None), (None, [1.0], "n"), (8000, None, "v")], "rate int, w array<double>, x string")
    got = waveform.resample(df, "w", "rate", 16000, "y").collect()
    assert [r.y and len(r.y) for r in got] == [3200, 2, None, None] and [r.x for r in got] == ["k", None, "n", "v"]
    assert np.abs(np.array(got[0].y)[100:-100:2] - tone[50:-50]).max() < 0.01


def test_streaming_rules(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").write.json(str(tmp_path / "in.jsonl"))
    body = {"dataset_name": "manifest", "split_paths": {"train": str(tmp_path / "in.jsonl")}, "streaming": True}
    made, _ = config.dataset_from_config(spark, {"dataset": body | {"transformations": [{"type": "filter", "property": "b", "values": ["x"]}]}})
    assert made.df.isStreaming and made.columns == ["a", "b"]
    with pytest.raises(NotImplementedError, match="length"):
        len(made)
    with pytest.raises(RuntimeError, match="__getitem__"):
        made[0]
    chained, _ = config.dataset_from_config(spark, {"chain": {"datasets": [body, body]}})
    for bad in (lambda: len(chained), lambda: chained[0]):
        with pytest.raises(RuntimeError, match="streaming"):
            bad()
    still = config.Dataset(spark.range(1), config.DatasetInfo("s"))
    with pytest.raises(config.ChainException):
        config.Chain([made, still])
    with pytest.raises(RuntimeError, match="apply"):
        table.apply(made.df, lambda b: b, "a int")
    lazy = stream.LazyTable(spark.createDataFrame([("a",), ("b",), ("a",)], "v string"))
    assert lazy.histogram("v") == {"a": 2, "b": 1} and [r["v"] for r in lazy.filter_isin("v", ["b"])] == ["b"]


def test_lazy_tables_sample_whole(spark):
    lazy = stream.LazyTable(spark.range(25).select("id", (F.col("id") % 2).cast("string").alias("v")))
    with pytest.warns(UserWarning, match="subsample"):
        assert sum(1 for _ in lazy.subsample("v", {"1": 0.5}, "id")) == 6
    with pytest.warns(UserWarning, match="upsample"):
        assert sum(1 for _ in lazy.upsample("v", {"0": 30}, "id")) == 30
    with pytest.warns(UserWarning, match="sample_rows"):
        assert sum(1 for _ in lazy.sample_rows(3, "id")) == 3
    assert [len(b) for b in lazy.iter_batches(10)] == [10, 10, 5] and lazy.columns == ["id", "v"]


def test_concatenated_rows_are_processed_by_their_source(spark):
    one = config.Dataset(spark.createDataFrame([("a", 1)], "k string, n int"), config.DatasetInfo("one"), {"k": "key", "audio": "audio"}, lambda df: df.withColumn("audio", F.col("n") * 10))
    two = config.Dataset(spark.createDataFrame([("b", 2), ("c", 3)], "k string, n int"), config.DatasetInfo("two"), {"k": "key"}, lambda df: df.withColumn("audio", F.col("n") + 100))
    both, _ = config.concatenate([one, two]).apply([{"type": "filter", "property": "k", "values": ["a", "c"]}])
    assert sorted((r["key"], r["audio"]) for r in iter(both)) == [("a", 10), ("c", 103)] and both[1] in ({"key": "a", "audio": 10}, {"key": "c", "audio": 103})
    loose = config.concatenate([config.Dataset(one.df, one.info, {"k": "key", "absent": "x"})])
    assert [*loose.samples().toPandas().to_dict("records")] == [{"key": "a"}] and loose.columns == ["k", "n"]
    with pytest.raises(KeyError):
        config.Dataset(one.df, one.info, {"absent": "x"}).samples()


def test_transform_registry(spark):
    from typing import Literal

    class Twice(config.Strict):
        type: Literal["twice_test"]
        column: str

    config.register_transform(Twice, lambda df, c: (df.withColumn(c.column, F.col(c.column) * 2), {"done": True}))
    out, found = config.transform(spark.range(2), [{"type": "twice_test", "column": "id"}])
    assert rows(out) == [(0,), (2,)] and found == {"twice_test": {"done": True}}
    with pytest.raises(ValueError):
        config.register_transform(Twice, None)

    class Loose(config.Strict):
        type: str

    with pytest.raises(ValueError):
        config.register_transform(Loose, None)


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Remote:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_root(Remote)
    keep = shared.saved(spark.range(1), "outer")
    with shared.only() as kept:
        gone = shared.saved(spark.range(2), "gone")
        kept.append(shared.saved(spark.range(3), "kept"))
    assert keep.count() == 1 and kept[0].count() == 3 and not files.exists(gone._corvane_path) and files.exists(kept[0]._corvane_path)


def test_fits(spark, monkeypatch):
    df = shared.saved(spark.createDataFrame([(1, "x" * 100), (2, None)], "i int, s string"), "t")
    assert shared.fits(df) and not shared.fits(df.withColumn("l", F.array("i")))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 100)
    assert not shared.fits(df) and shared.fits(df.limit(0))
