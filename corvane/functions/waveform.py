"""Waveforms as arrays: JVM expressions where they suffice, Arrow batches for decoding and resampling."""

from __future__ import annotations

import functools
import io
import math
import uuid
import wave
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import table
from ..sources.files import exists, open_store


def to_mono(channels: Column, method: str = "average", axis: str = "auto") -> Column:
    """An array of arrays -> one array. Channels are the outer arrays (first), the inner ones (last), or whichever are fewer."""
    if method not in ("average", "keep_first"):
        raise ValueError(f"unknown method {method!r}")
    if axis not in ("auto", "first", "last"):
        raise ValueError(f"unknown axis {axis!r}")
    if method == "keep_first":
        outer, inner = F.get(channels, F.lit(0)), F.transform(channels, lambda x: F.get(x, F.lit(0)))
    else:
        first = F.transform(F.get(channels, F.lit(0)), lambda x: F.lit(0.0) + x)
        total = F.aggregate(F.slice(channels, F.lit(2), F.greatest(F.size(channels) - 1, F.lit(0))), first, lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b))
        outer = F.transform(total, lambda x: x / F.size(channels))
        inner = F.transform(channels, lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x))
    if axis != "auto":
        return outer if axis == "first" else inner
    return F.when(F.size(channels) <= F.size(F.get(channels, F.lit(0))), outer).otherwise(inner)


def rounded(signal: Column, digits: int) -> Column:
    """Samples rounded half away from zero; one that comes to zero keeps its sign, as IEEE arithmetic and the SQL have it."""
    return F.transform(signal, lambda x: F.when(F.round(x, digits) == 0, x * F.lit(0.0)).otherwise(F.round(x, digits)))


def mono(df: DataFrame, name: str, output: str, method: str = "average") -> DataFrame:
    """A signal column as one channel: one-dimensional signals pass through, more than two dimensions raise ValueError."""
    kind, depth = df.schema[name].dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    if depth not in (1, 2):
        raise ValueError(f"{name} has {depth} dimensions")
    return df.withColumn(output, F.col(name) if depth == 1 else to_mono(F.col(name), method))


def window(signal: Column, start: Column, end: Column, rate: int) -> Column:
    """Samples [int(start * rate), int(end * rate)) within the signal; null bounds take all; end <= start gives null."""
    a = F.greatest(F.lit(0), (F.coalesce(start, F.lit(0.0)) * rate).cast("int"))
    b = F.least(F.size(signal), F.when(end.isNull(), F.size(signal)).otherwise((end * rate).cast("int")))
    return F.when(start.isNull() | end.isNull() | (end > start), F.slice(signal, a + 1, F.greatest(b - a, F.lit(0))))


def pad_truncate(signal: Column, n: int) -> Column:
    """Exactly n samples: cut, or zeros at the right."""
    return F.concat(F.slice(signal, 1, n), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(n) - F.size(signal), F.lit(0))))


def anchor(n: int, starts: Column, durations: Column) -> Column:
    """Frame-level Gaussian peaks at event starts (deviation a sixth of the duration), the largest per frame."""
    pairs = F.arrays_zip(starts.alias("s"), durations.alias("d"))
    peak = lambda i: F.transform(pairs, lambda e: F.exp(-F.pow((i - e["s"]) / (e["d"] / F.lit(6.0)), F.lit(2.0)) / F.lit(2.0)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.array_max(peak(i)), F.lit(0.0)))


def frame_targets(n: int, events: Column, rate: float, n_classes: int, segmentation: bool = False) -> Column:
    """Frame-level targets from events (begin, end, label index): anchor, regression, classes, and the same reversed (from the ends).

    An anchor is a Gaussian peak of a sixth of the duration's frames, the largest of all
    events; regression is the duration at the event's frame, of the last event there. Classes
    are a row per frame: 1 over the event's frames (segmentation) or at its frame, where the
    unknown label -1 spreads evenly; in segmentation it marks nothing. No events give zeros.
    """
    frame = lambda x: F.greatest(F.least(x.cast("int"), F.lit(n - 1)), F.lit(0))
    placed = F.transform(
        events,
        lambda e: F.struct(
            frame(F.floor(e["begin"] * rate)).alias("first"), frame(F.ceil(e["end"] * rate)).alias("last"), (e["end"] - e["begin"]).alias("seconds"),
            F.ceil((e["end"] - e["begin"]) * rate).cast("int").alias("frames"), e["label"].alias("label"),
        ),
    )
    frames, labels = F.sequence(F.lit(0), F.lit(n - 1)), F.sequence(F.lit(0), F.lit(n_classes - 1))
    none = F.array().cast("array<double>")

    def anchors(at: str) -> Column:
        peak = lambda i: F.transform(placed, lambda e: F.exp(-F.pow((i - e[at]) / (e["frames"] / F.lit(6.0)), F.lit(2.0)) / F.lit(2.0)))
        return F.transform(frames, lambda i: F.coalesce(F.array_max(peak(i)), F.lit(0.0)))

    def durations(at: str) -> Column:
        here = lambda i: F.transform(F.filter(placed, lambda e: e[at] == i), lambda e: e["seconds"])
        return F.transform(frames, lambda i: F.coalesce(F.try_element_at(F.coalesce(here(i), none), F.lit(-1)), F.lit(0.0)))

    def marks(at: str) -> Column:
        if segmentation:
            inside = lambda e, i, c: (e["label"] == c) & (i >= e["first"]) & (i < e["first"] + e["frames"])
            if at == "last":
                return F.transform(frames, lambda i: F.transform(labels, lambda c: F.lit(0.0)))
            return F.transform(frames, lambda i: F.transform(labels, lambda c: F.exists(placed, lambda e: inside(e, i, c)).cast("double")))
        value = lambda e, c: F.when(e["label"] == -1, F.lit(1.0 / n_classes)).when(e["label"] == c, 1.0)
        last = lambda i, c: F.filter(F.transform(F.filter(placed, lambda e: e[at] == i), lambda e: value(e, c)), lambda v: v.isNotNull())
        return F.transform(frames, lambda i: F.transform(labels, lambda c: F.coalesce(F.try_element_at(last(i, c), F.lit(-1)), F.lit(0.0))))

    return F.struct(
        anchors("first").alias("anchor"), durations("first").alias("regression"), marks("first").alias("classes"),
        anchors("last").alias("rev_anchor"), durations("last").alias("rev_regression"), marks("last").alias("rev_classes"),
    )


def n_frames(samples: int, scale: int) -> int:
    """Frames of a signal at one per `scale` samples, the last perhaps short."""
    return math.ceil(samples / scale)


def usable(resampled: Column, original: Column, rate: int) -> Column:
    """The resampled signal, or the original where that is missing (its decode failed) or shorter than a second."""
    return F.when(F.coalesce(F.size(resampled), F.lit(-1)) >= rate, resampled).otherwise(original)


def stack_batches(df: DataFrame, name: str, size: int, n: int | None = None) -> DataFrame:
    """batch, stacked: signals of `size` numbered rows at a time, in order, all padded to n samples or to the batch's longest."""
    rows = table.batches(df, size).select("batch", F.col(table.ORDINAL).alias("at"), F.col(name).alias("signal"))
    groups = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("at", "signal"))).alias("rows"), F.max(F.size("signal")).alias("longest"))
    zeros = lambda x, to: F.concat(F.slice(x, F.lit(1), to), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(to - F.size(x), F.lit(0))))
    to = F.col("longest") if n is None else F.lit(n)
    return groups.select("batch", F.transform("rows", lambda r: zeros(r["signal"], to)).alias("stacked"))


def issues(signal: Column, least: int = 10) -> Column:
    """The first quality issue of a signal, or null: too short, not a number, silent."""
    return (
        F.when(signal.isNull() | (F.size(signal) < least), "too_short")
        .when(F.exists(signal, lambda x: F.isnan(x) | x.isNull()), "nan")
        .when(F.forall(signal, lambda x: x == 0), "all_zero")
    )


def qc_issues(signal: Column, rate: Column | int, events: Column, species: Column | None = None, known: Sequence[str] = (), canonical: Sequence[str] = (), least: int = 10) -> Column:
    """All quality issues of a row, in order: of the signal, of the events against it, and of the species.

    A signal that is null could not be read, and has no other issue. Of the species only the first
    is named: unknown (not in `known`) or non-canonical (known, not in `canonical`).
    """
    rate = F.lit(rate) if isinstance(rate, int) else rate
    begins = F.array_max(F.transform(events, lambda e: e["begin"]))
    found = [
        F.when(F.size(signal) < least, "too_short"),
        F.when(F.exists(signal, lambda x: F.isnan(x) | x.isNull()), "nan_in_audio"),
        F.when(F.forall(signal, lambda x: x == 0), "all_zeros"),
        F.when(F.coalesce(begins, F.lit(0.0)) > F.size(signal) / rate + 1e-6, "events_after_audio"),
        F.when(F.exists(events, lambda e: e["end"] - e["begin"] <= 0), "events of dur <= 0"),
    ]
    if species is not None:
        inside = lambda names: species.isin(list(names))
        found.append(F.when(~F.coalesce(inside(known), F.lit(False)), "unknown_species").when(~inside(canonical), "non_canonical_species"))
    return F.when(signal.isNull(), F.array(F.lit("read_audio_failed"))).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))


@functools.cache
def _taps(rate: int, target: int, zeros: int) -> tuple[int, int, np.ndarray]:
    """Steps (up, down) and the weights of each of the `up` phases, made once per pair of rates."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    cut = min(1.0, target / rate)
    half = int(np.ceil(zeros / cut))
    t = np.arange(-half, half + 1)[None, :] - (np.arange(up) / up)[:, None]
    return up, down, cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / (half + 1), -1, 1)))


def resample_array(signal: np.ndarray, rate: int, target: int, zeros: int = 32) -> np.ndarray:
    """Band-limited resampling by a Hann-windowed sinc, in blocks, so memory is bounded by the signal."""
    if rate == target or not len(signal):
        return np.asarray(signal, np.float32)
    up, down, weights = _taps(int(rate), int(target), zeros)
    n, half = -(-len(signal) * up // down), weights.shape[1] // 2
    out = np.empty(n, np.float32)
    padded = np.pad(np.asarray(signal, np.float64), half + 1)
    taps = np.arange(-half, half + 1) + half + 1
    for at in range(0, n, 4096):
        place = np.arange(at, min(n, at + 4096)) * down
        spots = np.minimum((place // up)[:, None] + taps[None, :], len(padded) - 1)
        out[at : at + len(place)] = (padded[spots] * weights[place % up]).sum(axis=1)
    return out


def resample(df: DataFrame, name: str, rate: int | str, target: int, output: str) -> DataFrame:
    """The signal at another rate (a number, or the name of its column); rows already there pass through, null signals and rates give null.

    Arrow batches; the weights of a pair of rates are made once per worker.
    """
    if rate == target:
        return df.withColumn(output, F.col(name))
    schema = T.StructType([f for f in df.schema.fields if f.name != output] + [T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rates = batch.column(rate).to_pylist() if isinstance(rate, str) else [rate] * batch.num_rows
            made = []
            for signal, own in zip(batch.column(name), rates):
                made.append(resample_array(signal.values.to_numpy(zero_copy_only=False), own, target) if signal.is_valid and own else None)
            kept = [c for c in batch.schema.names if c != output]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(made, pa.list_(pa.float32()))], [*kept, output])

    return df.mapInArrow(run, schema)


class UnreadableAudio(ValueError):
    """Bytes that no registered decoder reads."""


def _is_wav(head: bytes) -> bool:
    return head[:4] == b"RIFF" and head[8:12] == b"WAVE"


_DECODERS: list[tuple[Callable[[bytes], bool], Callable]] = []


def register_decoder(recognises: Callable[[bytes], bool], decode: Callable) -> None:
    """Add a codec: recognises(first 16 bytes), decode(seekable binary file, start, end) -> (samples (frames, channels), rate). Later ones go first."""
    _DECODERS.insert(0, (recognises, decode))


def decode_audio(source, start: float | None = None, end: float | None = None, decoders: Sequence[tuple] | None = None) -> tuple[np.ndarray, int]:
    """Samples (frames, channels) as float32 and the rate, from bytes or a seekable file; a window reads only its frames.

    The first decoder that recognises the head and does not fail counts, so a second one for a format is a fall-back.
    """
    if start is not None and end is not None and end <= start:
        raise ValueError("the window ends before it starts")
    file = io.BytesIO(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
    head, failed = file.read(16), []
    for recognises, decode in _DECODERS if decoders is None else decoders:
        if recognises(head):
            file.seek(0)
            try:
                return decode(file, start, end)
            except (wave.Error, EOFError, ValueError) as e:
                failed.append(f"{type(e).__name__}: {e}")
    raise UnreadableAudio("; ".join(failed) or "no decoder for this format")


def decode_wav(raw, start: float | None = None, end: float | None = None) -> tuple[np.ndarray, int]:
    """Samples (frames, channels) as float32 in [-1, 1) and the rate; a window reads only its frames."""
    if start is not None and end is not None and end <= start:
        raise ValueError("the window ends before it starts")
    with wave.open(io.BytesIO(raw) if isinstance(raw, (bytes, bytearray, memoryview)) else raw) as f:
        rate, width, channels, total = f.getframerate(), f.getsampwidth(), f.getnchannels(), f.getnframes()
        first = min(total, int((start or 0) * rate))
        last = total if end is None else min(total, int(end * rate))
        f.setpos(first)
        data = f.readframes(last - first)
    if width == 1:
        values = np.frombuffer(data, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        values = (wide.view("<i4").ravel() / 2**31).astype(np.float32)
    else:
        values = np.frombuffer(data, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    return values.reshape(-1, channels), rate


def encode_wav(signal: np.ndarray, rate: int) -> bytes:
    """16-bit PCM."""
    signal = np.atleast_2d(np.asarray(signal, np.float32).T).T
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(signal.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(signal, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


register_decoder(_is_wav, decode_wav)


def encode_files(df: DataFrame, path: str, signal: str, rate: int) -> DataFrame:
    """path and content: each signal (a list of samples, or one list for each channel) as a 16-bit WAV file; null where there is no signal."""
    nested = isinstance(df.schema[signal].dataType.elementType, T.ArrayType)

    def file_of(values) -> bytes | None:
        if not values.is_valid:
            return None
        one = values.values
        samples = np.array(one.to_pylist(), np.float32).T if nested else one.to_numpy(zero_copy_only=False)
        return encode_wav(samples, rate)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([file_of(v) for v in part.column(1)], pa.binary())], ["path", "content"])

    return df.select(F.col(path).cast("string").alias("path"), F.col(signal)).mapInArrow(run, "path string, content binary")


def _put(goal: str, raw: bytes) -> None:
    """Write a file under a name of its own and move it to its place, so that a lost task leaves no half file."""
    store, at = open_store(goal)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    fresh = f"{at}.{uuid.uuid4().hex[:8]}"
    with store.open_output_stream(fresh) as out:
        out.write(raw)
    store.move(fresh, at)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each content under root/path; path, status (success, error) and error of each row. It runs when the result does.

    Rows without a path or a content are errors; files that are there are replaced.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            for name, content in zip(batch.column(0), batch.column(1)):
                try:
                    if not name.is_valid or not content.is_valid:
                        raise ValueError("no path or no content")
                    _put(f"{root.rstrip('/')}/{name.as_py()}", content.as_py())
                    found.append(("success", None))
                except (ValueError, OSError) as e:
                    found.append(("error", f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in found], pa.string()) for k in range(2))], ["path", "status", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, status string, error string")

AUDIO = "path string, sample_rate int, channels int, signal array<array<float>>, error string"
WINDOW = ("_start", "_end")


def _audio_row(open_file: Callable, start: float | None, end: float | None, decoders: Sequence[tuple]) -> tuple:
    try:
        signal, rate = decode_audio(open_file(), start, end, decoders)
        return rate, signal.shape[1], np.ascontiguousarray(signal.T), None
    except (UnreadableAudio, wave.Error, EOFError, ValueError, OSError) as e:
        return None, None, None, f"{type(e).__name__}: {e}"


def _audio_batch(paths: list, found: list[tuple]):
    """An Arrow batch of AUDIO; samples go over as arrays, not as Python numbers."""
    import pyarrow as pa

    flat = [c for r in found if r[2] is not None for c in r[2]]
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c) for c in flat])]).astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.float32), pa.float32()))
    counts = [0 if r[2] is None else len(r[2]) for r in found]
    signals = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), inner, mask=pa.array([r[2] is None for r in found]))
    columns = [pa.array(paths, pa.string()), pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int32()), signals, pa.array([r[3] for r in found], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["path", "sample_rate", "channels", "signal", "error"])


def decode_files(files: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A table of path and content -> samples by channel, of the window that two columns may give; what cannot be decoded has an error instead."""
    bound = lambda c: (F.lit(None) if c is None else F.col(c)).cast("double")
    decoders = list(_DECODERS)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                paths, contents, starts, ends = (batch.column(k)[at : at + 16].to_pylist() for k in range(4))
                yield _audio_batch(paths, [_audio_row(lambda c=c: io.BytesIO(c), a, b, decoders) for c, a, b in zip(contents, starts, ends)])

    return files.select("path", "content", bound(start).alias(WINDOW[0]), bound(end).alias(WINDOW[1])).mapInArrow(run, AUDIO)


def read_audio(df: DataFrame, path: str, root: str = "", start: str | None = None, end: str | None = None, fall_back: str | None = None) -> DataFrame:
    """The rows of a manifest with sample_rate, channels, signal and error: each file is opened where its row is, and of a window only its frames are read.

    Null bounds take the whole file; a window that ends before it starts, a missing file and an unknown codec give an error row.
    fall_back names a second path, read where the first cannot be or is shorter than a second.
    """
    bound = lambda c: (F.lit(None) if c is None else F.col(c)).cast("double")
    extra = [T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("signal", T.ArrayType(T.ArrayType(T.FloatType()))), T.StructField("error", T.StringType())]
    kept = [c for c in df.columns if c not in {f.name for f in extra}]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], bound(start).alias(WINDOW[0]), bound(end).alias(WINDOW[1]))
    schema, decoders = T.StructType([*[df.schema[c] for c in kept], *extra]), list(_DECODERS)

    def opened(name: str | None):
        if name is None:
            raise FileNotFoundError("no path")
        store, at = open_store(f"{root.rstrip('/')}/{name}" if root else name)
        return store.open_input_file(at)

    def one(first: str | None, second: str | None, a: float | None, b: float | None) -> tuple:
        found = _audio_row(lambda: opened(first), a, b, decoders)
        poor = found[2] is None or found[2].shape[1] < found[0]
        return _audio_row(lambda: opened(second), a, b, decoders) if poor and second is not None and second != first else found

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                paths, starts, ends = (part.column(c).to_pylist() for c in (path, *WINDOW))
                seconds = part.column(fall_back).to_pylist() if fall_back else [None] * len(paths)
                audio = _audio_batch(paths, [one(*x) for x in zip(paths, seconds, starts, ends)])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *audio.columns[1:]], [*kept, *audio.schema.names[1:]])

    return rows.mapInArrow(run, schema)


SUBTYPES = {1: "PCM_U8", 2: "PCM_16", 3: "PCM_24", 4: "PCM_32"}


def audio_info(files: DataFrame) -> DataFrame:
    """sample_rate, frames, duration, channels, sample bytes, format and subtype from the header of each file; nulls where it is no WAV."""
    schema = "path string, sample_rate int, num_frames long, duration double, num_channels int, sample_bytes int, format string, subtype string"
    kinds = [f.split()[1] for f in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with wave.open(io.BytesIO(content)) as f:
                        rows.append((path, f.getframerate(), f.getnframes(), f.getnframes() / f.getframerate(), f.getnchannels(), f.getsampwidth(), "WAV", SUBTYPES.get(f.getsampwidth())))
                except (wave.Error, EOFError):
                    rows.append((path, *[None] * 7))
            yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], types[k]) for k in kinds], [f.split()[0] for f in schema.split(", ")])

    return files.select("path", "content").mapInArrow(run, schema)


def rate_folder(target: int) -> str:
    """The name of a rate's folder and columns: 16kHz, 22.05kHz."""
    return f"{target / 1000:g}kHz"


def write_resampled(df: DataFrame, path: str, root: str, export: str, target: int, skip_existing: bool = True) -> DataFrame:
    """Decode, mix down, resample and write each file as 16-bit WAV under export/<rate>/, one status row per row of df.

    Returns path, new_path (relative to export; empty after an error), status (success, skipped, error) and error.
    A file is written under a name of its own and then moved, so a lost task leaves no half file.
    It runs when the result does: write the status rows once, then read them.
    """
    folder, decoders = rate_folder(target), list(_DECODERS)

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    if name is None:
                        raise ValueError("no path")
                    new = f"{folder}/{os.path.splitext(name)[0]}.wav"
                    goal = f"{export.rstrip('/')}/{new}"
                    if skip_existing and exists(goal):
                        rows.append((name, new, "skipped", None))
                        continue
                    store, at = open_store(f"{root.rstrip('/')}/{name}")
                    with store.open_input_file(at) as f:
                        signal, rate = decode_audio(f, decoders=decoders)
                    raw = encode_wav(resample_array(signal.mean(axis=1), rate, target), target)
                    _put(goal, raw)
                    rows.append((name, new, "success", None))
                except (UnreadableAudio, wave.Error, EOFError, ValueError, OSError) as e:
                    rows.append((name, "", "error", f"{type(e).__name__}: {e}"))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["path", "new_path", "status", "error"])

    return df.select(F.col(path).alias("path")).mapInArrow(run, "path string, new_path string, status string, error string")
