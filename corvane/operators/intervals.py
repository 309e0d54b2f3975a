"""Nested event tables, clips, overlap joins and event-sequence segments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved

BEGIN, END = "Begin Time (s)", "End Time (s)"
#: One event of a selection table.
EVENT = "array<struct<selection:bigint,begin:double,end:double,label:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_selection_table(cell: Column, label: str = "Label") -> Column:
    """A tab-separated table in a cell -> array of events; blank and null cells give none. Columns go by the header.

    The cell, its header and each line are split once, so time is linear in the length of the cell.
    """
    place = lambda header, name: (F.array_position(header, F.lit(name)) - 1).cast("int")

    def event(cells: Column, at: Column) -> Column:
        return F.struct(
            F.get(cells, at["selection"]).try_cast("bigint").alias("selection"), F.get(cells, at["begin"]).try_cast("double").alias("begin"),
            F.get(cells, at["end"]).try_cast("double").alias("end"), F.get(cells, at["label"]).alias("label"),
        )

    def places(lines: Column) -> Column:
        return _let(
            F.split(F.get(lines, F.lit(0)), "\t"),
            lambda header: F.struct(place(header, "Selection").alias("selection"), place(header, BEGIN).alias("begin"), place(header, END).alias("end"), place(header, label).alias("label")),
        )

    def events(lines: Column) -> Column:
        body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        return _let(places(lines), lambda at: F.transform(body, lambda line: _let(F.split(line, "\t"), lambda cells: event(cells, at))))

    lines = F.filter(F.split(F.coalesce(cell, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    return F.coalesce(_let(lines, lambda x: F.when(F.size(x) > 1, events(x))), F.array().cast(EVENT))


def write_selection_table(df: DataFrame, by: Sequence[str], begin: str, end: str, label: str, output: str = "selection_table") -> DataFrame:
    """Rows -> one tab-separated table per group, ordered by begin, end and label. A group becomes one cell, as the format asks."""
    events = F.array_sort(F.collect_list(F.struct(F.col(begin).alias("b"), F.col(end).alias("e"), F.col(label).alias("l"))))
    body = F.transform(events, lambda e, i: F.concat_ws("\t", (i + 1).cast("string"), e["b"].cast("string"), e["e"].cast("string"), e["l"]))
    head = "\t".join(["Selection", BEGIN, END, "Label"])
    return df.groupBy(*by).agg(F.concat_ws("\n", F.lit(head), F.array_join(body, "\n")).alias(output))


def clip_to_duration(events: Column, duration: Column) -> Column:
    return F.filter(events, lambda e: e["begin"] < duration)


def available_labels(df: DataFrame, cell: str, label: str = "Label") -> DataFrame:
    events = df.select(F.explode(parse_selection_table(F.col(cell), label)).alias("e"))
    return events.select(F.col("e.label").alias("label")).where("label is not null").distinct().orderBy("label")


def interval_set(events: Column, labels: Sequence[str], unknown: str = "Unknown") -> Column:
    """Distinct (begin, end, label index) of events with end > begin and a known label; `unknown` is -1."""
    known = F.array(*[F.lit(x) for x in labels])
    kept = F.filter(events, lambda e: (e["end"] > e["begin"]) & ((e["label"] == unknown) | F.array_contains(known, e["label"])))
    index = lambda e: F.when(e["label"] == unknown, -1).otherwise(F.array_position(known, e["label"]) - 1).cast("int")
    return F.array_distinct(F.transform(kept, lambda e: F.struct(e["begin"].alias("begin"), e["end"].alias("end"), index(e).alias("label"))))


def sliding_clips(df: DataFrame, duration: str, clip: float, hop: float, offset: float = 0.0) -> DataFrame:
    """A row per clip: clip number, start, end. The count is floor((duration - clip - offset) / hop), so the last that fits is left out."""
    n = F.greatest(F.lit(0), F.floor((F.col(duration) - clip - offset) / hop)).cast("int")
    rows = df.withColumn("_n", n).where("_n > 0").withColumn("clip", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    start = F.col("clip") * F.lit(float(hop)) + F.lit(float(offset))
    return rows.withColumn("clip_start", start).withColumn("clip_end", start + F.lit(float(clip)))


def overlap_join(clips: DataFrame, events: DataFrame, key: str, start: str, end: str, begin: str, stop: str, width: float, how: str = "left") -> DataFrame:
    """clips x events of one file that overlap, half-open.

    The equi key is the file and a time bin of `width`: a file with very many events
    is spread over its bins. A pair is taken in the first bin that both lie in, so none comes twice.
    """
    names = clips.columns
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))
    left = clips.withColumn("_clip", F.monotonically_increasing_id()).withColumn("_bin", F.explode(bins(start, end)))
    right = events.where(F.col(stop) > F.col(begin)).withColumn("_ebin", F.explode(bins(begin, stop))).withColumnRenamed(key, "_key")
    first = F.floor(F.greatest(F.col(start), F.col(begin)) / width)
    met = (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_ebin")) & (F.col(begin) < F.col(end)) & (F.col(stop) > F.col(start)) & (F.col("_bin") == first)
    extra = [c for c in events.columns if c != key]
    inner = left.join(right, met).select(*names, *extra)
    if how == "inner":
        return inner
    inner = saved(inner, "overlaps")  # read twice, joined once
    seen = inner.select(*[F.col(n).alias(f"_{n}") for n in (key, start, end)]).distinct()
    lone = clips.join(seen, [F.col(n) == F.col(f"_{n}") for n in (key, start, end)], "left_anti")
    return inner.unionByName(lone, allowMissingColumns=True)


def clip_relative(met: DataFrame, start: str, end: str, begin: str, stop: str) -> DataFrame:
    """Events of overlap_join (inner) in the time of their clip: rel_begin and rel_end, cut at its borders."""
    rel = lambda c: c - F.col(start)
    return met.withColumns({"rel_begin": rel(F.greatest(begin, start)), "rel_end": rel(F.least(stop, end))})


def cut_segments(
    rows: DataFrame, by: str, signal: str | Callable[[Column, Column], Column], rate: int, begin: str, stop: str, name: str, least: int = 10, length: Column | None = None
) -> DataFrame:
    """Rows of segments() with times from the segment's start, its samples and a name with the suffix _song<number>, numbered from 0.

    A segment runs from its first begin to its last stop, within the signal; one of fewer than
    `least` samples is dropped, and keeps its number. signal names a column of samples, or gives the samples of a window
    from (first, number) where they are cut, for signals of `length` samples that are not to travel whole with each row.
    Samples are cut once per segment, after the only shuffle. Rows with a null key are dropped.
    """
    named = isinstance(signal, str)
    own = [c for c in rows.columns if c not in (by, "segment") and not (named and c == signal)]
    whole = F.first(F.size(signal) if named else length)
    found = rows.where(F.col(by).isNotNull()).groupBy(by, "segment").agg(
        F.min(begin).alias("_from"), F.max(stop).alias("_to"), F.first(name).alias("_name"), whole.alias("_length"),
        F.collect_list(F.struct(*own)).alias("_rows"), *([F.first(signal).alias("_signal")] if named else []),
    )
    numbered = found.withColumn("_number", F.row_number().over(Window.partitionBy(by).orderBy("segment")) - 1)
    first = F.greatest(F.lit(0), (F.col("_from") * rate).cast("int"))
    last = F.least(F.col("_length"), (F.col("_to") * rate).cast("int"))
    kept = numbered.withColumns({"_first": first, "_n": F.greatest(last - first, F.lit(0))}).where(F.col("_n") >= least)
    cut = F.slice("_signal", F.col("_first") + 1, F.col("_n")) if named else F.when(F.col("_n") > 0, signal(F.col("_first"), F.col("_n"))).otherwise(F.array())
    stem = F.regexp_replace("_name", r"(?<=.)\.[^./]*$", "")
    parts = kept.select(by, "segment", "_from", "_rows", cut.alias("samples"), F.concat(stem, F.lit("_song"), F.col("_number").cast("string"), F.lit(".wav")).alias("segment_name"))
    out = parts.select(by, "segment", "_from", "samples", "segment_name", F.explode("_rows").alias("_row"))
    moved = {begin: F.col(f"_row.{begin}") - F.col("_from"), stop: F.col(f"_row.{stop}") - F.col("_from")}
    return out.select(by, "segment", *[moved[c].alias(c) if c in moved else F.col(f"_row.{c}") for c in own], "samples", "segment_name")


def segments(df: DataFrame, by: str, order: Sequence[str], label: str, first: str, middle: str, last: str) -> DataFrame:
    """Rows of complete segments: from `first` over `middle`s to the next `last`; a new `first` restarts, other labels are ignored.

    Order matters within a key, so a key is one sorted run of a task (it spills, and is
    shuffled once for all windows); give a recording, not a whole collection, as the key.
    """
    rows = df.where(F.col(label).isin(first, middle, last))
    upto = Window.partitionBy(by).orderBy(*order)
    rows = rows.withColumn("_segment", F.sum((F.col(label) == first).cast("int")).over(upto)).where("_segment > 0")
    inside = Window.partitionBy(by, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col(label) == last).cast("int")).over(inside), F.lit(0))
    rows = rows.withColumn("_ended", ended).where("_ended = 0")
    whole = F.max((F.col(label) == last).cast("int")).over(Window.partitionBy(by, "_segment"))
    return rows.withColumn("_whole", whole).where("_whole = 1").drop("_ended", "_whole").withColumnRenamed("_segment", "segment")
