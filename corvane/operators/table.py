"""Table operators: projection, filters, distinct-on, positional access and unions on DataFrames.

Row position is explicit: a BIGINT column ORDINAL, hidden from columns().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import BROADCAST_BYTES, discard, saved, small

ORDINAL = "_ordinal"
HIDDEN_PREFIX = "_source_"


class MergeException(ValueError):
    """Tables that cannot be merged at the level asked for."""


def columns(df: DataFrame) -> list[str]:
    """Visible columns; nothing is run."""
    return [c for c in df.columns if c != ORDINAL and not c.startswith(HIDDEN_PREFIX)]


def need(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns {missing} not found; available: {columns(df)}")


def with_ordinal(df: DataFrame, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Number rows 0.. in the order of a key, or in partition order where there is none.

    The rows are written once with their partition and place in it; of those only
    the row counts of the partitions meet on the driver: no global window, no Python.
    """
    ordered = df.sort(*order_by) if order_by else df
    within = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)
    rows = saved(ordered.withColumns({"_part": F.spark_partition_id(), "_place": within}), "numbered")
    before, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((part, total))
        total += n
    side = df.sparkSession.createDataFrame(before, "_part int, _before long")
    out = rows.join(F.broadcast(side), "_part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_place")).alias(ORDINAL))


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if not names:
        raise ValueError("no columns asked for")
    need(df, names)
    return df.select(*names)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Names that do not exist are ignored."""
    return df.withColumnsRenamed(mapping)


def add_column(df: DataFrame, name: str, value: Any, key: str | None = None) -> DataFrame:
    """A constant, or a list by position in the order of `key`; the list must have a value per row."""
    if not isinstance(value, (list, tuple)):
        return df.withColumn(name, F.lit(value))
    placed = df if ORDINAL in df.columns else with_ordinal(df, [key] if key else None)
    n = placed.count()
    if n != len(value):
        raise ValueError(f"{len(value)} values for {n} rows")
    side = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(value)], [ORDINAL, name])
    out = placed.join(F.broadcast(side), ORDINAL)
    return out if ORDINAL in df.columns else out.drop(ORDINAL)


def map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def map_column(df: DataFrame, name: str, mapping: dict, output: str, default: Any = None, value_type: str | None = None) -> DataFrame:
    """Dictionary lookup; unmapped and null keys give the default, or null. An empty mapping gives an all-null column.

    The mapping is always a joined table, broadcast up to BROADCAST_BYTES, so the plan
    does not grow with it. The output has the type of the values, or of value_type;
    an empty mapping without default or type gives strings.
    """
    need(df, [name])
    kept = [F.col(f"`{c}`") for c in df.columns if c != output]
    values = [v for v in [*mapping.values(), default] if v is not None]
    kind = T._parse_datatype_string(value_type) if value_type else T._infer_type(values[0]) if values else T.StringType()
    if not mapping:
        return df.select(*kept, F.lit(default).cast(kind).alias(output))
    schema = T.StructType([T.StructField("_key", T._infer_type(next(iter(mapping)))), T.StructField("_value", kind)])
    side = df.sparkSession.createDataFrame(list(mapping.items()), schema)
    if sum(32 + len(str(k)) + len(str(v)) for k, v in mapping.items()) <= BROADCAST_BYTES:
        side = F.broadcast(side)
    out = df.join(side, F.col(name) == F.col("_key"), "left")
    value = F.col("_value") if default is None else F.coalesce("_value", F.lit(default).cast(kind))
    return out.select(*kept, value.alias(output))


#: Mappings of lists are part of the plan up to so many entries, and a joined table beyond.
LITERAL_VALUES = 1000


def map_list(df: DataFrame, name: str, mapping: dict, output: str) -> DataFrame:
    """The value of each element of a list, in order; null where there is none, and for a null list."""
    need(df, [name])
    if not mapping:
        return df.withColumn(output, F.transform(name, lambda x: F.lit(None).cast("string")))
    if len(mapping) <= LITERAL_VALUES:
        codes = map_literal(mapping)
        return df.withColumn(output, F.transform(name, lambda x: F.element_at(codes, x)))
    rows = saved(df.withColumn("_row", F.monotonically_increasing_id()), "listed")
    each = map_column(rows.select("_row", F.posexplode(name).alias("_pos", "_v")), "_v", mapping, "_code")
    found = each.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_code"))), lambda p: p["_code"]).alias("_codes"))
    none = F.when(F.col(name).isNotNull(), F.array().cast(found.schema["_codes"].dataType))
    return rows.join(found, "_row", "left").select(*[F.col(f"`{c}`") for c in df.columns if c != output], F.coalesce("_codes", none).alias(output))


def _keyed(other: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One row per non-null key, of repeated keys the one with the smallest values, nulls last."""
    order = [c for v in values for c in (F.col(v).isNull(), F.col(v))]
    found = other.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_found"))
    return found.select("_key", *[F.col(f"_found.{v}").alias(f"_v{i}") for i, v in enumerate(values)])


def look_up(df: DataFrame, name: str, other: DataFrame, key: str, values: Sequence[str], missing: Any = None) -> DataFrame:
    """Every row with the columns `values` of the row of `other` whose key equals its `name`.

    Of repeated keys the smallest values count, nulls last, so no row is multiplied. Rows
    without a match, and null names, get `missing` (null). Columns of those names in df are replaced.
    """
    need(df, [name])
    side = saved(_keyed(other, key, values), "look-up")
    out = df.withColumn("_key", F.col(name)).join(small(side), "_key", "left")
    fill = lambda c: c if missing is None else F.coalesce(c, F.lit(missing))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *[fill(F.col(f"_v{i}")).alias(v) for i, v in enumerate(values)])


def look_up_or_fill(df: DataFrame, name: str, known: DataFrame, key: str, values: Sequence[str], fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """look_up, with a fall-back for names that `known` lacks: (rows with values, known with what was fetched inserted).

    fetch gets the distinct missing names (one column, `key`) and returns rows of key and
    values for those it finds; it is called on one table, not per row.
    """
    need(df, [name])
    names = df.select(F.col(name).alias(key)).where(F.col(key).isNotNull()).distinct()
    fetched = saved(fetch(names.join(known.select(key), key, "left_anti")).select(key, *values), "fetched")
    grown = known.unionByName(fetched, allowMissingColumns=True)
    return look_up(df, name, grown, key, values), grown


def take_and_give(df: DataFrame, mapping: dict[str, str], strict: bool = True, always: Sequence[str] = ()) -> DataFrame:
    """Pick and rename; missing names raise if strict and are skipped otherwise; `always` come along unless mapped."""
    if strict:
        need(df, list(mapping))
    chosen = [F.col(a).alias(b) for a, b in mapping.items() if a in df.columns]
    return df.select(*chosen, *[c for c in always if c in df.columns and c not in mapping])


def drop_empty(df: DataFrame, named: Sequence[str] = (), index_prefix: str = "Unnamed") -> DataFrame:
    """Without index-like, named and all-null columns; one aggregate finds the empty ones."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    gone = [c for c in df.columns if c.startswith(index_prefix) or c in named or not counts[c]]
    return df.drop(*gone)


def filter_isin(df: DataFrame, name: str, values: Sequence, negate: bool = False, keep_nulls: bool = False) -> DataFrame:
    """Membership; null cells match neither way unless keep_nulls with negate."""
    need(df, [name])
    inside = F.col(name).isin(list(values))
    if not negate:
        return df.where(inside)
    return df.where(~inside | F.col(name).isNull() if keep_nulls else ~inside)


def dropna(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without null in the subset; NaN is a value."""
    names = list(subset) if subset else columns(df)
    need(df, names)
    for n in names:
        df = df.where(F.col(n).isNotNull())
    return df


def contains_any(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    return df.where(F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])))


def unique(df: DataFrame, name: str) -> DataFrame:
    need(df, [name])
    return df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name)


def histogram(df: DataFrame, name: str, count: str = "n") -> DataFrame:
    need(df, [name])
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias(count))


def _has_size(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def deduplicate(df: DataFrame, subset: Sequence[str] | None, order: Sequence[str], keep: str = "first") -> DataFrame:
    """The first or last row of each key in the given order, with all its columns; nulls are equal.

    Partial aggregates instead of a ranking window: a key of any share is combined
    before the shuffle. Keys without a fixed size (texts, lists) are grouped by 128
    bits of hash, so that neither the shuffle nor the sort within it handles them; the
    key columns themselves travel only if they are used. Ties of the order go by the
    other columns; map columns come along but decide nothing, and cannot be keys.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    names = list(subset) if subset else columns(df)
    need(df, names)
    kind = {f.name: f.dataType for f in df.schema.fields}
    if any(_has_map(kind[n]) for n in names):
        raise ValueError("map columns cannot be keys; name a subset without them")
    rest = [c for c in df.columns if c not in names]
    if not rest:
        return df.distinct()
    tail = [c for c in rest if c not in order and not _has_map(kind[c])]
    pick = F.min_by if keep == "first" else F.max_by
    best = pick(F.struct(*rest), F.struct(*order, *tail)).alias("_best")
    if all(_has_size(kind[n]) for n in names):
        out = df.groupBy(*names).agg(best)
    else:
        marks = [*names, *[F.col(n).isNull() for n in names]]
        out = df.groupBy(F.xxhash64(*marks).alias("_k1"), F.xxhash64(F.lit(1), *marks).alias("_k2")).agg(best, *[F.first(n).alias(n) for n in names])
    return out.select(*[F.col(c) if c in names else F.col(f"_best.{c}").alias(c) for c in df.columns])


def max_rows(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is the greatest of their group, all of them if several are; nulls in keys match nothing."""
    need(df, [*by, value])
    best = df.groupBy(*by).agg(F.max(value).alias(value))
    return df.join(best, [*by, value]).select(*df.columns)


def outer_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join on equally named keys, which come once; rows with a null key stay, unmatched."""
    return left.join(right, list(on), "outer")


def rows_in(df: DataFrame, name: str, other: DataFrame, other_name: str, negate: bool = False) -> DataFrame:
    """Rows whose value occurs in a column of another table, or with negate those whose value does not.

    A null value is in nothing, so it stays with negate; nulls of the other table count for nothing.
    """
    side = other.select(F.col(other_name).alias("_in")).where("_in is not null").distinct()
    return df.join(side, F.col(name) == F.col("_in"), "left_anti" if negate else "left_semi")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that both have; columns by position; nulls are equal."""
    return left.intersect(right)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left less those of right, as often as each has them; nulls are equal."""
    return left.exceptAll(right)


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two numbered tables with the same number, side by side; the shorter one decides how many."""
    return left.join(right, ORDINAL)


def proportions(df: DataFrame, name: str, output: str = "share") -> DataFrame:
    """Share of each value among all rows that have one; nothing for an empty table."""
    counts = saved(histogram(df, name, "_n"), "counts")
    total = counts.agg(F.sum("_n")).first()[0]
    return counts.select(name, (F.col("_n") / F.lit(total)).alias(output))


def grouped_mean(df: DataFrame, by: str | Column, value: str, output: str) -> DataFrame:
    """Mean of each group to 6 digits; nulls do not count, a group of nulls has none."""
    return df.groupBy(by).agg(F.round(F.avg(value), 6).alias(output))


def string_sets(df: DataFrame, by: str, value: str, output: str, sep: str = ",") -> DataFrame:
    """Distinct lower-cased values of each group, sorted and joined; a group of nulls gets the empty string."""
    lower = df.select(by, F.lower(value).alias("_v")).distinct()
    return lower.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("_v")), sep).alias(output))


def group_extremes(df: DataFrame, by: str, value: str, kind: str) -> DataFrame:
    """low and high of a value, and how many kinds there are, of each group; nulls do not count."""
    return df.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.countDistinct(kind).alias("kinds"))


def duplicate_count(df: DataFrame, name: str) -> DataFrame:
    """One row: n, and copies, the rows beyond the first of each value. Texts are told apart by SHA-256; nulls are all copies."""
    return df.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct(F.sha2(F.col(name).cast("string"), 256))).alias("copies"))


def top_k(df: DataFrame, name: str, k: int) -> DataFrame:
    """The k most frequent values with their counts n; ties by value; nulls do not count."""
    return histogram(df, name).orderBy(F.desc("n"), name).limit(k)


def n_distinct(df: DataFrame, name: str) -> int:
    """How many values a column has; nulls do not count."""
    need(df, [name])
    return df.agg(F.countDistinct(name)).first()[0]


def shape(df: DataFrame) -> tuple[int, int]:
    """Rows and visible columns."""
    return df.count(), len(columns(df))


def column_exists(df: DataFrame, name: str) -> bool:
    """Whether there is such a column, hidden ones included; nothing is run."""
    return name in df.columns


def apply(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """fn on batches of rows as pandas frames; it returns a frame of the schema for each. The schema is needed: a plan has types before it runs."""
    if not callable(fn):
        raise TypeError("fn is not callable")
    if df.isStreaming:
        raise RuntimeError("Cannot perform 'apply' in streaming mode")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def row_at(df: DataFrame, i: int) -> dict:
    """Row i as a dict; IndexError beyond the table."""
    row = df.where(F.col(ORDINAL) == i).first()
    if row is None:
        raise IndexError(i)
    return {c: row[c] for c in columns(df)}


def rows_at(df: DataFrame, places: Sequence[int]) -> DataFrame:
    """Rows in the order asked for, repeats allowed."""
    side = df.sparkSession.createDataFrame(list(enumerate(places)), "_place long, _at long")
    if 32 * len(places) <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return df.join(side, F.col(ORDINAL) == F.col("_at")).orderBy("_place").drop("_at", "_place")


def rows_slice(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start:stop:step of a numbered table; open and negative bounds as in a Python slice, steps forward only."""
    if step < 1:
        raise ValueError("step is at least 1")
    place = F.col(ORDINAL)
    if (start or 0) < 0 or (stop or 0) < 0:
        last = df.agg(F.max(ORDINAL)).first()[0]
        start, stop, _ = slice(start, stop).indices(0 if last is None else last + 1)
    out = df.where((place >= (start or 0)) & ((place - (start or 0)) % step == 0))
    return out if stop is None else out.where(place < stop)


def batches(df: DataFrame, size: int) -> DataFrame:
    """Rows with their batch number; the last batch may be short."""
    return df.withColumn("batch", F.floor(F.col(ORDINAL) / size).cast("long"))


def batch_tables(df: DataFrame, size: int) -> Iterator[DataFrame]:
    """Tables of `size` rows of a numbered table, in order; the last may be short."""
    last = df.agg(F.max(ORDINAL)).first()[0]
    for at in range(0, -1 if last is None else last + 1, size):
        yield rows_slice(df, at, at + size).orderBy(ORDINAL)


def iterate(df: DataFrame) -> Iterator[dict]:
    names = columns(df)
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield {c: row[c] for c in names}


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _aligned(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Columns that differ in type: numbers widen, anything else becomes text."""
    kinds: dict[str, list] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)
    to: dict[str, str] = {}
    for name, found in kinds.items():
        if len({k.simpleString() for k in found}) > 1:
            if all(isinstance(k, _NUMBERS) for k in found):
                whole = all(not isinstance(k, (T.FloatType, T.DoubleType)) for k in found)
                to[name] = "bigint" if whole else "double"
            else:
                to[name] = "string"
    return [df.select(*[F.col(c).cast(to[c]) if c in to else F.col(c) for c in df.columns]) for df in frames]


def concat(frames: Sequence[DataFrame], level: str = "soft", provenance: bool = False, sort: bool = False) -> DataFrame:
    """Union by name. hard: equal column sets; overlap: common columns; soft: all, missing ones null.

    provenance adds the number of the source table and, where rows are numbered, the row in it.
    """
    if not frames:
        raise ValueError("nothing to concatenate")
    if provenance:
        frames = [
            df.withColumn("_source_dataset", F.lit(i)).withColumn("_source_index", F.col(ORDINAL) if ORDINAL in df.columns else F.lit(None).cast("long"))
            for i, df in enumerate(frames)
        ]
    if level == "hard":
        if any(set(df.columns) != set(frames[0].columns) for df in frames):
            raise MergeException("columns differ: " + "; ".join(str(columns(df)) for df in frames))
    elif level == "overlap":
        common = [c for c in frames[0].columns if all(c in df.columns for df in frames)]
        if not [c for c in common if not c.startswith("_")]:
            raise MergeException("no column in common")
        frames = [df.select(*common) for df in frames]
    elif level != "soft":
        raise ValueError(f"unknown merge level {level!r}")
    out, *rest = _aligned(frames)
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*sorted(out.columns)) if sort else out


def top_and_other(df: DataFrame, name: str, k: int, other: str = "other") -> DataFrame:
    """Counts of the k most frequent values (ties by value) and of all the rest together."""
    counts = histogram(df, name)
    top = counts.orderBy(F.desc("n"), name).limit(k).select(F.col(name).alias("_top"))
    label = F.when(F.col("_top").isNotNull(), F.col(name)).otherwise(F.lit(other))
    return counts.join(F.broadcast(top), F.col(name) == F.col("_top"), "left").groupBy(label.alias(name)).agg(F.sum("n").alias("n"))


def prefix_unique(rows: DataFrame, key: str, name: str, others: DataFrame, other_key: str, other_name: str, sep: str = "-", parts: int = 5) -> DataFrame:
    """key, parts, hit of every row: the shortest prefix of 1 to `parts` parts that one other name starts with, and the key of that other.

    Both are null where no prefix is unique, and for a null name. The other names
    are cut at every length that a prefix has, so prefixes meet them by equality.
    """
    split = F.split(F.col(name), f"\\Q{sep}\\E")
    longest = F.least(F.size(split), F.lit(parts))
    paths = F.transform(F.sequence(F.lit(1), longest), lambda k: F.struct(k.alias("parts"), F.array_join(F.slice(split, 1, k), sep).alias("prefix")))
    tried = rows.where(F.col(name).isNotNull()).select(F.col(key).alias("_key"), F.inline(paths))
    side = others.select(F.col(other_key).alias("_hit"), F.col(other_name).alias("_name"))
    cut = _cuts(side, "_name", tried, "prefix", lambda text, n: F.array(F.substring(text, F.lit(1), n)))
    alone = tried.select("prefix").distinct().join(cut.withColumnRenamed("_gram", "prefix"), "prefix").groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("_hit").alias("hit")).where("n = 1")
    found = tried.join(alone, "prefix").groupBy("_key").agg(F.min("parts").alias("parts"), F.min_by("hit", "parts").alias("hit"))
    return rows.select(key).join(found, F.col(key) == F.col("_key"), "left").select(key, "parts", "hit")


def _cuts(side: DataFrame, text: str, wanted: DataFrame, word: str, cut: Callable[[Column, Column], Column], most: int | None = None) -> DataFrame:
    """side with _gram: the pieces of its text, as cut(text, n) lists them, for each length n that a wanted word has (`most` at most).

    The lengths are few: no more than the longest wanted word is long.
    """
    length = F.length(word) if most is None else F.least(F.length(word), F.lit(most))
    lengths = sorted(r[0] for r in wanted.select(length).distinct().collect() if r[0] is not None)
    if not lengths:
        return side.limit(0).withColumn("_gram", F.lit(""))
    sized = side.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(F.length(text) >= F.col("_n"))
    return sized.withColumn("_gram", F.explode(cut(F.col(text), F.col("_n")))).drop("_n")


#: Words are found by their first so many characters, then compared whole.
GRAM = 6


def contains_first(rows: DataFrame, key: str, text: str, others: DataFrame, other_key: str, other_text: str, sep: str = ",") -> DataFrame:
    """key, hits of every row: for each word of the text in order, the first other row (by key) whose text contains the whole word.

    Words that no row contains and the word None are passed over; hits is null where there are none.
    The other texts are cut into runs as long as a word's first GRAM characters, so words meet them by equality.
    """
    words = rows.select(F.col(key).alias("_key"), F.posexplode(F.split(F.col(text), f"\\Q{sep}\\E")).alias("pos", "word")).where("word <> 'None'")
    side = others.select(F.col(other_key).alias("_other"), F.col(other_text).alias("_text"))
    runs = lambda t, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, n)))
    grams = _cuts(side, "_text", words, "word", runs, GRAM)
    distinct = words.select("word").distinct().withColumn("_gram", F.substring("word", 1, GRAM))
    first = distinct.join(grams, "_gram").where(F.contains("_text", "word")).groupBy("word").agg(F.min("_other").alias("hit"))
    found = words.join(first, "word").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", "hit"))).alias("_pairs"))
    return rows.select(key).join(found, F.col(key) == F.col("_key"), "left").select(key, F.transform("_pairs", lambda p: p["hit"]).alias("hits"))


def resolve_pointers(spark: SparkSession, table: DataFrame, depth: int | None = None) -> DataFrame:
    """id, parent, accepted, rank, status -> id, resolved: follow parents up to a species, then accepted ids.

    Chains of any length are followed: each step doubles the way, so the bits of the
    number of rows bound the steps, and what is open then goes in a circle. Cycles and
    dangling ids end unresolved (null). A depth, if given, closes chains that are longer.
    """
    species = F.col("rank").eqNullSafe("species")
    done = species & F.coalesce(F.col("status").isin("accepted", "doubtful"), F.lit(False))
    ahead = F.when(done, F.col("id")).when(species, F.col("accepted")).otherwise(F.col("parent"))
    state = saved(table.select("id", ahead.alias("at"), done.alias("done")), "pointers")
    dim = state.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("done").alias("_done"))
    for _ in range(depth or 0):
        joined = state.join(dim, F.col("at") == F.col("_id"), "left")
        state = saved(joined.select("id", F.when(F.col("done"), F.col("at")).otherwise(F.col("_at")).alias("at"), (F.col("done") | F.coalesce("_done", F.lit(False))).alias("done")), "pointers")
    for _ in range(state.count().bit_length() if depth is None else 0):
        if state.where("not done and at is not null").isEmpty():
            break
        other = state.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        joined = state.join(other, F.col("at") == F.col("_id"), "left")
        state, before = saved(joined.select("id", F.col("_at").alias("at"), F.coalesce("_done", F.lit(False)).alias("done")), "pointers"), state
        discard(before)
    return state.select("id", F.when(F.col("done"), F.col("at")).alias("resolved"))


def resolve_names(names: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """name, resolved of every row: the id that the name leads to; table also has a column name.

    Of rows with the same name the accepted one stands for all (the lowest id if there
    are several or none), at the start and wherever a pointer leads to the name.
    """
    order = F.struct((~F.col("status").eqNullSafe("accepted")).alias("late"), "id")
    first = table.where("name is not null").groupBy("name").agg(F.min_by(F.struct("id", "parent", "accepted", "rank", "status"), order).alias("r")).select("name", "r.*")
    stands = table.select(F.col("id").alias("_from"), "name").join(first.select("name", F.col("id").alias("_to")), "name").select("_from", "_to")
    for pointer in ("parent", "accepted"):
        first = first.join(stands, F.col(pointer) == F.col("_from"), "left").withColumn(pointer, F.col("_to")).drop("_from", "_to")
    found = resolve_pointers(table.sparkSession, first.select("id", "parent", "accepted", "rank", "status"))
    by_name = first.select(F.col("name").alias("_name"), "id").join(found, "id").select("_name", "resolved")
    return names.select(name).join(by_name, F.col(name) == F.col("_name"), "left").select(name, "resolved")
