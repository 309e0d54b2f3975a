"""Manifest sources and sinks."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import number_of
from ..shared import discard, saved, small
from .files import exists


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the block of the file that a line lies in), id and text of each line; start and id give the order in a file."""
    meta = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    return spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))


def without_head(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """text: the lines of each file after its first `skip`. Only the lines of a file's first block are ranked."""
    lines = numbered_lines(spark, path)
    rank = F.row_number().over(Window.partitionBy("file").orderBy("id"))
    head = lines.where("start = 0").withColumn("_rank", rank).where(F.col("_rank") > skip).drop("_rank")
    return head.unionByName(lines.where("start > 0")).select("text")


def from_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None, strings: bool = False, dirty: bool = False, quoted: bool = True, header: bool = True, skip: int = 0) -> DataFrame:
    """Inferred types (or a schema, or all strings); only an empty cell is null; cells may hold line breaks.

    Without a header, columns are _c0, _c1 and so on. dirty drops lines that do not fit the
    schema. With skip, that many lines at the head of each file are passed over; cells then
    hold no line breaks. Types are inferred from all rows: give a schema for large tables.
    """
    reader = spark.read.option("header", header).option("sep", sep).option("nullValue", "").option("multiLine", quoted and not skip).option("escape", '"')
    if not quoted:
        reader = reader.option("quote", "")
    if dirty:
        reader = reader.option("mode", "DROPMALFORMED")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", not strings)
    if not skip:
        return reader.csv(path)
    lines = without_head(spark, path, skip)._jdf
    return DataFrame(reader._jreader.csv(getattr(lines, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())), spark)


def distinct_paths(spark: SparkSession, files: Sequence[str], column: str, suffix: str) -> DataFrame:
    """path: the distinct values of a column over several split files, all read as strings, that end with the suffix."""
    paths = [from_csv(spark, f, strings=True).select(F.col(column).alias("path")) for f in files]
    return functools.reduce(DataFrame.unionByName, paths).where(F.col("path").endswith(suffix)).distinct()


def from_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return from_csv(spark, path, sep="\t", **options)


def from_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.option("multiLine", not lines).json(path)


def from_parquet(spark: SparkSession, path: str, row_index: str | None = None) -> DataFrame:
    """With row_index, rows are numbered 0.. over all files, by path and place in the file; the counts of the files meet on the driver."""
    df = spark.read.parquet(path)
    if row_index is None:
        return df
    where = F.col("_metadata.file_path").alias("_file")
    counts = sorted(tuple(r) for r in df.select(where).groupBy("_file").count().collect())
    before, total = [], 0
    for file, n in counts:
        before.append((file, total))
        total += n
    side = spark.createDataFrame(before, "_file string, _before long")
    rows = df.select("*", where, F.col("_metadata.row_index").alias("_at")).join(small(side), "_file")
    return rows.select(*df.columns, (F.col("_before") + F.col("_at")).alias(row_index))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".parquet": from_parquet,
    ".csv": from_csv,
    ".tsv": from_tsv,
    ".json": from_json,
    ".jsonl": lambda spark, path: from_json(spark, path, lines=True),
    ".ndjson": lambda spark, path: from_json(spark, path, lines=True),
}


def from_path(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending."""
    ending = PurePosixPath(path).suffix.lower()
    if ending not in READERS:
        raise ValueError(f"no reader for {ending or 'a path without ending'}")
    return READERS[ending](spark, path)


def from_split(spark: SparkSession, splits: dict[str, str], split: str) -> DataFrame:
    if split not in splits:
        raise LookupError(f"no split {split!r}; there are {sorted(splits)}")
    return from_path(spark, splits[split])


def from_version(versions: dict[str, dict[str, str]], version: str) -> dict[str, str]:
    if version not in versions:
        raise ValueError(f"no version {version!r}; there are {sorted(versions)}")
    return versions[version]


def file_table(spark: SparkSession, folder: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """The files of a folder as rows, found by Spark's reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files if content else files.drop("content")


def paired_files(spark: SparkSession, folder: str, pattern: str, other_suffix: str) -> DataFrame:
    """path and annotation: files that match the pattern, each with the file of the same folder and stem that ends with other_suffix, or null."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    ours = file_table(spark, folder, pattern).select("path", stem("path").alias("_stem"))
    theirs = file_table(spark, folder, f"*{other_suffix}").select(F.col("path").alias("annotation"), F.expr(f"left(path, length(path) - {len(other_suffix)})").alias("_stem"))
    return ours.join(theirs, "_stem", "left").select("path", "annotation")


def two_line_records(spark: SparkSession, path: str, low: float = 0.0, high: float = 8000.0) -> DataFrame:
    """begin, end, label, low_hz, high_hz of data lines, each with an optional frequency line that begins with a backslash.

    Malformed data lines are left out; a missing or malformed frequency line gives the defaults. Files are read line by line.
    """
    order = Window.partitionBy("file").orderBy("start", "id")
    text = numbered_lines(spark, path).withColumns({"line": F.row_number().over(order) - 1, "next": F.lead("text").over(order)})
    cells = F.split("text", "\t")
    after = F.split(F.when(F.col("next").startswith("\\"), F.col("next")), "\t")
    rows = text.where(~F.col("text").startswith("\\")).select(
        "file", "line", number_of(F.get(cells, F.lit(0)), "double").alias("begin"), number_of(F.get(cells, F.lit(1)), "double").alias("end"), F.get(cells, F.lit(2)).alias("label"),
        number_of(F.get(after, F.lit(1)), "double", low).alias("low_hz"), number_of(F.get(after, F.lit(2)), "double", high).alias("high_hz"),
    )
    return rows.where("begin is not null and end is not null and label is not null")


def to_csv(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    (df.coalesce(1) if single else df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def to_json(df: DataFrame, path: str, by: str | None = None, full: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines, in a folder per value of `by` if given; and with `full` one more file of all rows in that folder."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)
    if full:
        df.coalesce(1).write.mode(mode).json(full)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append to a Parquet table the rows whose key it lacks, one of each key; the number appended. Null keys are equal."""
    spark = df.sparkSession
    new = df.dropDuplicates(list(keys))
    if exists(path):
        marks = [f"_k{i}" for i in range(len(keys))]
        old = spark.read.parquet(path).select(*[F.col(k).alias(m) for k, m in zip(keys, marks)]).distinct()
        new = new.join(old, functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks))), "left_anti")
    new = saved(new, "arrivals")
    n = new.count()
    new.write.mode("append").parquet(path)
    discard(new)
    return n


def append_csv(df: DataFrame, path: str) -> None:
    to_csv(df, path, mode="append")


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
