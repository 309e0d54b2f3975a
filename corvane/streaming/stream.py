"""Manifests that arrive over time, and the rules of lazy tables.

A lazy table allows row-wise operators; what needs positions or the whole table
raises, or runs the table with a warning.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling, table


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "")
    return reader.load(path)


def distinct_stream(df: DataFrame, keys: Sequence[str], time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """First arrival per key; with an event time, state older than the delay is let go."""
    if time is None:
        return df.dropDuplicates(list(keys))
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(df: DataFrame, time: str, by: Sequence[str], width: str, delay: str = "10 minutes") -> DataFrame:
    return df.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))


class LazyTable:
    """A DataFrame under the rules of lazy tables."""

    def __init__(self, df: DataFrame):
        self.df, self.is_streaming = df, True

    def __getitem__(self, key):
        raise RuntimeError("Cannot use __getitem__ in streaming mode")

    def __len__(self) -> int:
        raise NotImplementedError("Cannot get length in streaming mode")

    def apply(self, fn: Callable) -> None:
        raise RuntimeError("Cannot perform 'apply' in streaming mode")

    def __iter__(self) -> Iterator[dict]:
        return table.iterate(self.df)

    @property
    def columns(self) -> list[str]:
        return table.columns(self.df)

    def _with(self, df: DataFrame) -> LazyTable:
        return LazyTable(df)

    def filter_isin(self, name: str, values: Sequence, negate: bool = False) -> LazyTable:
        return self._with(table.filter_isin(self.df, name, values, negate))

    def dropna(self, subset: Sequence[str] | None = None) -> LazyTable:
        return self._with(table.dropna(self.df, subset))

    def map_column(self, name: str, mapping: dict, output: str, default=None) -> LazyTable:
        return self._with(table.map_column(self.df, name, mapping, output, default))

    def select_columns(self, names: Sequence[str]) -> LazyTable:
        return self._with(table.select_columns(self.df, names))

    def rename_columns(self, mapping: dict[str, str]) -> LazyTable:
        return self._with(table.rename_columns(self.df, mapping))

    def drop_duplicates(self, subset: Sequence[str] | None = None) -> LazyTable:
        return self._with(self.df.dropDuplicates(list(subset) if subset else None))

    def _whole(self, what: str) -> DataFrame:
        warnings.warn(f"{what} runs the whole table in streaming mode", UserWarning, stacklevel=3)
        return self.df

    def get_unique(self, name: str) -> list:
        return [r[0] for r in table.unique(self._whole("get_unique"), name).collect()]

    def histogram(self, name: str) -> dict:
        return {r[0]: r["n"] for r in table.histogram(self._whole("histogram"), name).collect()}

    def subsample(self, name: str, ratios: dict, key: str, seed: int = 42) -> LazyTable:
        return self._with(sampling.subsample(self._whole("subsample"), name, ratios, key, seed))

    def upsample(self, name: str, targets: dict, key: str, seed: int = 42) -> LazyTable:
        return self._with(sampling.upsample(self._whole("upsample"), name, targets, key, seed))

    def sample_rows(self, n: int, key: str, seed: int = 42, replace: bool = False) -> LazyTable:
        return self._with(sampling.sample_rows(self._whole("sample_rows"), n, key, seed, replace))

    def iter_batches(self, size: int = 1000) -> Iterator[list[dict]]:
        """Lists of `size` rows, the last perhaps shorter; one partition at a time meets the driver."""
        rows = iter(self)
        while batch := list(itertools.islice(rows, size)):
            yield batch
