"""Declarative transforms: configs, the open registry, datasets and their composition."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from pathlib import PurePosixPath
from typing import Any, Literal, get_args, get_origin

from pydantic import BaseModel, ConfigDict, Field, field_validator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, sampling, table
from ..sources import files, readers
from ..streaming import stream
from . import audio

Result = tuple[DataFrame, dict]


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class FilterConfig(Strict):
    type: Literal["filter"]
    property: str
    values: list[str]
    mode: Literal["include", "exclude"] = "include"


class SelectColumnsConfig(Strict):
    type: Literal["select_columns"]
    columns: list[str] = Field(min_length=1)


class RenameColumnsConfig(Strict):
    type: Literal["rename_columns"]
    mapping: dict[str, str]


class DropNaConfig(Strict):
    type: Literal["dropna"]
    subset: list[str] | None = None


class DeduplicateConfig(Strict):
    """subset must be present and may be null."""

    type: Literal["deduplicate"]
    subset: list[str] | None
    keep_first: bool = True


class LabelConfig(Strict):
    type: Literal["label_from_feature"]
    feature: str
    label_map: dict[Any, int] | None = None
    output_feature: str = "label"
    override: bool = False


class MultiLabelConfig(Strict):
    type: Literal["labels_from_features"]
    features: list[str]
    label_map: dict[Any, int] | None = None
    output_feature: str = "labels"

    @field_validator("features", mode="before")
    @classmethod
    def listed(cls, value):
        return [value] if isinstance(value, str) else value


class SubsampleConfig(Strict):
    type: Literal["subsample"]
    property: str
    ratios: dict[str, float]
    seed: int = 42

    @field_validator("ratios")
    @classmethod
    def shares(cls, value: dict[str, float]) -> dict[str, float]:
        if any(not 0 <= v <= 1 for v in value.values()):
            raise ValueError("ratios lie between 0 and 1")
        return value


class BalancedConfig(Strict):
    type: Literal["balanced_sample"]
    property: str
    strategy: Literal["min", "max", "median", "mean", "median_with_range"] = "median"
    range_fraction: float = 0.2
    seed: int = 42


class LongTailConfig(Strict):
    type: Literal["long_tail_upsample"]
    property: str
    sufficient_threshold: int = Field(ge=1)
    max_repeats: int = Field(ge=1)
    seed: int = 42


class TaxonomyConfig(Strict):
    type: Literal["add_taxonomy"]
    feature: str = "scientific_name"
    path: str
    key: str = "canonicalName"
    add_taxonomic_name: bool = False
    corrections: dict[str, str] | None = None
    corrections_path: str | None = None

    @field_validator("path", "corrections_path")
    @classmethod
    def there(cls, value: str | None) -> str | None:
        if value is not None and not files.exists(value):
            raise ValueError(f"{value} does not exist")
        return value


def _key(df: DataFrame) -> tuple[DataFrame, str]:
    """df with numbered rows; numbers are given once, and kept."""
    return (df, table.ORDINAL) if table.ORDINAL in df.columns else (table.with_ordinal(df), table.ORDINAL)


def _filter(df: DataFrame, c: FilterConfig) -> Result:
    return table.filter_isin(df.withColumn("_text", F.col(c.property).cast("string")), "_text", c.values, c.mode == "exclude").drop("_text"), {}


def _deduplicate(df: DataFrame, c: DeduplicateConfig) -> Result:
    df, key = _key(df)
    return table.deduplicate(df, c.subset, [key], "first" if c.keep_first else "last"), {}


def _sampled(run: Callable) -> Callable:
    def apply(df: DataFrame, c) -> Result:
        df, key = _key(df)
        before = sampling.histogram_of(df, c.property)
        out = run(df, c, key)
        return out, {"histogram_before": before, "histogram_after": sampling.histogram_of(out, c.property)}

    return apply


def _taxonomy(df: DataFrame, c: TaxonomyConfig) -> Result:
    dimension = readers.from_path(df.sparkSession, c.path)
    ranks = [r for r in labels.RANKS if r in dimension.columns]
    corrections = c.corrections if c.corrections_path is None else readers.from_path(df.sparkSession, c.corrections_path)
    return labels.add_taxonomy(df, c.feature, dimension, c.key, ranks, corrections, "taxonomic_name" if c.add_taxonomic_name else None)


_TRANSFORMS: dict[str, tuple[type[BaseModel], Callable[[DataFrame, Any], Result]]] = {}


def register_transform(config: type[BaseModel], apply: Callable[[DataFrame, Any], Result]) -> None:
    """Add a transform; its config has a `type: Literal[one name]` that no other has."""
    kind = config.model_fields.get("type")
    names = get_args(kind.annotation) if kind is not None and get_origin(kind.annotation) is Literal else ()
    if len(names) != 1:
        raise ValueError("a transform config needs type: Literal with one name")
    if names[0] in _TRANSFORMS:
        raise ValueError(f"transform {names[0]!r} exists")
    _TRANSFORMS[names[0]] = (config, apply)


for _config, _apply in (
    (FilterConfig, _filter),
    (SelectColumnsConfig, lambda df, c: (table.select_columns(df, c.columns), {})),
    (RenameColumnsConfig, lambda df, c: (table.rename_columns(df, c.mapping), {})),
    (DropNaConfig, lambda df, c: (table.dropna(df, c.subset), {})),
    (DeduplicateConfig, _deduplicate),
    (LabelConfig, lambda df, c: labels.label_from_feature(df, c.feature, c.output_feature, c.label_map, c.override)),
    (MultiLabelConfig, lambda df, c: labels.multilabel(df, c.features, c.output_feature, c.label_map)),
    (SubsampleConfig, _sampled(lambda df, c, key: sampling.subsample(df, c.property, c.ratios, key, c.seed))),
    (BalancedConfig, _sampled(lambda df, c, key: sampling.balanced(df, c.property, key, c.strategy, c.range_fraction, c.seed))),
    (LongTailConfig, _sampled(lambda df, c, key: sampling.long_tail(df, c.property, key, c.sufficient_threshold, c.max_repeats, c.seed))),
    (TaxonomyConfig, _taxonomy),
):
    register_transform(_config, _apply)


def transform(df: DataFrame, configs: Sequence[dict | BaseModel]) -> Result:
    """All transforms in order; metadata by type (of a type used twice, the last)."""
    found: dict[str, dict] = {}
    for c in configs:
        kind = c.get("type") if isinstance(c, dict) else c.type
        if kind not in _TRANSFORMS:
            raise ValueError(f"unknown transform {kind!r}; there are {sorted(_TRANSFORMS)}")
        config, apply = _TRANSFORMS[kind]
        df, found[kind] = apply(df, config.model_validate(c) if isinstance(c, dict) else c)
    return df, found


@dataclass
class DatasetInfo:
    name: str
    owner: str = ""
    version: str = "0.0.1"
    description: str = ""
    license: str = ""
    sources: list[str] = field(default_factory=list)
    split_paths: dict[str, str] = field(default_factory=dict)
    changelog: str = ""
    sample_rate: int | None = None


def merge_info(infos: Sequence[DatasetInfo]) -> DatasetInfo:
    """Names joined, owners, licences and sources once each, the highest version, numbered texts; rates equal or None."""
    once = lambda values: list(dict.fromkeys(v for v in values if v))
    numbered = lambda values: "\n".join(f"{i}. {v}" for i, v in enumerate(once(values), 1))
    rates = {i.sample_rate for i in infos}
    return DatasetInfo(
        name="+".join(i.name for i in infos), owner=", ".join(once(i.owner for i in infos)), license=", ".join(once(i.license for i in infos)),
        version=max((i.version for i in infos), key=lambda v: tuple(int(x) for x in v.split("."))), sources=once(s for i in infos for s in i.sources),
        description=numbered(i.description for i in infos), changelog=numbered(i.changelog for i in infos), sample_rate=rates.pop() if len(rates) == 1 else None,
    )


def merge_take_and_give(maps: Sequence[dict[str, str] | None]) -> dict[str, str] | None:
    out: dict[str, str] = {}
    for m in maps:
        for k, v in (m or {}).items():
            if out.setdefault(k, v) != v:
                raise table.MergeException(f"{k!r} goes to {out[k]!r} and {v!r}")
    return out or None


@dataclass
class Dataset:
    """A table, what it is, and how its rows are given out."""

    df: DataFrame
    info: DatasetInfo
    take_and_give: dict[str, str] | None = None
    process: Callable[[DataFrame], DataFrame] | None = None
    loose: bool = False

    def samples(self) -> DataFrame:
        """Rows as they are given out; a missing key of take_and_give raises, unless loose."""
        df = self.process(self.df) if self.process else self.df
        return table.take_and_give(df, self.take_and_give, strict=not self.loose) if self.take_and_give else df

    @property
    def columns(self) -> list[str]:
        return table.columns(self.df)

    def __iter__(self):
        return table.iterate(self.samples())

    def __len__(self) -> int:
        if self.df.isStreaming:
            raise NotImplementedError("Cannot get length in streaming mode")
        return self.df.count()

    def __getitem__(self, i: int) -> dict:
        """Row i. The table is numbered once, before its rows are processed; only the row asked for is."""
        if self.df.isStreaming:
            raise RuntimeError("Cannot use __getitem__ in streaming mode")
        if i < 0:
            raise IndexError(i)
        self.df, key = _key(self.df)
        one = replace(self, df=self.df.where(F.col(key) == i).drop(key)).samples()
        row = one.first()
        if row is None:
            raise IndexError(i)
        return {c: row[c] for c in table.columns(one)}

    def apply(self, configs: Sequence[dict | BaseModel]) -> tuple[Dataset, dict]:
        df, found = transform(self.df, configs)
        return replace(self, df=df), found

    def map(self, fn: Callable, schema) -> Dataset:
        """fn on batches of rows as pandas frames: table.apply on the table."""
        return replace(self, df=table.apply(self.df, fn, schema))


def concatenate(parts: Sequence[Dataset], level: str = "soft") -> Dataset:
    """One table of all, each row with the number of its source and its place there.

    A row is processed as its source does it, on the row as it is here: what transforms of the
    whole changed holds. Streams cannot be concatenated.
    """
    if not parts:
        raise ValueError("nothing to concatenate")
    if any(p.df.isStreaming for p in parts):
        raise RuntimeError("Cannot concatenate in streaming mode")
    df = table.concat([_key(p.df)[0] for p in parts], level, provenance=True).drop(table.ORDINAL)
    if df.isEmpty():
        raise ValueError("the datasets are empty")

    def process(rows: DataFrame) -> DataFrame:
        own = [(rows.where(F.col("_source_dataset") == i), p.process) for i, p in enumerate(parts)]
        return table.concat([run(some) if run else some for some, run in own])

    some = any(p.process for p in parts)
    return Dataset(df, merge_info([p.info for p in parts]), merge_take_and_give([p.take_and_give for p in parts]), process if some else None, loose=True)


class ChainException(ValueError):
    """Datasets that cannot be chained."""


class Chain:
    """Datasets one after another, rows as they are."""

    def __init__(self, parts: Sequence[Dataset]):
        if not parts:
            raise ChainException("nothing to chain")
        if len({p.df.isStreaming for p in parts}) > 1:
            raise ChainException("all datasets stream, or none does")
        self.parts, self._ends = list(parts), None

    @property
    def columns(self) -> list[str]:
        return sorted({c for p in self.parts for c in table.columns(p.samples())})

    def __len__(self) -> int:
        if self.parts[0].df.isStreaming:
            raise RuntimeError("Cannot get length in streaming mode")
        return sum(len(p) for p in self.parts)

    def __iter__(self):
        for p in self.parts:
            yield from p

    def __getitem__(self, i: int) -> dict:
        if self.parts[0].df.isStreaming:
            raise RuntimeError("Cannot use __getitem__ in streaming mode")
        if i < 0:
            raise IndexError(i)
        if self._ends is None:
            self._ends = list(itertools.accumulate(len(p) for p in self.parts))
        place = bisect.bisect_right(self._ends, i)
        if place == len(self.parts):
            raise IndexError(i)
        return self.parts[place][i - (self._ends[place - 1] if place else 0)]

    def table(self) -> DataFrame:
        return table.concat([p.samples().withColumn("_chain_pos", F.lit(k)) for k, p in enumerate(self.parts)])


_DATASETS: dict[str, Callable[..., Dataset]] = {}


def register_dataset(name: str) -> Callable:
    def add(make: Callable[..., Dataset]) -> Callable[..., Dataset]:
        if name in _DATASETS:
            raise ValueError(f"dataset {name!r} exists")
        _DATASETS[name] = make
        return make

    return add


def registered_datasets() -> list[str]:
    return sorted(_DATASETS)


def dataset_class(name: str) -> Callable[..., Dataset]:
    if name not in _DATASETS:
        raise KeyError(f"no dataset {name!r}; there are {registered_datasets()}")
    return _DATASETS[name]


@register_dataset("manifest")
def manifest(
    spark: SparkSession, split: str = "train", version: str | None = None, versions: dict | None = None, split_paths: dict | None = None, info: dict | None = None,
    output_take_and_give: dict | None = None, streaming: bool = False, audio_spec: dict | None = None,
) -> Dataset:
    """A named table by split and version: the one parametrised class that stands for all built-in manifests.

    audio_spec says where the audio of a row lies and how it is given out: root, path column, resampled
    paths, window, selection table, labels (see audio.AudioSpec). streaming takes new files as they come.
    """
    paths = readers.from_version(versions, version) if versions else (split_paths or {})
    spec = audio.AudioSpec(**audio_spec) if audio_spec else None
    if streaming:
        still = readers.from_split(spark, paths, split)
        df = stream.read_stream(spark, paths[split], still.schema, {".jsonl": "json", ".ndjson": "json"}.get(PurePosixPath(paths[split]).suffix, PurePosixPath(paths[split]).suffix[1:]))
    else:
        df = readers.from_split(spark, paths, split)
    known = {"name": "manifest"} | (info or {}) | ({"sample_rate": spec.sample_rate} if spec else {})
    return Dataset(df, DatasetInfo(**known, split_paths=paths), output_take_and_give, (lambda rows: audio.samples(rows, spec)) if spec else None)


def dataset_from_config(spark: SparkSession, config: dict | str, key: str | None = None) -> tuple[Dataset | Chain, dict]:
    """A dataset, concat or chain from a config or a YAML file; exactly one of the three."""
    if isinstance(config, str):
        config = files.read_yaml(config)
    if key is not None:
        if key not in config:
            raise KeyError(key)
        config = config[key]
    kinds = [k for k in ("dataset", "concat", "chain") if k in config]
    if len(kinds) != 1:
        raise ValueError("a config has exactly one of dataset, concat and chain")
    body = dict(config[kinds[0]])
    if kinds[0] == "dataset":
        steps = body.pop("transformations", [])
        made = dataset_class(body.pop("dataset_name"))(spark, **body)
        return made.apply(steps)
    parts = [dataset_from_config(spark, {"dataset": d})[0] for d in body.pop("datasets")]
    if kinds[0] == "chain":
        if body:
            raise ValueError(f"a chain takes no {sorted(body)}")
        return Chain(parts), {}
    steps = body.pop("transformations", [])
    made = concatenate(parts, body.pop("merge_level", "soft"))
    if body:
        raise ValueError(f"a concat takes no {sorted(body)}")
    return made.apply(steps)
