"""Labels, multi-labels and taxonomy columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import saved, small
from .table import ORDINAL, map_column, map_literal, need, with_ordinal

RANKS = ("kingdom", "phylum", "class", "order", "family", "genus")


#: Label maps of up to so many entries are looked up in place; with more, list elements meet them by a join.
LITERAL_LABELS = 1000


def _dimension(values: DataFrame) -> DataFrame:
    """value and label: the distinct non-null values of a one-column table, numbered in their order."""
    values = values.toDF("_value").where("_value is not null").distinct()
    return with_ordinal(values, ["_value"]).select("_value", F.col(ORDINAL).alias("_label"))


def _as_map(dimension: DataFrame) -> dict:
    """The label map as metadata: one entry per label meets on the driver, as its caller asked."""
    return {r["_value"]: r["_label"] for r in sorted(dimension.collect(), key=lambda r: r["_label"])}


def label_map(df: DataFrame, name: str) -> dict:
    """Sorted distinct values to 0..k-1."""
    return _as_map(_dimension(df.select(name)))


def label_from_feature(df: DataFrame, feature: str, output: str = "label", mapping: dict | None = None, override: bool = False) -> tuple[DataFrame, dict]:
    """Rows with the feature, with its id; and label_feature, label_map, num_classes.

    The ids are joined from the table of labels, broadcast if it fits; they are no part of the plan.
    """
    need(df, [feature])
    if output in df.columns and not override:
        raise AssertionError(f"column {output!r} exists; set override")
    rows = df.where(F.col(feature).isNotNull())
    if mapping is not None:
        return map_column(rows, feature, mapping, output, value_type="long"), {"label_feature": feature, "label_map": mapping, "num_classes": len(mapping)}
    dimension = _dimension(rows.select(feature))
    found = _as_map(dimension)
    out = rows.join(small(dimension), F.col(feature) == F.col("_value"), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != output], F.col("_label").alias(output)), {"label_feature": feature, "label_map": found, "num_classes": len(found)}


def _as_list(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.col(name), F.array().cast(kind))
    return F.when(F.col(name).isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(F.col(name)))


def multilabel(df: DataFrame, features: str | Sequence[str], output: str = "labels", mapping: dict | None = None, allow_missing: bool = True) -> tuple[DataFrame, dict]:
    """Sorted distinct ids over several scalar or list columns; values without id are dropped, rows without any too unless allowed."""
    names = [features] if isinstance(features, str) else list(features)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found")
    values = F.flatten(F.array(*[_as_list(df, n) for n in names]))
    if mapping is None:
        mapping = _as_map(_dimension(df.select(F.explode(values))))
    out = _listed_ids(df, values, mapping, output)
    if not allow_missing:
        out = out.where(F.size(output) > 0)
    return out, {"label_feature": names, "label_map": mapping, "num_classes": len(mapping)}


def _listed_ids(df: DataFrame, values: Column, mapping: dict, output: str) -> DataFrame:
    """df with the sorted distinct ids of its listed values."""
    if not mapping:
        return df.withColumn(output, F.array().cast("array<bigint>"))
    if len(mapping) <= LITERAL_LABELS:
        known = map_literal(mapping)
        return df.withColumn(output, F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.element_at(known, v).cast("long")), lambda i: i.isNotNull()))))
    rows = saved(df.withColumns({"_row": F.monotonically_increasing_id(), "_values": values}), "listed")
    each = map_column(rows.select("_row", F.explode("_values").alias("_v")), "_v", mapping, "_id", value_type="long").where("_id is not null")
    found = each.groupBy("_row").agg(F.array_sort(F.collect_set("_id")).alias("_ids"))
    out = rows.join(found, "_row", "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != output], F.coalesce("_ids", F.array().cast("array<bigint>")).alias(output))


def _preferred(dimension: DataFrame, key: str, ranks: Sequence[str]) -> DataFrame:
    """One row per name: an accepted one before others, then the smallest taxonID, then the smallest ranks."""
    order = []
    if "taxonomicStatus" in dimension.columns:
        order.append(F.coalesce(F.lower("taxonomicStatus") != "accepted", F.lit(True)).alias("late"))
    if "taxonID" in dimension.columns:
        order.append(F.col("taxonID"))
    best = F.min_by(F.struct(*ranks), F.struct(*order, *ranks)).alias("_ranks")
    return dimension.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_name")).agg(best).select("_name", *[F.col(f"_ranks.{r}").alias(f"_{r}") for r in ranks])


def add_taxonomy(df: DataFrame, feature: str, dimension: DataFrame, key: str, ranks: Sequence[str] = RANKS, corrections: dict[str, str] | DataFrame | None = None, name_column: str | None = None) -> tuple[DataFrame, dict]:
    """One left join for all ranks, after correcting synonyms; unresolved names have null ranks.

    corrections are a dictionary, or a table of two columns, from a name to the name it stands for.
    Of repeated names in the dimension an accepted one counts, then the smallest taxonID.
    With name_column, a joined name of the non-empty ranks but the genus, and the
    corrected name. Counts distinct names resolved and failed.
    """
    if feature not in df.columns:
        raise ValueError(f"column {feature!r} not found")
    named = df.withColumn("_corrected", F.col(feature))
    if isinstance(corrections, DataFrame):
        right = corrections.toDF("_wrong", "_right").where("_wrong is not null").groupBy("_wrong").agg(F.min("_right").alias("_right"))
        named = named.join(small(saved(right, "corrections")), F.col("_corrected") == F.col("_wrong"), "left").drop("_wrong")
    elif corrections:
        named = map_column(named, "_corrected", corrections, "_right")
    if corrections is not None and "_right" in named.columns:
        named = named.withColumn("_corrected", F.coalesce("_right", "_corrected")).drop("_right")
    side = saved(_preferred(dimension, key, ranks), "taxonomy")
    joined = named.join(small(side), F.col("_corrected") == F.col("_name"), "left")
    out = joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in ranks], *[F.col(f"_{r}").alias(r) for r in ranks], F.when(F.col("_name").isNotNull(), F.col("_corrected")).alias("_corrected"))
    names = out.select(feature, F.col("_corrected").isNotNull().alias("ok")).where(F.col(feature).isNotNull()).groupBy(feature).agg(F.max("ok").alias("ok"))
    found = {r["ok"]: r["n"] for r in names.groupBy("ok").agg(F.count(F.lit(1)).alias("n")).collect()}
    if name_column:
        parts = [F.when(F.col(r) != "", F.col(r)) for r in ranks if r != "genus"]
        text = F.concat_ws(" ", *parts, F.col("_corrected"))
        out = out.withColumn(name_column, F.when(text != "", text))
    return out.drop("_corrected"), {"feature": feature, "resolved": found.get(True, 0), "failed": found.get(False, 0), "taxonomy_columns_added": list(ranks)}


def string_to_list(name: str) -> Column:
    """null and "none" in any case to [], else split on commas and trimmed."""
    c = F.col(name)
    return F.when(c.isNull() | (F.lower(c) == "none"), F.array().cast("array<string>")).otherwise(F.transform(F.split(c, ","), lambda x: F.trim(x)))


def relabel(name: str, mapping: dict) -> Column:
    return F.coalesce(F.element_at(map_literal(mapping), F.col(name)), F.col(name))
