"""Tables in the folder that all machines share, and joins that stay even when one key is hot."""

from __future__ import annotations

import contextlib
import functools
import operator
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot from this share of the rows on; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000

#: Tables of up to so many bytes, as Spark holds their rows, are broadcast; the bound is checked on the table itself.
BROADCAST_BYTES = 4 << 20

_LOCAL: dict[str, str] = {}
_open: list[list[DataFrame]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Where the setting is missing and all runs on one machine (tests) a temporary
    folder takes its place; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _LOCAL[app]


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    store, target = _file_system(spark, path)
    store.deleteOnExit(target)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    df.withColumns({c: F.col(c).cast("string") for c in void}).write.parquet(path) if void else df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in void else f.dataType, f.nullable, f.metadata) for f in df.schema.fields])
    out = df.sparkSession.read.schema(schema).parquet(path)
    if void:
        out = out.withColumns({c: F.lit(None) for c in void})
    out._corvane_path = path
    for made in _open:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by saved() once nothing lazy reads them any more."""
    for table in tables:
        path = getattr(table, "_corvane_path", None)
        if path:
            store, target = _file_system(table.sparkSession, path)
            store.delete(target, True)


@contextlib.contextmanager
def only(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Discard, at the end, all tables saved within but those appended to the list it gives."""
    made: list[DataFrame] = []
    keep = list(kept)
    _open.append(made)
    try:
        yield keep
    finally:
        _open[:] = [m for m in _open if m is not made]
    paths = {t._corvane_path for t in keep if hasattr(t, "_corvane_path")}
    discard(*[t for t in made if t._corvane_path not in paths])


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no column called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fits(table: DataFrame, most: int | None = None) -> bool:
    """Whether a table's rows take at most `most` bytes (BROADCAST_BYTES): 8 bytes a row and a column, and its strings and binaries.

    Columns of other kinds without a fixed size do not fit. One narrow aggregate; pass a saved or small table.
    """
    wide = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in table.schema.fields):
        return False
    sums = table.agg(F.count(F.lit(1)), *[F.sum(F.octet_length(F.col(f"`{c}`")) + 8) for c in wide]).first()
    return sums[0] * (16 + 8 * len(table.columns)) + sum(s or 0 for s in sums[1:]) <= (BROADCAST_BYTES if most is None else most)


def small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it fits."""
    return F.broadcast(table) if fits(table) else table


def join_by_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str], n_rows: int, how: str = "inner") -> DataFrame:
    """rows join groups (inner or left) on keys, whatever a key's share of the rows.

    groups has one row per key and a column group_rows: how many of the n_rows
    rows share it at most. Groups that fit are broadcast. Of more, keys
    holding at least 1/HOT_SHARE of the rows are so few that they are broadcast; the
    others are shuffled, and none of them is large. groups is read several times:
    pass a saved table. Null keys match nothing, and are not shuffled.
    """
    keys = list(keys)
    if fits(groups):
        return rows.join(F.broadcast(groups), keys, how)
    least = max(2, -(-n_rows // HOT_SHARE))
    hot = groups.where(F.col("group_rows") >= least)
    rest = groups.where(F.col("group_rows") < least)
    many = rows.join(F.broadcast(hot), keys, "inner")
    known = functools.reduce(operator.and_, (F.col(k).isNotNull() for k in keys))
    few = rows.where(known).join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    out = many.unionByName(few)
    return out.unionByName(rows.where(~known), allowMissingColumns=True) if how == "left" else out
