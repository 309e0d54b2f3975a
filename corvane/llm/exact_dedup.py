"""Exact dedup (operator 6): a persistent digest index, bucketed and sorted by hash.

New rows are reduced to one per digest, anti-joined with the index by sort-merge
and appended. DataFrame and SQL functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_by_group, keep_once, only, saved, text_mark, unused, without

#: A new index has a bucket for so many digests of its first arrival (about 200 bytes each), and LEAST_BUCKETS at least.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 16

#: The index is rewritten once a bucket has so many files.
MOST_FILES = 16

#: White space that counts as one space: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def digest_of(text: Column) -> Column:
    """sha256 of the text with each run of blanks as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_no and text_sha256 of every row; null text counts as empty. row_no tells repeated rows apart."""
    return docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), digest_of(F.col(text_col)).alias("text_sha256"))


class DigestIndex:
    """The table of digests that have been seen, with the row that stays for each.

    How many buckets it has is kept in the table: it follows from the rows first added, unless
    given. Every append adds a file to a bucket; compact() brings them to one sorted file each
    and can give the index more buckets.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.appends = 0
        if spark.catalog.tableExists(name):
            described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
            self.buckets = int(described["Num Buckets"])

    def _write(self, rows: DataFrame, mode: str, name: str | None = None) -> None:
        # one file per bucket and append
        rows.repartition(self.buckets, "text_sha256").write.mode(mode).format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(name or self.name)

    def _create(self, n_rows: int) -> None:
        if not self.spark.catalog.tableExists(self.name):
            self.buckets = self.buckets or buckets_for(n_rows)
            self._write(self.spark.createDataFrame([], "text_sha256 string, keep_id long, keep_row long"), "errorifexists")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame, n_rows: int | None = None) -> DataFrame:
        """Add the digests of new rows that the index lacks, and return them; of equal ones the smallest id (then row) stays, null ids last."""
        self._create(new.count() if n_rows is None else n_rows)
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no"))
        one = new.groupBy("text_sha256").agg(first.alias("first")).select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row_no").alias("keep_row"))
        fresh = saved(one.join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti"), "new-digests")
        self._write(fresh, "append")
        self.appends += 1
        if self.appends >= MOST_FILES:
            self.compact()
        return fresh

    def compact(self, buckets: int | None = None) -> None:
        """One sorted file per bucket again; with more buckets if given. The old table stays until the new one is whole."""
        self.buckets = buckets or self.buckets
        fresh = f"{self.name}_{uuid.uuid4().hex[:8]}"
        self._write(self.table(), "errorifexists", fresh)
        self.drop()
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.name}")
        self.appends = 0

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def buckets_for(n_rows: int) -> int:
    """Buckets of an index whose first arrival has so many rows: a power of two."""
    return max(LEAST_BUCKETS, 1 << (-(-n_rows // BUCKET_ROWS) - 1).bit_length()) if n_rows > 0 else LEAST_BUCKETS


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, arrivals: int = 2) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of blanks becomes one
    space (not trimmed; null is empty). The row of the smallest id stays, null ids
    last; of rows repeated with one id a single one stays. With an index given,
    a digest it already has keeps the row named there, and nothing of the new
    rows stays. Without one, an index of its own takes the table in `arrivals`
    parts of ascending id. group_size counts the rows of docs. Only id and text
    are read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    own = index is None
    with only() as keep:
        rows = saved(digests(docs, id_col, text_col), "digests")
        keep.append(rows)
        n = rows.count()
        index = index or DigestIndex(spark, f"corvane_digests_{uuid.uuid4().hex[:12]}")
        if own and arrivals > 1:
            low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
            low, high = (low or 0), (high or 0)
            cuts = [low + (high - low) * k // arrivals for k in range(1, arrivals)]
            place = sum(((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(0))
            part = F.when(F.col("doc_id").isNull(), arrivals - 1).otherwise(place)
            for k in range(arrivals):
                index.append(rows.where(part == k), n)
        else:
            fresh = index.append(rows, n)
        sizes = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_rows"))
        wanted = sizes if not own else sizes.where(F.col("group_rows") > 1)
        groups = wanted.join(index.table(), "text_sha256")
        if not own:
            groups = groups.join(fresh.select("text_sha256", F.lit(True).alias("fresh")), "text_sha256", "left")
        groups = saved(groups, "digest-groups")
        keep.append(groups)
        if own:
            index.drop()
    every = join_by_group(rows, groups, ["text_sha256"], n, "left")
    alone = F.col("group_rows").isNull()
    kept = alone | (F.col("keep_row") == F.col("row_no"))
    if not own:
        kept = kept & F.coalesce("fresh", F.lit(False))
    return every.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_rows", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that repeat an earlier text; all columns.

    Only the ids and digests of the rows to drop travel to the documents, broadcast
    where they are few. Of rows repeated with one id and text a single one stays,
    whatever their other columns hold; rows of one id but other texts are told
    apart; a null id is an id like others, and comes last. Columns may have any names.
    """
    name = unused(docs, "text_mark")
    with only() as keep:
        marked = deduplicate(docs, id_col, text_col)
        gone = marked.where(~F.col("kept")).select("doc_id", text_mark(F.col("text_sha256")).alias("mark"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("own"))
        gone = saved(gone.distinct(), "gone")
        keep.append(gone)
    columns = [F.col("doc_id"), F.col("mark")]
    out = keep_once(docs.withColumn(name, text_mark(digest_of(F.col(text_col)))), gone.where("not own").select(*columns), gone.where("own").select(*columns), [id_col, name])
    return out.drop(name)


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs whose id is not in gone (one column, a saved table). Rows without an id stay."""
    return without(docs, gone.where(F.col(gone.columns[0]).isNotNull()).distinct(), [id_col])
