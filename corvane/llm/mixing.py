"""Mixing sources to target weights (operator 2) by hash-threshold histograms.

Tokens are summed by source and hash bucket; the bucket in which a source's
budget runs out is refined, level by level, and the rest is a filter on the
hash: no row is sorted. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.table import ORDINAL, with_ordinal
from .shared import join_by_group, only, saved, small

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)

#: A document is taken so many times at most.
MOST_EPOCHS = 3

#: Each level looks at so many bits of the hash; all levels are LEVELS * BITS bits deep.
BITS, LEVELS = 8, 4

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words by the white space of the contract; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """32 bits of the md5 of the id as text (null as the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size and any more -> the same with target: shares of the whole by weight, capped, the excess reshared.

    Sources are numbered without a global window, and the level of the shares is found by
    sums over them: those whose share exceeds their cap are held there, and the level
    of the others rises, until none is above. Three numbers a round meet on the driver.
    """
    numbered = with_ordinal(sources, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col(ORDINAL), F.lit(len(weights))) + 1).cast("int"))
    rows = saved(numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "sources")
    held, level = F.lit(False), 0.0
    while True:
        whole, caps, open_ = rows.agg(F.sum("source_size"), F.sum(F.when(held, F.col("cap"))), F.sum(F.when(~held, F.col("weight")))).first()
        if not open_:  # all are held at their caps
            level = float("inf")
            break
        risen = (float(whole) - (caps or 0.0)) / open_
        if risen <= level:
            break
        level = risen
        held = F.col("cap") / F.col("weight") <= level
    return rows.select(*sources.columns, F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, hash and key of every row, written to the shared folder."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), document_hash(F.col(id_col)).alias("hash"))
    return saved(rows, "sizes").withColumn("key", source_key(F.col("source")))


def thresholds(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source: key, group_rows (its rows), source_size, target, epochs and cut, from what sizes() gives.

    A document is taken `epochs` times, and once more if its hash is under the cut.
    """
    n = narrow.count()
    with only() as keep:
        sums = saved(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("group_rows")), "source-sizes")
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        state = targets(sums, weights, most).withColumn("epochs", F.floor(ratio)).select(
            source_key(F.col("source")).alias("key"), "group_rows", "source_size", "target", "epochs",
            (F.col("target") - F.col("epochs") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("cell"),
        )
        state = saved(state, "mix-state")
        for level in range(LEVELS):
            state = saved(_refined(narrow, state, n, level), "mix-state")
        # the last cell is taken whole where that comes nearer the target
        under = F.col("prefix") + (F.col("cell") - F.col("left") < F.col("left")).cast("long")
        cuts = saved(state.select("key", "group_rows", "source_size", "target", "epochs", under.alias("cut")), "mix-cuts")
        keep.append(cuts)
    return cuts


def _refined(narrow: DataFrame, state: DataFrame, n_rows: int, level: int) -> DataFrame:
    """The state with BITS more bits of each source's threshold: words are summed by cell, of a refined cell only.

    There are at most 2**BITS cells of a source, and running sums over them.
    """
    here = narrow.select("key", "size", F.shiftright("hash", BITS * (LEVELS - level - 1)).alias("bucket"))
    if level:
        here = join_by_group(here, state.select("key", "prefix", "group_rows"), ["key"], n_rows).where(F.shiftright("bucket", BITS) == F.col("prefix"))
    sums = here.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy("bucket")
    cells = sums.withColumn("upto", F.sum("words").over(upto)).join(small(state.select("key", "left")), "key")
    found = cells.groupBy("key").agg(
        F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "words"))).alias("at"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0)).alias("spent"),
        F.max("bucket").alias("last"),
    )
    # where the budget lasts beyond all cells the threshold is above the last one, and stays there
    beyond = F.col("last") + 1 if level == 0 else F.shiftleft(F.col("prefix"), BITS)
    return state.join(found, "key", "left").select(
        "key", "group_rows", "source_size", "target", "epochs", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"),
        F.coalesce("at.bucket", beyond).alias("prefix"), F.coalesce("at.words", F.lit(0)).alias("cell"),
    )


def times(most: int) -> Column:
    """How often a row with hash, epochs and cut is taken, `most` times at most."""
    return F.least(F.col("epochs") + (F.col("hash") < F.col("cut")).cast("long"), F.lit(most))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken.

    Every document is taken as often as its source's target holds the source
    whole; once more if its hash is under the source's threshold, which is put
    where the words taken come nearest the target. Null is a source of its own
    and comes last; documents with equal ids share a hash; empty documents
    count no words, and none is taken more than `most` times; a source without words has target 0 and
    yields its rows once; an empty table
    gives an empty one. Only id, text and source are read.
    """
    narrow = sizes(docs, id_col, text_col, source_col)
    rows = join_by_group(narrow, thresholds(narrow, weights, most), ["key"], narrow.count())
    return rows.select("doc_id", "source", "size", "source_size", "target", times(most).alias("epochs"), (F.col("size") * times(most)).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, copy_col: str | None = None) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns, whatever their names.

    If asked for, copy_col numbers the copies of a document from 0.

    The documents are filtered by their own hash against the few thresholds of their
    sources; their texts are not shuffled.
    """
    narrow = sizes(docs, id_col, text_col, source_col)
    cuts = thresholds(narrow, weights, most)
    own = [f"own_{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    rows = docs.toDF(*own).withColumns({"key": source_key(F.col(at[source_col])), "hash": document_hash(F.col(at[id_col]))})
    joined = join_by_group(rows, cuts, ["key"], narrow.count())
    copies = F.posexplode(F.array_repeat(F.lit(True), times(most).cast("int")))
    out = joined.select(*own, copies.alias("copy", "taken"))
    return out.select(*own, "copy").toDF(*docs.columns, copy_col) if copy_col else out.select(*own).toDF(*docs.columns)
