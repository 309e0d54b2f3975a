"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_by_group, only, saved


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> id, component_id: the smallest id reachable, for every id that has a link.

    Every step replaces edges by as few or fewer; a node that a third of all links
    meet is joined by broadcast of its one row, never gathered in a task.
    Self-links, repeated links and nulls are allowed and add nothing.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _signature(edges)
    n = state[0]
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("least"), F.count(F.lit(1)).alias("group_rows")), "least")
        large = saved(join_by_group(both, least, ["a"], 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "large-star")
        least2 = saved(large.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("group_rows")), "least")
        joined = join_by_group(large, least2, ["a"], max(1, n))
        small = joined.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        fresh = saved(small.where("a <> b").distinct(), "edges")
        after = _signature(fresh)
        discard(least, large, least2, edges)
        edges = fresh
        if after == state:
            break
        state = after
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())


def repeated_ids(rows: DataFrame) -> DataFrame:
    """Of rows (id, digest): the ids with several rows, group_rows (how many) and mixed (whether their digests differ, null being one of its own)."""
    known = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("group_rows"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("digest").alias("n"))
    mixed = F.coalesce(F.col("low") != F.col("high"), F.lit(False)) | ((F.col("n") > 0) & (F.col("n") < F.col("group_rows")))
    return saved(known.where("group_rows > 1").select("id", "group_rows", mixed.alias("mixed")), "repeated-ids")


def class_components(rows: DataFrame, classes: DataFrame, links: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of classes of equal rows, where rows of one id are one node.

    rows (id, digest), classes (digest, cid, rep, group_rows; rep the smallest id of a class), links (a, b: cids), repeated
    from repeated_ids(rows). Gives (digest, component_id) for classes linked with others, and (id, component_id, group_rows)
    for ids with rows in several classes or in none; component_id is the smallest id reachable.
    """
    mixed = repeated.where("mixed").select("id", "group_rows")
    several = not mixed.isEmpty()
    n = rows.count() if several else 1
    with only() as keep:
        if several:
            mixed = saved(mixed, "mixed-ids")
            pairs = rows.where("id is not null and digest is not null").select("id", "digest").distinct()
            mine = join_by_group(pairs, mixed, ["id"], n).select("id", "digest")
            mine = saved(join_by_group(mine, classes.select("digest", "cid", "group_rows"), ["digest"], n).select("id", "cid"), "memberships")
            heads = saved(mine.groupBy("id").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("group_rows")), "heads")
            links = links.select("a", "b").unionByName(join_by_group(mine, heads, ["id"], n).select(F.col("head").alias("a"), F.col("cid").alias("b")))
        found = components(links).select(F.col("id").alias("cid"), F.col("component_id").alias("label"))
        placed = saved(classes.select("digest", "cid", "rep").join(found, "cid"), "placed")
        least = saved(placed.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("group_rows")), "least")
        by_digest = saved(join_by_group(placed, least, ["label"], max(1, placed.count())).select("digest", "cid", "component_id"), "class-components")
        keep.append(by_digest)
        by_id = mixed.limit(0).withColumn("component_id", F.col("id"))
        if several:
            one = classes.select(F.col("cid").alias("head"), "rep").join(by_digest.select(F.col("cid").alias("head"), "component_id"), "head", "left")
            chosen = heads.select("id", "head").join(one, "head").select("id", F.coalesce("component_id", "rep").alias("component_id"))
            by_id = saved(chosen.join(mixed, "id"), "id-components")
            keep.append(by_id)
    return by_digest.select("digest", "component_id"), by_id.select("id", "component_id", "group_rows")


def with_components(rows: DataFrame, groups: DataFrame, by_id: DataFrame, n_rows: int) -> DataFrame:
    """rows (id, digest and more) left joined with groups (digest, component_id, group_rows and more) and a final component_id.

    A row of no group is its own component, unless its id has rows in one; a null id has none.
    """
    every = join_by_group(rows, groups, ["digest"], n_rows, "left")
    own = F.col("component_id")
    if not by_id.isEmpty():
        placed = by_id.withColumnRenamed("component_id", "id_component")
        alone = join_by_group(every.where("digest is null").drop("group_rows"), placed, ["id"], n_rows, "left").drop("group_rows")
        every = every.where("digest is not null").drop("group_rows").unionByName(alone, allowMissingColumns=True)
        own = F.coalesce("component_id", "id_component")
    return every.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce(own, F.col("id"))))
