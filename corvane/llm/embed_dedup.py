"""Embedding near-dedup (operator 1): int8 tile products with rigorous error bounds.

A unit vector u is quantised as u = s*q + d with q in int8 and |d| known. For two,
|u.v - s*t*(q.p)| <= |d_u| + (1 + |d_u|) * |d_v|, so pairs whose product plus bound stays under
the threshold are no links, those whose product less bound reaches it are, and only
the others are computed in double precision. Equal vectors form a class
first. Classes are dealt to cells around pivots; two cells whose angle, less their
radii, exceeds the angle of the threshold hold no links and are never paired. Tiles,
parts of cells, meet twice: first as codes alone, which tell the rows that may have a
link in the other tile; then those rows alone, with their whole vectors. A
pair of tiles yields link counts and a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .components import class_components, repeated_ids, with_components
from .shared import only, saved, small

#: Vectors of a tile at most and, unless the table has fewer, at least; of a block of products within it; and pivots at most, of each length of vectors.
TILE, LEAST_TILE, BLOCK, PIVOTS = 1 << 15, 1024, 1024, 256

#: A tile's vectors take so many bytes at most in double precision, unless LEAST_TILE of them take more.
TILE_BYTES = 16 << 20

#: Pairs of tiles are dealt to so many tasks at most; more pairs share tasks.
MOST_TASKS = 20_000


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of unit vectors (a row each)."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: sums of up to 1024 of them are whole numbers below 2**24, so float32 holds them."""
    out = None
    for k in range(0, a.shape[1], 1024):
        part = a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: exact, and no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(v).max(axis=1, initial=0.0))
    return np.ldexp(v, -exponent[:, None])


def prepared(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Norms of scaled rows, and codes, scales and error norms of their unit vectors."""
    norm = np.sqrt((v * v).sum(axis=1))
    return norm, *quantise(v / norm[:, None])


def estimates(a: tuple, b: tuple) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Blocks of rows of a and of b (codes, scales, errors each), the estimated cosines of their pairs, and how far these can be off."""
    (qx, sx, ex), (qy, sy, ey) = a, b
    for i in range(0, len(qx), BLOCK):
        rows = slice(i, i + BLOCK)
        for j in range(0, len(qy), BLOCK):
            cols = slice(j, j + BLOCK)
            about = products(qx[rows], qy[cols]) * sx[rows, None] * sy[None, cols]
            bound = ex[rows, None] + (1 + ex[rows, None]) * ey[None, cols] + 1e-6
            yield rows, cols, about, bound


def links(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine >= threshold, block by block. Rows are scaled; none may be zero or non-finite.

    Pairs that the bounds do not decide are computed in double precision.
    """
    nx, *cx = prepared(x)
    ny, *cy = prepared(y)
    for rows, cols, about, bound in estimates(cx, cy):
        may = about + bound >= threshold
        if not may.any():
            continue
        must = about - bound >= threshold
        a, b = np.nonzero(must)
        yield a + rows.start, b + cols.start
        a, b = np.nonzero(may & ~must)
        a, b = a + rows.start, b + cols.start
        for k in range(0, len(a), 1 << 16):
            p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            cosine = (x[p] * y[q]).sum(axis=1) / (nx[p] * ny[q])
            yes = cosine >= threshold
            yield p[yes], q[yes]


class _Forest:
    """Labels of the components among n nodes, as links come in."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            low = np.minimum(label[a], label[b])
            high = np.maximum(label[a], label[b])
            apart = low != high
            if not apart.any():
                break
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label[:] = label[label]


def _precision(rows: DataFrame, vec_col: str) -> type:
    """In what numbers vectors travel: those of the column if it has single precision. All arithmetic is in double."""
    return np.float32 if isinstance(rows.schema[vec_col].dataType.elementType, FloatType) else np.float64


def _vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, digest and vector (bytes) of each row; digest null where it links with nothing."""
    kind = _precision(rows, vec_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vectors, digests = [], []
            for v in batch.column(1):
                values = v.values
                ok = v.is_valid and len(values) and not values.null_count
                array = np.asarray(values.to_numpy(zero_copy_only=False), kind) + kind(0) if ok else None
                ok = bool(ok and np.isfinite(array).all() and array.any())
                raw = array.tobytes() if ok else None
                vectors.append(raw)
                digests.append(hashlib.blake2b(raw, digest_size=16).hexdigest() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(digests, pa.string()), pa.array(vectors, pa.binary())], ["vec_id", "digest", "vector"])

    return rows.select(id_col, vec_col).mapInArrow(run, "vec_id long, digest string, vector binary")


def _matrix(raw: list[bytes], kind: type) -> np.ndarray:
    return scaled(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _coded(classes: DataFrame, pivots: dict[int, np.ndarray], kind: type) -> DataFrame:
    """cid, rep, group_rows, width, the nearest pivot (cell) and the angle to it, and codes, scale and error; widths without pivots are one cell, 0."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            widths = batch.column(3).to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                x = _matrix(part.column(4).to_pylist(), kind)
                cell, angle = np.zeros(len(x), np.int32), np.zeros(len(x))
                if width in shared.value:
                    cosine = _unit(x) @ shared.value[width].T
                    cell = cosine.argmax(axis=1).astype(np.int32)
                    angle = np.arccos(np.clip(cosine[np.arange(len(x)), cell], -1, 1))
                _, codes, scale, error = prepared(x)
                columns = [*part.columns[:4], pa.array(cell), pa.array(angle), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "rep", "group_rows", "width", "cell", "angle", "codes", "scale", "error"])

    schema = "cid long, rep long, group_rows long, width int, cell int, angle double, codes binary, scale double, error double"
    return classes.select("cid", "rep", "group_rows", "width", "vector").mapInArrow(run, schema)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id (smallest id reachable), kept.

    All vectors of one length are compared by cosine in double precision, whatever their size.
    Null and empty vectors, zero vectors and those with null or non-finite components
    link with nothing, nor do rows with a null id, whose
    component is null; all these are kept. Rows that repeat a vector link with each
    other; n_links counts the other rows that a row's vector links with. Rows of one
    id are one node of the components, whatever their vectors: all have one
    component_id, and all are kept or none. Only id and vector are
    read; an empty table gives an empty one.
    """
    with only() as keep:
        vectors = saved(_vectors(rows, id_col, vec_col), "vectors")
        known = vectors.where("digest is not null and vec_id is not null")
        grouped = known.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("group_rows"), F.first("vector").alias("vector"))
        kind = _precision(rows, vec_col)
        width = (F.length("vector") / np.dtype(kind).itemsize).cast("int")
        classes = saved(grouped.withColumns({"cid": F.monotonically_increasing_id(), "width": width}), "vector-classes")
        linked = saved(_linked(classes, threshold, kind), "vector-links")
        counts = linked.groupBy(F.col("c").alias("cid")).agg(F.sum("n").alias("n"))
        usable = F.when(F.col("vec_id").isNotNull(), F.col("digest"))
        narrow = saved(vectors.select(F.col("vec_id").alias("id"), usable.alias("digest")), "vector-rows")
        by_digest, by_id = class_components(narrow, classes, linked.select(F.col("c").alias("a"), F.col("d").alias("b")), repeated_ids(narrow))
        placed = classes.select("digest", "cid", "rep", "group_rows").join(counts, "cid", "left").join(by_digest, "digest", "left").where("group_rows > 1 or n is not null or component_id is not null")
        links_of = F.coalesce("n", F.lit(0)) + F.col("group_rows") - 1
        groups = saved(placed.select("digest", "group_rows", F.coalesce("component_id", "rep").alias("component_id"), links_of.alias("n_links")), "vector-groups")
        every = saved(with_components(narrow, groups, by_id, narrow.count()).select("id", "n_links", "component_id"), "vector-result")
        keep.append(every)
    out = every.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _pairs(cells: dict[int, tuple[int, float]], pivots: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Cells (a <= b) that may hold a link between them, from the size and radius of each. There are at most PIVOTS cells."""
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    limit = np.arccos(threshold) + 1e-6
    return [(a, b) for a in sorted(cells) for b in sorted(cells) if a == b or (a < b and between[a, b] - cells[a][1] - cells[b][1] <= limit)]


_TILES = ["width", "a", "slot_a", "b", "slot_b"]


def tile_size(n: int, tasks: int, width: int = 1) -> int:
    """Vectors per tile: so many that pairs of tiles keep `tasks` tasks busy about twice, within LEAST_TILE and TILE.

    Up to TILE * sqrt(4 * tasks) vectors a row is dealt to the same number of tiles, whatever n. Of long vectors
    (`width` components) a tile takes fewer, so that a task's two tiles stay within its memory.
    """
    most = min(TILE, TILE_BYTES // (8 * width))
    return max(min(LEAST_TILE, TILE), min(most, math.ceil(n / math.ceil(math.sqrt(4 * tasks)))))


def _dealt(coded: DataFrame, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Every row once for each pair of tiles it is part of. plan: width, cells a <= b and the slots (tiles) of each.

    Only pairs of cells are joined; pairs of tiles are spelled out row by row.
    """
    sides = [(w, a, a, b, 0, m, n) for w, a, b, m, n in plan] + [(w, b, a, b, 1, n, m) for w, a, b, m, n in plan]
    table = coded.sparkSession.createDataFrame(sides, "width int, cell int, a int, b int, side int, slots int, others int")
    own = coded.join(small(table), ["width", "cell"]).withColumn("slot", F.pmod(F.xxhash64("cid"), F.col("slots")).cast("int"))
    # within a cell a tile meets itself and the later ones; with itself its rows come once, on side 0
    same = F.col("a") == F.col("b")
    low = F.when(same & (F.col("side") == 0), F.col("slot")).otherwise(0)
    high = F.when(same & (F.col("side") == 1), F.col("slot")).otherwise(F.col("others")) - 1
    met = own.withColumn("other", F.explode(F.when(low <= high, F.sequence(low, high))))
    first, second = F.when(F.col("side") == 0, F.col("slot")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("slot"))
    return met.select("width", "a", first.alias("slot_a"), "b", second.alias("slot_b"), "side", "cid", "codes", "scale", "error")


def _by_tiles(batches: Iterator, work) -> Iterator:
    """work(tile pair, sides, rows of the other columns) for the rows of each pair of tiles, which follow one another."""
    at, rows = None, []
    for batch in batches:
        for *pair, side, row in zip(*(batch.column(c).to_pylist() for c in range(6)), zip(*(batch.column(c).to_pylist() for c in range(6, batch.num_columns)))):
            if pair != at:
                if rows:
                    yield from work(at, rows)
                at, rows = pair, []
            rows.append((side, row))
    if rows:
        yield from work(at, rows)


def _linked(classes: DataFrame, threshold: float, kind: type) -> DataFrame:
    """c, d, n: for classes with links, n linked rows of other classes, and a class d in the same component (perhaps c itself)."""
    spark = classes.sparkSession
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = {r.width: r.n for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(TILE, LEAST_TILE)).collect()}
    pivots, plan = {}, []
    for width, n in sorted(sizes.items()):
        k = min(PIVOTS, max(1, math.ceil(n / tile_size(n, tasks, width))))
        chosen = classes.where(F.col("width") == width).orderBy(F.xxhash64("cid"), "cid").limit(k).select("vector").collect()
        pivots[width] = _unit(_matrix([bytes(r.vector) for r in chosen], kind))
    coded = saved(_coded(classes, pivots, kind), "vector-codes")
    found: dict[int, dict[int, tuple[int, float]]] = {}
    for r in coded.where(F.col("width").isin(list(sizes))).groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect():
        found.setdefault(r.width, {})[r.cell] = (r.n, r.radius)
    for width, cells in sorted(found.items()):
        tile = tile_size(sizes[width], tasks, width)
        slots = {c: math.ceil(n / tile) for c, (n, _) in cells.items()}
        plan += [(width, a, b, slots[a], slots[b]) for a, b in _pairs(cells, pivots[width], threshold)]
    # vectors of lengths that few have are one tile each
    few = coded.where(~F.col("width").isin(list(sizes)))
    alone = few.select("width", *[F.lit(0).alias(c) for c in (*_TILES[1:], "side")], "cid", "codes", "scale", "error")
    dealt = _dealt(coded, plan).unionByName(alone) if plan else alone
    pairs = sum(m * n if a != b else m * (m + 1) // 2 for _, a, b, m, n in plan)
    parts = max(tasks, min(pairs, MOST_TASKS))

    def survivors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def work(pair: list, rows: list[tuple]) -> Iterator:
            split = sum(1 for side, _ in rows if side == 0)
            alone = split == len(rows)
            codes = np.frombuffer(b"".join(r[1] for _, r in rows), np.int8).reshape(len(rows), -1)
            scale, error = np.array([r[2] for _, r in rows]), np.array([r[3] for _, r in rows])
            first = codes[:split], scale[:split], error[:split]
            second = first if alone else (codes[split:], scale[split:], error[split:])
            hit = np.zeros(len(rows), bool)
            for i, j, about, bound in estimates(first, second):
                may = about + bound >= threshold
                if alone:
                    if i.start > j.start:
                        continue
                    if i.start == j.start:
                        np.fill_diagonal(may, False)
                hit[:split][i] |= may.any(axis=1)
                (hit if alone else hit[split:])[j] |= may.any(axis=0)
            some = np.flatnonzero(hit).tolist()
            if some:
                names = [*_TILES, "side", "cid"]
                columns = [pa.array([x] * len(some), pa.int32()) for x in pair] + [pa.array([rows[i][0] for i in some], pa.int32()), pa.array([rows[i][1][0] for i in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

        yield from _by_tiles(batches, work)

    schema = "width int, a int, slot_a int, b int, slot_b int, side int, cid long"
    left = saved(dealt.repartition(parts, *_TILES).sortWithinPartitions(*_TILES, "side").mapInArrow(survivors, schema), "survivors")

    def confirmed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def work(pair: list, rows: list[tuple]) -> Iterator:
            split = sum(1 for side, _ in rows if side == 0)
            alone = split == len(rows)
            cids, sizes = np.array([r[0] for _, r in rows], np.int64), np.array([r[1] for _, r in rows], np.int64)
            x = _matrix([r[2] for _, r in rows], kind)
            counts, forest = np.zeros(len(rows), np.int64), _Forest(len(rows))
            for i, j in links(x[:split], x if alone else x[split:], threshold):
                if alone:
                    some = i < j
                    i, j = i[some], j[some]
                else:
                    j = j + split
                counts += np.bincount(i, weights=sizes[j], minlength=len(rows)).astype(np.int64)
                counts += np.bincount(j, weights=sizes[i], minlength=len(rows)).astype(np.int64)
                forest.add(i, j)
            hit = np.flatnonzero(counts)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(cids[hit]), pa.array(cids[forest.label[hit]]), pa.array(counts[hit])], ["c", "d", "n"])

        yield from _by_tiles(batches, work)

    whole = small(left).join(classes.select("cid", "group_rows", "vector"), "cid").select(*_TILES, "side", "cid", "group_rows", "vector")
    return whole.repartition(parts, *_TILES).sortWithinPartitions(*_TILES, "side").mapInArrow(confirmed, "c long, d long, n long")
