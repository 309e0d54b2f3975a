"""MinHash near-dedup (operator 8) by min-max hashing.

Each permutation gives two signature values, the smallest and the largest image,
so a signature of 192 values takes 96 hash evaluations per shingle. The signature is
cut into bands; equal bands make candidates. Candidates are confirmed on the
full shingle sets. Documents of equal sets form a class first, and only one
of a class goes on.

Candidates of a band bucket are not all paired. (1) Every member is checked
against the bucket's first member. (2) The links found give components; where
the members of a bucket still lie in several, those outside the largest one are
compared, by signature and in blocks, with the members of other components.
Documents that may be similar enough to another are dealt to the same blocks
again with their full sets, and each block gives a spanning forest of its links;
so no pairs are written, only documents and links. Links inside one component
change nothing, so the components are those of all links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import class_components, components, repeated_ids, with_components
from .shared import discard, join_by_group, keep_once, only, saved, small, text_mark, unused
from .textcols import code_points, lower_ascii, mix64, range_hashes, sub_batches, word_ranges

#: Permutations; each gives a minimum and a maximum.
PERMUTATIONS = 96

#: Members outside a bucket's largest component are compared in blocks of so many, against so many others at a time;
#: in larger buckets of up to MOST, so that members are dealt to more blocks only in buckets that are larger still.
BLOCK, OTHERS, MOST = 256, 256, 8192

#: Blocks grow once a bucket has so many pairs of them for each task, enough to spread its work evenly.
PAIRS = 64

#: The full sets that a block holds at once have so many shingles together, unless a single one has more.
HELD_SHINGLES = 1 << 22

#: Standard errors under the threshold down to which a signature's estimate counts as perhaps similar enough.
MARGIN = 5.0

_ODD = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_ADD = mix64(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64)).astype(np.uint32)


def band_rows(percent: int) -> int:
    """Signature values per band: pairs at the threshold share no band in fewer than one case in a million."""
    for rows in range(8, 1, -1):
        if (1 - (percent / 100) ** rows) ** (2 * PERMUTATIONS // rows) < 1e-6:
            return rows
    return 1


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than a shingle takes, one of them all; none without words."""
    points, offsets = code_points([t or "" for t in texts])
    points = lower_ascii(points)
    starts, ends, document = word_ranges(points, offsets)
    hashes = range_hashes(points, starts, ends)
    first = np.searchsorted(document, np.arange(len(texts) + 1))
    n = max(0, len(hashes) - words + 1)
    shingles = np.zeros(n, np.uint64)
    for k in range(words):
        shingles = mix64(shingles + hashes[k : k + n] + np.uint64(k + 1))
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(shingles[a : b - words + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(b - a):
                one = mix64(one + hashes[a + k : a + k + 1] + np.uint64(k + 1))
            out.append(mix64(one + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side; shingles may be of any number."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 2048):
        images = x[at : at + 2048, None] * _ODD + _ADD
        images ^= images >> np.uint32(15)
        images *= np.uint32(0x2C1B3C6D)
        np.minimum(low, images.min(axis=0), out=low)
        np.maximum(high, images.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band, different for different bands."""
    n = len(values) // rows
    parts = values[: n * rows].reshape(n, rows).astype(np.uint64)
    keys = np.arange(1, n + 1, dtype=np.uint64)
    for k in range(rows):
        keys = mix64(keys + parts[:, k] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    return keys.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, mark: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys, one byte of each signature value, and the mark (a long) of the row, if one is asked for."""
    rows = band_rows(percent)
    schema = "doc_id long, n_shingles long, digest string, bands array<long>, sig binary, mark long"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in sub_batches(batches, text_col):
            sizes, digests, keys, sigs = [], [], [], []
            for s in shingle_sets(texts, words):
                sizes.append(len(s))
                digests.append(_digest(s))
                values = signature(s)
                keys.append(bands(values, rows) if len(s) else None)
                sigs.append(values.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), part.column(2)],
                ["doc_id", "n_shingles", "digest", "bands", "sig", "mark"],
            )

    mark = F.lit(None).cast("long") if mark is None else mark
    return docs.select(id_col, text_col, mark.alias(unused(docs, "own_mark"))).mapInArrow(run, schema)


def _digest(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def _sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """cid, set (its shingle hashes as bytes) of the classes wanted (cid, rep, digest), from the document rep of each.

    Only where ids repeat are rows reduced to one per class; the others are not shuffled if the ids fit a broadcast.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in sub_batches(batches, text_col):
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([_digest(s) for s in sets]), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "digest", "set"])

    ids = wanted.select(F.col("rep").alias("_rep")).distinct()
    some = docs.select(id_col, text_col).join(small(ids), F.col(id_col) == F.col("_rep"), "left_semi").mapInArrow(run, "id long, digest string, set binary")
    if not repeated.isEmpty():
        some = saved(some, "sets-of-rows")
        again = repeated.select("id")
        once = some.join(small(again), "id", "left_semi").dropDuplicates(["digest"])
        some = some.join(small(again), "id", "left_anti").unionByName(once)
    return some.drop("id").join(small(wanted.select("cid", "digest")), "digest").select("cid", "set")


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether 100 * common >= percent * all, on full sets."""
    few, many = (one, other) if len(one) < len(other) else (other, one)
    if not len(few) or 100 * len(few) < percent * len(many):
        return False
    common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of cids whose full sets are similar enough. Pairs are dealt by a, in chunks, and stream past a's set."""
    n = pairs.count()
    degrees = saved(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("group_rows")), "degrees")
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("group_rows") / 256)).cast("int")
    dealt = saved(join_by_group(pairs, degrees, ["a"], n).select("a", "b", chunk.alias("chunk")), "dealt")
    wanted = dealt.select("a", "chunk", F.col("b").alias("cid"), F.lit(1).alias("turn")).unionByName(
        dealt.select("a", "chunk", F.col("a").alias("cid"), F.lit(0).alias("turn")).distinct()
    )
    wanted = saved(wanted, "wanted")
    rows = sets.join(small(wanted), "cid").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "turn")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, own = None, []
        for batch in batches:
            found = []
            for a, chunk, cid, turn, raw in zip(*(batch.column(k).to_pylist() for k in ("a", "chunk", "cid", "turn", "set"))):
                shingles = np.frombuffer(raw, np.uint64)
                if at != (a, chunk):
                    at, own = (a, chunk), []
                if turn == 0:
                    own.append(shingles)
                    continue
                if any(similar(mine, shingles, percent) for mine in own):
                    found.append((a, cid))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return rows.select("a", "chunk", "cid", "turn", "set").mapInArrow(run, "a long, b long")


def _parts(n: Column, least: int, most: int, tasks: int) -> Column:
    """In how many parts n rows of a bucket are dealt: parts grow, from `least` rows to `most`, once their pairs are PAIRS for each of the tasks."""
    size = F.least(F.lit(max(least, most)), F.greatest(F.lit(least), F.ceil(n / math.ceil(math.sqrt(PAIRS * tasks)))))
    return F.ceil(n / size).cast("int")


def _blocks(members: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that lie in several components, dealt to blocks.

    In a block, the rows of turn 0 (outside the bucket's largest component) are to be
    compared with those of turn 1 (any). A member is dealt to a bounded number of blocks
    up to MOST * sqrt(PAIRS * shuffle partitions) members of a bucket.
    """
    tasks = max(8, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = members.join(found.select(F.col("id").alias("cid"), "component_id"), "cid", "left")
    placed = saved(placed.select("key", "cid", F.coalesce("component_id", "cid").alias("part")), "placed")
    parts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("group_rows"), F.max(F.struct("n", "part")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    buckets = saved(mixed.select("key", "group_rows", F.col("top.part").alias("main"), (F.col("group_rows") - F.col("top.n")).alias("others")), "mixed")
    rows = join_by_group(placed, buckets, ["key"], placed.count())
    blocks, lanes = _parts(F.col("others"), BLOCK, MOST, tasks), _parts(F.col("group_rows"), OTHERS, MOST, tasks)
    block, lane = F.pmod(F.xxhash64("cid", F.lit(1)), blocks).cast("int"), F.pmod(F.xxhash64("cid", F.lit(2)), lanes).cast("int")
    asking = rows.where("part <> main").select("key", "cid", "part", block.alias("block"), F.explode(F.sequence(F.lit(0), lanes - 1)).alias("lane"), F.lit(0).alias("turn"))
    asked = rows.select("key", "cid", "part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), lane.alias("lane"), F.lit(1).alias("turn"))
    return asking.unionByName(asked).join(classes.select("cid", "n_shingles", "sig", "bands"), "cid")


_PLACE = ["key", "block", "lane"]


def _least(percent: int) -> float:
    share = percent / 100
    return share - MARGIN * (share * (1 - share) / (2 * PERMUTATIONS)) ** 0.5


class _Block:
    """The rows of turn 0 of one block, to compare rows of turn 1 with."""

    def __init__(self, rows: list[tuple], percent: int):
        self.cids, self.parts, self.sizes = (np.array([r[k] for r in rows]) for k in range(3))
        self.sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        self.percent, self.least = percent, _least(percent)

    def may(self, part: int, n: int, sig: bytes) -> np.ndarray:
        """Places of rows of another component that may be similar enough."""
        some = np.flatnonzero((self.parts != part) & (100 * np.minimum(self.sizes, n) >= self.percent * np.maximum(self.sizes, n)))
        return some[(self.sigs[some] == np.frombuffer(sig, np.uint8)).mean(axis=1) >= self.least] if len(some) else some


def _candidates(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows of blocks that may be similar enough to one of the other turn; a pair counts in the first band it shares."""
    schema = "key long, block int, lane int, turn int, cid long, part long, n_shingles int, sig binary"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = [f.split()[0] for f in schema.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def asked() -> list[tuple]:
            return [(*at, 0, *queries[i][:4]) for i in np.flatnonzero(hit).tolist()] if block is not None else []

        at, queries, block, hit, their = None, [], None, np.zeros(0, bool), None
        for batch in batches:
            out = []
            for *key, turn, cid, part, n, sig, keys in zip(*(batch.column(k) if k == "bands" else batch.column(k).to_pylist() for k in (*_PLACE, "turn", "cid", "part", "n_shingles", "sig", "bands"))):
                if at != key:
                    out += asked()
                    at, queries, block = key, [], None
                bands = keys.values.to_numpy()
                if turn == 0:
                    queries.append((cid, part, n, sig, bands))
                    continue
                if not queries:
                    continue
                if block is None:
                    block, hit, their = _Block(queries, percent), np.zeros(len(queries), bool), np.stack([q[4] for q in queries])
                may = block.may(part, n, sig)
                if len(may):  # a pair counts in the first band it shares
                    may = may[bands[(their[may] == bands).argmax(axis=1)] == key[0]]
                if len(may):
                    hit[may] = True
                    out.append((*at, 1, cid, part, n, sig))
            if out:
                yield batch_of(out)
        if last := asked():
            yield batch_of(last)

    dealt = blocks.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "turn")
    return dealt.withColumn("n_shingles", F.col("n_shingles").cast("int")).mapInArrow(run, schema)


def _split(candidates: DataFrame) -> tuple[DataFrame, list[str]]:
    """candidates, and what they are dealt by: where the asking rows of blocks have large sets, also pieces of blocks, each with all rows of turn 1."""
    shares = F.ceil(F.sum("n_shingles") / HELD_SHINGLES).cast("int").alias("parts")
    large = saved(candidates.where("turn = 0").groupBy(*_PLACE).agg(shares).where("parts > 1"), "large-blocks")
    if large.isEmpty():
        return candidates, _PLACE
    parts, own = F.coalesce("parts", F.lit(1)), F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1))).cast("int")
    pieces = F.when(F.col("turn") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), parts - 1))
    return saved(candidates.join(small(large), _PLACE, "left").withColumn("piece", F.explode(pieces)).drop("parts"), "candidates"), [*_PLACE, "piece"]


def _across(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the links (a, b) between components, from each piece of a block, on the full sets."""
    split, place = _split(candidates)
    rows = sets.join(small(split), "cid")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, queries, block, joined = None, [], None, {}

        def root(part: int) -> int:
            while joined.get(part, part) != part:
                part = joined[part]
            return part

        for batch in batches:
            found = []
            for *key, turn, cid, part, n, sig, raw in zip(*(batch.column(k).to_pylist() for k in (*place, "turn", "cid", "part", "n_shingles", "sig", "set"))):
                if at != key:
                    at, queries, block, joined = key, [], None, {}
                if turn == 0:
                    queries.append((cid, part, n, sig, np.frombuffer(raw, np.uint64)))
                    continue
                if not queries:
                    continue
                if block is None:
                    block = _Block(queries, percent)
                shingles = np.frombuffer(raw, np.uint64)
                for i in block.may(part, n, sig).tolist():
                    one, other = root(part), root(queries[i][1])
                    if one != other and similar(queries[i][4], shingles, percent):
                        joined[max(one, other)] = min(one, other)
                        found.append((cid, queries[i][0]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition(*place).sortWithinPartitions(*place, "turn").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Documents are linked when 100 * common shingles >= percent * all shingles of the two,
    shingles being runs of `words` words (blanks by the contract, A-Z lower-cased), told apart by 64 bits of hash.
    Documents without words and rows with a null id are linked with nothing and kept
    (a null id has a null component). Rows of one id are one node: what any of them is linked with, all
    are, so all are kept or none; keep_one() tells single rows. Columns besides id and text are
    not read; an empty table gives an empty one. A pair at the
    threshold shares no band in fewer than one case in a million.
    """
    return _found(docs, id_col, text_col, words, percent).drop("digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component of near copies; all columns, whatever their names.

    Here every row is a node of its own, also among rows of one id; so a text that is like no other
    stays whatever its id. Of a component the row with the smallest id stays, then with the smallest
    60 bits of the SHA-256 of its text; of rows that repeat id and text a single one. Rows without
    words or with a null id are like nothing and stay. An empty table gives an empty one.
    """
    mark = text_mark(F.sha2(F.col(text_col), 256))
    with only() as keep:
        sketch = saved(sketches(docs, id_col, text_col, words, percent, mark), "sketches")
        classes = _classes(sketch.where("n_shingles > 0 and doc_id is not null"))
        known = saved(sketch.where("n_shingles > 0 and doc_id is not null").select("doc_id", "mark", "digest"), "rows")
        discard(sketch)
        repeated = repeated_ids(known.select(F.col("doc_id").alias("id"), "digest"))
        links = _links(docs, classes, repeated, id_col, text_col, words, percent)
        found = components(links).select(F.col("id").alias("cid"), F.col("component_id").alias("label"))
        labels = classes.select("digest", "cid", "group_rows").join(found, "cid", "left").where("group_rows > 1 or label is not null")
        labels = saved(labels.select("digest", "group_rows", F.coalesce("label", "cid").alias("label")), "labels")
        rows = saved(join_by_group(known, labels, ["digest"], classes.count()).select("doc_id", "mark", "label"), "near-rows")
        best = saved(rows.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("best"), F.count(F.lit(1)).alias("group_rows")).select("label", "group_rows", F.col("best.doc_id").alias("best_id"), F.col("best.mark").alias("best_mark")), "best")
        decided = join_by_group(rows, best, ["label"], rows.count()).select("doc_id", "mark", ((F.col("doc_id") == F.col("best_id")) & (F.col("mark") == F.col("best_mark"))).alias("stays"))
        counted = saved(decided.groupBy("doc_id", "mark", "stays").agg(F.count(F.lit(1)).alias("n")).where("not stays or n > 1"), "near-copies")
        keep.append(counted)
    gone, again = (counted.where(c).select("doc_id", "mark") for c in ("not stays", "stays"))
    name = unused(docs, "own_mark")
    return keep_once(docs.withColumn(name, mark), gone, again, [id_col, name]).drop(name)


def _classes(known: DataFrame) -> DataFrame:
    """One row per set: digest, cid (a number of its own), rep (smallest id), group_rows, n_shingles, bands and sig."""
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")]
    grouped = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("group_rows"), *firsts)
    return saved(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _links(docs: DataFrame, classes: DataFrame, repeated: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Links (a, b) of cids, whose components are those of all links."""
    with only() as keep:
        n = classes.count()
        banded = classes.select(F.explode("bands").alias("key"), "cid")
        buckets = saved(banded.groupBy("key").agg(F.count(F.lit(1)).alias("group_rows"), F.min("cid").alias("center")).where("group_rows > 1"), "buckets")
        members = saved(join_by_group(banded, buckets, ["key"], n).select("key", "cid", "center"), "members")
        discard(buckets)
        stars = saved(members.where("cid <> center").select(F.col("center").alias("a"), F.col("cid").alias("b")).distinct(), "stars")
        wanted = saved(classes.select("cid", "rep", "digest").join(members.select("cid").distinct(), "cid", "left_semi"), "wanted-sets")
        sets = saved(_sets(docs, wanted, repeated, id_col, text_col, words), "sets")
        links = saved(_confirmed(stars, sets, percent), "links")
        found = saved(components(links), "components")
        candidates = saved(_candidates(_blocks(members.select("key", "cid"), classes, found), percent), "candidates")
        every = saved(links.unionByName(_across(candidates, sets, percent)), "links")
        keep.append(every)
    return every


def _found(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    with only() as keep:
        sketch = saved(sketches(docs, id_col, text_col, words, percent), "sketches")
        known = sketch.where("n_shingles > 0 and doc_id is not null")
        classes = _classes(known)
        narrow = saved(sketch.select(F.col("doc_id").alias("id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")), "rows")
        discard(sketch)
        repeated = repeated_ids(narrow)
        links = _links(docs, classes, repeated, id_col, text_col, words, percent)
        by_digest, by_id = class_components(narrow.select("id", "digest"), classes, links, repeated)
        placed = classes.select("digest", "rep", "group_rows").join(by_digest, "digest", "left").where("group_rows > 1 or component_id is not null")
        groups = saved(placed.select("digest", "group_rows", F.coalesce("component_id", "rep").alias("component_id")), "groups")
        every = saved(with_components(narrow, groups, by_id, classes.count()), "near-result")
        keep.append(every)
    out = every.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "digest")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
