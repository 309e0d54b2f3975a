"""What the corpus operators share beyond the engine: zstandard dictionaries and slices of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import discard, fits, join_by_group, only, saved, scratch, shared_root, small, unused

__all__ = [
    "dictionary_of", "discard", "fits", "join_by_group", "keep_once", "only", "saved", "scratch", "shared_root", "slices", "small", "text_mark", "unused", "without",
]

#: Keys of rows to drop are broadcast up to so many bytes; the other way is to shuffle whole documents.
KEY_BYTES = 32 << 20


def text_mark(digest: Column) -> Column:
    """60 bits of a digest in hexadecimal: with the id of a row they tell its text from others of that id."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _matched(docs: DataFrame, keys: DataFrame, columns: list[str], how: str) -> DataFrame:
    """docs joined with distinct keys (a saved table) on columns, null equal to null, by broadcast where the keys are few."""
    names = [unused(docs, f"gone_{k}") for k in range(len(columns))]
    keys = keys.toDF(*names)
    if fits(keys, KEY_BYTES):
        keys = F.broadcast(keys)
    return docs.join(keys, [docs[c].eqNullSafe(keys[n]) for c, n in zip(columns, names)], how)


def without(docs: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """docs without the rows whose columns are in keys."""
    return _matched(docs, keys, columns, "left_anti")


def keep_once(docs: DataFrame, gone: DataFrame, again: DataFrame, columns: list[str]) -> DataFrame:
    """docs without the rows whose columns are in gone, and with one row of each that is in again. Both are saved tables of distinct keys."""
    out = without(docs, gone, columns)
    if again.isEmpty():
        return out
    # only the repeated rows are shuffled; of each group the map side keeps one
    once = _matched(out, again, columns, "left_semi").dropDuplicates(columns)
    return without(out, again, columns).unionByName(once)

#: The smallest dictionary that zstandard makes, and the fewest samples that its trainer takes.
LEAST_DICTIONARY, LEAST_SAMPLES = 256, 8


def slices(raw: bytes, most: int, parts: int = 8, unit: int = 1) -> bytes:
    """Up to `most` bytes of raw, in equal slices spread evenly over it, each beginning at a multiple of unit."""
    if len(raw) <= most:
        return raw
    size = most // parts // unit * unit
    starts = [(len(raw) - size) * k // (parts - 1) // unit * unit for k in range(parts)]
    return b"".join(raw[at : at + size] for at in starts)


def dictionary_of(samples: list[bytes], most: int) -> bytes:
    """A zstandard dictionary of an eighth of the samples, of 256 bytes at least and `most` at most.

    Samples too few or too short for the trainer are cut into pieces; where it still finds nothing
    that repeats, the samples themselves, the last `most` bytes of them, are the dictionary's content.
    Empty only if all samples are.
    """
    import zstandard

    samples = [s for s in samples if s]
    total = sum(map(len, samples))
    if not total:
        return b""
    size = max(LEAST_DICTIONARY, min(most, total // 8))
    pieces = samples
    if len(samples) < LEAST_SAMPLES:
        step = max(8, total // (4 * LEAST_SAMPLES))
        pieces = [s[at : at + step] for s in samples for at in range(0, len(s), step)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        # content without the magic number of a trained dictionary is a raw one
        return b"".join(samples)[-most:]
