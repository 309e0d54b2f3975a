"""Vectorised text kernels over whole batches: code points, words and their hashes.

A batch of texts is one array of code points with document offsets; words are
half-open ranges of it. Nothing here is limited in text length.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np

#: Characters of one sub-batch; a longer text makes a sub-batch of its own.
SUB_BATCH_CHARS = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX2
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0..n-1, modulo 2**64; kept and grown as needed."""
    global _POWERS
    if n > len(_POWERS):
        fresh = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        fresh[0] = 1
        _POWERS = np.multiply.accumulate(fresh)
    return _POWERS


_POWERS = np.ones(1, np.uint64)


def give_back() -> None:
    """Return what Arrow and the C library hold free to the system; a worker that waits for its next task would keep it from the others."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # C libraries other than glibc
        ctypes.CDLL(None).malloc_trim(0)


def sub_batches(batches: Iterator, text: str = "text", chars: int = SUB_BATCH_CHARS) -> Iterator[tuple]:
    """Slices of Arrow batches with at most about `chars` characters, and their texts (null as None). Free memory is given back at the end."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + chars, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(text).to_pylist()
            start = stop
    batch = part = None
    give_back()


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and offsets of length len(texts) + 1."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return points, offsets


def range_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of points[start:end] for ascending, disjoint, non-empty ranges."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    if len(starts) == 1 or np.array_equal(starts[1:], ends[:-1]):
        values = points[starts[0] : ends[-1]]
        bounds = starts - starts[0]
        place = np.arange(len(values), dtype=np.int64) - np.repeat(bounds, lengths)
    else:
        bounds = np.zeros(len(starts), np.int64)
        np.cumsum(lengths[:-1], out=bounds[1:])
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(bounds, lengths)
        values = points[place + np.repeat(starts, lengths)]
    terms = (values.astype(np.uint64) + np.uint64(1)) * _MIX
    terms ^= terms >> np.uint64(31)
    terms *= powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(terms, bounds) ^ (lengths.astype(np.uint64) << np.uint64(48)))


#: ASCII space, and tab to carriage return: the white space of the word contracts.
def word_ranges(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words `[^\\x20\\x09-\\x0D]+`; none crosses a document."""
    inside = ~((points == 32) | ((points >= 9) & (points <= 13)))
    edge = np.zeros(len(points) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    if len(starts):
        real = inside[starts]
        starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lower_ascii(points: np.ndarray) -> np.ndarray:
    """A-Z as a-z; everything else as it is."""
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


class WordTable:
    """A bounded map from word hash to a run of small integers, for whole arrays at once.

    Misses are made by `make(first)`; when the map holds more than `most` words
    it starts afresh, which only costs time. New words go to a small sorted
    layer that is merged into the large one now and then.
    """

    def __init__(self, most: int = 3_000_000, dtype=np.uint16):
        self.most, self.dtype = most, dtype
        self._clear()

    def _clear(self) -> None:
        self.layers = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in range(2)]
        self.store, self.used = np.zeros(1 << 16, self.dtype), 0

    def __len__(self) -> int:
        return sum(len(layer[0]) for layer in self.layers)

    @property
    def data(self) -> np.ndarray:
        return self.store[: self.used]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, at, size = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        for have, places, sizes in self.layers:
            if len(have):
                spot = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[spot] == keys
                known |= hit
                at[hit], size[hit] = places[spot[hit]], sizes[spot[hit]]
        return known, at, size

    def _add(self, layer: int, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        have = self.layers[layer]
        into = np.searchsorted(have[0], keys)
        self.layers[layer] = tuple(np.insert(x, into, y) for x, y in zip(have, (keys, at, size)))

    def lookup(self, hashes: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """For each hash, place and length of its run in self.data.

        make(first) gets, for each missing distinct hash, the index of one of its
        occurrences, and returns (all runs in a row, their lengths).
        """
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known, at, size = self._find(keys)
        if not known.all():
            if len(self) + np.count_nonzero(~known) > self.most:
                self._clear()
                known[:] = False
            new = ~known
            runs, sizes = make(first[new])
            runs, sizes = np.asarray(runs, self.dtype), np.asarray(sizes, np.int32)
            if self.used + len(runs) > len(self.store):
                grown = np.zeros(max(len(self.store) * 3 // 2, self.used + len(runs)), self.dtype)
                grown[: self.used] = self.store[: self.used]
                self.store = grown
            self.store[self.used : self.used + len(runs)] = runs
            at[new] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
            size[new] = sizes
            self.used += len(runs)
            self._add(1, keys[new], at[new], size[new])
            if len(self.layers[1][0]) > 1000 + len(self.layers[0][0]) // 8:
                small, self.layers[1] = self.layers[1], tuple(x[:0] for x in self.layers[1])
                self._add(0, *small)
        return at[inverse], size[inverse]


def gather_runs(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[at:at+size] of all runs in a row."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    if not len(size) or not ends[-1]:
        return data[:0]
    return data[np.arange(ends[-1]) + np.repeat(at - (ends - size), size)]


def sums_by_document(values: np.ndarray, documents: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of values by document number."""
    return np.rint(np.bincount(documents, weights=values, minlength=n)).astype(np.int64)
