"""Token counts (operator 9): byte-pair merging on a heap and a linked list, counting only.

A text's count is the sum over its pre-tokens of initial bytes minus merges;
no identifiers are made. Equal pre-tokens are counted once per worker and kept
in a bounded table.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import bytebpe
from .textcols import WordTable, range_hashes, sub_batches, sums_by_document

#: A document with more tokens is over the limit.
LIMIT = 1024


@functools.cache
def merge_ranks(path: str) -> dict[tuple[bytes, bytes], int]:
    """Rank of each merge of a tokenizers .json file, keyed by the two byte strings."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    bytebpe.check(path)
    letters = {c: b for b, c in bytebpe.alphabet().items()}
    as_bytes = functools.cache(lambda piece: bytes(letters[c] for c in piece))
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return {(as_bytes(a), as_bytes(b)): rank for rank, (a, b) in enumerate(pairs)}


def count_tokens(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Initial symbols minus merges, taking the lowest-rank adjacent pair (leftmost first) again and again."""
    n = len(word)
    if n < 2:
        return n
    piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    rank = ranks.get
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := rank((a, b))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if piece[i] != a or j >= n or piece[j] != b:
            continue  # one of the two has been merged meanwhile
        merges += 1
        joined = piece[i] = a + b
        piece[j] = None
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := rank((joined, piece[k]))) is not None:
                heapq.heappush(heap, (r, i, joined, piece[k]))
        h = left[i]
        if h >= 0 and (r := rank((piece[h], joined))) is not None:
            heapq.heappush(heap, (r, h, piece[h], joined))
    return n - merges


@functools.cache
def _table(path: str) -> WordTable:
    return WordTable(dtype=np.int32)


def batch_counts(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text; null counts as empty."""
    ranks, table = merge_ranks(path), _table(path)
    segments, owner, specials = bytebpe.cut_special(texts)
    points, starts, ends, segment = bytebpe.split(segments)

    def make(first: np.ndarray) -> tuple[list[int], np.ndarray]:
        counts = [count_tokens(bytebpe.text_of(points, starts[i], ends[i]).encode(), ranks) for i in first.tolist()]
        return counts, np.ones(len(first), np.int32)

    if not len(starts):
        return specials
    at, _ = table.lookup(range_hashes(points, starts, ends), make)
    return specials + sums_by_document(table.data[at], owner[segment], len(texts))


def count_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every document.

    Null and empty texts have 0 bytes and 0 tokens; a null id is passed on; repeated rows
    give repeated results; an empty table gives an empty one; other columns are not read.
    One narrow pass without a shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in sub_batches(batches, text_col):
            tokens = batch_counts(texts, path)
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
