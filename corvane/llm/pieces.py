"""SentencePiece encoding and decoding (operator 7) with seeded merge-dropout.

Merges are taken from an agenda, best score first and leftmost among equals. A
candidate is skipped when a hash keyed by seed, document, copy, the word's place
in the document and the candidate's place in the word is under the dropout share;
so reruns agree, every occurrence of a word is cut by draws of its own, and every
cut decodes to the same text. Kept from one occurrence to the next is only what
no draw decides: the cut of a word and the merges it takes once given merges are
dropped. An occurrence draws for these merges, and the first one dropped leads it
to the next such cut.
Words run from a run of spaces to the next one: no piece holds a space after
another character (checked when the model is loaded). A literal U+2581 is
written as byte pieces, so that it is not read back as a space.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .textcols import WordTable, code_points, gather_runs, mix64, range_hashes, sub_batches

#: The column variant deals documents to so many groups; cuts do not follow from it.
VARIANTS = 4
DROPOUT = 0.1
SEED = 20240229
MARK = "▁"

#: Words of up to so many characters go through the agenda together, longer ones singly.
TOGETHER = 24
#: A candidate's left, middle and right end in a word of up to TOGETHER characters, as one number.
_BASE = TOGETHER + 1
_NEVER = np.int32(2**31 - 1)


class Pieces:
    """The pieces of a model: ids, scores as ranks, merges, and the bytes they decode to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        normal = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[1:-1], 16)] = i
                self.raw.append(bytes([int(name[1:-1], 16)]))
            elif special[i]:
                self.raw.append(b"")
            else:
                self.raw.append(name.replace(MARK, " ").encode())
                normal.append(i)
                if MARK in name.lstrip(MARK):
                    raise ValueError(f"piece {name!r} holds a space inside; words cannot be cut at spaces")
        self.id_of = {names[i]: i for i in normal}
        order = sorted(normal, key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(n, _NEVER, np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.chars = np.full(0x110000, -1, np.int32)
        for name, i in self.id_of.items():
            if len(name) == 1 and name != MARK:
                self.chars[ord(name)] = i
        self.chars[32] = self.id_of[MARK]
        merges = sorted(
            (self.id_of[a] << 32 | self.id_of[b], self.id_of[name])
            for name in self.id_of
            for a, b in ((name[:k], name[k:]) for k in range(1, len(name)))
            if a in self.id_of and b in self.id_of
        )
        self._index(np.array([m[0] for m in merges], np.int64), np.array([m[1] for m in merges], np.int32))
        self.lengths = np.array([len(x) for x in self.raw], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def _index(self, keys: np.ndarray, made: np.ndarray) -> None:
        """A table of the pairs by hash, with open addressing, an eighth full at most; empty places hold -1."""
        bits = max(4, int(len(keys)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.pairs, self.merged = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        spot, open_ = self._spot(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.pairs[spot[open_]] == -1]
            _, first = np.unique(spot[free], return_index=True)
            placed = free[first]
            self.pairs[spot[placed]], self.merged[spot[placed]] = keys[placed], made[placed]
            open_ = open_[self.pairs[spot[open_]] != keys[open_]]
            spot[open_] = (spot[open_] + 1) & (len(self.pairs) - 1)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; _NEVER where there is none."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        spot = self._spot(keys)
        have = self.pairs[spot]
        on = np.flatnonzero((have != keys) & (have != -1))
        while len(on):
            spot[on] = (spot[on] + 1) & (len(self.pairs) - 1)
            have[on] = self.pairs[spot[on]]
            on = on[(have[on] != keys[on]) & (have[on] != -1)]
        found = (have == keys) & (left >= 0) & (right >= 0)
        made = self.merged[spot]
        return np.where(found, self.rank[made], _NEVER), made


@functools.cache
def load(path: str) -> Pieces:
    return Pieces(path)


def places(left, middle, right) -> np.ndarray:
    """A hash of the place of the candidate merge of [left, middle) and [middle, right)."""
    return mix64((np.asarray(left, np.uint64) << np.uint64(42)) ^ (np.asarray(middle, np.uint64) << np.uint64(21)) ^ np.asarray(right, np.uint64))


def skipped(keys, left, middle, right, limit: int):
    """Whether the candidate merge of [left, middle) and [middle, right) is dropped, by keyed hash."""
    return (mix64(keys ^ places(left, middle, right)) >> np.uint64(32)) < np.uint64(limit)


_CODES = np.arange(_BASE**3)
#: places() of every code.
_PLACES = places(_CODES // _BASE**2, _CODES // _BASE % _BASE, _CODES % _BASE)


def agenda(points: np.ndarray, key: np.uint64, pieces: Pieces, limit: int) -> list[int]:
    """Ids of one word of any length: a heap of candidate merges over a linked list of symbols."""
    n = len(points)
    symbol = pieces.chars[points].tolist()
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int, int]] = []

    def offer(lefts: list[int]) -> None:
        a, m = np.array(lefts), np.array([right[i] for i in lefts])
        e = np.array([right[j] for j in m.tolist()])
        rank, made = pieces.merge(np.array([symbol[i] for i in lefts], np.int32), np.array([symbol[j] for j in m.tolist()], np.int32))
        real = np.flatnonzero(rank != _NEVER)
        if limit and len(real):
            real = real[~skipped(key, a[real], m[real], e[real], limit)]
        for t in real.tolist():
            heapq.heappush(heap, (int(rank[t]), lefts[t], int(m[t]), int(e[t]), symbol[lefts[t]], int(made[t])))

    if n > 1:
        offer(list(range(n - 1)))
    while heap:
        _, i, j, k, was, made = heapq.heappop(heap)
        if symbol[i] != was or right[i] != j or symbol[j] is None or right[j] != k:
            continue
        symbol[i], symbol[j] = made, None
        right[i] = k
        if k < n:
            left[k] = i
        if fresh := [x for x in ((left[i],) if left[i] >= 0 else ()) + ((i,) if k < n else ())]:
            offer(fresh)
    out: list[int] = []
    i = 0
    while i < n:
        if symbol[i] >= 0:
            out.append(symbol[i])
        else:
            out += pieces.byte_ids[list(chr(points[i]).encode("utf-8", "surrogatepass"))].tolist()
        i = right[i]
    return out


def agendas(raw: np.ndarray, lengths: np.ndarray, keys: np.ndarray, pieces: Pieces, limit: int, without: np.ndarray | None = None, taken: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many short words in a row and how many each has: all agendas advance together, one merge each per step.

    raw has a word per line, lengths[i] code points of it counting; its last column is spare.
    The candidates whose codes are in without[i] are dropped in word i; the codes of the
    merges that each word takes are written to its line of taken, in order.
    """
    n, width = raw.shape
    columns = np.arange(width)
    filled = columns < lengths[:, None]
    final = np.full((n, width), -1, np.int32)
    sizes = np.zeros(n, np.int64)
    symbol = np.where(filled, pieces.chars[raw], -1)
    first = np.minimum(columns, lengths[:, None]).astype(np.int32)  # where each symbol starts; then the word's end
    row = np.arange(n)
    spelled: dict[int, list[int]] = {}  # words with characters that no piece has
    step = 0

    def ranks(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = pieces.merge(symbol[r, c], symbol[r, c + 1])
        if limit or without is not None:
            real = np.flatnonzero(rank != _NEVER)
            a, b = r[real], c[real]
            end = np.where(b + 2 < width, first[a, np.minimum(b + 2, width - 1)], lengths[row[a]])
            if limit:
                gone = skipped(keys[row[a]], first[a, b], first[a, b + 1], end, limit)
            else:
                gone = (without[row[a]] == ((first[a, b] * _BASE + first[a, b + 1]) * _BASE + end)[:, None]).any(axis=1)
            rank[real[gone]] = _NEVER
        return rank, made

    rank = np.full((n, width), _NEVER, np.int32)
    made = np.zeros((n, width), np.int32)
    r, c = np.nonzero(filled[:, 1:])
    rank[r, c], made[r, c] = ranks(r, c)
    while True:
        best = rank.argmin(axis=1)
        going = rank[np.arange(len(row)), best] != _NEVER
        done = np.flatnonzero(~going)
        if len(done):
            k = row[done]
            final[k] = symbol[done]
            sizes[k] = (first[done] < lengths[k][:, None]).sum(axis=1)
            for i in done[((symbol[done] < 0) & (first[done] < lengths[k][:, None])).any(axis=1)].tolist():
                parts = zip(symbol[i, : sizes[row[i]]].tolist(), first[i].tolist())
                spelled[row[i]] = [x for s, p in parts for x in ([s] if s >= 0 else pieces.byte_ids[list(chr(raw[row[i], p]).encode("utf-8", "surrogatepass"))].tolist())]
        if len(done) == len(row):
            break
        if len(done):
            row, symbol, first, rank, made, best = (x[going] for x in (row, symbol, first, rank, made, best))
        lines = np.arange(len(row))
        if taken is not None:
            end = np.where(best + 2 < width, first[lines, np.minimum(best + 2, width - 1)], lengths[row])
            taken[row, step] = (first[lines, best] * _BASE + first[lines, best + 1]) * _BASE + end
            step += 1
        symbol[lines, best] = made[lines, best]
        shift = (np.minimum(columns + (columns > best[:, None]), width - 1) + (lines * width)[:, None]).ravel()
        symbol, first, rank, made = (x.ravel()[shift].reshape(len(row), width) for x in (symbol, first, rank, made))
        symbol[:, -1], first[:, -1], rank[:, -1] = -1, lengths[row], _NEVER
        # the two pairs beside the new symbol
        rank[lines, best] = _NEVER
        on = np.flatnonzero(first[lines, np.minimum(best + 1, width - 1)] < lengths[row])
        rank[on, best[on]], made[on, best[on]] = ranks(on, best[on])
        on = np.flatnonzero(best > 0)
        rank[on, best[on] - 1], made[on, best[on] - 1] = ranks(on, best[on] - 1)
    if not spelled:
        return final[columns < sizes[:, None]], sizes
    runs = [np.array(spelled[i], np.int32) if i in spelled else final[i, : sizes[i]] for i in range(n)]
    return np.concatenate(runs), np.array([len(x) for x in runs])


def word_keys(hashes: np.ndarray, documents: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """The key of each occurrence of a word: of its hash, its document and its place there."""
    return mix64(hashes ^ mix64(mix64(documents.astype(np.uint64) + np.uint64(seed)) ^ (at.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))))


@functools.cache
def _table(path: str) -> WordTable:
    return WordTable(most=2_000_000, dtype=np.uint16 if len(load(path).raw) <= 1 << 16 else np.int32)


def _cut_short(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, keys: np.ndarray, path: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of up to TOGETHER characters in a row, and how many each has.

    A run of the table holds, for a word and the merges dropped in it, the codes of the
    merges it takes, its ids and the number of merges. An occurrence stays there unless
    it drops one of them.
    """
    pieces, table, n = load(path), _table(path), len(starts)
    out, sizes = [], np.zeros(n, np.int64)
    order = []
    live, state = np.arange(n), hashes
    drawn = np.zeros(n, np.int64)  # merges already drawn for: those before the last one dropped
    without = np.full((n, 0), -1, np.int32)

    def make(missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = live[missing]
        length = lengths[word]
        groups, runs, counts = [], [], []
        for low, high in ((0, 6), (6, 9), (9, 12), (12, 16), (16, TOGETHER)):
            some = np.flatnonzero((length > low) & (length <= high))
            for at in range(0, len(some), 8_000):
                group = some[at : at + 8_000]
                spot = np.minimum(starts[word[group]][:, None] + np.arange(high + 1), len(points) - 1)
                taken = np.full((len(group), high + 1), -1, np.int32)
                ids, size = agendas(points[spot], length[group], keys[word[group]], pieces, 0, without[missing[group]] if without.shape[1] else None, taken)
                merges = (taken >= 0).sum(axis=1)
                count = merges + size + 1
                ends = np.cumsum(count)
                run = np.zeros(int(ends[-1]), np.int32)
                run[gather_runs(np.arange(len(run)), ends - count, merges)] = taken[taken >= 0]
                run[gather_runs(np.arange(len(run)), ends - 1 - size, size)] = ids
                run[ends - 1] = merges
                groups.append(group)
                runs.append(run)
                counts.append(count)
        group, count, flat = np.concatenate(groups), np.concatenate(counts), np.concatenate(runs)
        back = np.argsort(group)
        at = np.cumsum(count) - count
        return gather_runs(flat, at[back], count[back]), count[back]

    while len(live):
        at, size = table.lookup(state, make)
        data, size = table.data, size.astype(np.int64)
        merges = data[at + size - 1].astype(np.int64)
        open_ = merges - drawn if limit else np.zeros(len(live), np.int64)
        codes = gather_runs(data, at + drawn, open_)
        ends = np.cumsum(open_)
        gone = np.flatnonzero((mix64(np.repeat(keys[live], open_) ^ _PLACES[codes]) >> np.uint64(32)) < np.uint64(limit))
        owner = np.searchsorted(ends, gone, "right")
        moved, lead = np.unique(owner, return_index=True)
        stay = np.ones(len(live), bool)
        stay[moved] = False
        count = (size - merges - 1)[stay]
        out.append(gather_runs(data, (at + merges)[stay], count))
        order.append(live[stay])
        sizes[live[stay]] = count
        code = codes[gone[lead]].astype(np.int32)
        drawn = drawn[moved] + gone[lead] - (ends - open_)[moved]
        without = np.column_stack([without[moved], code])
        state = mix64(state[moved] ^ _PLACES[code])
        live = live[moved]
    order = np.concatenate(order)
    at = np.empty(n, np.int64)
    at[order] = np.cumsum(sizes[order]) - sizes[order]
    return gather_runs(np.concatenate(out), at, sizes), sizes


def encode_batch(texts: list[str | None], documents: np.ndarray, path: str, dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and how many each has; null and empty texts have none.

    documents has a number for each text, by which its draws differ from those of others.
    """
    pieces, limit = load(path), round(dropout * 2**32)
    points, offsets = code_points([" " + t if t else "" for t in texts])
    if not len(points):
        return np.zeros(0, _table(path).dtype), np.zeros(len(texts), np.int64)
    space = points == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(points))
    document = np.searchsorted(offsets, starts, "right") - 1
    hashes = range_hashes(points, starts, ends)
    keys = word_keys(hashes, documents[document], starts - offsets[document], seed)
    lengths = ends - starts
    short = lengths <= TOGETHER
    sizes = np.zeros(len(starts), np.int64)
    some = np.flatnonzero(short)
    ids = np.zeros(0, _table(path).dtype)
    if len(some):
        ids, sizes[some] = _cut_short(points, starts[some], lengths[some], hashes[some], keys[some], path, limit)
    if len(some) < len(starts):
        more = np.flatnonzero(~short)
        singly = [agenda(points[starts[i] : ends[i]], keys[i], pieces, limit) for i in more.tolist()]
        sizes[more] = [len(x) for x in singly]
        order = np.concatenate([some, more])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        ids = gather_runs(np.concatenate([ids, *[np.array(x, ids.dtype) for x in singly]]), at, sizes)
    return ids, np.rint(np.bincount(document, weights=sizes, minlength=len(texts))).astype(np.int64)


def decode_batch(ids: np.ndarray, counts: np.ndarray, path: str) -> list[bytes]:
    """The texts of encoded documents, as UTF-8."""
    pieces = load(path)
    sizes = pieces.lengths[ids]
    raw = gather_runs(pieces.bytes, pieces.starts[ids], sizes).tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [raw[a + 1 : b] if b > a else b"" for a, b in zip(ends, ends[1:])]


def variants_of(doc_ids: list[int | None], seed: int, variants: int = VARIANTS) -> np.ndarray:
    """The variant of each document, by keyed hash of its id (null: 0)."""
    ids = np.array([0 if x is None else x for x in doc_ids], np.int64).astype(np.uint64)
    return (mix64(mix64(ids) ^ np.uint64(seed)) % np.uint64(variants)).astype(np.int64)


def draw_numbers(doc_ids: list[int | None], texts: list[str | None], copies: list[int | None]) -> np.ndarray:
    """A number for the draws of each row, from its id, its text (ids may be null or repeat) and the number of the copy."""
    ids = np.array([0 if x is None else x for x in doc_ids], np.int64).astype(np.uint64)
    sums = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
    return mix64(mix64(ids) ^ (sums << np.uint64(32)) ^ np.array([x or 0 for x in copies], np.uint64))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED, with_ids: bool = False, copy_col: str | None = None) -> DataFrame:
    """Encode every whole text and decode it again; copies of a document that copy_col numbers are cut by draws of their own.

    Returns doc_id, variant, n_pieces, ids_crc32 (of the ids as little-endian
    uint32), restored (the decoded text is the text) and, if asked for, ids. Null
    and empty texts have no pieces and are restored; repeated rows repeat; other
    columns are not read. One narrow pass without a shuffle.
    """
    schema = "doc_id long, variant int, n_pieces long, ids_crc32 long, restored boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in sub_batches(batches, text_col):
            doc_ids = part.column(0).to_pylist()
            variants = variants_of(doc_ids, seed)
            copies = part.column(2).to_pylist() if copy_col else [0] * len(texts)
            ids, counts = encode_batch(texts, draw_numbers(doc_ids, texts, copies), path, dropout, seed)
            wide = ids.astype("<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            same = [raw == (t or "").encode() for raw, t in zip(decode_batch(ids, counts, path), texts)]
            columns = [pa.array(doc_ids, pa.int64()), pa.array(variants, pa.int32()), pa.array(counts), pa.array(crc, pa.int64()), pa.array(same)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return docs.select(id_col, text_col, *([copy_col] if copy_col else [])).mapInArrow(run, schema)
