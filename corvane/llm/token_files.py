"""Token-id files (operator 3): one zstandard dictionary, each document compressed by itself.

File layout, little-endian:
    header   8 bytes MAGIC, 32 bytes SHA-256 of the dictionary, uint32 bytes per id
    blobs    one zstandard frame per document, in ascending id order
    index    int64 doc_id, uint8 id present, uint64 offset, uint32 blob bytes, uint64 ids, as five arrays
    footer   uint64 index offset, uint64 documents, 8 bytes MAGIC
The dictionary lies beside the files as dictionary-<sha256>.zdict.
"""

from __future__ import annotations

import array
import functools
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe
from .files import fresh_name, open_store
from .shared import dictionary_of, scratch, slices
from .textcols import WordTable, gather_runs, range_hashes, sub_batches

MAGIC = b"CVTOK\x00\x01\n"
HEADER = len(MAGIC) + 32 + 4
FOOTER = 8 + 8 + len(MAGIC)
END_ID = 2

#: The dictionary is trained on at most so many documents, and of each on so many bytes of ids, spread over it.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 32 << 10, 64 << 10

#: A file is closed once it holds so many ids; a document is never split.
FILE_IDS = 1 << 27


@functools.cache
def _library(path: str):
    """The library's model, the byte alphabet as a translation table, and the kept words."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    alphabet = str.maketrans({chr(b): c for b, c in bytebpe.alphabet().items() if ord(c) != b})
    tokenizer = Tokenizer.from_file(path)
    bytebpe.check(path)
    dtype = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
    return tokenizer, alphabet, WordTable(dtype=dtype), tokenizer.token_to_id(bytebpe.SPECIAL)


def encode_batch(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each has (null: none), as the library encodes them.

    Texts are cut into pre-tokens as the library cuts them; each distinct one
    goes through the library's model once per worker.
    """
    tokenizer, alphabet, table, special = _library(path)
    segments, owner, specials = bytebpe.cut_special(texts)
    points, starts, ends, segment = bytebpe.split(segments)
    model = tokenizer.model.tokenize

    def make(first: np.ndarray) -> tuple[list[int], list[int]]:
        runs: list[int] = []
        sizes = []
        for i in first.tolist():
            word = bytebpe.text_of(points, starts[i], ends[i]).encode().decode("latin-1").translate(alphabet)
            ids = [t.id for t in model(word)]
            runs += ids
            sizes.append(len(ids))
        return runs, sizes

    counts = np.zeros(len(texts), np.int64)
    if len(starts):
        at, size = table.lookup(range_hashes(points, starts, ends), make)
        ids = gather_runs(table.data, at, size)
        by_segment = np.rint(np.bincount(segment, weights=size, minlength=len(segments))).astype(np.int64)
    else:
        ids, by_segment = table.data[:0], np.zeros(len(segments), np.int64)
    if specials.any():  # a special string stands between the segments of a text
        ends_at = np.cumsum(by_segment)[:-1]
        ids = np.insert(ids, ends_at[owner[1:] == owner[:-1]], special)
    counts += np.rint(np.bincount(owner, weights=by_segment, minlength=len(texts))).astype(np.int64) + specials
    return ids, counts


def _documents(batches: Iterator, path: str, text_col: str) -> Iterator[tuple]:
    """(doc_id, its ids with the end id) one after another."""
    for part, texts in sub_batches(batches, text_col):
        ids, counts = encode_batch(texts, path)
        ends = np.cumsum(counts)
        for doc_id, start, end in zip(part.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist()):
            yield doc_id, np.append(ids[start:end], ids.dtype.type(END_ID))


def train_dictionary(docs: DataFrame, path: str, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded, hash-chosen sample; empty only without documents."""
    chosen = docs.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCUMENTS).distinct()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, ids in _documents(batches, path, text_col):
            yield pa.RecordBatch.from_arrays([pa.array([slices(ids.tobytes(), SAMPLE_BYTES, unit=ids.itemsize)], pa.binary())], ["ids"])

    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col, "left_semi").limit(SAMPLE_DOCUMENTS)
    samples = sorted(bytes(r[0]) for r in rows.mapInArrow(run, "ids binary").collect())
    return dictionary_of(samples, DICTIONARY_BYTES)


def _dictionary(raw: bytes):
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def write_files(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Write all documents, ascending by id; (file, documents, ids) of each file, in order.

    Null ids come first; null texts have the end id alone. Rows with equal ids follow
    each other by hash of their text, and may be spread over several files. An empty
    table gives no files. What is returned has a
    row per file; files of task attempts that failed are in no manifest and are never read.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, path, id_col, text_col)
    digest = hashlib.sha256(raw).digest()
    store, at = open_store(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/dictionary-{digest.hex()}.zdict") as out:
        out.write(raw)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        store, at = open_store(folder)
        pack = zstandard.ZstdCompressor(level=3, **_dictionary(raw)).compress
        number, turn, out = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            for column in index:
                out.write(column.tobytes())
            out.write(np.asarray([offset, len(index[0])], np.uint64).tobytes() + MAGIC)
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([turn]), pa.array([name]), pa.array([len(index[0])]), pa.array([total])], ["part", "turn", "file", "documents", "ids"])

        for doc_id, ids in _documents(batches, path, text_col):
            if out is not None and total >= FILE_IDS:
                yield closed()
                turn, out = turn + 1, None
            if out is None:
                name, total, index = fresh_name(at, f"part-{number:06d}-{turn:04d}", ".cvtok"), 0, [array.array(c) for c in INDEX_CODES]
                out = store.open_output_stream(name)
                offset = out.write(MAGIC + digest + np.uint32(ids.itemsize).tobytes())
            blob = pack(ids.tobytes())
            for column, value in zip(index, (doc_id or 0, doc_id is not None, offset, len(blob), len(ids))):
                column.append(value)
            out.write(blob)
            offset, total = offset + len(blob), total + len(ids)
        if out is not None:
            yield closed()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = (id_col, F.xxhash64(text_col))
    ordered = docs.select(id_col, text_col).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    manifest = ordered.mapInArrow(run, "part long, turn long, file string, documents long, ids long").collect()
    return [(r.file, r.documents, r.ids) for r in sorted(manifest, key=lambda r: (r.part, r.turn))]


#: Types of the columns of the index, in numpy and as codes of arrays.
INDEX_TYPES, INDEX_CODES = (np.int64, np.uint8, np.uint64, np.uint32, np.uint64), "qBQIQ"


class TokenFile:
    """One file, opened for documents by place or id: reads the footer and index, then only the blobs asked for."""

    def __init__(self, folder: str, name: str):
        import zstandard

        store, at = open_store(folder)
        self.source = store.open_input_file(name)
        tail = self._at(self.source.size() - FOOTER, FOOTER)
        head = self._at(0, HEADER)
        if tail[16:] != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is not a token-id file")
        index_at, n = np.frombuffer(tail[:16], np.uint64).tolist()
        with store.open_input_stream(f"{at}/dictionary-{head[len(MAGIC) : len(MAGIC) + 32].hex()}.zdict") as f:
            raw = f.read()
        if hashlib.sha256(raw).digest() != head[len(MAGIC) : len(MAGIC) + 32]:
            raise ValueError(f"the dictionary of {name} has another hash")
        self.dtype = {2: np.uint16, 4: np.uint32}[int(np.frombuffer(head[-4:], np.uint32)[0])]
        self.unpack = zstandard.ZstdDecompressor(**_dictionary(raw)).decompress
        columns = []
        for kind in INDEX_TYPES:
            columns.append(np.frombuffer(self._at(index_at, n * np.dtype(kind).itemsize), kind))
            index_at += n * np.dtype(kind).itemsize
        self.doc_ids, self.present, self.offsets, self.sizes, self.counts = columns

    def _at(self, offset: int, size: int) -> bytes:
        return self.source.read_at(size, offset)

    def places(self, doc_id: int | None) -> list[int]:
        """Places of the documents of an id in this file, found by halving: ids ascend, null ids come first."""
        nulls = int(np.searchsorted(self.present, 1))
        if doc_id is None:
            return list(range(nulls))
        some = self.doc_ids[nulls:]
        return list(range(nulls + int(np.searchsorted(some, doc_id)), nulls + int(np.searchsorted(some, doc_id, "right"))))

    def ids(self, place: int) -> np.ndarray:
        """All ids of the document at that place in the file."""
        blob = self._at(int(self.offsets[place]), int(self.sizes[place]))
        return np.frombuffer(self.unpack(blob), self.dtype)


def read_files(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files; one task per file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    bases = np.concatenate([[0], np.cumsum([f[2] for f in files])]).tolist()
    names = [f[0] for f in files]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                file = TokenFile(folder, names[k])
                counts = file.counts.astype(np.int64)
                starts = bases[k] + np.cumsum(counts) - counts
                sums = [zlib.crc32(file.ids(i).astype("<u4").tobytes()) for i in range(len(counts))]
                ids = pa.array(file.doc_ids, mask=file.present == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(names), 1, len(names)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents as token-id files in the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "token-files")
    return read_files(docs.sparkSession, folder, write_files(docs, folder, path, id_col, text_col))
