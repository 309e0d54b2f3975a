"""WARC (operator 10): a writer that compresses each record by itself with one Zstandard dictionary.

The dictionary is built from a bounded sample of the records and stands in a
skippable frame at the head of every file; so each file can be read alone, and each
record from its own frame. Records of equal payload become revisits of one of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import fresh_name, open_store
from .shared import dictionary_of, join_by_group, saved, scratch, slices

# fixed values: the frame that holds the dictionary, and the revisit profile
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000

#: The dictionary is trained on at most so many records, of each on so many bytes, spread over it.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 32 << 10, 64 << 10

DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%[]!~*()')}")
    head.append(f"WARC-Payload-Digest: {digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream) -> Iterator[dict]:
    """The records of an uncompressed stream, each with its headers, payload and full payload length."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?i)\r\ncontent-length: (\d+)", http)
        yield {"headers": headers, "payload": payload, "length": int(length[1]) if length else len(payload)}


def read_archive(raw_stream) -> Iterator[dict]:
    """The records of a file: its dictionary from the leading frame, then frame by frame."""
    import io

    import zstandard

    head = raw_stream.read(8)
    if head[:4] != SKIPPABLE:
        raise ValueError("no dictionary frame at the head")
    dictionary = raw_stream.read(int.from_bytes(head[4:], "little"))
    context = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    yield from records(io.BufferedReader(context.stream_reader(raw_stream, read_across_frames=True), 1 << 20))


def train_dictionary(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> bytes:
    """From the records of a bounded, hash-chosen sample; empty only without records. Records are cut to slices where they lie."""
    chosen = pages.select(F.col(id_col).alias("chosen_id")).orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(SAMPLE_RECORDS).distinct()
    some = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    some = some.join(F.broadcast(chosen), F.col("page_id").eqNullSafe(F.col("chosen_id")), "left_semi")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html = (batch.column(c)[k].as_py() for c in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([slices(record(page_id, url, (html or "").encode()), SAMPLE_BYTES)], pa.binary())], ["sample"])

    return dictionary_of(sorted(bytes(r[0]) for r in some.mapInArrow(run, "sample binary").limit(SAMPLE_RECORDS).collect()), DICTIONARY_BYTES)


def revisits(pages: DataFrame, id_col: str, html_col: str, least: int) -> DataFrame:
    """digest (sha-256 of the payload), first (largest id) and group_rows of payloads that several ids have."""
    some = pages.where(F.col(id_col).isNotNull() & (F.octet_length(html_col) >= least))
    grouped = some.groupBy(F.sha2(F.col(html_col), 256).alias("digest"))
    counted = grouped.agg(F.max(id_col).alias("first"), F.min(id_col).alias("other"), F.count(F.lit(1)).alias("group_rows"))
    return counted.where("first <> other").select("digest", "first", "group_rows")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> list[str]:
    """Write a record per page; the files, one per task.

    Null html is an empty payload. Of equal payloads of `least` bytes or more the
    one with the largest id is a response (rows repeated with that id too), the
    others revisit it; a null id is always a response. Files of task attempts
    that failed are not in the list and never read.
    """
    groups = saved(revisits(pages, id_col, html_col, least), "revisits")
    raw = train_dictionary(pages, id_col, url_col, html_col)
    store, at = open_store(folder)
    store.create_dir(at, recursive=True)
    key = F.when(F.octet_length(html_col) >= least, F.sha2(F.col(html_col), 256))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), key.alias("digest"))
    rows = join_by_group(rows, groups, ["digest"], pages.count(), "left").select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        store, at = open_store(folder)
        options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
        pack = zstandard.ZstdCompressor(level=3, **options).compress
        name, out = fresh_name(at, f"part-{TaskContext.get().partitionId():06d}", ".warc.zst"), None
        for batch in batches:
            for k in range(batch.num_rows):
                if out is None:
                    out = store.open_output_stream(name)
                    out.write(SKIPPABLE + len(raw).to_bytes(4, "little") + raw)
                page_id, url, html, refers = (batch.column(c)[k].as_py() for c in range(4))
                out.write(pack(record(page_id, url, (html or "").encode(), refers)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    return sorted(r.file for r in rows.mapInArrow(run, "file string").collect())


def read_archives(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; one task per file.

    The digest of a response is made from its payload and checked against the header.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not files:
        return spark.createDataFrame([], schema)

    def page(uri: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(found[1]) if found else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, _ = open_store(folder)
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(files[k]) as raw:
                    for r in read_archive(raw):
                        head = r["headers"]
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if head["warc-type"] == "response" and (hashlib.sha1(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["length"]):
                            raise ValueError(f"{head['warc-record-id']}: the payload does not match its digest")
                        rows.append((page(head["warc-record-id"]), r["length"], digest, head["warc-type"], page(head.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names)

    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "archives")
    return read_archives(pages.sparkSession, folder, write_archives(pages, folder, id_col, url_col, html_col))
