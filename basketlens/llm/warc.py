"""WARC archives, compressed record by record with a shared dictionary.

A Zstandard dictionary is trained on a bounded sample of the records.  Each archive starts
with a skippable frame that embeds it, and every record is a frame of its own, so a reader
can start at any record.  Of records with equal payloads of ``least`` bytes and more, the one
with the largest id is written as a response and the others as revisits of it.

:func:`write` writes archives of about ``archive_bytes`` each below a folder that executors
share, under names that differ by task attempt, and returns a manifest of those that belong
to the result: the files of a lost or repeated attempt are not in it.  :func:`read` reads the
manifest's archives frame by frame.

Defined results: a null payload is empty.  Rows with a null id are records as well, but do not
count as the largest unless all ids of the payload are null; rows that share the largest id
are all responses.  Line breaks in a URL are written as spaces; a null URL is empty.  An empty
table gives no archive.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import about

#: Fixed values of the format: the magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
LEAST, ARCHIVE_BYTES = 1_000, 1 << 30
#: Bounded sample for the dictionary (records, characters of each, in so many slices), and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, SLICES, DICTIONARY_BYTES = 300, 16 << 10, 4, 64 << 10
LEVEL, READ_AT_ONCE = 3, 1 << 20
DATE = "2024-01-01T00:00:00Z"


def http_block(payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to, revisit: bool) -> bytes:
    """A response with the payload, or a revisit that names the response."""
    labelled = base64.b32encode(bytes.fromhex(digest)).decode()
    block = b"HTTP/1.1 200 OK\r\n\r\n" if revisit else http_block(payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").splitlines())),
        ("WARC-Payload-Digest", f"sha1:{labelled}"),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[3:3] = [
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line[:-1], "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples, their bytes serve as one; none of none."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, size and the id of the response."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")
    )
    firsts = (
        rows.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return rows.join(firsts, ["digest", "size"], "left")


def opened(url: str) -> tuple[fs.FileSystem, str]:
    """File system and path of any address that Arrow knows; a bare path is local."""
    if "://" in url or url.startswith("file:"):
        return fs.FileSystem.from_uri(url)
    return fs.LocalFileSystem(), url


def sampled(text: Column) -> Column:
    """A text whole up to the bound, or slices from its start to its end."""
    size = SAMPLE_BYTES // SLICES
    room = F.length(text) - size
    slices = [
        F.substring(text, (room * i / (SLICES - 1)).cast("int") + 1, F.lit(size)) for i in range(SLICES)
    ]
    return F.when(F.length(text) <= SAMPLE_BYTES, text).otherwise(F.concat(*slices))


def write(
    pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write the archives; the manifest has path, n_records, n_bytes."""
    import zstandard

    chosen = about(pages.where(F.length("html") > 0), SAMPLE_RECORDS, "page_id", "url")
    sample = (
        chosen.select("page_id", "url", sampled(F.col("html")).alias("html"))
        # a repeated page is one sample, so the bound holds however often it occurs
        .groupBy("page_id", "url")
        .agg(F.min("html").alias("html"))
        .orderBy("page_id", "url")
        .collect()
    )
    samples = []
    for r in sample:
        data = r["html"].encode("utf-8", "surrogatepass")
        samples.append(
            record(r["page_id"], r["url"], data, hashlib.sha1(data).hexdigest(), len(data), None, False)
        )
    sent = pages.sparkSession.sparkContext.broadcast(train_dictionary(samples))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        kept = zstandard.ZstdCompressionDict(sent.value) if sent.value else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=True)
        out, name, records, size, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", records, size))
                out = None

        for batch in batches:
            for at in range(batch.num_rows):
                row = {k: batch.column(k)[at].as_py() for k in batch.schema.names}
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{base}/{name}")
                    head = struct.pack("<II", DICTIONARY_FRAME, len(sent.value)) + sent.value
                    out.write(head)
                    size = len(head)
                response = row["response_id"]
                revisit = response is not None and row["page_id"] != response
                frame = packer.compress(
                    record(row["page_id"], row["url"], row["payload"], row["digest"], row["size"], response, revisit)
                )
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
            ],
            ["path", "n_records", "n_bytes"],
        )

    return with_revisits(pages, least).mapInArrow(
        archive, "path string, n_records long, n_bytes long"
    )


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    import zstandard

    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary")
    data = stream.read(size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    left = b""
    while True:
        left = left or stream.read(READ_AT_ONCE)
        if not left:
            return
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(left))
            left = frame.unused_data
            if frame.eof:
                break
            left = stream.read(READ_AT_ONCE)
            if not left:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def read(manifest: DataFrame) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    The digest of a response is computed from its payload and must equal its header.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def packed(rows):
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        number = lambda s: int(s[len("<urn:page:") : -1]) if len(s) > len("<urn:page:>") else None
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = opened(path)
                rows, size = [], 0
                with store.open_input_stream(place) as stream:
                    for data in frames(stream):
                        fields, payload = parse(data)
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload and digest differ in {path}")
                        rows.append(
                            (
                                number(fields["WARC-Record-ID"]),
                                fields["WARC-Target-URI"],
                                int(fields["X-Payload-Length"]) if revisit else len(payload),
                                digest,
                                fields["WARC-Type"],
                                number(fields["WARC-Refers-To"]) if revisit else None,
                                None if revisit else payload,
                            )
                        )
                        size += len(payload)
                        if len(rows) >= 2_000 or size >= 16 << 20:
                            yield packed(rows)
                            rows, size = [], 0
                yield packed(rows)

    return manifest.select("path").mapInArrow(
        found,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
        " refers_to long, payload binary",
    )
