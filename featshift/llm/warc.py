"""WARC archives: one gzip member per record, written and read inside Spark tasks.

The writer stores equal payloads once: the record with the smallest id is a ``response``,
the others are ``revisit`` records that name it. The reader walks an archive from front to
back: it decompresses a member piece by piece, cuts the block by its Content-Length and
compares the digests, so it holds one record at a time.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payloads below this are always stored as responses.
SMALLEST_REVISIT = 100
#: A task starts another archive beyond so many compressed bytes.
ARCHIVE_BYTES = 256 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

RECORD = T.StructType([
    T.StructField("archive", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
])


class ArchiveError(ValueError):
    """An archive that is cut short, badly framed or does not match its digests."""


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _header(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(text: str | None) -> str | None:
    return None if text is None else text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, level: int = 6) -> bytes:
    """One record as a gzip member."""
    digest = hashlib.sha256(payload).hexdigest()
    head = _HTTP.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:record:{_header(record_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", _header(uri))] if uri is not None else []),
        *([("WARC-Refers-To", f"<urn:record:{_header(refers_to)}>"), ("WARC-Profile", _PROFILE)] if refers_to is not None else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(text.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _members(stream, piece: int = 1 << 16) -> Iterator[tuple[int, bytearray]]:
    """Offset and decompressed content of each gzip member."""
    offset, left = 0, stream.read(piece)
    while left:
        unpacker, content, at = zlib.decompressobj(31), bytearray(), offset
        while not unpacker.eof:
            if not left:
                raise ArchiveError(f"the member at {at} is cut short")
            try:
                content += unpacker.decompress(left)
            except zlib.error as e:
                raise ArchiveError(f"the member at {at}: {e}") from e
            offset += len(left)
            left = b"" if unpacker.eof else stream.read(piece)
        offset -= len(unpacker.unused_data)
        left = unpacker.unused_data or stream.read(piece)
        yield at, content


def _urn(value: str | None) -> str | None:
    return None if value is None else _plain(value.removeprefix("<urn:record:").removesuffix(">"))


def read_records(stream) -> Iterator[dict]:
    """The records of an open archive in order, checked against length and digests."""
    for offset, content in _members(stream):
        end = content.find(b"\r\n\r\n")
        lines = bytes(content[: max(end, 0)]).decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ArchiveError(f"no record at {offset}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        length = int(fields["content-length"])
        block = memoryview(content)[end + 4 : end + 4 + length]
        if len(content) != end + 8 + length or content[-4:] != b"\r\n\r\n":
            raise ArchiveError(f"the record at {offset} does not hold its Content-Length")
        if fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ArchiveError(f"the record at {offset} does not match its block digest")
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        payload = None
        if fields["warc-type"] == "response":
            payload = bytes(block[content.find(b"\r\n\r\n", end + 4) - end :])
            if digest != hashlib.sha256(payload).hexdigest():
                raise ArchiveError(f"the record at {offset} does not match its payload digest")
        yield {
            "offset": offset, "record_type": fields["warc-type"], "record_id": _urn(fields["warc-record-id"]),
            "refers_to": _urn(fields.get("warc-refers-to")), "target_uri": _plain(fields.get("warc-target-uri")),
            "payload": payload, "payload_bytes": None if payload is None else len(payload), "payload_digest": digest,
        }


def _revisits(pages: DataFrame) -> DataFrame:
    """``(record_id, refers_to)`` of every record whose payload an earlier one has."""
    long = pages.filter((F.octet_length("payload") >= SMALLEST_REVISIT) & F.col("record_id").isNotNull()).select(
        "record_id", F.sha2("payload", 256).alias("digest")
    )
    firsts = long.groupBy("digest").agg(F.min("record_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return long.join(firsts.hint("merge"), "digest").filter(F.col("record_id") > F.col("refers_to")).select("record_id", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, record_id: str, uri: str, payload: str, level: int = 3) -> DataFrame:
    """Write a record per row below ``folder`` (a URI that every executor reaches); returns the archives.

    Null payloads are empty, null URIs are left out. A row without an id is a response of
    its own; repeated rows of the smallest id are all responses. An archive appears under its
    name when it is whole: a task writes under a name of its own and then renames, so a
    repeated task replaces what the lost one left.
    """
    rows = pages.select(
        F.col(record_id).alias("record_id"), F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.encode(F.col(payload).cast("string"), "utf-8"), F.lit(b"")).alias("payload"),
    )
    rows = rows.join(_revisits(rows).hint("merge"), "record_id", "left")
    rows = rows.select(F.col("record_id").cast("string"), "uri", "payload", F.col("refers_to").cast("string"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        n_archives, out, records, size = 0, None, 0, 0
        mine = f"{base}/.{part:06d}-{uuid.uuid4().hex}"

        def close() -> pa.RecordBatch:
            out.close()
            name = f"{base}/{part:06d}-{n_archives:04d}.warc.gz"
            files.move(mine, name)
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [records], "n_bytes": [size]})

        for batch in batches:
            for row_id, target, body, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    out, records, size = files.open_output_stream(mine, compression=None), 0, 0
                member = record_bytes(row_id.as_py() or "", target.as_py(), body.as_py(), refers.as_py(), level)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    n_archives, out = n_archives + 1, None
        if out is not None:
            yield close()

    return rows.mapInArrow(task, "archive string, n_records long, n_bytes long")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``folder``; ``payload`` is null for revisits."""
    schema = RECORD if payloads else T.StructType([f for f in RECORD.fields if f.name != "payload"])
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = []
        size = 0
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                files, path = _filesystem(uri)
                with files.open_input_stream(path, compression=None) as stream:
                    for record in read_records(stream):
                        size += record["payload_bytes"] or 0
                        kept.append(record | {"archive": os.path.basename(path)})
                        if not payloads:
                            record["payload"] = kept[-1]["payload"] = None
                        if len(kept) >= 5000 or payloads and size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(kept, pa_schema)
                            kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_pylist(kept, pa_schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    pa_schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])
    return archives.mapInArrow(task, schema)
