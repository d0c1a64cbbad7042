"""WARC archives as a PySpark data source, and archiving of pages with revisit records.

Archives hold one gzip member per record. A member names its compressed and inflated lengths in the gzip
extra field `sl` (skip lengths), so a reader inflates the record's headers, decides, and seeks to the next
member without touching the payload. Members without that field (from other writers) are read through, whether they hold
one record or many.

Reading: files are planned as ranges that begin at records (the writer lists such places in a manifest, which
also names the files of the successful task attempts only). Archives of other writers (`*.warc.gz` in the folder, or the
path of one) are in no manifest and are planned whole; files of this writer that no manifest names are left out, as their
attempts failed. Equality and IN filters on the header columns are
pushed into the reader; a record that fails them costs its headers. The payload is inflated only if the
schema asks for it. Give a schema without `payload` to leave payloads alone.

Defined cases: a null html is an empty payload; a null url has no target header; rows that repeat a page
are records of their own; of records with equal payloads those with the largest page_id are responses, and a
null page_id is never the largest unless all are null; an empty table is an archive without records. Only the
named columns of a table are read. Digests are read in base 32 or hexadecimal, of any case; digests of another kind, and
numbers that are none, are null. Payloads of responses and requests are what follows their HTTP headers, those of other
records the whole block, those of revisits null. What is no gzip member with WARC records, an archive that is not
compressed, or one that ends inside a record, raises an error.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from pipescope.llm import files
from pipescope.session import scratch_path

HEADERS_SCHEMA = ("record_type string, record_id string, page_id long, target_uri string, payload_digest string, "
                  "payload_bytes long, refers_to long")
SCHEMA = HEADERS_SCHEMA + ", payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
GZIP_HEAD = "<4BI2B"  # magic 1f 8b, method, flags, time, extra flags, system
EXTRA = "<H2sHII"  # length of the field, 'sl', length of its data, compressed, inflated
HEAD_SIZE, EXTRA_SIZE = struct.calcsize(GZIP_HEAD), struct.calcsize(EXTRA)
EXTRA_FLAG = 4
CHUNK_BYTES = 1 << 16
OWN_FILE = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")


def record_id(page_id, record_type: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{record_type}')}>"


def record(row: dict) -> bytes:
    """One uncompressed record. `payload_digest` is hexadecimal and goes in as the customary base 32."""
    revisit = row["record_type"] == "revisit"
    block = HTTP + (b"" if revisit else row["payload"] or b"")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'], row['record_type'])}",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(row['url'], safe='%/:=&?~#+!$,;@()*[].-_')}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], 'response')}",
                  f"X-Refers-To-Page-ID: {row['refers_to']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(content: bytes, level: int = 6) -> bytes:
    """A gzip member that names its lengths."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    total = HEAD_SIZE + EXTRA_SIZE + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)
    if total >= 1 << 32:
        return struct.pack(GZIP_HEAD, 0x1F, 0x8B, 8, 0, 0, 0, 255) + body + tail
    return (struct.pack(GZIP_HEAD, 0x1F, 0x8B, 8, EXTRA_FLAG, 0, 0, 255)
            + struct.pack(EXTRA, EXTRA_SIZE - 2, b"sl", 8, total, len(content) & 0xFFFFFFFF) + body + tail)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


def header_columns(headers: dict[str, str]) -> dict:
    def number(name):
        value = headers.get(name, "")
        return int(value) if re.fullmatch(r"-?[0-9]{1,18}", value) else None

    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    hexed = None
    if kind.lower() == "sha1" and re.fullmatch(r"[0-9a-fA-F]{40}", digest):
        hexed = digest.lower()
    elif kind.lower() == "sha1" and re.fullmatch(r"[a-zA-Z2-7]{32}", digest):
        hexed = base64.b32decode(digest.upper()).hex()
    return {
        "record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "page_id": number("x-page-id"),
        "target_uri": headers.get("warc-target-uri"), "payload_digest": hexed, "payload_bytes": number("x-payload-length"),
        "refers_to": number("x-refers-to-page-id"),
    }


def _inflated(stream, start: int, wanted: int | None) -> tuple[bytes, zlib._Decompress | None, int]:
    """Inflate from the deflate data at `start` until a blank line ends the headers or `wanted` bytes are out."""
    inflater, out, at = zlib.decompressobj(-15), b"", start
    while not inflater.eof:
        stream.seek(at)
        chunk = stream.read(1024 if wanted is None else 1 << 18)
        if not chunk:
            raise ValueError("the archive ends inside a record")
        out += inflater.decompress(chunk)
        at += len(chunk)
        if wanted is None and b"\r\n\r\n" in out:
            break
        if wanted is not None and len(out) >= wanted:
            break
    return out, inflater, at


class _Member:
    """The contents of a gzip member, inflated as far as they are asked for."""

    def __init__(self, stream, start: int):
        self.stream, self.at, self.inflater, self.held = stream, start, zlib.decompressobj(-15), bytearray()

    def fill(self, size: int) -> bool:
        while len(self.held) < size and not self.inflater.eof:
            self.stream.seek(self.at)
            chunk = self.stream.read(CHUNK_BYTES)
            if not chunk:
                raise ValueError("the archive ends inside a record")
            self.held += self.inflater.decompress(chunk)
            self.at += len(chunk)
        return len(self.held) >= size

    def head(self) -> bytes | None:
        """Up to the next blank line, without line ends before; None if nothing is left."""
        while self.fill(1) and self.held[:1] in (b"\r", b"\n"):
            del self.held[:1]
        at = -1
        while at < 0 and self.fill(len(self.held) + 1):
            at = self.held.find(b"\r\n\r\n")
        if at < 0:
            at = self.held.find(b"\r\n\r\n")
        if at < 0 and self.held:
            raise ValueError("the archive ends inside a record")
        if at < 0:
            return None
        text = bytes(self.held[:at])
        del self.held[:at + 4]
        return text

    def block(self, size: int, keep: bool) -> bytes:
        """The next `size` bytes, or none of them if they are not kept."""
        out = []
        while size:
            if not self.fill(1):
                raise ValueError("the archive ends inside a record")
            part = self.held[:size]
            if keep:
                out.append(bytes(part))
            del self.held[:len(part)]
            size -= len(part)
        return b"".join(out)


def _member_records(member: _Member, wanted, with_payload: bool) -> Iterator[dict]:
    """The records of a member, one after the other."""
    while (text := member.head()) is not None:
        headers = parse_headers(text)
        if not text.startswith(b"WARC/") or not re.fullmatch(r"[0-9]+", headers.get("content-length", "")):
            raise ValueError("no WARC record where one should begin")
        row = header_columns(headers)
        take = wanted(row)
        block = member.block(int(headers["content-length"]), take and with_payload)
        if take:
            if with_payload:
                row["payload"] = _payload(row["record_type"], block)
            yield row


def _payload(record_type: str | None, block: bytes) -> bytes | None:
    if record_type == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if record_type in ("response", "request") else block


def _data_start(stream, at: int, flags: int) -> int:
    """Where the deflate data of a gzip member begin, behind the optional fields of its head."""
    stream.seek(at)
    head, start = stream.read(1 << 17), HEAD_SIZE
    if flags & EXTRA_FLAG:
        start += 2 + int.from_bytes(head[start:start + 2], "little")
    for flag in (8, 16):  # name, comment
        if flags & flag:
            start = head.index(b"\0", start) + 1
    return at + start + (2 if flags & 2 else 0)


def read_records(stream, start: int, end: int, wanted, with_payload: bool) -> Iterator[dict]:
    """The records that begin in [start, end) and whose header columns satisfy `wanted`."""
    at = start
    while at < end:
        stream.seek(at)
        head = stream.read(HEAD_SIZE + EXTRA_SIZE).ljust(HEAD_SIZE + EXTRA_SIZE, b"\0")
        magic0, magic1, _, flags, *_ = struct.unpack_from(GZIP_HEAD, head)
        if (magic0, magic1) != (0x1F, 0x8B):
            raise ValueError(f"no gzip member at byte {at}")
        size, kind, _, total, _ = struct.unpack_from(EXTRA, head, HEAD_SIZE) if flags == EXTRA_FLAG else (0, b"", 0, 0, 0)
        if kind != b"sl":
            content = _Member(stream, _data_start(stream, at, flags))
            yield from _member_records(content, wanted, with_payload)
            at = content.at - len(content.inflater.unused_data) + 8
            continue
        body = at + HEAD_SIZE + 2 + size
        out, inflater, read = _inflated(stream, body, None)
        text, _, rest = out.partition(b"\r\n\r\n")
        headers = parse_headers(text)
        row = header_columns(headers)
        take = wanted(row)
        if take and with_payload:
            need = len(text) + 4 + int(headers["content-length"])
            while len(out) < need and not inflater.eof:
                stream.seek(read)
                chunk = stream.read(1 << 18)
                out += inflater.decompress(chunk)
                read += len(chunk)
            block = out[len(text) + 4:need]
            row["payload"] = _payload(row["record_type"], block)
        if take:
            yield row
        at += total


@dataclass
class ArchiveRange(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class WrittenFiles(WriterCommitMessage):
    files: list  # (name, bytes, places where a record begins)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        done: list = []
        out, name, size, places = None, "", 0, [0]
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size, places = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
                    out = files.open_output(f"{self.folder}/{name}")
                if size - places[-1] >= RANGE_BYTES:
                    places.append(size)
                packed = member(record(row))
                out.write(packed)
                size += len(packed)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, size, places))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, places))
        return WrittenFiles(done)

    def commit(self, messages: list) -> None:
        """Files of failed or repeated attempts are in no message, so no reader sees them."""
        named = [x for m in messages if m is not None for x in m.files]
        with files.open_output(f"{self.folder}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(named).encode())

    def abort(self, messages: list) -> None:
        for m in messages:
            for name, _, _ in m.files if m is not None else []:
                files.remove(f"{self.folder}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names = folder, schema.names
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and IN over header columns; leave everything else to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] != "payload" and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], (f.value,)))
            elif isinstance(f, In) and f.attribute[0] != "payload" and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[ArchiveRange]:
        if self.folder.endswith((".warc.gz", ".warc")):
            return [ArchiveRange(self.folder, 0, files.size(self.folder))]
        found = files.listing(self.folder)
        named = []
        for x in found:
            if x.startswith("manifest-"):
                with files.open_input(f"{self.folder}/{x}") as stream:
                    named += json.loads(stream.read())
        ranges = [ArchiveRange(f"{self.folder}/{name}", start, end) for name, size, places in named
                  for start, end in zip(places, [*places[1:], size])]
        ranges += [ArchiveRange(f"{self.folder}/{x}", 0, files.size(f"{self.folder}/{x}")) for x in found
                   if x.endswith((".warc.gz", ".warc")) and not OWN_FILE.fullmatch(x)]
        return ranges or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        wanted = [(name, frozenset(values)) for name, values in self.wanted]
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("page_id", "payload_bytes", "refers_to")
                             else pa.string()) for n in self.names])
        rows, held = [], 0
        with files.open_input(partition.file) as stream:
            for row in read_records(stream, partition.start, partition.end,
                                    lambda r: all(r[n] in values for n, values in wanted), "payload" in self.names):
                rows.append(row)
                held += len(row.get("payload") or b"")
                if len(rows) >= 4096 or held >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html",
               least_bytes: int = 1000) -> DataFrame:
    """The records to write: (page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload).

    Equal payloads are found by digest and length; only digests that occur twice come back to the pages, and
    that join is one that adaptive execution splits when a third of the pages share a payload.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    repeated = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "_last")
    same = (rows.payload_digest == repeated["_digest"]) & (rows.payload_bytes == repeated["_bytes"])
    revisit = F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("page_id"))
    return rows.join(repeated, same, "left").select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_last")).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"))


def write_archives(records: DataFrame, folder: str) -> None:
    register(records.sparkSession)
    files.create_folder(folder)
    records.write.format("warc").mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).load(folder)


def archive_round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write `pages` as archives, read them back: HEADERS_SCHEMA rows, digests of responses from their payloads."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write_archives(records_of(pages, **columns), folder)
    headers = [c.split()[0] for c in HEADERS_SCHEMA.split(", ")]
    revisits = read_archives(spark, folder, HEADERS_SCHEMA).where(F.col("record_type") == "revisit")
    responses = read_archives(spark, folder).where(F.col("record_type") == "response").withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    return responses.select(*headers).unionByName(revisits.select(*headers))
