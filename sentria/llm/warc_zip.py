"""WARC records in ZIP packages: write pages, read them back by ranges.

A package is a ZIP file whose members are stored, not deflated:
``archive/data.warc.gz`` has one gzip member for each WARC record and
``indexes/index.jsonl`` has offset and length of each record in it. The reader
parses the end record, the ZIP64 record and the central directory itself, finds
the stored members in the package, and reads each record by its own range. No
member is extracted.

Payloads of at least ``min_revisit`` bytes that occur more than once are kept
once: with the record of the smallest page id. The others are revisit records
that refer to it.

Defined cases: a null payload is empty; a null page id is written without an id,
revisits any equal payload that has one, and is a response where none has; rows
that repeat both id and payload as the smallest are all responses; a null URL is
recorded as ``urn:page:`` and the id; an empty table gives an empty result;
extra columns are ignored. Each task writes packages under a name of its own
attempt, and only those that the committed manifest names are read, so that lost
executors leave no trace but unused files.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch_of, filesystem, keyed_only, qualified, rows_of, small_batches, written

MIN_REVISIT = 100
#: A package is closed beyond this many stored bytes.
PACKAGE_BYTES = 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
DATE = "2024-01-01T00:00:00Z"

# ZIP signatures and record sizes (fixed values of the format)
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class BadPackage(ValueError):
    """The file is not a ZIP package that this reader takes."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    stored: int
    size: int
    header: int


class Ranges:
    """Reads by range from an open file that can seek; counts the bytes."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.read_bytes = file, size, 0

    def at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise BadPackage(f"range {offset}+{length} is outside the file")
        self.file.seek(offset)
        got = self.file.read(length)
        self.read_bytes += len(got)
        return bytes(got)


def directory(source: Ranges) -> dict[str, Member]:
    """Members by name from the central directory, ZIP64 fields included."""
    tail = source.at(max(0, source.size - 65557), min(source.size, 65557))
    end = tail.rfind(END)
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise BadPackage("no end of central directory")
    count, size, offset = struct.unpack_from("<HII", tail, end + 10)
    place = source.size - len(tail) + end
    if 0xFFFF == count or 0xFFFFFFFF in (size, offset) or (place >= 20 and source.at(place - 20, 4) == LOCATOR64):
        sign, _, record, _ = struct.unpack("<4sIQI", source.at(place - 20, 20))
        if sign != LOCATOR64:
            raise BadPackage("ZIP64 locator is missing")
        sign, _, _, _, _, _, _, count, size, offset = struct.unpack("<4sQHHIIQQQQ", source.at(record, 56))
        if sign != END64:
            raise BadPackage("ZIP64 end record is missing")
    block, at, found = source.at(offset, size), 0, {}
    for _ in range(count):
        if block[at : at + 4] != ENTRY:
            raise BadPackage("central directory entry is damaged")
        method = struct.unpack_from("<H", block, at + 10)[0]
        stored, whole, named, extra, remark = struct.unpack_from("<IIHHH", block, at + 20)
        header = struct.unpack_from("<I", block, at + 42)[0]
        name = block[at + 46 : at + 46 + named].decode("utf-8")
        more = block[at + 46 + named : at + 46 + named + extra]
        values = [whole, stored, header]
        while len(more) >= 4:
            tag, length = struct.unpack_from("<HH", more)
            if tag == 1:  # only the fields that overflowed, in this order
                wide = iter(struct.unpack(f"<{length // 8}Q", more[4 : 4 + length // 8 * 8]))
                values = [next(wide, v) if v == 0xFFFFFFFF else v for v in values]
            more = more[4 + length :]
        found[name] = Member(name, method, values[1], values[0], values[2])
        at += 46 + named + extra + remark
    return found


def stored_at(source: Ranges, member: Member) -> int:
    """Offset in the package of a stored member's first byte."""
    if member.method != 0 or member.stored != member.size:
        raise BadPackage(f"{member.name} is not stored")
    head = source.at(member.header, 30)
    if head[:4] != LOCAL:
        raise BadPackage(f"{member.name} has no local header")
    named, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + named + extra


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    target = "".join(c for c in url if c > " ") if url else f"urn:page:{page_id}"
    refer = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page-Id: {refers_to}\r\n" if revisit else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>\r\n"
        f"WARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\n{own}{refer}WARC-Payload-Digest: sha256:{digest}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields and payload of one WARC record. The payload's digest is checked for responses."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadPackage("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise BadPackage("payload does not have the digest of its record")
    number = lambda k: int(fields[k]) if fields.get(k, "None") != "None" else None
    return {"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if whole else None}


class Package:
    """Writes records to one package; ``close`` adds the index and the directory."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        files, inner = filesystem(self.path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        self.sink = files.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.bytes = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self.data.write(member)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.bytes, "length": len(member)}))
        self.bytes += len(member)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.sink.close()
        return self.path, len(self.index), self.bytes


def read_package(path: str) -> Iterator[dict]:
    """All records of a package, each read by its range."""
    files, inner = filesystem(path)
    with files.open_input_file(inner) as f:
        source = Ranges(f, f.size())
        members = directory(source)
        index, data = members[INDEX], stored_at(source, members[DATA])
        for line in source.at(stored_at(source, index), index.size).decode().splitlines():
            entry = json.loads(line)
            yield parse_record(zlib.decompress(source.at(data + entry["offset"], entry["length"]), 31))


MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write every row as a record; returns the manifest ``MANIFEST``, written.

    Payloads move between machines only if more digests are repeated than may
    be broadcast (``BROADCAST_KEYS``).
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    records = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.sha2(payload, 256).alias("digest"))
    digests = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(F.coalesce(F.col(html_col), F.lit(""))).alias("bytes"))
    repeated = digests.filter(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null")
    first = written(repeated.select(F.unhex("digest").alias("of_digest"), "first_id"), "repeated-payloads")
    decided = records.join(keyed_only(first), F.unhex("digest") == F.col("of_digest"), "left").withColumn("revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).drop("of_digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for ids, urls, pages_, digests_, firsts, revisits in rows_of(batches, "page_id", "url", "html", "digest", "first_id", "revisit"):
            for page_id, url, html, digest, first_id, revisit in zip(ids, urls, pages_, digests_, firsts, revisits, strict=True):
                package = package or Package(folder)
                package.add(page_id, record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first_id, revisit))
                if package.bytes >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield batch_of(done, _MANIFEST)

    return written(decided.mapInArrow(write, MANIFEST), "manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """The records (without payloads) of all packages that ``manifest`` names."""
    count = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (paths,) in rows_of(batches, "path"):
            for path in paths:
                rows = []
                for found in read_package(path):
                    rows.append(tuple(found[n] for n in _RECORD.names))
                    if len(rows) == 10_000:
                        yield batch_of(rows, _RECORD)
                        rows = []
                yield batch_of(rows, _RECORD)

    return manifest.select("path").repartition(min(count, 10_000)).mapInArrow(read, RECORD)
