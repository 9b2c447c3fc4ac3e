"""Web archives packaged as ZIP files: written by partition, read by ranges without extraction.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, in which each record is a
gzip member of its own, and ``indexes/index.cdxj``, which gives each record's offset and length
there. The reader finds the end-of-central-directory record, follows the ZIP64 locator if there is
one, reads the central directory, and takes from each member's local header where its data begin;
a record is then one range of the package.

Packages are rows (name, content) of a table in the shared folder, so any store that Spark reaches
will do; ``spark.read.format("binaryFile")`` gives the same rows for packages that lie as files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpointing import materialize
from .textops import slices

#: Payload bytes of one package, about.
PACKAGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ReadAt = Callable[[int, int], bytes]
_DATE = "2024-01-01T00:00:00Z"
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


# --- ZIP ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    size: int
    stored: int
    header: int


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP package of stored members, with ZIP64 records where sizes need them or ``zip64`` asks."""
    out, directory, at = [], [], 0
    for name, data in members:
        raw, crc, wide = name.encode(), zlib.crc32(data), zip64 or len(data) >= _MAX32 or at >= _MAX32
        size = _MAX32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        head = struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x5821, crc, size, size, len(raw), len(extra))
        out += [_LOCAL, head, raw, extra, data]
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        directory += [_CENTRAL, struct.pack("<H", 45), struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x5821, crc, size, size, len(raw), len(extra)), struct.pack("<HHHII", 0, 0, 0, 0, _MAX32 if wide else at), raw, extra]
        at += 30 + len(raw) + len(struct.pack("<HHQQ", 1, 16, 0, 0) if wide else b"") + len(data)
    central = b"".join(directory)
    wide = zip64 or at + len(central) >= _MAX32 or len(members) >= _MAX16
    out.append(central)
    if wide:
        out.append(_EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(central), at))
        out.append(_LOCATOR + struct.pack("<IQI", 0, at + len(central), 1))
    n = _MAX16 if wide else len(members)
    out.append(_EOCD + struct.pack("<HHHHIIH", 0, 0, n, n, _MAX32 if wide else len(central), _MAX32 if wide else at, 0))
    return b"".join(out)


def central_directory(read_at: ReadAt, size: int) -> dict[str, Member]:
    """Members by name, from the directory at the end of a package of ``size`` bytes."""
    tail_at = max(0, size - 22 - _MAX16 - 20)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(_EOCD)
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") > len(tail):
        end = tail.rfind(_EOCD, 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package, or cut short")
    count, length, start = struct.unpack_from("<10xHII", tail, end)
    if _MAX16 == count or _MAX32 in (length, start):
        if end < 20 or tail[end - 20 : end - 16] != _LOCATOR:
            raise ValueError("ZIP64 fields without a ZIP64 locator")
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        record = read_at(at, 56)
        if record[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory where its locator points")
        count, length, start = struct.unpack_from("<32xQQQ", record)
    raw, at, members = read_at(start, length), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, crc, stored, full, n, m, k, header = struct.unpack_from("<10xH4xIIIHHH8xI", raw, at)
        name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            kind, span = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{span // 8}Q", extra, 4))
                full = wide.pop(0) if full == _MAX32 else full
                stored = wide.pop(0) if stored == _MAX32 else stored
                header = wide.pop(0) if header == _MAX32 else header
            extra = extra[4 + span :]
        members[name] = Member(name, method, crc, full, stored, header)
        at += 46 + n + m + k
    return members


def data_offset(read_at: ReadAt, member: Member) -> int:
    """Where a member's data begin: its local header may be longer than the directory says."""
    head = read_at(member.header, 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"no local header for {member.name}")
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    n, m = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + m


# --- WARC --------------------------------------------------------------------------------------


def sha1_base32(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def warc_record(kind: str, uri: str, page_id: int | None, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP headers, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {sha1_base32(digest)}", "Content-Type: application/http; msgtype=response", f"WARC-Page-ID: {page_id}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record; header names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC version line")
    warc = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(warc["content-length"])]
    top, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("latin-1").split("\r\n")[1:])}
    return warc, http, payload


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def package(records: list[tuple[str, str, int | None, bytes, int, str, int | None]]) -> bytes:
    data, index, at = [], [], 0
    for kind, uri, page_id, payload, length, digest, refers_to in records:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        raw = squeeze.compress(warc_record(kind, uri, page_id, payload, length, digest, refers_to)) + squeeze.flush()
        entry = {"url": uri, "mime": "warc/revisit" if kind == "revisit" else "text/html", "digest": sha1_base32(digest), "offset": str(at), "length": str(len(raw)), "filename": DATA.rpartition("/")[2]}
        key = "-" * 20 if page_id is None else f"{page_id:020d}"
        index.append(f"{key} {_DATE[:4]}0101000000 {json.dumps(entry)}\n".encode())
        data.append(raw)
        at += len(raw)
    return zip_stored([(DATA, b"".join(data)), (INDEX, b"".join(sorted(index)))])


def read_package(read_at: ReadAt, size: int) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """All records of a package, each read by its own range as the index gives it."""
    members = central_directory(read_at, size)
    index = read_at(data_offset(read_at, members[INDEX]), members[INDEX].size)
    if zlib.crc32(index) != members[INDEX].crc:
        raise ValueError("the index does not match its checksum")
    base = data_offset(read_at, members[DATA])
    for line in index.decode().splitlines():
        entry = json.loads(line.split(" ", 2)[2])
        raw = zlib.decompress(read_at(base + int(entry["offset"]), int(entry["length"])), 31)
        yield parse_record(raw)


# --- Spark -------------------------------------------------------------------------------------


def write_packages(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(name, content): ``pages`` (page_id, url, html) as packages of WARC records.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of ``min_bytes`` or more the
    one with the largest page_id is a response and the others are revisits that refer to it (repeated
    rows of that page_id are responses too). Which they are is found on digests alone: pages below
    ``min_bytes`` are written where they lie, and so are the others as long as Spark broadcasts the
    repeated digests, by the size of their table; beyond that size pages meet their digest in one
    shuffle. A null page_id is smaller than any other, and is written as a record without a number."""
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    sized = sized.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    large = sized.where(F.col("bytes") >= min_bytes)
    copies = large.groupBy(F.col("digest").alias("copied")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = large.join(materialize(copies, "copies"), F.col("digest") == F.col("copied"), "left").select("page_id", "url", "html", "digest", "keeper")
    joined = joined.union(sized.where(F.col("bytes") < min_bytes).select("page_id", "url", "html", "digest", F.lit(None).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html", PACKAGE_BYTES):
                records = []
                for page_id, url, html, digest, keeper in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    payload = html.encode()
                    again = keeper is not None and keeper != page_id
                    records.append(("revisit" if again else "response", _one_line(url), page_id, payload, len(payload), digest, keeper if again else None))
                content = package(records)
                yield pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.wacz"]), pa.array([content], pa.binary())], ["name", "content"])

    return joined.mapInArrow(run, "name string, content binary")


_RECORDS = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_RECORDS_DDL = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _records(read_at: ReadAt, size: int) -> Iterator[pa.RecordBatch]:
    """A package's records in batches of about ``PACKAGE_BYTES`` of payload."""
    rows, held = [], 0
    for warc, http, payload in read_package(read_at, size):
        digest = base64.b32decode(warc["warc-payload-digest"].partition(":")[2]).hex()
        full = warc["warc-type"] == "response"
        if full and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of page {warc['warc-page-id']} does not match its digest")
        page, refers = warc["warc-page-id"], warc.get("warc-refers-to-page-id")
        rows.append((None if page == "None" else int(page), warc["warc-target-uri"], warc["warc-type"], int(refers) if refers else None, len(payload) if full else int(http["content-length"]), digest, payload if full else None))
        held += len(payload)
        if held >= PACKAGE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)


def read_packages(packages: DataFrame) -> DataFrame:
    """(page_id, uri, record_type, refers_to, payload_bytes, digest, payload) of every record in
    ``packages`` (content, more columns are ignored; a null content has none). A revisit's payload is
    null and its length is that of its HTTP header; a payload is checked against the digest in its
    record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0):
                if cell.is_valid:
                    view = memoryview(cell.as_buffer())
                    yield from _records(lambda at, n, view=view: bytes(view[at : at + n]), len(view))

    return packages.select("content").mapInArrow(run, _RECORDS_DDL)


def read_package_files(paths: DataFrame) -> DataFrame:
    """The same records of packages that lie as files, from their ``path``: a local path, or a URI of a
    store that Arrow's file systems open. Only the directory, the index and the records' own ranges are
    read, so a package may be larger than a task's memory. Null paths have no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).drop_null().to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as f:
                    yield from _records(lambda at, n, f=f: f.read_at(n, at), f.size())

    return paths.select("path").mapInArrow(run, _RECORDS_DDL)
