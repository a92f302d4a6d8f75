"""Web archives in ZIP packages: written record by record, read by ranges without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member per WARC record) and
``indexes/index.cdxj`` (one JSON line per record with offset and length in the archive), both
stored without further compression, so a record is a byte range of the package.

The reader takes the end-of-central-directory record from the file's tail, follows the ZIP64
locator where sizes, offsets or counts overflow, parses the central directory, reads the local
header of a stored member to find its data, and then ranges only.

``pages`` has page_id, url and html.  Nulls: a null html is an empty payload, a null url an
empty target, a null page_id sorts behind every id and is read back as null.  Of records with
equal payloads of at least ``least`` bytes the one with the smallest page_id is the response and
the others revisit it; rows that repeat that page_id are responses too.  An empty table gives no
packages and an empty result.  Further columns are left out.

Memory: one payload, and the index of one package, which is closed beyond ``package_bytes``.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .files import attempt_name, opened, shared_folder

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_BYTES = 100
PACKAGE_BYTES = 1 << 30
#: Bytes of records that one reading task takes.
RANGE_BYTES = 16 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def _record(row: dict, digest: str) -> bytes:
    """One WARC record; a revisit has the HTTP header but no payload."""
    payload, refers = row["payload"], row["refers_to"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if row["revisit"] else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}",
        f"WARC-Record-ID: <urn:page:{row['page_id']}>", f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if row["revisit"]:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    """One package being written to a stream that cannot seek."""

    def __init__(self, system, path: str):
        self.sink = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, row: dict, level: int) -> None:
        digest = hashlib.sha256(row["payload"]).hexdigest()
        data = gzip.compress(_record(row, digest), level, mtime=0)
        self.member.write(data)
        self.index.append(json.dumps({"offset": self.size, "length": len(data), "page_id": row["page_id"], "digest": f"sha256:{digest}"}))
        self.size += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.sink.close()


def write_packages(
    pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES,
    package_bytes: int = PACKAGE_BYTES, level: int = 6,
) -> DataFrame:
    """Write a record per row and return the packages (``package``, ``records``)."""
    folder = folder or shared_folder(pages.sparkSession, "archives")
    rows = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", "first")
    )
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    marked = rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = package = name = None
        count = made = 0

        def done():
            package.close()
            return pa.RecordBatch.from_pydict({"package": [name], "records": pa.array([count], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                if package is None:
                    if system is None:
                        system, root = opened(folder)
                        system.create_dir(root, recursive=True)
                    file = f"{attempt_name('pages')}-{made}.wacz"
                    package, name, count, made = _Package(system, f"{root}/{file}"), f"{folder}/{file}", 0, made + 1
                package.add(batch.slice(i, 1).to_pylist()[0], level)
                count += 1
                if package.size >= package_bytes:
                    yield done()
                    package = None
        if package is not None:
            yield done()

    return stage(marked.mapInArrow(write, "package string, records bigint"), "packages")


# Reading

class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


_TAIL = 22 + 65535  # the end record and the longest comment


def central_directory(file) -> list[Member]:
    """The members of a ZIP file, by its central directory; ZIP64 where the fields overflow."""
    size = file.size()
    tail_at = max(0, size - _TAIL)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<10xHII", tail, end)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        at = tail_at + end - 20
        locator = file.read_at(20, at) if at >= 0 else b""
        if locator[:4] == b"PK\x06\x07":
            (where,) = struct.unpack_from("<8xQ", locator)
            record = file.read_at(56, where)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<32xQQQ", record)
    data, at, members = file.read_at(length, start), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is broken")
        flags, method, packed, full, n, extra, comment, header = struct.unpack_from("<8xHH8xIIHHH8xI", data, at)
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        wide = iter(_wide(data[at + 46 + n : at + 46 + n + extra]))
        full = next(wide) if full == 0xFFFFFFFF else full
        packed = next(wide) if packed == 0xFFFFFFFF else packed
        header = next(wide) if header == 0xFFFFFFFF else header
        members.append(Member(name, method, packed, header))
        at += 46 + n + extra + comment
    return members


def _wide(extra: bytes) -> list[int]:
    """The 8-byte values of the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return [x for (x,) in struct.iter_unpack("<Q", extra[at + 4 : at + 4 + size // 8 * 8])]
        at += 4 + size
    return []


def stored_range(file, member: Member) -> tuple[int, int]:
    """Where a stored member's bytes lie in the file."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed and has no ranges")
    header = file.read_at(30, member.header)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    name, extra = struct.unpack_from("<26xHH", header)
    return member.header + 30 + name + extra, member.size


def locate(file) -> Iterator[tuple[int, int]]:
    """Byte ranges of all records of a package, from its indexes."""
    members = {m.name: m for m in central_directory(file)}
    start, size = stored_range(file, members[ARCHIVE])
    at, left = stored_range(file, members[INDEX])
    rest = b""
    while left or rest:
        data = file.read_at(min(left, 1 << 20), at) if left else b""
        at, left = at + len(data), left - len(data)
        *lines, rest = (rest + data).split(b"\n")
        if not left:
            lines, rest = [*lines, rest], b""
        for line in filter(None, lines):
            entry = json.loads(line[line.index(b"{"):])
            if entry["offset"] + entry["length"] > size:
                raise ValueError("the index points behind the archive")
            yield start + entry["offset"], entry["length"]


def parse_record(data: bytes) -> dict:
    """A gzip member's WARC record."""
    raw = gzip.decompress(data)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is broken")
    page = lambda uri: None if uri == "<urn:page:None>" else int(uri[10:-1])
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": full,
        "refers_to": page(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


RECORDS = (
    "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, "
    "refers_to bigint, payload binary"
)


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the packages named in ``package``; ``payload`` is null for revisits.

    Ranges are found per package and dealt out again by ``RANGE_BYTES``, so that a large
    package is read by many tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("package").to_pylist():
                system, path = opened(name)
                with system.open_input_file(path) as file:
                    found = []
                    for entry in locate(file):
                        found.append(entry)
                        if len(found) == 10_000:
                            yield ranges(name, found)
                            found = []
                    if found:
                        yield ranges(name, found)

    def ranges(name, found):
        return pa.RecordBatch.from_pydict({"package": [name] * len(found), "at": pa.array([a for a, _ in found], pa.int64()), "size": pa.array([s for _, s in found], pa.int64())})

    ddl = RECORDS if payloads else RECORDS.rsplit(",", 1)[0]
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file = None
        for batch in batches:
            rows, held = [], 0
            for entry in batch.to_pylist():
                if entry["package"] != name:
                    name = entry["package"]
                    system, path = opened(name)
                    file = system.open_input_file(path)
                rows.append(parse_record(file.read_at(entry["size"], entry["at"])))
                if not payloads:
                    del rows[-1]["payload"]
                held += entry["size"]
                if held > 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    entries = packages.select("package").mapInArrow(find, "package string, at bigint, size bigint")
    block = F.floor(F.col("at") / RANGE_BYTES)
    return (
        entries.repartition("package", block).sortWithinPartitions("package", "at")
        .mapInArrow(read, ddl)
    )


def archive_digests(pages: DataFrame, **options) -> DataFrame:
    """Write all pages to packages and describe each record as it is read back."""
    return read_packages(write_packages(pages, **options), payloads=False)
