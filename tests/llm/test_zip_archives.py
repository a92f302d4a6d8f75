import hashlib
import io
import struct
import zipfile

import pyarrow as pa
from pyarrow import fs
import pytest

from tallyspark.llm import zip_archives as za

DDL = "page_id bigint, url string, html string, payload_bytes string"


def test_round_trip_with_revisits(spark):
    long = "<p>" + "ü" * 80 + "</p>"
    rows = [(3, "http://a/ b\n", long, "x"), (1, None, long, "x"), (1, None, long, "x"), (None, "u", long, "x"),
            (4, "v", "short", "x"), (5, "w", "short", "x"), (6, "z", None, "x"), (7, "z", "", "x"), (8, "big", "k" * 3_000_000, "x")]
    pages = spark.createDataFrame(rows, DDL).repartition(3)
    got = za.read_packages(za.write_packages(pages)).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.record_type): r for r in got}
    digest = hashlib.sha256(long.encode()).hexdigest()
    assert (by[1, "response"].payload_digest, by[1, "response"].payload_bytes) == (digest, 167)
    assert [r.record_type for r in got if r.page_id == 1] == ["response"] * 2
    assert (by[3, "revisit"].refers_to, by[3, "revisit"].payload_bytes, by[3, "revisit"].payload_digest) == (1, 167, digest)
    assert by[None, "revisit"].refers_to == 1
    assert by[3, "revisit"].url == "http://a/%20b%0A"
    assert by[4, "response"].refers_to is None and by[5, "response"].payload == b"short"
    assert by[6, "response"].payload == by[7, "response"].payload == b""
    assert by[8, "response"].payload == b"k" * 3_000_000


def test_packages_close_at_their_size_and_are_plain_zip_files(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i * 37}</p>", "x") for i in range(50)], DDL).coalesce(1)
    packages = za.write_packages(pages, package_bytes=2000).collect()
    assert len(packages) > 2 and sum(p.records for p in packages) == 50
    for p in packages:
        with zipfile.ZipFile(p.package.removeprefix("file://")) as z:
            assert z.testzip() is None
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_empty_table(spark):
    pages = spark.createDataFrame([], DDL)
    assert za.archive_digests(pages).collect() == []


class File:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, size, at):
        return self.data[at : at + size]


def test_directory_with_comment_prefix_and_compressed_members():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.txt", b"abc")
        z.writestr(zipfile.ZipInfo("d/ü.bin"), b"xyz" * 9)
        z.writestr("c", b"c" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    file = File(raw.getvalue())
    members = {m.name: m for m in za.central_directory(file)}
    assert set(members) == {"a.txt", "d/ü.bin", "c"}
    at, size = za.stored_range(file, members["d/ü.bin"])
    assert file.read_at(size, at) == b"xyz" * 9
    with pytest.raises(ValueError, match="compressed"):
        za.stored_range(file, members["c"])
    with pytest.raises(ValueError, match="end of central"):
        za.central_directory(File(b"no archive"))


def test_zip64_directory():
    """All sizes, offsets and counts only in the ZIP64 fields."""
    name, data = b"m", b"payload"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(data), len(data), 1, 0) + name + data
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    skipped = struct.pack("<HHI", 0x5455, 4, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(skipped + extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + skipped + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    file = File(local + central + end64 + locator + end)
    (member,) = za.central_directory(file)
    assert member == ("m", 0, len(data), 0)
    at, size = za.stored_range(file, member)
    assert file.read_at(size, at) == data


def test_broken_payload_is_noticed():
    row = {"payload": b"x" * 10, "revisit": False, "refers_to": None, "page_id": 1, "url": "u"}
    record = za._record(row, hashlib.sha256(b"other").hexdigest())
    with pytest.raises(ValueError, match="broken"):
        za.parse_record(za.gzip.compress(record))


def test_large_index_is_read_in_pieces(tmp_path):
    package = za._Package(fs.LocalFileSystem(), str(tmp_path / "p.wacz"))
    rows = [{"payload": b"%d" % i, "revisit": False, "refers_to": None, "page_id": i, "url": "u"} for i in range(9000)]
    for row in rows:
        package.add(row, 1)
    package.close()
    with pa.OSFile(str(tmp_path / "p.wacz")) as file:
        found = list(za.locate(file))
        assert len(found) == 9000
        assert za.parse_record(file.read_at(found[-1][1], found[-1][0]))["payload"] == b"8999"
