import gzip
import hashlib
import io
import json
import zipfile
from collections import defaultdict

import pyarrow as pa
import pytest
from helpers import prose
from pyarrow import fs

from tallywork.llm import warc_zip

LONG = prose(1, 300)


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2) for r in rows], "page_id long, url string, html string, id int, digest string, bytes long")


def brute(rows, least=1000):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        named = [x for x in groups[html or ""] if x is not None]
        last = max(named) if named and len(data) >= least else None
        visit = last is not None and i != last
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response", last if visit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/", LONG), (2, "http://b/\r\nX-Bad: 1", LONG), (3, None, LONG), (None, "http://n/", LONG), (4, "http://c/", "short"), (5, "http://d/", "short"),
    (6, "http://e/", None), (7, "http://f/", ""), (8, "http://g/ü", "é" * 600), (9, "x", "é" * 600), (9, "x", "é" * 600), (10, "y", "\r\n\r\nWARC/1.1\r\n\r\n" * 90),
    (None, "z", "n" * 2000), (None, "z", "n" * 2000), (-5, "z", "w" * 1000), (-6, "z", "w" * 1000), (11, "big", prose(2, 60_000)), (12, "999", "v" * 999), (13, "999", "v" * 999),
]


def read(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"package_bytes": 300}])
def test_round_trip(spark, options):
    written = warc_zip.write_packages(pages(spark, ROWS), **options)
    records = warc_zip.read_packages(spark, written, range_bytes=500 if options else 1 << 20)
    assert read(records) == brute(ROWS)
    assert all(r.intact for r in records.collect())
    texts = {r[0]: r[2] or "" for r in ROWS}
    for r in records.where("record_type = 'response' and page_id is not null").collect():
        assert bytes(r.payload) == texts[r.page_id].encode()
    assert {r.target for r in records.where("page_id = 2").collect()} == {"http://b/%0D%0AX-Bad: 1"}
    assert sum(r.records for r in written.collect()) == len(ROWS)


def test_packages_are_what_other_readers_expect(spark):
    written = warc_zip.write_packages(pages(spark, ROWS[:6]))
    total = 0
    for row in written.collect():
        system, place = fs.FileSystem.from_uri(row.package)
        with zipfile.ZipFile(system.open_input_file(place)) as z:
            assert z.testzip() is None
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            stream = gzip.decompress(z.read(warc_zip.ARCHIVE))
            total += stream.count(b"WARC/1.1\r\n")
            for line in z.read(warc_zip.INDEX).splitlines():
                fields = json.loads(line.split(b" ", 2)[2])
                one = gzip.decompress(z.read(warc_zip.ARCHIVE)[fields["offset"] : fields["offset"] + fields["length"]])
                assert warc_zip.parse_record(one)[0]["warc-type"] == fields["type"]
    assert total == 6


def test_no_rows(spark):
    written = warc_zip.write_packages(pages(spark, []))
    assert written.count() == 0 and warc_zip.read_packages(spark, written).count() == 0


def zipped(monkeypatch, zip64, comment=b""):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    record = gzip.compress(warc_zip.warc_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("first/other.txt", "x" * 50, zipfile.ZIP_DEFLATED)
        z.writestr("archive/data.warc.gz", b"skip" + record, zipfile.ZIP_STORED)
        z.writestr("indexes/index.cdx.gz", gzip.compress(b"com,a)/ 2020 " + json.dumps({"offset": "4", "length": str(len(record)), "filename": "data.warc.gz"}).encode() + b"\n"), zipfile.ZIP_DEFLATED)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"a comment PK\x05\x06 with a mark and more text behind it"])
def test_directories(monkeypatch, zip64, comment):
    data = zipped(monkeypatch, zip64, comment)
    assert (warc_zip.END64_MARK in data) == zip64
    file = pa.BufferReader(data)
    assert set(warc_zip.members(file)) == {"first/other.txt", "archive/data.warc.gz", "indexes/index.cdx.gz"}
    ((at, length),) = warc_zip.record_ranges(file)
    fields, block = warc_zip.parse_record(gzip.decompress(file.read_at(length, at)))
    assert fields["x-page-id"] == "1" and block.endswith(b"payload")


def test_broken_packages_are_refused(monkeypatch):
    data = zipped(monkeypatch, False)
    for bad in (b"", b"no zip", data[:-30]):
        with pytest.raises(ValueError):
            warc_zip.members(pa.BufferReader(bad))
