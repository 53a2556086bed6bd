"""WARC records in ZIP packages: written with revisits, read by ranges without extraction.

A package holds one WARC file and its index, both stored, so each record is a byte range of the
package. The reader parses the end of the package (with the ZIP64 records, if any), the central
directory, and the index found there; it then reads ranges of several records at a time. Tasks
share ranges, not packages, so a large package is read by many.

Of records with equal payloads of at least ``least`` bytes, that with the largest id is the
response and the others are revisits that refer to it. Only digests and ids are grouped.

Defined results: a null payload is empty; a null id is less than any other and stays null; rows
that share the largest id of a payload are all responses; if all ids of a payload are null, all
are responses; a null target stays null; an empty table gives no package and no records; other
columns are not written. A task that is repeated writes a new package; only packages in the
list of the attempt that counted are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.common import Batches
from tallywork.operators.stages import written
from tallywork.session import run_folder

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
RANGES_PER_TASK = 4

# Signatures and sizes of the ZIP format.
END_MARK, END_SIZE, END_SEARCH = b"PK\x05\x06", 22, 22 + 65535
LOCATOR_MARK, LOCATOR_SIZE = b"PK\x06\x07", 20
END64_MARK, CENTRAL_MARK, LOCAL_MARK = b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1


# Writing.


class _Stream:
    """What a ZIP writer needs of a file that cannot seek."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


class Package:
    """One package that is being written."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        self.path, self.out = path, system.open_output_stream(place)
        self.zip = zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, record: bytes, **fields) -> None:
        packed = zlib.compress(record, 1, 31)
        self.member.write(packed)
        self.index.append(f"{fields['digest']} {DATE} " + json.dumps({"offset": self.at, "length": len(packed), **fields}))
        self.at += len(packed)

    def close(self) -> dict:
        self.member.close()
        self.zip.writestr(INDEX, "".join(line + "\n" for line in sorted(self.index)))
        self.zip.close()
        self.out.close()
        return {"package": self.path, "records": len(self.index)}


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = url and url.replace("\r", "%0D").replace("\n", "%0A")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Profile": PROFILE if refers_to is not None else None,
        "WARC-Refers-To": record_id(refers_to, digest) if refers_to is not None else None,
        "X-Page-ID": page,
        "X-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """The digests that several ids share, each with the largest id, from (id, digest, bytes)."""
    large = pages.where(F.col("bytes") >= least).groupBy("digest")
    groups = large.agg(F.max("id").alias("last"), F.min("id").alias("first"), F.count("*").alias("n"), F.count("id").alias("named"))
    return groups.where("first != last OR (named > 0 AND named < n)").select("digest", "last")


def write_packages(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write a record per row into packages in the shared folder; the list of packages (package, records).

    The digests of several ids are written first, so that Spark knows their size: if it is small
    they are broadcast, otherwise both sides are sorted and a digest of many rows is split.
    """
    folder = run_folder(pages.sparkSession, "packages")
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    chosen = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    chosen = chosen.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    shared = written(revisits(chosen.select("id", "digest", "bytes"), least), "revisits")
    joined = chosen.join(shared, "digest", "left")
    refers_to = F.when((F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    records = joined.select("id", "url", "payload", "digest", refers_to.alias("refers_to"))

    def write(batches: Batches) -> Batches:
        package, done = None, []
        for batch in batches:
            for id_, url_, data, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                package = package or Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                package.add(warc_record(id_, url_, data, digest, refers), digest=digest, type="response" if refers is None else "revisit")
                if package.at >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("package", pa.string()), ("records", pa.int64())]))

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1])
    return written(records.mapInArrow(write, "package string, records long"), "package-list")


# Reading.


def _extra64(extra: bytes, wanted: list[int]) -> list[int]:
    """Sizes and offset of a central entry, those that are full taken from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(values) if v == FULL32 else v for v in wanted]
        at += 4 + size
    return wanted


def members(file) -> dict[str, tuple[int, int, int]]:
    """Each member's method, place of its data, and packed size, from the central directory."""
    total = file.size()
    tail_at = max(0, total - END_SEARCH - LOCATOR_SIZE)
    tail = file.read_at(total - tail_at, tail_at)
    end = tail.rfind(END_MARK)
    while end >= 0:  # the true one reaches with its comment to the end of the file
        if end + END_SIZE <= len(tail) and end + END_SIZE + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
        end = tail.rfind(END_MARK, 0, end)
    if end < 0:
        raise ValueError("not a ZIP package: no end of central directory")
    count, size, start = struct.unpack_from("<HLL", tail, end + 10)
    if end >= LOCATOR_SIZE and tail[end - LOCATOR_SIZE : end - LOCATOR_SIZE + 4] == LOCATOR_MARK:
        place = struct.unpack_from("<Q", tail, end - LOCATOR_SIZE + 8)[0]
        record = file.read_at(56, place)
        if record[:4] != END64_MARK:
            raise ValueError("ZIP64 locator without its record")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    elif count == FULL16 or size == FULL32 or start == FULL32:
        raise ValueError("ZIP64 package without a locator")
    directory, at, found = file.read_at(size, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL_MARK:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, whole = struct.unpack_from("<LL", directory, at + 20)
        name_size, extra_size, comment_size = struct.unpack_from("<HHH", directory, at + 28)
        offset = struct.unpack_from("<L", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_size].decode()
        extra = directory[at + 46 + name_size : at + 46 + name_size + extra_size]
        _, packed, offset = _extra64(extra, [whole, packed, offset])
        found[name] = (method, offset, packed)
        at += 46 + name_size + extra_size + comment_size
    return found


def data_place(file, offset: int) -> int:
    """Where the data of the member begins whose local header is at ``offset``."""
    head = file.read_at(30, offset)
    if head[:4] != LOCAL_MARK:
        raise ValueError("broken local header")
    return offset + 30 + sum(struct.unpack_from("<HH", head, 26))


def member_bytes(file, method: int, offset: int, packed: int) -> bytes:
    data = file.read_at(packed, data_place(file, offset))
    return zlib.decompress(data, -15) if method == zipfile.ZIP_DEFLATED else data


def record_ranges(file) -> Iterator[tuple[int, int]]:
    """Place and length of every record in a package, from its indexes, by place."""
    listed = members(file)
    places = {}
    for name, (method, offset, _) in listed.items():
        if name.startswith("archive/"):
            if method != zipfile.ZIP_STORED:
                raise ValueError(f"{name} is not stored, its records cannot be read by ranges")
            places[name.split("/")[-1]] = data_place(file, offset)
    found = []
    for name, entry in listed.items():
        if not name.startswith("indexes/"):
            continue
        data = member_bytes(file, *entry)
        for line in (zlib.decompress(data, 47) if name.endswith(".gz") else data).splitlines():
            fields = json.loads(line.split(b" ", 2)[2])
            base = places[fields["filename"]] if "filename" in fields else next(iter(places.values()))
            found.append((base + int(fields["offset"]), int(fields["length"])))
    yield from sorted(found)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record, names in lower case, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


RECORD = {
    "package": ("string", pa.string()), "at": ("long", pa.int64()), "record_type": ("string", pa.string()), "target": ("string", pa.string()),
    "page_id": ("long", pa.int64()), "refers_to": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()),
    "payload_digest": ("string", pa.string()), "intact": ("boolean", pa.bool_()), "payload": ("binary", pa.binary()),
}


def _row(package: str, at: int, data: bytes, with_payload: bool) -> dict:
    fields, block = parse_record(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    declared = base64.b32decode(fields["warc-payload-digest"].split(":", 1)[1]).hex()
    response = fields["warc-type"] == "response"
    digest = hashlib.sha1(payload).hexdigest() if response else declared
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "package": package, "at": at, "record_type": fields["warc-type"], "target": fields.get("warc-target-uri"),
        "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"),
        "payload_bytes": len(payload) if response else int(http[b"content-length"]), "payload_digest": digest,
        "intact": digest == declared, "payload": payload if response and with_payload else None,
    }


def read_packages(spark: SparkSession, packages: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per record of the listed packages; the payload of a revisit is null.

    ``payload_digest`` (hexadecimal SHA-1) and ``payload_bytes`` of a response are those of the
    payload read, of a revisit those it states. ``intact`` says whether read and stated agree.
    """

    def plan(batches: Batches) -> Batches:
        for batch in batches:
            for path in batch.column("package").to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as file:
                    rows, chunk = [], []
                    for at, length in record_ranges(file):
                        if chunk and at + length - chunk[0][0] > range_bytes:
                            rows.append({"package": path, "records": chunk})
                            chunk = []
                        chunk.append((at, length))
                    if chunk:
                        rows.append({"package": path, "records": chunk})
                rows = [{"package": r["package"], "starts": [a for a, _ in r["records"]], "lengths": [n for _, n in r["records"]]} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("package", pa.string()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]))

    def read(batches: Batches) -> Batches:
        schema = pa.schema([(name, kind) for name, (_, kind) in RECORD.items()])
        for batch in batches:
            for path, starts, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as file:
                    data = memoryview(file.read_at(starts[-1] + lengths[-1] - starts[0], starts[0]))
                rows, held = [], 0
                for at, length in zip(starts, lengths):
                    record = zlib.decompress(data[at - starts[0] : at - starts[0] + length], 31)
                    rows.append(_row(path, at, record, with_payload))
                    held += len(record) if with_payload else 0
                    if held > 8 * range_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    ranges = written(packages.select("package").mapInArrow(plan, "package string, starts array<long>, lengths array<long>"), "ranges")
    # By the number of ranges, each of some megabytes to read: their table is so small that adaptive
    # execution would take it for one task's work.
    tasks = max(1, -(-ranges.count() // RANGES_PER_TASK))
    spread = ranges.repartition(tasks, F.xxhash64("package", F.col("starts")[0]))
    return spread.mapInArrow(read, ", ".join(f"{name} {kind}" for name, (kind, _) in RECORD.items()))
