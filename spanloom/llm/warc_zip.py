"""WARC archives packaged in ZIP files: written with an index, read by ranges without extraction.

A package stores (method 0) ``archive/data.warc.gz``, whose records are gzip members of their own, and
``indexes/index.cdxj``, which gives each record's offset and length in that member. The reader parses the
end-of-central-directory record, the ZIP64 locator and directory where sizes ask for them, and the central
directory; finds the stored members; and reads the index. Any record is then one range of the ZIP file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import attempt, open_file, write_file
from .workspace import Workspace, pages

QUERY = "op2_warc_zip"

#: Payloads from this size on are stored once.
MIN_REVISIT_BYTES = 1000
#: A package is closed when its records reach this size.
PACKAGE_BYTES = 16 << 20
#: Shared digests are broadcast up to this number (40 bytes each), else joined by shuffle.
BROADCAST_DIGESTS = 500_000
#: Records that one row of the block table covers.
BLOCK_RECORDS = 256

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_ALL, _HALF = 0xFFFFFFFF, 0xFFFF


# ---- ZIP ----


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False) -> list[bytes]:
    """A ZIP file of stored members, in parts. ZIP64 fields are written where sizes need them, or always."""
    parts: list[bytes] = []
    directory: list[bytes] = []
    at = 0
    for name, data in members:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or size >= _ALL or at >= _ALL
        local_extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        shown = _ALL if wide else size
        local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(local_extra)) + raw + local_extra
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        directory.append(
            struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, _ALL if wide else at) + raw + extra
        )
        parts += [local, data]
        at += len(local) + size
    central = b"".join(directory)
    count, wide = len(members), zip64 or at >= _ALL or len(central) >= _ALL or len(members) >= _HALF
    parts.append(central)
    if wide:
        parts.append(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, len(central), at))
        parts.append(struct.pack("<IIQI", 0x07064B50, 0, at + len(central), 1))
    parts.append(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, _HALF if wide else count, _HALF if wide else count, _ALL if wide else len(central), _ALL if wide else at, 0))
    return parts


def _at(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) != size:
        raise ValueError("the ZIP file ends too early")
    return data


def zip_members(file) -> dict[str, tuple[int, int, int]]:
    """name: (offset of the data, size, method), from the central directory of a seekable file."""
    file.seek(0, io.SEEK_END)
    length = file.tell()
    tail_at = max(0, length - 22 - _HALF)
    tail = _at(file, tail_at, length - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (record_at,) = struct.unpack_from("<Q", tail, end - 12)
        record = _at(file, record_at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of the central directory")
        count, size, at = struct.unpack_from("<QQQ", record, 32)
    central, pos, found = _at(file, at, size), 0, {}
    for _ in range(count):
        if central[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, packed, plain, n_name, n_extra, n_comment, offset = (
            *struct.unpack_from("<H", central, pos + 10), *struct.unpack_from("<II", central, pos + 20),
            *struct.unpack_from("<HHH", central, pos + 28), *struct.unpack_from("<I", central, pos + 42),
        )
        name = central[pos + 46 : pos + 46 + n_name].decode()
        extra, i = central[pos + 46 + n_name : pos + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:  # only the fields that overflow are there, in this order
                j = i + 4
                if plain == _ALL:
                    (plain,), j = struct.unpack_from("<Q", extra, j), j + 8
                if packed == _ALL:
                    (packed,), j = struct.unpack_from("<Q", extra, j), j + 8
                if offset == _ALL:
                    (offset,), j = struct.unpack_from("<Q", extra, j), j + 8
            i += 4 + n
        local = _at(file, offset, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("a broken local header")
        n_name_here, n_extra_here = struct.unpack_from("<HH", local, 26)
        found[name] = (offset + 30 + n_name_here + n_extra_here, packed, method)
        pos += 46 + n_name + n_extra + n_comment
    return found


def stored(members: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    offset, size, method = members[name]
    if method:
        raise ValueError(f"{name} is compressed in the package; records in it can't be read by range")
    return offset, size


# ---- WARC ----

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    value = record.removeprefix("<urn:x-page:").removesuffix(">")
    return None if value == "null" else int(value)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int | None] | None) -> bytes:
    """One record. refers_to: for a revisit, the page of the response that holds the payload."""
    uri = "" if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {uri}")
    if refers_to:
        head += [f"WARC-Refers-To: {record_id(refers_to[0])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than stated")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if revisit:
        n, digest = int(re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http)[1]), stated
    else:
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} has another digest than stated")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload, "payload_bytes": n, "payload_digest": digest,
    }


# ---- Spark ----


def classify(table: DataFrame, ws: Workspace, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """page_id, url, html, digest, refers_to (a revisit's response, else null), revisit."""
    rows = table.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html"))
    # Only digests that several rows share matter. Partial sums leave one row a digest and task.
    large = rows.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest")
    shared = large.agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keep")).where("n > 1 AND keep IS NOT NULL").select("digest", "keep")
    shared = ws.table(shared, "shared")
    if shared.count() <= broadcast_digests:
        shared = F.broadcast(shared)
    # Else both sides come straight from tables, so that adaptive execution may split a hot digest.
    joined = rows.join(shared, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", "keep", (F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))).alias("revisit"))


def write_packages(table: DataFrame, ws: Workspace, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write a record for each row; a table of the packages: path, n_records.

    Of rows with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, that with the largest page_id is
    the response and the others revisit it. Rows repeated with that page_id are responses each; a null
    page_id is never preferred, and where a payload has only null ids all are responses. Null html is an
    empty payload, a null url has no target field, control characters and blanks in urls are escaped. An
    empty table writes no package; further columns are ignored.
    """
    root = ws.path("packages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, seq = TaskContext.get().partitionId(), attempt(), 0
        records: list[bytes] = []
        lines: list[str] = []
        size = 0

        def close() -> pa.RecordBatch:
            uri = f"{root}/{part:06d}-{seq:04d}-{name}.zip"
            index = "".join(f"{x}\n" for x in lines).encode()
            write_file(uri, zip_package([(ARCHIVE, b"".join(records)), (INDEX, index)], zip64))
            return pa.RecordBatch.from_pydict({"path": [uri], "n_records": [len(lines)]})

        for batch in batches:
            for row in (x for i in range(0, batch.num_rows, 64) for x in batch.slice(i, 64).to_pylist()):
                payload = row["html"].encode("utf-8", "surrogatepass")
                press = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = warc_record(row["page_id"], row["url"], payload, row["digest"], (row["keep"],) if row["revisit"] else None)
                raw = press.compress(raw) + press.flush()
                lines.append(json.dumps({"id": record_id(row["page_id"]), "offset": size, "length": len(raw)}))
                records.append(raw)
                size += len(raw)
                if size >= package_bytes:
                    yield close()
                    records, lines, size, seq = [], [], 0, seq + 1
        if lines:
            yield close()

    return ws.table(classify(table, ws).mapInArrow(run, "path string, n_records long"), "packages_table")


def read_index(packages: DataFrame) -> DataFrame:
    """path, start, offsets, lengths: blocks of neighbouring records, found through the packages' directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as file:
                    members = zip_members(file)
                    start, _ = stored(members, ARCHIVE)
                    index = _at(file, *stored(members, INDEX))
                entries = [json.loads(x) for x in index.splitlines()]
                for i in range(0, len(entries), BLOCK_RECORDS):
                    block = entries[i : i + BLOCK_RECORDS]
                    yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "offsets": [[x["offset"] for x in block]], "lengths": [[x["length"] for x in block]]})

    return packages.select("path").repartition(_spread(packages)).mapInArrow(run, "path string, start long, offsets array<long>, lengths array<long>")


def _spread(packages: DataFrame) -> int:
    return max(1, min(packages.count(), 10_000))


def read_records(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the packages: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and on demand payload."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    for i in range(0, len(row["offsets"]), 64):
                        found = [parse_record(zlib.decompress(_at(file, row["start"] + o, n), 31)) for o, n in zip(row["offsets"][i : i + 64], row["lengths"][i : i + 64], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in zip(names, types, strict=True)], names=names)

    return read_index(packages).repartition(4 * _spread(packages)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(pages(spark, sf_dir), Workspace(spark, "warc-zip"))
    return read_records(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH base AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM base
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM grouped
"""
