r"""WARC records in ZIP archives, read by their directories (operator 4).

Each task writes archives of at most ARCHIVE_BYTES of payload: a ZIP file with two stored (uncompressed) members, a
gzip-per-record WARC file and an index with one JSON line per record. The reader parses the end-of-central-directory
record, its ZIP64 form where present, and the central directory, finds the stored members, and reads single records by
byte range; nothing is extracted to disk and no archive is read whole.

Archives go to the shared folder under new names; only those that a finished task lists are read, so a lost or repeated
task leaves no trace in the result. Payloads move once, to their digest and a salt, so the pages of one digest are dealt over
many tasks and archives whatever their share; only the digest table is held in memory of the join.

Edge cases: null html is an empty payload; a null url an empty target; repeated rows are records of their own, and rows
that repeat the row with the largest id are responses like it; a null id can only be a response if all ids of its payload
are null; an empty table writes no archive and gives an empty result; a long payload is one record, held in memory whole;
other columns than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import keep, shared_dir, small_batches, spread

#: Payload bytes of an archive; least size of a payload that revisits can refer to.
ARCHIVE_BYTES, LEAST_BYTES = 1 << 25, 0
WARC, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Fixed date of all records, so that archives are reproducible.
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a WARC response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    fields = lambda b: dict(x.split(": ", 1) for x in b.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


class Archive:
    """A ZIP file of stored members, read by range through a seekable file."""

    def __init__(self, f):
        self.f = f
        size = f.size() if hasattr(f, "size") else f.seek(0, 2)
        tail_at = max(0, size - 65_557 - 20)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        n, length, at = struct.unpack("<H", tail[end + 10 : end + 12])[0], *struct.unpack("<II", tail[end + 12 : end + 20])
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07" and (n == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF):
            (where,) = struct.unpack("<Q", tail[end - 12 : end - 4])
            far = self.read(where, 56)
            if far[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            n, length, at = struct.unpack("<QQQ", far[32:56])
        self.members = dict(self._directory(self.read(at, length), n))

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _directory(self, raw: bytes, n: int) -> Iterator[tuple[str, tuple[int, int]]]:
        """name: (offset of the local header, size), from the central directory and its ZIP64 fields."""
        p = 0
        for _ in range(n):
            if raw[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, size = struct.unpack("<H", raw[p + 10 : p + 12])[0], *struct.unpack("<II", raw[p + 20 : p + 28])
            a, b, c = struct.unpack("<HHH", raw[p + 28 : p + 34])
            (at,) = struct.unpack("<I", raw[p + 42 : p + 46])
            name, extra = raw[p + 46 : p + 46 + a].decode("utf-8"), raw[p + 46 + a : p + 46 + a + b]
            q = 0
            while q + 4 <= len(extra):
                kind, m = struct.unpack("<HH", extra[q : q + 4])
                if kind == 1:
                    more = list(struct.unpack(f"<{m // 8}Q", extra[q + 4 : q + 4 + m // 8 * 8]))
                    size = more.pop(0) if size == 0xFFFFFFFF else size
                    packed = more.pop(0) if packed == 0xFFFFFFFF else packed
                    at = more.pop(0) if at == 0xFFFFFFFF else at
                q += 4 + m
            if method == 0:
                yield name, (at, packed)
            p += 46 + a + b + c

    def span(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes."""
        at, size = self.members[name]
        a, b = struct.unpack("<HH", self.read(at + 26, 4))
        return at + 30 + a + b, size

    def member(self, name: str) -> bytes:
        return self.read(*self.span(name))


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        row = next(rows, None)
        while row is not None:
            path, index, at, size = f"{base}/{uuid.uuid4().hex}.zip", [], 0, 0
            with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                with z.open(zipfile.ZipInfo(WARC), "w", force_zip64=True) as m:
                    while row is not None and size < ARCHIVE_BYTES:
                        payload = (row["html"] or "").encode("utf-8", "replace")
                        raw = record(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"])
                        m.write(raw)
                        index.append(json.dumps({"page": row["page_id"], "at": at, "n": len(raw)}))
                        at, size = at + len(raw), size + len(payload) + 200
                        row = next(rows, None)
                z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([len(index)], pa.int64())})

    return write


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archives of pages (page_id, url, html) in a shared folder; returns their list (path, records), already written.

    Of equal payloads of at least ``least_bytes`` bytes that with the largest id is a response, which the others revisit.
    """
    small_batches(pages.sparkSession)
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    p = spread(p, "sha", "page_id", "last", "page_id", F.max)
    revisit = ~F.col("page_id").eqNullSafe(F.col("last")) & (F.octet_length("html") >= least_bytes)
    rows = p.select("page_id", "url", "html", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))
    return keep(rows.mapInArrow(_writer(folder), "path string, records bigint"), "archives")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        ident = lambda x: int(x[10:-1]) if len(x) > 11 else None
        for path in (x.as_py() for b in batches for x in b.column(0)):
            with store.open_input_file(path) as f:
                z = Archive(f)
                base, _ = z.span(WARC)
                rows = []
                for line in z.member(INDEX).decode().splitlines():
                    e = json.loads(line)
                    warc, http, payload = parse(z.read(base + e["at"], e["n"]))
                    kind, sha = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and sha != digest(payload):
                        raise ValueError(f"{path}: payload of {warc['WARC-Record-ID']} doesn't have its digest")
                    rows.append({"page_id": ident(warc["WARC-Record-ID"]), "payload_bytes": len(payload) if kind == "response" else int(http["Content-Length"]), "payload_digest": sha, "record_type": kind, "refers_to": ident(warc.get("WARC-Refers-To", ""))})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return read


def read(archives: DataFrame, folder: str) -> DataFrame:
    """The records of a list of archives; each archive is one unit of work."""
    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(n, "path").mapInArrow(_reader(folder), RECORDS)


def op4(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back."""
    folder = shared_dir(spark, "warc")
    return read(write(pages, folder), folder)


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last FROM s)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(x, CAST(5 * (j // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM g
"""
