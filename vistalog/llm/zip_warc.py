"""Web archives in ZIP packages: write WARC records, then range-read them by the package's own directories.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj``, both stored, so
that a record is one range of the package: the reader parses the end record, the ZIP64 locator and the central
directory, reads the index and then only the ranges of records; nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, package string, at long, size long"
_EPOCH = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 8 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a local absolute path, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# --- records ---------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record: a response with its payload, or a revisit that has only the HTTP header of it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{target}')}>",
        f"WARC-Date: {_EPOCH}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    head += [f"WARC-Target-URI: {target}"] * (url is not None) + [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields, lower-cased, and the block of one WARC record; raises ValueError where it is malformed."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut off")
    return fields, rest[:size]


# --- packages --------------------------------------------------------------------------------------------


class Package:
    """Writes one ZIP package to a stream that need not seek."""

    def __init__(self, out):
        self.out, self.at, self.lines = out, 0, []
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, url: str | None, digest: str, data: bytes) -> None:
        packed = gzip.compress(data, 1, mtime=0)
        self.data.write(packed)
        self.lines.append((url or "", json.dumps({"offset": self.at, "length": len(packed), "digest": digest})))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            for url, entry in sorted(self.lines):
                f.write(f"{json.dumps(url)} {entry}\n".encode())
        self.zip.close()


def directory(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int, int]]:
    """(method, start of the data, bytes) of each member, from ZIP and ZIP64 directories by range reads.

    ``read(at, n)`` gives n bytes of the package. Raises ValueError where there is no end record, or where a
    directory points outside the package.
    """
    tail = read(max(0, size - 65_557), min(size, 65_557))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        wide = read(at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    if start + length > size:
        raise ValueError("the central directory lies outside the package")
    table, out, p = read(start, length), {}, 0
    for _ in range(count):
        if table[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, (packed, plain), (n, m, k) = struct.unpack("<H", table[p + 10 : p + 12])[0], struct.unpack("<II", table[p + 20 : p + 28]), struct.unpack("<HHH", table[p + 28 : p + 34])
        (local,) = struct.unpack("<I", table[p + 42 : p + 46])
        name, extra = table[p + 46 : p + 46 + n].decode("utf-8"), table[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:
            kind, width = struct.unpack("<HH", extra[:4])
            if kind == 1:
                values = iter(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            extra = extra[4 + width :]
        a, b = struct.unpack("<HH", read(local + 26, 4))
        out[name] = (method, local + 30 + a + b, packed)
        p += 46 + n + m + k
    return out


def records_in(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every index line, in the order of offsets, by ranges of at most 8 MB or one record."""
    members = directory(read, size)
    for name in (DATA, INDEX):
        if members[name][0] != 0:
            raise ValueError(f"{name} is not stored")
    _, base, _ = members[DATA]
    lines = read(members[INDEX][1], members[INDEX][2]).splitlines()
    spans = sorted((e["offset"], e["length"]) for e in (json.loads(line[line.rindex(b" {") + 1 :]) for line in lines))
    i = 0
    while i < len(spans):
        j, start = i, spans[i][0]
        while j < len(spans) and (j == i or spans[j][0] + spans[j][1] - start <= _READ):
            j += 1
        data = read(base + start, spans[j - 1][0] + spans[j - 1][1] - start)
        for at, n in spans[i:j]:
            yield at, n, zlib.decompress(data[at - start : at - start + n], 31)
        i = j


# --- Spark -----------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to of the record to write for each page.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response and the others refer to
    it; rows that repeat this page_id are responses too, and so are all of a group whose ids are all null. Only
    digests are grouped; the group's first id is joined back, a join that Spark may split for a hot payload.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    joined = rows.join(firsts.select("payload_digest", "first"), "payload_digest", "left")
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_packages(planned: DataFrame, folder: str) -> DataFrame:
    """Write one package a partition into ``folder``; runs a job and returns its table: package, bytes, records.

    An attempt writes under a name of its own, and only packages of finished tasks are in the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        name = f"{uuid.uuid4().hex}.wacz"
        out = package = None
        n = 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}")
                    package = Package(out)
                package.add(url, digest, record(page_id, url, payload.encode("utf-8", "surrogatepass"), digest, refers_to))
                n += 1
        if package is not None:
            package.close()
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"package": f"{folder}/{name}", "bytes": size, "records": n}])

    return written(planned.mapInArrow(run, "package string, bytes long, records long"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """Every record of the packages listed in column ``package``; digests of payloads that were read are verified.

    Each package is a task, whatever the size of their list; so its rows are counted first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("package", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = file_system(path)
                with store.open_input_file(inner) as f:
                    size, rows = f.size(), []
                    for at, n, data in records_in(lambda p, k, f=f: f.read_at(k, p), size):
                        fields, block = parse_record(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(h.split(b":")[1] for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:")))
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                            raise ValueError(f"{path}: the payload at {at} differs from its digest")
                        number = lambda k, fields=fields: int(fields[k]) if k in fields else None
                        rows.append((number("x-page-id"), fields.get("warc-target-uri"), length, digest, fields["warc-type"], number("x-refers-to-page-id"), path, at, n))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return packages.select("package").repartition(max(1, packages.count())).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) as packages in the shared folder and read their records back.

    A null html is an empty payload; a null url or page_id is left out of the record and read back as null. Rows
    that repeat are records of their own. An empty table has no package and gives no record. Other columns are
    ignored. Runs the writing job; the result is lazy.
    """
    spark: SparkSession = pages.sparkSession
    return read_packages(write_packages(plan_records(pages, least), new_path(spark, "warc")))
