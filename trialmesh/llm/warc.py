"""WARC archives with a two-level capture index.

Captures are sorted by a key that starts with the reversed host and cut into compressed blocks of lines.  Each index
part has a sparse directory with the first key of every block; a lookup finds the part among the parts' ranges, the
block by binary search in the directory, and reads only the byte ranges of that block and of the records it names.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialmesh.llm.common import remove, store
from trialmesh.session import new_path

WRITTEN = "page_id long, url string, key string, kind string, digest string, file string, at long, size long"
FOUND = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
PARTS = "part string, directory string, first string, last string, captures long"


def file_system(path: str):
    """The file system of a shared path, and the path inside it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def capture_key(url: str | None) -> str:
    """host.example.org/a?b as ``org,example,host)/a?b``; scheme, user, port and fragment are left out."""
    rest = (url or "").split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    end = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host = rest[:end].rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest[end:] or "/")


def _line_safe(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One compressed record; a revisit has the headers of the response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = f"urn:page:{'' if page_id is None else page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {_line_safe(url) if url else name}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if refers_to is not None else http + payload
    return gzip.compress("\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> dict:
    """A record read back; the digest of a response is computed from its payload and has to agree with the header."""
    text = gzip.decompress(data)
    head, _, rest = text.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[:int(fields["content-length"])]
    if not version.startswith("WARC/") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"not a whole record: {head[:200]!r}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"payload differs from its header: {fields['warc-record-id']}")
    number = lambda field: int(v) if (v := fields.get(field, "").strip("<>").removeprefix("urn:page:")) else None
    uri = fields["warc-target-uri"]
    return {"page_id": number("warc-record-id"), "url": None if uri.startswith("urn:page:") else uri, "payload": payload if kind == "response" else None,
            "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to")}


def _rows(rows: list[dict], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def write_archive(pages: DataFrame, folder: str, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row below ``folder``; the captures (page_id, url, key, kind, digest, file, at, size).

    Payload is the html in UTF-8, null as empty.  Of equal payloads of at least ``least`` bytes the record of the
    smallest page_id is the response and the others revisit it; smaller payloads are always responses.  Rows that
    repeat that page_id are responses too; a null page_id never is the smallest.  Other columns are not used.

    Each task writes a file of its own name and hands over the offsets.  Only files named in the captures count, so a
    task that runs twice leaves at most a file that nobody reads.  Repeated payloads are found on digests: counts are
    combined in the tasks, and only digests that occur twice are joined back.
    Eager: repeated digests and captures are written to the shared folder; paths are below ``folder``.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    held = rows.select("page_id", "digest").where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    held.where("n > 1 AND first IS NOT NULL").select("digest", "first").write.parquet(f"{folder}/repeated")
    repeated = spark.read.schema("digest string, first long").parquet(f"{folder}/repeated")
    rows = rows.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("key", pa.string()), ("kind", pa.string()), ("digest", pa.string()),
                        ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = f"{folder}/warc/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            done = []
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    files, path = file_system(name)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                data = record(page_id, url, html.encode(), digest, first, date)
                out.write(data)
                done.append({"page_id": page_id, "url": url, "key": capture_key(url), "kind": "response" if first is None else "revisit", "digest": digest,
                             "file": name, "at": at, "size": len(data)})
                at += len(data)
            if done:
                yield _rows(done, schema)
        if out is not None:
            out.close()
    rows.mapInArrow(write, WRITTEN).write.parquet(f"{folder}/captures")
    return spark.read.schema(WRITTEN).parquet(f"{folder}/captures")


def build_index(captures: DataFrame, folder: str, per_block: int = 1000) -> DataFrame:
    """Write the sorted, compressed index below ``folder``; one row per index part: part, directory, first, last, captures.

    The sort goes by key, then page_id, so an address with very many captures spreads over several parts.
    """
    fields = ["key", "page_id", "url", "kind", "digest", "file", "at", "size"]
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.select(*fields).repartitionByRange(tasks, "key", "page_id", "at").sortWithinPartitions("key", "page_id", "at")
    schema = pa.schema([("part", pa.string()), ("directory", pa.string()), ("first", pa.string()), ("last", pa.string()), ("captures", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/index/{uuid.uuid4().hex}"
        waiting, sparse, out, at, last, total = [], [], None, 0, "", 0

        def block() -> None:
            nonlocal at, waiting
            data = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in waiting).encode())
            out.write(data)
            sparse.append([waiting[0][0], at, len(data)])
            at, waiting = at + len(data), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    files, path = file_system(name)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                waiting.append(row)
                last, total = row[0], total + 1
                if len(waiting) == per_block:
                    block()
        if out is not None:
            if waiting:
                block()
            out.close()
            files, path = file_system(name + ".directory")
            with files.open_output_stream(path, compression=None) as stream:
                stream.write(json.dumps(sparse).encode())
            yield _rows([{"part": name, "directory": name + ".directory", "first": sparse[0][0], "last": last, "captures": total}], schema)
    ordered.mapInArrow(write, PARTS).write.parquet(f"{folder}/parts")
    return captures.sparkSession.read.schema(PARTS).parquet(f"{folder}/parts")


class IndexPart:
    """One part of the index: its sparse directory, and blocks by range read."""

    def __init__(self, part: str, directory: str):
        files, path = file_system(directory)
        with files.open_input_file(path) as stream:
            self.sparse = json.loads(stream.read())
        self.first = [entry[0] for entry in self.sparse]
        files, path = file_system(part)
        self.data, self.held = files.open_input_file(path), (-1, [])

    def block(self, number: int) -> list[list]:
        if self.held[0] != number:
            _, at, size = self.sparse[number]
            self.held = number, [json.loads(line) for line in zlib.decompress(self.data.read_at(size, at)).decode().split("\n")]
        return self.held[1]

    def find(self, key: str) -> Iterator[list]:
        """Captures of a key: its first block is the last one that starts before it."""
        number = max(0, bisect.bisect_left(self.first, key) - 1)
        while number < len(self.first) and self.first[number] <= key:
            rows = self.block(number)
            yield from rows[bisect.bisect_left(rows, key, key=lambda r: r[0]):bisect.bisect_right(rows, key, key=lambda r: r[0])]
            number += 1


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("digest", pa.string()),
                      ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
CAPTURE = "key string, page_id long, url string, kind string, digest string, file string, at long, size long"


def _captures(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CAPTURE)], schema=_CAPTURE)


def _in_lists(rows: Iterator[list], size: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _captures(held)
            held = []
    if held:
        yield _captures(held)


def lookup(parts: DataFrame, urls: DataFrame) -> DataFrame:
    """Captures of the addresses in column ``url``: parts by range, block by binary search, then one range read.

    The parts' ranges (one row per index part, so as many as tasks wrote it) are joined by comparison to the distinct
    keys; each part is opened by the task that gets its keys in order.  Null addresses find nothing; the empty address
    finds the captures without one.
    """
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = urls.where("url IS NOT NULL").select("url").distinct()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["wanted"])
    keys = wanted.mapInArrow(keyed, "wanted string").distinct()
    ranges = [(r["part"], r["directory"], r["first"], r["last"]) for r in parts.orderBy("first", "last").collect()]
    firsts = [r[2] for r in ranges]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                at = bisect.bisect_right(firsts, key) - 1
                while at >= 0 and ranges[at][3] >= key:
                    rows.append((ranges[at][0], ranges[at][1], key))
                    at -= 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["part", "directory", "wanted"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, index = None, None
        for batch in batches:
            for part, directory, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != name:
                    name, index = part, IndexPart(part, directory)
                yield from _in_lists(index.find(key))
    placed = keys.mapInArrow(routed, "part string, directory string, wanted string").repartition(tasks, "part").sortWithinPartitions("part", "wanted")
    return placed.mapInArrow(read, CAPTURE)


def read_records(captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records that ``captures`` names, by range reads in the order of the files.

    ``payload`` false leaves the payload null, after it was read and checked.
    """
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = captures.select("file", "at", "size").repartitionByRange(tasks, "file", "at").sortWithinPartitions("file", "at")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, done = None, None, []
        for batch in batches:
            for file, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    files, path = file_system(file)
                    name, stream = file, files.open_input_file(path)
                found = parse(stream.read_at(size, at))
                done.append(found if payload else found | {"payload": None})
                if len(done) == 500:
                    yield _rows(done, schema)
                    done = []
        if done:
            yield _rows(done, schema)
    return placed.mapInArrow(read, FOUND)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, as its record says when read back.

    Records are found as a reader of the archive finds them: the distinct addresses of the pages are looked up in the
    index, blocks by binary search in the sparse directories, and the records named there are range-read.  Pages
    without an address share one key, which spreads over index parts like any other.
    Archives and index are written below the shared folder and removed when the result is written.
    """
    folder = new_path(spark, "archive")
    index = build_index(write_archive(pages, folder), folder)
    asked = pages.select(F.coalesce("url", F.lit("")).alias("url"))
    captures, path = store(lookup(index, asked), "captures")
    found = read_records(captures, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    result, _ = store(found, "records")
    remove(spark, folder, path)
    return result
