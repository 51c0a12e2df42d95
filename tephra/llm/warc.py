"""WARC files: a PySpark data source that reads headers first and skips payloads, and a writer with revisit records.

Each record is a gzip member. Its header has an extra field "sl" with the member's and the record's length, so that a reader that
doesn't want a record's payload inflates its first bytes only and goes on behind it; members of other writers are inflated to their end.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from .common import arrow_map, list_files, open_file, shuffle_partitions, work_path, write_file, written

GZIP, SKIP_LENGTHS = b"\x1f\x8b\x08", b"sl"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
SCHEMA = ", ".join(f"{k} string" for k in FIELDS) + ", content_length long, http_length long, payload binary, payload_length long, payload_sha1 string, file string, offset long"
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member with its skip lengths (0 where it is too long for them)."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = SKIP_LENGTHS + struct.pack("<HII", 8, *((total, len(record)) if max(total, len(record)) < 1 << 32 else (0, 0)))
    return GZIP + b"\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone (its Content-Length is the full payload's)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if uri is not None:  # no line breaks or other controls in a header
        head.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)))
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(batches, folder: str):
    """A partition's records (page_id, url, raw, digest, refers_to) as one archive; yields (uri, records, bytes)."""
    uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
    count = size = 0

    def fill(out):
        nonlocal count, size
        for batch in batches:
            for page, url, raw, to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = raw or b""
                kind = "response" if to is None else "revisit"
                data = member(record(kind, f"urn:page:{'null' if page is None else page}", url, payload_digest(raw), raw, None if to is None else f"urn:page:{to}"))
                out.write(data)
                count += 1
                size += len(data)

    write_file(uri, fill)
    yield pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})


def write_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, folder: str | None = None) -> str:
    """Write a record for each row of df and return the folder of the archives.

    Of rows whose payloads (the html in UTF-8, null: empty) are equal and have min_bytes or more, those with the largest id are
    responses and the others revisit it; smaller payloads are all responses, as are groups without any id. A null url leaves its header
    out. Other columns are left out. An empty table gives a folder without records.

    Payloads are compared by SHA-1 and length. The largest id of each payload is found by a pre-aggregated sum; payloads that over a
    50,000th of the repeated rows share, at most 50,000 of them, are looked up in a broadcast, so that no task gets all rows of one payload.
    """
    spark = df.sparkSession
    folder = folder or work_path(spark, "warc")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("raw")).withColumn("key", F.unhex(F.sha1("raw")))
    first = written(
        rows.where(F.octet_length("raw") >= min_bytes).groupBy("key", F.octet_length("raw").alias("size")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-groups"
    )
    many = first.agg(F.sum("n")).head()[0] or 0
    hot = first.where(F.col("n") > max(1000, many // 50_000)).select("key", "size", F.col("first").alias("hot_first"))
    cold = first.where(F.col("n") <= max(1000, many // 50_000)).select(F.col("key").alias("cold_key"), F.col("size").alias("cold_size"), "first")
    found = rows.withColumn("size", F.octet_length("raw")).join(F.broadcast(hot), ["key", "size"], "left")
    # a hot row needs no second lookup: a key of its own keeps it from meeting the others of its payload
    own = F.when(F.col("hot_first").isNull(), F.col("key")).otherwise(F.concat(F.col("key"), F.xxhash64("page_id", "url").cast("string").cast("binary")))
    found = found.withColumn("cold_key", own).withColumn("cold_size", F.col("size")).join(cold, ["cold_key", "cold_size"], "left")
    of = F.coalesce("hot_first", "first")
    found = found.select("page_id", "url", "raw", F.when(F.col("page_id").isNull() | (F.col("page_id") != of), of).alias("refers_to"))
    written(arrow_map(found, lambda batches: _write(batches, folder), "uri string, records long, bytes long"), "warc-manifest")
    return folder


# --- reading -----------------------------------------------------------------------------------


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Member:
    """The record at a place of a file, inflated as far as asked for."""

    def __init__(self, file, at: int, packed: bool):
        self.file, self.at, self.packed, self.data, self.ended, self.skip = file, at, packed, b"", False, 0
        file.seek(at)
        if packed:
            head = file.read(12 + 12)
            if len(head) > 23 and head[3] & 4 and head[12:14] == SKIP_LENGTHS:
                self.skip = struct.unpack_from("<I", head, 16)[0]
            file.seek(at)
            self.inflate = zlib.decompressobj(31)
            self.taken = 0

    def until(self, size: int, step: int = 4096) -> bytes:
        """At least size bytes of the record, if it has them."""
        while len(self.data) < size and not self.ended:
            part = self.file.read(max(step, (size - len(self.data)) // 4))
            if not part:
                self.ended = True
            elif self.packed:
                self.data += self.inflate.decompress(part)
                self.taken += len(part)
                if self.inflate.eof:
                    self.ended, self.taken = True, self.taken - len(self.inflate.unused_data)
            else:
                self.data += part
        return self.data

    def header(self) -> tuple[dict[str, str], int] | None:
        """Its fields by lower-case name, and where its block begins; None at the end of the file."""
        size = 1024
        while (end := self.until(size).find(b"\r\n\r\n")) < 0:
            if self.ended:
                if self.data.strip():
                    raise ValueError(f"no WARC record at {self.at}")
                return None
            size *= 2
        lines = self.data[:end].decode("utf-8", "replace").lstrip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {self.at}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4

    def after(self, block: int, length: int) -> int:
        """Where the next record begins."""
        if not self.packed:
            return self.at + block + length + 4
        if self.skip:
            return self.at + self.skip
        while not self.ended:
            self.until(len(self.data) + (1 << 16), 1 << 16)
        return self.at + self.taken


def _unquoted(value: str | None) -> str | None:
    return value[1:-1] if value and value.startswith("<") and value.endswith(">") else value


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload, self.digest = options.get("path"), options.get("payload", "true").lower() == "true", options.get("digest", "false").lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Equality, lists and beginnings of header fields are tested here, before anything of a payload is inflated."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo | EqualNullSafe) and isinstance(f.value, str):
                self.tests.append((name, "in", (f.value,)))
            elif name in FIELDS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in FIELDS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", (f.value,)))
            elif name in FIELDS and isinstance(f, IsNotNull):
                self.tests.append((name, "known", ()))
            else:
                yield f

    def partitions(self):
        groups, size = [[]], 0
        for uri, n in [x for s in (".warc.gz", ".warc") for x in list_files(self.path, s)]:
            if groups[-1] and size + n > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(uri)
            size += n
        return [_Files(g) for g in groups]

    def _wanted(self, values: dict) -> bool:
        for name, kind, than in self.tests:
            v = values[name]
            if v is None or kind == "in" and v not in than or kind == "starts" and not v.startswith(than[0]):
                return False
        return True

    def read(self, partition):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in SCHEMA.split(", ")]
        rows, held = [], 0
        for uri in partition.files:
            with open_file(uri) as file:
                at, packed = 0, uri.endswith(".gz")
                while (found := (m := _Member(file, at, packed)).header()) is not None:
                    fields, block = found
                    length = int(fields.get("content-length") or 0)
                    values = {k: fields.get(v.lower()) for k, v in FIELDS.items()}
                    values |= {k: _unquoted(values[k]) for k in ("record_id", "refers_to")}
                    if self._wanted(values):
                        http, body = None, None
                        if (values["content_type"] or "").startswith("application/http"):
                            part = m.until(block + min(length, 512))[block : block + length]
                            while (end := part.find(b"\r\n\r\n")) < 0 and len(part) < length and not m.ended:
                                part = m.until(block + 2 * len(part) + 512)[block : block + length]
                            lines = dict(x.lower().split(b":", 1) for x in part[: max(end, 0)].split(b"\r\n")[1:] if b":" in x)
                            http = int(lines[b"content-length"]) if lines.get(b"content-length", b"").strip().isdigit() else None
                            skip = end + 4 if end >= 0 else 0
                        else:
                            skip = 0
                        size = sha1 = None
                        if (self.payload or self.digest) and values["record_type"] != "revisit":
                            body = m.until(block + length)[block + skip : block + length]
                            size, sha1 = len(body), payload_digest(body) if self.digest else None
                            body = body if self.payload else None
                        rows.append((*values.values(), length, http, body, size, sha1, uri, at))
                        held += 300 + len(body or b"")
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                    at = m.after(block, length)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); option payload=false leaves payloads null and unread; with digest=true they are read for their
    length and SHA-1, which the header only claims."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, digest: bool = False) -> DataFrame:
    """The records of all .warc and .warc.gz files below path (or of the one file), a row each, with their header fields.

    Header fields that a record lacks are null. Filters on them (equality, lists, beginnings, not null) are tested on the header, and what they
    rule out isn't inflated. payload=False leaves payloads null and unread; digest=True reads them for their length and SHA-1 all the same.
    Revisits have no payload. A record that is read is held whole, however long. A folder that isn't there, or has no such files, is empty.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload)).option("digest", str(digest)).load(path)
