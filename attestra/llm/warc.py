"""WARC archives: a writer and a PySpark Python data source.

Reading: option `files` names a JSON file of [uri, bytes] pairs; only planning reads it, and plans partitions of about
`partition_bytes`, so a task knows its own files alone. Predicates on record_type, target_uri and record_id are pushed down and decided on the WARC header
alone, which is parsed first. The payload of a record is only inflated when the read schema asks for it or `verify`
is set; members that carry their compressed size in the gzip extra field `sl` are skipped by a seek.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from .shared import fresh_path, small_batches

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, content_length long, payload_bytes long, payload_digest string, payload binary"
_DECIDED = ("record_id", "record_type", "target_uri")
_END = b"\r\n\r\n"


def _local(uri: str) -> str | None:
    return uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:") if uri.startswith("file:") else uri if "://" not in uri else None


def open_input(uri: str):
    """A seekable binary stream, of a local (shared) path or of any file system that pyarrow knows."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


class _Output:
    """Writes under a name of this attempt, then renames: readers never see half a file, and retries replace each other."""

    def __init__(self, uri: str):
        self.uri, self.size = uri, 0
        task = TaskContext.get()
        self.part = f"{uri}.{task.taskAttemptId() if task else 0}.part"
        if (path := _local(self.part)) is not None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.store, self.file = None, open(path, "wb")
        else:
            from pyarrow import fs

            self.store, path = fs.FileSystem.from_uri(self.part)
            self.store.create_dir(os.path.dirname(path), recursive=True)
            self.file = self.store.open_output_stream(path)
        self.path = path

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.file.close()
        to = self.path.rsplit(".", 2)[0]
        if self.store is None:
            os.replace(self.path, to)
        else:
            self.store.move(self.path, to)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member with the skip lengths `sl` (compressed, uncompressed) in its extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(body), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + _END


def _one_line(x: str | None) -> str:
    return "".join(c for c in x or "" if c not in "\r\n")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", gzip: bool = True) -> list[list]:
    """Writes one record per row of pages under path; returns [uri, bytes] of each archive (one entry a file, none a row).

    Of rows whose payloads are equal and have min_bytes or more, those of the smallest id are `response` records, all others
    `revisit` records that name it and hold no payload. Null bodies are empty payloads; null urls empty addresses. Rows that
    repeat an id with the same payload get the same type; rows with a null id are always responses and never referred to.
    Very long bodies are written whole: a task holds a few copies of its longest one. Other columns are ignored, whatever their names. Empty
    tables give no archive.

    Equal payloads are found by SHA-1 and length: hashes alone are shuffled, with partial minima, so a payload that a third of
    all rows share costs no task more than others. Rows then meet their reference by (id, hash).
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    rows = rows.withColumn("h", F.unhex(F.sha1("body"))).withColumn("n", F.octet_length("body"))
    known = rows.select("id", "h", "n").where(F.col("id").isNotNull() & (F.col("n") >= min_bytes))
    first = known.groupBy("h", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    again = known.join(first, ["h", "n"]).where("id <> first").distinct()
    todo = rows.join(again.hint("shuffle_hash"), ["id", "h", "n"], "left").select("id", "url", "body", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, serial, out, made = task.partitionId() if task else 0, 0, None, []
        pack = member if gzip else bytes
        for batch in batches:
            for pid, url, body, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = _Output(f"{path}/part-{part:05d}-{serial:05d}.warc" + ".gz" * gzip)
                    info = b"software: attestra\r\nformat: WARC File Format 1.1\r\n"
                    out.write(pack(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:attestra:info:{part}-{serial}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info)))
                payload = body.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                headers = [("WARC-Type", "response" if ref is None else "revisit"), ("WARC-Record-ID", f"<urn:attestra:page:{pid}>"), ("WARC-Date", date), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload))]
                if ref is not None:
                    headers += [("WARC-Refers-To", f"<urn:attestra:page:{ref}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                out.write(pack(record([*headers, ("Content-Type", "application/http;msgtype=response")], http + (payload if ref is None else b""))))
                if out.size >= archive_bytes:
                    out.close()
                    made.append((out.uri, out.size))
                    out, serial = None, serial + 1
        if out is not None:
            out.close()
            made.append((out.uri, out.size))
        yield pa.RecordBatch.from_pydict({"uri": [m[0] for m in made], "bytes": [m[1] for m in made]}, schema=pa.schema([("uri", pa.string()), ("bytes", pa.int64())]))

    return sorted([r.uri, r.bytes] for r in todo.mapInArrow(run, "uri string, bytes long").collect())


class _Plain:
    """The bytes of an uncompressed archive from here on."""

    def __init__(self, file):
        self.file, self.buffer = file, b""

    def more(self) -> bool:
        data = self.file.read(1 << 16)
        self.buffer += data
        return bool(data)

    def skip(self, n: int) -> None:
        if n > len(self.buffer):
            self.file.seek(n - len(self.buffer), 1)
            self.buffer = b""
        else:
            self.buffer = self.buffer[n:]


class _Member:
    """The bytes of one gzip member, inflated as far as they are asked for."""

    def __init__(self, file, head: bytes):
        if head[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip member")
        flags, self.length = head[3], None
        if flags & 4:
            extra = file.read(struct.unpack("<H", file.read(2))[0])
            while len(extra) >= 4:
                size = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and size == 8:
                    self.length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size :]
        for bit in (8, 16):
            while flags & bit and file.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            file.read(2)
        self.file, self.start, self.buffer = file, file.tell(), b""
        self.inflate, self.pending = zlib.decompressobj(-15), b""

    def more(self) -> bool:
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.file.read(1 << 15)
            if not data:
                raise EOFError("the archive ends inside a record")
            if got := self.inflate.decompress(data, 1 << 16):
                self.buffer += got
                return True
        return False

    def skip(self, n: int) -> None:
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if not self.more():
                return
        self.buffer = self.buffer[n:]

    def leave(self) -> None:
        """Goes to the next member, by its length if it is known."""
        if self.length is not None:
            self.file.seek(self.start + self.length + 8)
            return
        self.buffer = b""
        while self.more():
            self.buffer = b""
        self.file.seek(self.file.tell() - len(self.inflate.unused_data) + 8)


def _until(stream, mark: bytes) -> bytes | None:
    """What comes up to and with mark; None at the end of the stream."""
    while (at := stream.buffer.find(mark)) < 0:
        if not stream.more():
            return None
    head = stream.buffer[: at + len(mark)]
    stream.buffer = stream.buffer[at + len(mark) :]
    return head


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def records(file, wanted, payloads: bool, verify: bool) -> Iterator[dict]:
    """Records whose header `wanted` accepts; others are passed without being inflated."""
    magic = file.read(2)
    file.seek(0)
    while True:
        if magic == b"\x1f\x8b":
            head = file.read(10)
            if not head:
                return
            stream = _Member(file, head)
        else:
            stream = _Plain(file)
        while (head := _until(stream, _END)) is not None:
            fields = _fields(head.lstrip(b"\r\n"))
            length = int(fields.get("content-length", 0))
            row = {
                "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "warc_date": fields.get("warc-date"),
                "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "content_length": length, "payload_bytes": None, "payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None, "payload": None,
            }
            if not wanted(row):
                if isinstance(stream, _Member) and stream.length is not None:
                    break
                stream.skip(length + 4)
                continue
            http, left = b"", length
            if row["record_type"] in ("response", "revisit") and fields.get("content-type", "").startswith("application/http"):
                while _END not in stream.buffer[:left] and len(stream.buffer) < left and stream.more():
                    pass
                cut = stream.buffer[:left].find(_END)
                if cut >= 0:
                    http, left = stream.buffer[: cut + 4], left - cut - 4
                    stream.buffer = stream.buffer[cut + 4 :]
            row["payload_bytes"] = left if row["record_type"] != "revisit" else int(_fields(http).get("content-length", left))
            if (payloads or verify) and row["record_type"] != "revisit":
                parts, need = [], left
                while need > len(stream.buffer):
                    need -= len(stream.buffer)
                    parts.append(stream.buffer)
                    stream.buffer = b""
                    if not stream.more():
                        raise EOFError("the archive ends inside a payload")
                body = b"".join([*parts, stream.buffer[:need]])
                stream.buffer, left = stream.buffer[need:], 0
                if verify and row["payload_digest"] not in (None, sha1_base32(body)):
                    raise ValueError(f"{row['record_id']}: the payload is not what its digest says")
                row["payload"] = body if payloads else None
            yield row
            if isinstance(stream, _Member) and stream.length is not None:
                break
            stream.skip(left + 4)
        if isinstance(stream, _Plain):
            return
        stream.leave()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.files = options.get("files")
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.verify = options.get("verify", "false").lower() == "true"
        self.schema = schema
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _DECIDED or not isinstance(f, EqualTo | In | IsNotNull | StringStartsWith):
                yield f
            elif isinstance(f, IsNotNull):
                self.filters.append((column, "^", ""))
            elif isinstance(f, In):
                self.filters.append((column, "in", frozenset(f.value)))
            else:
                self.filters.append((column, "=" if isinstance(f, EqualTo) else "^", f.value))

    def partitions(self) -> list[InputPartition]:
        groups: list[list[str]] = []
        size = self.most
        with open_input(self.files) as file:
            files = json.loads(file.read())
        for uri, n in files:
            if size + n > self.most:
                groups.append([])
                size = 0
            groups[-1].append(uri)
            size += n
        return [InputPartition(g) for g in groups]

    def wanted(self, row: dict) -> bool:
        for column, how, value in self.filters:
            x = row[column]
            if x is None or not (x == value if how == "=" else x in value if how == "in" else x.startswith(value)):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, names = to_arrow_schema(self.schema), self.schema.names
        rows, held = [], 0
        for uri in partition.value if partition is not None else ():
            with open_input(uri) as file:
                for row in records(file, self.wanted, "payload" in names, self.verify):
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=schema)


class WarcSource(DataSource):
    """spark.read.format("warc"). A schema given by the user is the list of columns wanted of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)


def read_archives(spark: SparkSession, files: list[list], columns: str = SCHEMA, verify: bool = False, partition_bytes: int = 64 << 20) -> DataFrame:
    """The records of archives given as [uri, bytes]; columns is a DDL list out of SCHEMA.

    Use the result with one filter only, and call again for another: Spark keeps what a filter pushed into a Python source for all uses of the
    same DataFrame, so that a second use would lose rows."""
    listed = _Output(f"{fresh_path(spark, 'warc-files')}/files.json")
    listed.write(json.dumps(files).encode())
    listed.close()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).option("files", listed.uri).option("verify", str(verify).lower()).option("partition_bytes", str(partition_bytes)).load()


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages into archives in the shared folder and reads their records back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    files = write_archives(pages, fresh_path(spark, "warc"), min_bytes=min_bytes)
    got = read_archives(spark, files, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string", verify=True, partition_bytes=4 << 20)
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS {dict(pages.dtypes)['page_id']})")
    return got.where(F.col("record_type").isin("response", "revisit")).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
