"""WARC archives as a PySpark Python data source (format ``warc``).

Writing: each task writes gzip members, one for each record, to files of at
most about ``ROLL`` bytes with names of their own. The driver's commit writes a
manifest of the files whose tasks succeeded, with places every ``SPLIT`` bytes
at which a record begins. Readers see only what a manifest lists, so retried
and lost tasks leave no duplicates. Every commit has a manifest of its own:
appending adds to what is there, overwriting deletes what older manifests list,
and no other file is ever touched.

Reading: listed files are planned into partitions of about ``SPLIT`` bytes,
large ones cut at the listed places. Predicates on the record type and the
other header columns are pushed down (where the session allows it, see
``read``). A record's headers are inflated first; if a predicate fails, or
payloads aren't asked for, the rest of the member is skipped by the length that
the writer keeps in the gzip header. Members of other writers, without that
length, are inflated to find their end. Header names are matched in any case.
Folders without a manifest are read by their ``.warc.gz`` files.

Revisits follow the profile of identical payload digests and name the record
they refer to; the integer ids of pages are kept in headers of our own.

Edge cases. Null payloads are empty. A null id has no id header and reads as
null. Control characters in header values are percent-encoded. Rows that repeat
an id and payload are records of their own, each a response if its id is the
smallest with that payload. Further columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .store import Workspace

ROLL, SPLIT, LEVEL = 512 << 20, 32 << 20, 3
#: Bytes of a record that are read to find its headers, and read ahead of them from the store.
HEAD, AHEAD = 2048, 1 << 18
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "page_id long, record_id string, record_type string, target_uri string, date string, payload_length long, payload_digest string, refers_to long, refers_to_id string, profile string, payload binary"
#: Columns and the headers that hold them.
HEADERS = {
    "page_id": "X-Page-Id",
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_length": "X-Payload-Length",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "X-Refers-To-Page-Id",
    "refers_to_id": "WARC-Refers-To",
    "profile": "WARC-Profile",
}
#: The profile of revisits, a fixed value of the format's standard.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LONGS = ("page_id", "payload_length", "refers_to")
_ARROW = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c in LONGS else pa.string()) for c in [*HEADERS, "payload"]])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; Hadoop's names of object stores are those that Arrow knows."""
    scheme, colon, rest = path.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest if colon else path)


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def member(headers: dict[str, str], payload: bytes) -> bytes:
    """One record as a gzip member whose header holds the member's length (extra field ``sl``)."""
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers.items())
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = 12 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"sl", 4, size) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Headers and the payload's place, or None if the header block isn't complete yet."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def records(f, size: int, wanted, payloads: bool, at: int = 0) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The records of an open file, from byte ``at`` to ``size``, that ``wanted(headers)`` accepts, without payloads unless asked for; header names are in lower case."""
    while at < size:
        f.seek(at)
        chunk = f.read(HEAD)
        length = struct.unpack_from("<I", chunk, 16)[0] if chunk[3:4] == b"\x04" and chunk[12:14] == b"sl" else None
        z, raw, used, head = zlib.decompressobj(31), b"", 0, None
        data = chunk
        while head is None and not z.eof:
            raw += z.decompress(data, 4096)
            head = parse(raw)
            data = z.unconsumed_tail
            if head is None and not data and not z.eof:
                data = f.read(65536)
                used += len(data)
                if not data:
                    raise ValueError(f"truncated record at byte {at}")
        headers, start = head if head else ({}, 0)
        take = wanted(headers)
        if length is not None and not (take and payloads):
            at += length
        else:
            out = io.BytesIO()
            out.write(raw)
            while not z.eof:
                if not data:
                    data = f.read(1 << 20)
                    used += len(data)
                    if not data:
                        raise ValueError(f"truncated record at byte {at}")
                piece = z.decompress(data, 1 << 20)
                if take and payloads:
                    out.write(piece)
                data = z.unconsumed_tail
            at += len(chunk) + used - len(z.unused_data)
            raw = out.getvalue()
        if take:
            yield headers, raw[start : start + int(headers.get("content-length", 0))] if payloads else None


@dataclass
class Split(InputPartition):
    parts: tuple[tuple[str, int, int], ...]  # file, first and end byte


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, int, tuple[int, ...]], ...]  # name, size, places at which a record begins


def manifests(system: fs.FileSystem, root: str) -> list[str]:
    if system.get_file_info(root).type != fs.FileType.Directory:
        return []
    return sorted(x.path for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("_manifest-") and x.base_name.endswith(".json"))


def listed(system: fs.FileSystem, root: str, paths: list[str]) -> list[tuple[str, int, list[int]]]:
    """Path, size and cuts of the files that the manifests list."""
    out = []
    for path in paths:
        with system.open_input_stream(path) as f:
            out += [(f"{root}/{name}", size, cuts) for name, size, cuts in json.loads(f.read())["files"]]
    return out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool, columns: list[str]):
        self.path, self.payloads, self.columns, self.filters = path, payloads, columns, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                self.filters.append((type(f).__name__, name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Split]:
        system, root = _open(self.path)
        if known := manifests(system, root):
            files = listed(system, root, known)
        else:
            info = system.get_file_info(root)
            found = system.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
            files = sorted((x.path, x.size, []) for x in found if x.type == fs.FileType.File and x.path.endswith(".warc.gz"))
        out, held, total = [], [], 0
        for name, size, cuts in files:
            for a, b in zip([0, *cuts], [*cuts, size], strict=True):
                if held and total + b - a > SPLIT:
                    out.append(Split(tuple(held)))
                    held, total = [], 0
                held.append((name, a, b))
                total += b - a
        return [*out, Split(tuple(held))] if held or not out else out

    def wanted(self, headers: dict[str, str]) -> bool:
        for kind, name, value in self.filters:
            got = _value(name, headers)
            if got is None or (kind == "EqualTo" and got != value) or (kind == "In" and got not in value) or (kind == "StringStartsWith" and not got.startswith(value)):
                return False
        return True

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        rows, size = [], 0
        for name, first, end in split.parts:
            with system.open_input_file(name) as raw:
                for headers, payload in records(io.BufferedReader(raw, AHEAD), end, self.wanted, self.payloads, first):
                    rows.append([payload if c == "payload" else _value(c, headers) for c in self.columns])
                    size += len(payload or b"") + 300
                    if size > 4 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        schema = pa.schema([_ARROW.field(c) for c in self.columns])
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x.type) for k, x in enumerate(schema)], schema=schema)


def _value(column: str, headers: dict[str, str]):
    v = headers.get(HEADERS[column].lower())
    if v is not None and column == "payload_digest":
        return v.removeprefix("sha256:")
    return int(v) if v is not None and column in LONGS else v


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        task, files, out, size, cuts = uuid.uuid4().hex, [], None, 0, []
        for b in iterator:
            cols = [b.column(c) for c in HEADERS]
            payloads = b.column("payload")
            for r in range(b.num_rows):
                headers = {h: str(v) for h, v in zip(HEADERS.values(), (c[r].as_py() for c in cols), strict=True) if v is not None}
                headers["WARC-Payload-Digest"] = f"sha256:{headers.get('WARC-Payload-Digest', '')}"
                if out is None:
                    name = f"{task}-{len(files):05d}.warc.gz"
                    out, size, cuts = system.open_output_stream(f"{root}/{name}", compression=None), 0, []
                if size - (cuts[-1] if cuts else 0) >= SPLIT:
                    cuts.append(size)
                m = member(headers, payloads[r].as_py() or b"")
                out.write(m)
                size += len(m)
                if size >= ROLL:
                    out.close()
                    files.append((name, size, tuple(cuts)))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size, tuple(cuts)))
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        before = manifests(system, root) if self.overwrite else []
        old = listed(system, root, before)
        files = sorted(f for m in messages if m for f in m.files)
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps({"files": files}).encode())
        for path in [*before, *(x[0] for x in old)]:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for name, _, _ in (f for m in messages if m for f in m.files):
            system.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Options: path; payload (``false`` leaves payloads null and unread)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false", schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def to_records(pages: DataFrame, ws: Workspace, least: int = 100) -> DataFrame:
    """Records of ``pages`` (page_id, url, html): of equal payloads of at least ``least`` bytes the smallest id is the response, others revisit it."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    d = ws.table(p.where(F.col("length") >= least).select("page_id", "digest"), "digests")
    first = d.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    again = ws.table(d.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct(), "revisits")
    r = again.select(F.col("page_id").alias("of"), F.col("digest").alias("same"), "first")
    p = p.join(r, (F.col("digest") == F.col("same")) & F.col("page_id").eqNullSafe(F.col("of")), "left")
    revisit = F.col("same").isNotNull()
    name = lambda page_id: F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws(" ", page_id.cast("string"), "digest"), 256), F.lit(">"))
    return p.select(
        "page_id", name(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(DATE).alias("date"),
        F.col("length").alias("payload_length"), F.col("digest").alias("payload_digest"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, name(F.col("first"))).alias("refers_to_id"),
        F.when(revisit, REVISIT).alias("profile"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(recs: DataFrame, path: str, mode: str = "append") -> None:
    """Write records to the archives at ``path``: ``append`` adds to them, ``overwrite`` replaces them."""
    register(recs.sparkSession)
    recs.write.format("warc").option("path", path).mode(mode).save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def round_trip(pages: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives.

    Responses are read with their payloads, of which length and digest are taken. Revisits have none: they are read by
    headers, all other members skipped. Both record types are pushed down to the reader.
    """
    ws = ws or Workspace(pages.sparkSession, "warc")
    path = ws.path("archives")
    write(to_records(pages, ws), path)
    full = read(pages.sparkSession, path).where("record_type = 'response'")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    again = read(pages.sparkSession, path, payload=False).where("record_type = 'revisit'")
    return full.unionByName(again.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
