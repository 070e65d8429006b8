"""WARC as a PySpark data source, reader and writer.

Writing: one gzip member a record, each with the format's skip-lengths field, one file a
task under a name of its own; the commit writes a manifest, so files of failed or repeated
attempts are never read. Reading: whole files are planned into partitions by size, headers
are inflated first, and a record that the pushed filters or the schema do not want is
skipped by its length without inflating its payload.

Record types ``response`` (HTTP head and payload) and ``revisit`` (HTTP head only, refers to
the response with the same payload digest) are written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from spanwright.llm.common import without

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Bytes of archives that one read task takes, and records in a batch.
SPLIT_BYTES = 64 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header names behind the columns that filters can be pushed to.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def digest32(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = 10 + 2 + 12
    extra = b"sl" + struct.pack("<HII", 8, head + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """Length of the member by its ``sl`` field; None where it has none."""
    if len(head) < 12 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    while len(extra) >= 4:
        size = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"sl" and size == 8:
            return struct.unpack_from("<I", extra, 4)[0]
        extra = extra[4 + size :]
    return None


def _line(value: object) -> str:
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in str(value) for c in "\r\n") else str(value)


def warc_record(record_type: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """The record as bytes; a revisit keeps the HTTP head and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    head = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    head += [("WARC-Payload-Digest", "sha1:" + digest32(payload)), ("Content-Type", "application/http; msgtype=response")]
    if record_type == "revisit":
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    head.append(("Content-Length", len(block)))
    lines = "".join(f"{k}: {_line(v)}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.date, self.level = options["path"], options.get("date", "1970-01-01T00:00:00Z"), int(options.get("level", "6"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            for kind, key, uri, refers, payload in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload"))):
                out.write(gzip_member(warc_record(kind.as_py(), key.as_py(), uri.as_py(), refers.as_py(), payload.as_py() or b"", self.date), self.level))
        if out is not None:
            out.close()
        return Written(out and name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        old = _manifest(fs, root) or []
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(old + [m.file for m in messages if m and m.file]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{root}/{m.file}")


def _manifest(fs: pafs.FileSystem, root: str) -> list[str] | None:
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.verify, self.columns = options["path"], options.get("verify", "false") == "true", [f.name for f in schema.fields]
        self.want: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterator:
        """Equality and IN on record type and headers are decided before any payload is inflated."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.want[column] = self.want.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        names = _manifest(fs, root)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if names is None else fs.get_file_info([f"{root}/{n}" for n in names])
        parts, size = [Files([])], 0
        for info in sorted((i for i in found if i.type == pafs.FileType.File and i.base_name.endswith(".warc.gz")), key=lambda i: i.path):
            if size and size + info.size > SPLIT_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append(info.path)
            size += info.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([(c, {"payload_bytes": pa.int64(), "payload": pa.binary()}.get(c, pa.string())) for c in self.columns])
        rows, held = [], 0
        for name in partition.names:
            with fs.open_input_file(name) as f:
                for row in self._records(f):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) == BATCH_ROWS or held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _records(self, f) -> Iterator[dict]:
        at, size = 0, f.size()
        while at < size:
            f.seek(at)
            packed = f.read(4096)
            length = member_length(packed)
            unpack = zlib.decompressobj(31)
            data = unpack.decompress(packed, 8192)
            while b"\r\n\r\n" not in data and not unpack.eof:
                packed = unpack.unconsumed_tail or f.read(1 << 16)
                if not packed:
                    raise ValueError("a WARC record ends inside its header")
                data += unpack.decompress(packed, 8192)
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data.partition(b"\r\n\r\n")[0].decode("utf-8").split("\r\n")[1:])}
            row = {c: head.get(h) for c, h in HEADERS.items()}
            row |= {c: row[c][1:-1] for c in ("record_id", "refers_to") if row[c]}
            row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
            wanted = all(row[c] in values for c, values in self.want.items())
            if wanted and length is not None and not {"payload", "payload_bytes"} & set(self.columns):
                yield {c: row[c] for c in self.columns}
            elif length is None or wanted:  # the payload is needed, or only inflating tells where the next record begins
                parts = [data]
                while not unpack.eof:
                    packed = unpack.unconsumed_tail or f.read(1 << 16)
                    if not packed:
                        raise ValueError("a WARC record ends early")
                    if length is not None and "payload" not in self.columns and "payload_bytes" in self.columns and b"\r\n\r\n" in b"".join(parts).partition(b"\r\n\r\n")[2]:
                        break
                    parts.append(unpack.decompress(packed))
                if length is None:
                    length = f.tell() - len(unpack.unused_data) - at
                if wanted:
                    yield {c: v for c, v in self._with_payload(row, head, b"".join(parts)).items() if c in self.columns}
            at += length

    def _with_payload(self, row: dict, head: dict, data: bytes) -> dict:
        http, _, payload = data.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")
        stated = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        row["payload_bytes"] = int(stated[0]) if stated else max(0, len(payload) - 4)
        row["payload"] = None if row["record_type"] == "revisit" else payload[: row["payload_bytes"]]
        if self.verify and row["payload"] is not None and "payload" in self.columns and digest32(row["payload"]) != row["payload_digest"]:
            raise ValueError(f"payload digest of {row['record_id']} does not match")
        return row


class WarcDataSource(DataSource):
    """``format("warc")``; options: path, verify (re-hash payloads), date and level (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema)


def read_warc(spark: SparkSession, path: str, *, schema: str = SCHEMA, verify: bool = False) -> DataFrame:
    """The records under ``path``; leave ``payload`` out of ``schema`` to skip payloads."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").schema(schema).option("verify", str(verify).lower()).load(path)


def with_revisits(pages: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """``pages`` plus ``record_type`` and ``refers_to``.

    Of rows with equal payloads (null text: empty) of ``min_bytes`` or more, those of the
    smallest id are responses, all others revisits that refer to it. Rows without an id are
    revisits where their payload has an id, else responses. Only ids and digests are
    shuffled to decide; columns named as the new ones are replaced; no row is lost.
    """
    pages = without(pages, ["record_type", "refers_to"])
    payload = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    keys = pages.filter(F.octet_length(payload) >= min_bytes).select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"))
    firsts = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    again = keys.join(firsts.select("digest", "first"), "digest").filter(~F.col("id").eqNullSafe(F.col("first"))).distinct().alias("again")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(id_col).alias("id"), F.sha1(payload).alias("digest")).alias("p")
    joined = rows.join(again, F.col("p.id").eqNullSafe(F.col("again.id")) & (F.col("p.digest") == F.col("again.digest")), "left")
    return joined.select("p.row.*", F.when(F.col("again.first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("again.first").alias("refers_to"))


def write_pages(pages: DataFrame, path: str, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", id_prefix: str = "urn:page:") -> None:
    """Archives a record per row of ``pages`` under ``path``; record ids are ``id_prefix`` and the row's id.

    A row without an id gets the digest of its payload in the id's place.
    """
    pages.sparkSession.dataSource.register(WarcDataSource)
    payload = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("none:"), F.sha1(payload)))
    records = with_revisits(pages, min_bytes=min_bytes, id_col=id_col, text_col=text_col).select(
        "record_type",
        F.concat(F.lit(id_prefix), key).alias("record_id"),
        F.col(url_col).alias("target_uri"),
        F.concat(F.lit(id_prefix), F.col("refers_to").cast("string")).alias("refers_to"),
        payload.alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)
