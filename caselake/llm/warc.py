"""WARC archives as a PySpark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition a file, or for each group of small files. Predicates on record_type, record_id,
target_uri, payload_digest and refers_to are pushed down (equality, IN, string prefix; with
spark.sql.python.filterPushdown.enabled, or as the option recordTypes). Of each record the headers are parsed
first; the payload is decoded only if the headers pass and the option payload is true. Gzip members that state their
length in an ``sl`` extra field are then left by a seek, others are inflated past.

Writing makes a gzip member a record, with ``sl`` fields. Tasks write under names of their own; the commit renames
those of the successful tasks, so lost or repeated tasks leave nothing in the archive.

``archive_pages`` stores each payload of MIN_REVISIT bytes or more once: the record with the smallest page_id is
response, those with equal payloads are revisit records that refer to it.

Defined cases: a null html is an empty payload; a null url leaves WARC-Target-URI out; rows with a null page_id
are response records; rows that repeat the smallest page_id are all response; of rows that repeat an id with other
html each is judged by its own payload; equal payloads below MIN_REVISIT bytes are all response; an empty table writes no record; columns other than page_id, url and html are ignored. A file
that ends within a record raises an error.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import qualified, shared_path

MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
ROLL_BYTES = 64 << 20
GROUP_BYTES = 16 << 20
BATCH_BYTES = 8 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it of a URI. A bare path would mean each machine's own disk, so it is refused: ``qualified``
    tells on the driver which file system it is in."""
    if not re.match("[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise ValueError(f"not a URI with a scheme: {path!r}")
    return pafs.FileSystem.from_uri(path)


# --- records ---------------------------------------------------------------------------------------------------


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def build_record(row: dict, date: str) -> bytes:
    """An HTTP response record, or a revisit record with the HTTP headers alone."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + payload if row["record_type"] == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    if row["payload_digest"] is not None:
        head.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member with its compressed and plain length in the extra field."""
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Source:
    """Bytes of a file from a position on; plain, or the content of one gzip member."""

    def __init__(self, f, gz: bool, start: int) -> None:
        self.f, self.at, self.buffer = f, start, b""
        self.inflate = zlib.decompressobj(31) if gz else None

    def more(self, size: int = 1 << 16) -> bool:
        if self.inflate is not None and self.inflate.eof:
            return False
        data = self.f.read(size)
        if not data:
            return False
        self.at += len(data)
        if self.inflate is not None:
            data = self.inflate.decompress(data)
            self.at -= len(self.inflate.unused_data)
        self.buffer += data
        return True

    def until(self, mark: bytes) -> bytes:
        while (k := self.buffer.find(mark)) < 0:
            if not self.more(1 << 12):
                raise ValueError("the archive ends within a record")
        out, self.buffer = self.buffer[: k + len(mark)], self.buffer[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
            parts.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends within a record")
            cut = min(n, len(self.buffer))
            self.buffer, n = self.buffer[cut:], n - cut


def parse_headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()}


def header_value(headers: dict[str, str], column: str) -> str | None:
    v = headers.get(HEADER_OF[column])
    if v is None:
        return None
    if column in ("record_id", "refers_to"):
        return v.strip("<>")
    return v.removeprefix("sha256:") if column == "payload_digest" else v


def read_records(f, size: int, tests: list, with_payload: bool) -> Iterator[dict]:
    """The records of a file whose header values pass all tests: (column, test of its value)."""
    at = 0
    while at < size:
        f.seek(at)
        start = f.read(36)
        if not start.strip(b"\r\n"):
            return
        if start[:1] in b"\r\n":
            at += 1
            continue
        gz, known = start[:2] == b"\x1f\x8b", 0
        if gz and start[3] & 4 and start[12:14] == b"sl":
            known = struct.unpack("<I", start[16:20])[0]
        f.seek(at)
        source = Source(f, gz, at)
        headers = parse_headers(source.until(b"\r\n\r\n"))
        length = int(headers.get("content-length", 0))
        values = {c: header_value(headers, c) for c in HEADER_OF}
        wanted = all(test(values[c]) for c, test in tests)
        if wanted:
            is_http = headers.get("content-type", "").startswith("application/http") and values["record_type"] in ("response", "revisit")
            http = source.until(b"\r\n\r\n") if is_http else b""
            stated = parse_headers(http).get("content-length") if http else None
            n = length - len(http)
            values["payload"] = source.take(n) if with_payload and values["record_type"] != "revisit" else None
            values["payload_bytes"] = int(stated) if stated is not None and values["record_type"] == "revisit" else n
            left = 0 if values["payload"] is not None else n
        else:
            left = length
        if known:
            at += known
        else:
            source.skip(left)
            if gz:
                while source.inflate is not None and not source.inflate.eof and source.more():
                    source.buffer = b""
                at = source.at
            else:
                source.skip(0)
                at = source.at - len(source.buffer)
        if wanted:
            yield values


# --- data source -----------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.pushed: list[tuple] = []
        if options.get("recordtypes"):
            self.pushed.append(("record_type", "in", tuple(options["recordtypes"].split(","))))

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  (name of the API)
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            if column in HEADER_OF and isinstance(f, EqualTo):
                self.pushed.append((column, "in", (f.value,)))
            elif column in HEADER_OF and isinstance(f, In):
                self.pushed.append((column, "in", tuple(f.value)))
            elif column in HEADER_OF and isinstance(f, StringStartsWith):
                self.pushed.append((column, "prefix", f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = open_fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")))
        groups, size = [], GROUP_BYTES
        for path, n in files:
            if size + n > GROUP_BYTES:
                groups.append([])
                size = 0
            groups[-1].append((path, n))
            size += n
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        tests = [(c, (lambda v, x=x: v in x) if kind == "in" else (lambda v, x=x: v is not None and v.startswith(x))) for c, kind, x in self.pushed]
        schema = pa.schema([(c, pa.string()) for c in HEADER_OF] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for path, size in partition.paths if partition else []:
            with fs.open_input_file(path) as f:
                for r in read_records(f, size, tests, self.with_payload):
                    rows.append(r)
                    held += len(r["payload"] or b"") + 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{names[-1]}.inprogress", compression=None), 0
                data = gzip_member(build_record(row, self.date))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for name in m.names if m else []:
                fs.move(f"{root}/{name}.inprogress", f"{root}/{name}")

    def abort(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for name in m.names if m else []:
                fs.delete_file(f"{root}/{name}.inprogress")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and turns on the filter pushdown that its reader needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


PAGE_URN = "urn:page:"


def archive_pages(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of pages (page_id, url, html) below path."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest, n = F.sha2(body.cast("binary"), 256), F.octet_length(body).cast("long")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(digest).alias("key"), n.alias("n")).where(F.col("n") >= MIN_REVISIT)
    first = keyed.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    # Only ids go through the join by payload; Spark splits its skewed keys. Pages meet it by id and digest, as an id
    # can repeat with other html.
    again = keyed.join(first, "key").where("page_id > refers_to").select("page_id", "key", "refers_to").distinct()
    all_pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"), F.unhex(digest).alias("key"))
    told = all_pages.join(again, ["page_id", "key"], "left")
    urn = lambda c: F.concat(F.lit(PAGE_URN), F.coalesce(F.col(c).cast("string"), F.lit("")))
    records = told.select(
        urn("page_id").alias("record_id"),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lower(F.hex("key")).alias("payload_digest"),
        F.when(F.col("refers_to").isNotNull(), urn("refers_to")).alias("refers_to"),
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.when(F.col("refers_to").isNull(), F.col("body").cast("binary")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(qualified(pages.sparkSession, path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; digests of responses are taken from the payloads read."""
    path = qualified(spark, path)
    full = spark.read.format("warc").load(path).where("record_type = 'response'")
    headers = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    number = lambda c: F.nullif(F.substring(c, len(PAGE_URN) + 1, 20), F.lit("")).cast("long").alias(c.replace("record", "page"))
    made = full.select(number("record_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", number("refers_to"))
    return made.unionByName(headers.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to")))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    register(spark)
    path = shared_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_pages(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM k)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""
