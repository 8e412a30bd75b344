"""WARC: a writer with one gzip member per record, and a reader that salvages what damage leaves.

The reader checks each member (gzip CRC) and each record (version line, header lines, Content-Length, block and payload
digests). Where a check fails it looks for the next place where a member, or in plain archives a version line, begins
and holds, goes on from there, and logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.common import apart, column, in_arrow, integral, shared_dir

VERSION = b"WARC/1.1\r\n"
MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
VERSION_LINE = re.compile(rb"WARC/[0-9]\.[0-9]\r?\n")
#: No header goes on beyond the next line of this kind.
NEXT_RECORD = re.compile(rb"\nWARC/[0-9]\.[0-9]\r?\n")
CONTROL = re.compile("[\x00-\x1f\x7f]")
#: Bytes after which a writer begins another file.
FILE_BYTES = 16 << 20
#: Packed bytes that are unpacked at a time; no more than these are looked at beyond a member's end.
PIECE = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_column(payload: F.Column) -> F.Column:
    """The same of a binary column, without Python: each five hex digits of the SHA-1 are four base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Control characters of a value, which could end its line, are percent-encoded."""
    head = b"".join(f"{k}: {CONTROL.sub(lambda c: f'%{ord(c[0]):02X}', v)}\r\n".encode() for k, v in headers)
    return VERSION + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member, the same for the same data."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def response(key: str, uri: str, date: str, payload: bytes, digest: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id(f"page:{key}")), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", key)], block)


def revisit(key: str, uri: str, date: str, size: int, digest: str, refers_to: str) -> bytes:
    """size, the payload's length, is in an extension field: a revisit has no payload of its own."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    return record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(f"page:{key}")), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"page:{refers_to}")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", key), ("X-Refers-To-Page-Id", refers_to), ("X-Payload-Length", str(size))], block)


@dataclass
class Record:
    offset: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


class Broken(ValueError):
    pass


def parse(data: bytes | memoryview, at: int) -> tuple[Record, int]:
    """The record at a place, checked, and where it ends."""
    raw = bytes(data[at : at + 16])
    line = VERSION_LINE.match(raw)
    if not line:
        raise Broken("no version line")
    whole = data if isinstance(data, bytes) else bytes(data)
    after = NEXT_RECORD.search(whole, at + line.end() - 1)
    end = whole.find(b"\r\n\r\n", at, after.start() if after else len(whole))
    if end < 0:
        raise Broken("header not ended")
    headers: dict[str, str] = {}
    for text in whole[at + line.end() : end].split(b"\r\n"):
        name, colon, value = text.partition(b":")
        if not colon or not name.strip() or b"\n" in text:
            raise Broken("header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdecimal():
        raise Broken("Content-Length")
    start, stop = end + 4, end + 4 + int(length)
    if whole[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("record not ended")
    found = Record(at, headers, whole[start:stop])
    for name, body in (("warc-block-digest", found.block), ("warc-payload-digest", None if headers.get("warc-type") == "revisit" else found.payload)):
        kind, _, want = headers.get(name, "").partition(":")
        if kind.lower() == "sha1" and body is not None and payload_digest(body) != want.upper():
            raise Broken(name)
    return found, stop + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at a place holds, where it ends, and why it is broken: empty if it ends and its CRC holds.
    Of a broken one, what was unpacked before the error, and -1."""
    unpack, out = zlib.decompressobj(31), []
    view = memoryview(data)
    while not unpack.eof:
        if at >= len(data):
            out.append(unpack.flush())
            return b"".join(out), -1, "member not ended"
        before = unpack.copy()
        try:
            out.append(unpack.decompress(view[at : at + PIECE]))
        except zlib.error as e:
            out.append(_until_error(before, view[at : at + PIECE]))
            return b"".join(out), -1, str(e)
        at += PIECE
    return b"".join(out), min(at, len(data)) - len(unpack.unused_data), ""


def _until_error(unpack, piece: memoryview) -> bytes:
    """What a piece with an error in it unpacks to before the error: halves of it are tried, then what is left byte by byte."""
    out = []
    while len(piece):
        step = max(1, len(piece) // 2)
        before = unpack.copy()
        try:
            out.append(unpack.decompress(piece[:step]))
            piece = piece[step:]
        except zlib.error:
            if step == 1:
                break
            unpack, piece = before, piece[:step]
    return b"".join(out)


def _inner(content: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """Records of unpacked or plain content, and gaps; after a failed record the next version line that holds is sought."""
    at, gap, reason = 0, -1, ""
    while at < len(content):
        try:
            found, after = parse(content, at)
        except Broken as e:
            if gap < 0:
                gap, reason = at, str(e)
            line = VERSION_LINE.search(content, at + 1)
            at = line.start() if line else len(content)
            continue
        if gap >= 0:
            yield gap, at - gap, reason
            gap = -1
        yield found
        at = after
    if gap >= 0:
        yield gap, len(content) - gap, reason


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """Records of an archive, and (offset, length, reason) of each quarantined gap.

    A gzip member may hold several records: those that hold are kept, wherever they are in it, and those that a broken
    member unpacked to before its error too. Their offset is the member's. A gap inside a member that is whole has the
    member's offset, its length in the unpacked content, and a reason that says from where; a broken member, or one without a
    record that holds, is a gap of the archive's bytes up to the next place that holds. Empty data has no records and no gaps.
    Cost: each failed member is unpacked at most up to its first error.
    """
    at, gap, reason, following = 0, -1, "", [0, 0]
    kept: list[Record] = []  # of broken members since the gap began; packed data may hold them as they are, to be found again
    while at < len(data):
        if gap < 0:
            kept = []
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                content, after, why = inflate(data, at)
                own = list(_inner(content))
                records = [x for x in own if isinstance(x, Record)]
                for found in records:
                    found.offset = at
                if not why and (records or not content):
                    if gap >= 0:
                        yield gap, at - gap, reason
                        gap = -1
                    for x in own:
                        yield x if isinstance(x, Record) else (at, x[1], f"{x[2]}, at {x[0]} of the member's content")
                    at = after
                    continue
                if records and gap >= 0:
                    yield gap, at - gap, reason
                    gap = -1
                yield from records
                kept += records
                raise Broken(f"{why}, {len(records)} of its records kept" if records else why or own[0][2])
            found, after = parse(data, at)
            if any(found.headers == x.headers and found.block == x.block for x in kept):
                raise Broken("found before")
            if gap >= 0:
                yield gap, at - gap, reason
                gap = -1
            yield found
            at = after
        except Broken as e:
            if gap < 0:
                gap, reason = at, str(e)
            for kind, pattern in enumerate((MEMBER, VERSION_LINE)):
                if following[kind] <= at:  # else what was found before still lies ahead
                    found = pattern.search(data, at + 1)
                    following[kind] = found.start() if found else len(data)
            at = min(following)
    if gap >= 0:
        yield gap, len(data) - gap, reason


def write_archives(rows: DataFrame, path: str) -> None:
    """rows (key, member): each partition's members in order of key, in files of about FILE_BYTES.

    A file has a fixed name and is moved into place when it is whole, so that a task that runs again, or twice, writes
    the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        target, folder = fs.FileSystem.from_uri(path)
        target.create_dir(folder, recursive=True)
        out, size, name = None, 0, ""

        def close() -> None:
            out.close()
            target.move(f"{folder}/_{name}.{task.taskAttemptId()}", f"{folder}/{name}")

        for batch in batches:
            for data in column(batch, "member"):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{n:04d}.warc.gz"
                    out, size, n = target.open_output_stream(f"{folder}/_{name}.{task.taskAttemptId()}", compression=None), 0, n + 1
                out.write(data.as_buffer())
                size += len(data.as_buffer())
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    at = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)  # rows may lie in no partition at all
    in_arrow(rows.select("key", "member").sortWithinPartitions("key", F.xxhash64("member")), run, "n long").agg(F.sum("n")).collect()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record and gap below path: file, offset, kind (record or gap), length, reason, headers, payload.

    Files come through Spark's reader, whole; so a file should fit in a task's memory. No files give no rows.
    """
    schema = "file string, offset long, kind string, length long, reason string, headers map<string,string>, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = column(batch, "path")[i].as_py(), column(batch, "content")[i].as_buffer().to_pybytes()
                held, size = [], 0
                for found in salvage(data):
                    if isinstance(found, Record):
                        payload = found.payload
                        held.append((name, found.offset, "record", len(payload), None, list(found.headers.items()), payload))
                        size += len(payload)
                    else:
                        held.append((name, found[0], "gap", found[1], found[2], None, None))
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return in_arrow(files.select("path", "content"), run, schema)


def salvaged(spark: SparkSession, path: str, to: str) -> tuple[DataFrame, DataFrame]:
    """Reads archives once and keeps both what was recovered and the log of quarantined gaps, as tables below `to`: records (file,
    offset, length, headers, payload) and gaps (file, offset, length, reason)."""
    read_archives(spark, path).write.partitionBy("kind").mode("overwrite").parquet(to)
    rows = spark.read.schema("file string, offset long, length long, reason string, headers map<string,string>, payload binary, kind string").parquet(to)
    return rows.where("kind = 'record'").drop("kind", "reason"), rows.where("kind = 'gap'").select("file", "offset", "length", "reason")


def write_pages(pages: DataFrame, path: str, smallest: int = 0, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", uri: str = "url", html: str = "html") -> None:
    """A record for each page. Of pages with equal payloads of at least smallest bytes the one with the smallest key is a
    response, the others revisit it; smaller ones are all responses. A null payload counts as empty; a null key is only
    a response. Of repeated rows with the key of the response each is a response. A null address counts as empty; its control
    characters are percent-encoded. Other columns, of any name, are ignored.

    Members are packed before they are dealt out by payload, as packed bytes are fewer.
    """
    integral(pages, key)
    raw = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(uri, F.lit("")).alias("uri"), raw.alias("t"))
    rows = rows.select("key", "uri", "t", digest_column(F.col("t")).alias("digest"), F.length("t").cast("long").alias("size"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(*(column(batch, c).to_pylist() for c in ("key", "uri", "t", "digest")), strict=True)
            members = [member(response("" if k is None else str(k), u, date, t, d)) for k, u, t, d in parts]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("key", "uri", "digest", "size")), pa.array(members, pa.binary())], ["key", "uri", "digest", "size", "member"])

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(*(column(batch, c).to_pylist() for c in ("key", "uri", "digest", "size", "first", "member")), strict=True)
            members = [m if f is None else member(revisit(str(k), u, date, n, d, str(f))) for k, u, d, n, f, m in parts]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(members, pa.binary())], ["key", "member"])

    kinds = "key long, uri string, digest string, size long"
    firsts = rows.where((F.col("size") >= smallest) & F.col("key").isNotNull()).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    packed = in_arrow(rows, pack, f"{kinds}, member binary").withColumn("k", apart(F.when(F.col("size") >= smallest, F.col("digest"))))
    joined = packed.join(firsts.select(apart(F.col("digest")).alias("k"), "first"), "k", "left")
    again = F.col("first") < F.col("key")
    joined = joined.select("key", "uri", "digest", "size", F.when(again, F.col("first")).alias("first"), F.when(again, None).otherwise(F.col("member")).alias("member"))
    write_archives(in_arrow(joined, refer, "key long, member binary"), path)


def round_trip(pages: DataFrame, smallest: int = 0, key: str = "page_id", uri: str = "url", html: str = "html") -> DataFrame:
    """Archives of the pages, read back: key, payload_bytes, payload_digest, record_type, refers_to. No pages give no rows."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_pages(pages, path, smallest, key=key, uri=uri, html=html)
    fields = F.col("headers")
    number = lambda name: F.when(fields[name] != "", fields[name].cast("long"))
    found = read_archives(spark, path).where("kind = 'record'")
    return found.select(
        number("x-page-id").alias(key), F.coalesce(number("x-payload-length"), F.col("length")).alias("payload_bytes"),
        F.substring_index(fields["warc-payload-digest"], ":", -1).alias("payload_digest"), fields["warc-type"].alias("record_type"), number("x-refers-to-page-id").alias("refers_to"),
    )
