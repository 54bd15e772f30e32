"""ARC archives: gzip members of one header line, HTTP headers and a body each."""

from __future__ import annotations

import gzip
import io
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: How a gzip member with the deflate method starts, and the bytes that are inflated at a time.
MAGIC, STEP = b"\x1f\x8b\x08", 1 << 14
SCHEMA = "file string, offset long, url string, ip string, ts string, mime string, length long, headers string, body binary"


def encode_record(url: str, ip: str, ts: str, mime: str, headers: str, body: bytes) -> bytes:
    content = headers.replace("\n", "\r\n").encode() + b"\r\n\r\n" + body
    head = f"{url} {ip} {ts} {mime} {len(content)}\n".encode()
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z:
        z.write(head + content + b"\n")
    return out.getvalue()


def _member(view: memoryview, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and where it ends; None if it is damaged or cut off."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(view):
            out.append(z.decompress(view[pos : pos + STEP]))
            pos += STEP
    except zlib.error:
        return None
    return (b"".join(out), min(pos, len(view)) - len(z.unused_data)) if z.eof else None


def decode_records(data: bytes):
    """(offset, url, ip, ts, mime, length, headers, body) of each member, in time linear in the archive's length.

    Where a member is damaged, a row with its offset and nulls tells so, and
    reading goes on at the next place that starts a whole member.
    """
    at, view, damaged = 0, memoryview(data), False
    while at < len(data):
        found = _member(view, at) if data.startswith(MAGIC, at) else None
        if found is None:
            if not damaged:
                yield (at, *[None] * 7)
            damaged, at = True, data.find(MAGIC, at + 1)
            if at < 0:
                return
            continue
        raw, end = found
        line, _, rest = raw.partition(b"\n")
        parts = line.decode("utf-8", "replace").rsplit(" ", 4)
        if len(parts) == 5 and parts[4].isdigit() and not parts[0].startswith("filedesc:"):
            content = rest[: int(parts[4])]
            headers, _, body = content.partition(b"\r\n\r\n")
            yield (at, *parts[:4], int(parts[4]), headers.decode("latin-1").replace("\r\n", "\n"), body)
        damaged, at = False, end


def _decode(batches):
    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("ts", pa.string()), ("mime", pa.string()), ("length", pa.int64()), ("headers", pa.string()), ("body", pa.binary())])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = [(path.as_py(), *r) for r in decode_records(content.as_py())]
            for i in range(0, len(rows), 256):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 256], strict=True), kind, strict=True)], schema=kind)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, and one with nulls per damaged stretch; a task reads whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_decode, SCHEMA)


def fetch_items(archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records at wanted (file, offset)."""
    return archive.join(wanted, ["file", "offset"])


def _encode(batches):
    for batch in batches:
        names = batch.schema.names
        rows = [encode_record(r["url"], r["ip"], r["ts"], r["mime"], r["headers"], r["body"]) for r in batch.to_pylist()]
        assert names
        yield pa.record_batch([pa.array([b"".join(rows)], pa.binary())], names=["archive"])


def encode_arc(records: DataFrame) -> DataFrame:
    """Archives, one binary per batch of (url, ip, ts, mime, headers, body) records."""
    return records.select("url", "ip", "ts", "mime", "headers", "body").mapInArrow(_encode, "archive binary")
