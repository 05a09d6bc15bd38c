"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own.  The reader gives every task a byte
range of an archive.  The task scans its range for the gzip magic, decodes what
follows a candidate, and accepts it as a record start only if it inflates to a
complete WARC header block.  From there members follow one another without
scanning.  A task owns the records that start inside its range and reads past
its end to finish the last one; so every record has one owner, wherever the
range borders fall, and no index or earlier pass over the archive is needed.

Tasks read and write archives with pyarrow's file systems, at any URI those
know (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.scratch import materialize, new_dir, small_batches

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
FILE_BYTES = 1 << 30
BLOCK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:keelson:page:"
MANDATORY = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def _header(url: str) -> str:
    """A header value: control characters, which would end the line, are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _write(uri: str):
    """Batches (id, url, payload, sha1 hex, refers_to, revisit) to archives; a row for each file.

    Names are new for every attempt, and only the files named by committed tasks
    are ever read, so a retried or duplicated task leaves no record twice."""

    def run(batches):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, sha1, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, revisit)
                out.write(data)
                size += len(data)
                n += 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.record_batch([pa.array([name]), pa.array([size]), pa.array([n])], ["file", "bytes", "records"])
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([size]), pa.array([n])], ["file", "bytes", "records"])

    return run


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, url, payload, sha1, refers_to, revisit): of equal payloads of ``least_bytes``
    or more, the rows with the smallest id are responses, the others revisit them.

    What revisits what is decided on ids and digests alone; payloads meet it by id,
    so that a payload which a third of all pages share is no hot key."""
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    narrow = materialize(rows.where(F.length("payload") >= least_bytes).select("id", "sha1"), "payload-digests")
    seen = narrow.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = materialize(seen.where("n > 1").select(F.col("sha1").alias("same"), "first"), "repeated-payloads")
    later = narrow.join(repeated, F.col("sha1") == F.col("same")).where(~F.col("id").eqNullSafe(F.col("first")))
    later = materialize(later.select(F.col("id").alias("later"), "same", "first").distinct(), "revisits")
    found = rows.join(later, F.col("id").eqNullSafe(F.col("later")) & (F.col("sha1") == F.col("same")), "left")
    return found.select("id", "url", "payload", "sha1", F.col("first").alias("refers_to"), F.col("same").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, uri: str | None = None, **columns) -> tuple[str, DataFrame]:
    """Write ``pages`` as WARC archives: (folder, table of (file, bytes, records))."""
    small_batches(pages.sparkSession)
    uri = uri or new_dir(pages.sparkSession, "warc")
    files = with_revisits(pages, **columns).mapInArrow(_write(uri), "file string, bytes long, records long")
    return uri, materialize(files, "warc-files")


# ---------------------------------------------------------------- reading


class Window:
    """Random access to a file by blocks, forgetting what lies before the last position."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size
        self.start, self.data = 0, b""

    def read(self, at: int, n: int = BLOCK) -> bytes:
        """Up to ``n`` bytes from ``at``; empty at the end."""
        n = max(0, min(n, self.size - at))
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.handle.seek(at)
            self.start, self.data = at, self.handle.read(max(n, BLOCK))
        return self.data[at - self.start : at - self.start + n]


def _fields(head: bytes) -> dict[bytes, bytes] | None:
    """Header fields of a WARC record, lower-cased names; None if ``head`` isn't one."""
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d", lines[0]):
        return None
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        found[name.strip().lower()] = value.strip()
    if any(x not in found for x in MANDATORY) or not found[b"content-length"].isdigit():
        return None
    return found


def inflate(window: Window, at: int, head_only: bool = False) -> tuple[dict[bytes, bytes], bytes, int] | None:
    """(fields, block, offset after the member) of the record whose member starts at
    ``at``; None if no valid record does.  ``head_only``: as soon as the header is whole."""
    unpacker, data, pos, fields, head_end = zlib.decompressobj(31), bytearray(), at, None, 0
    try:
        while not unpacker.eof:
            chunk = window.read(pos)
            if not chunk:
                return None
            pos += len(chunk)
            known = len(data)
            data += unpacker.decompress(chunk)
            if fields is None:
                if not b"WARC/1.".startswith(data[:7]):
                    return None
                head_end = data.find(b"\r\n\r\n", max(0, known - 3))
                if head_end >= 0:
                    fields = _fields(bytes(data[:head_end]))
                    if fields is None:
                        return None
                    if head_only:
                        return fields, b"", 0
    except zlib.error:
        return None
    if fields is None:
        return None
    length = int(fields[b"content-length"])
    if len(data) != head_end + 4 + length + 4 or not data.endswith(b"\r\n\r\n"):
        return None
    return fields, bytes(data[head_end + 4 : head_end + 4 + length]), pos - len(unpacker.unused_data)


def find_start(window: Window, at: int, end: int) -> int | None:
    """The offset of the first record that starts in [at, end).

    A record stored inside a payload may look like a start; it is refused because
    the outer member goes on after it: what follows a true record is the end of
    the file or another record's header."""
    while at < end:
        data = window.read(at, BLOCK + len(MAGIC) - 1)
        k = data.find(MAGIC)
        if k < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            if len(data) < BLOCK:
                return None
            continue
        spot = at + k
        if spot >= end:
            return None
        if inflate(window, spot, head_only=True) and (found := inflate(window, spot)):
            if found[2] == window.size or inflate(window, found[2], head_only=True):
                return spot
        at = spot + 1
    return None


class Damaged(ValueError):
    """Where a record must start, no valid one does."""


def records(handle, size: int, start: int, end: int, skip_damaged: bool = False) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, fields, block) of the records that start in [start, end).

    Where a record ends another must start, also one of the next range: if none
    does, Damaged is raised, or the next start is looked for.  Damage that a range
    border hides (the record before it is the first of its range, and is taken for
    one inside a payload) shows in the number of records."""
    window = Window(handle, size)
    at = find_start(window, start, end)
    if start == 0 and min(end, size) > 0 and at != 0 and not skip_damaged:
        raise Damaged("no record at 0")
    while at is not None and at < end:
        found = inflate(window, at)
        if found is None:
            if not skip_damaged:
                raise Damaged(f"no record at {at}")
            at = find_start(window, at + 1, end)
            continue
        yield at, found[0], found[1]
        at = found[2]
        if end <= at < size and not skip_damaged and inflate(window, at, head_only=True) is None:
            raise Damaged(f"no record at {at}")


def _number(value: bytes | None) -> int | None:
    tail = (value or b"").strip(b"<>").removeprefix(ID_PREFIX.encode())
    return int(tail) if re.fullmatch(rb"-?\d+", tail) else None


def _read(uri: str, with_payload: bool, skip_damaged: bool):
    names = ["file", "offset", "id", "url", "type", "refers_to", "digest", "payload_bytes", "payload"]

    def row(name, offset, fields, block):
        http, _, body = block.partition(b"\r\n\r\n")
        revisit = fields[b"warc-type"] == b"revisit"
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        n_bytes = int(length[1]) if revisit and length else len(body)
        digest = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") or None
        if not revisit and digest != base32_sha1(body):
            raise ValueError(f"{name} at {offset}: the payload doesn't match its digest")
        url = fields.get(b"warc-target-uri")
        return (name, offset, _number(fields[b"warc-record-id"]), url and url.decode("utf-8", "replace"), fields[b"warc-type"].decode(), _number(fields.get(b"warc-refers-to")) if revisit else None, digest, n_bytes, None if revisit or not with_payload else body)

    def pack(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        import pyarrow.fs as pafs

        fs = None
        for batch in batches:
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs = fs or pafs.FileSystem.from_uri(uri)[0]
                rows, held = [], 0
                with fs.open_input_file(file) as handle:
                    for offset, fields, block in records(handle, size, start, min(size, start + RANGE_BYTES), skip_damaged):
                        if fields[b"warc-type"] in (b"response", b"revisit"):
                            rows.append(row(file, offset, fields, block))
                            held += len(block)
                        if held > 16 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return run


SCHEMA = "file string, offset long, id long, url string, type string, refers_to long, digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, uri: str, files: DataFrame, with_payload: bool = True, skip_damaged: bool = False) -> DataFrame:
    """A row for each response and revisit record of ``files`` (file, bytes), by byte ranges.

    Without ``with_payload`` payload is NULL.  Damage raises, or with ``skip_damaged``
    loses the damaged records alone."""
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(RANGE_BYTES).cast("long"))).alias("start"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks).mapInArrow(_read(uri, with_payload, skip_damaged), SCHEMA)


def round_trip(pages: DataFrame, with_payload: bool = True, **columns) -> DataFrame:
    """Archive ``pages`` and read them back: a row for each row of ``pages``.

    NULL and empty html are empty payloads, equal to each other; payloads and urls
    of any length come back whole.  Rows with one id and one payload are repeated
    rows: all those with the smallest id are responses.  A NULL id is smaller than
    none: such a row is a response only if no other row has its payload.  A NULL url
    leaves the header out.  An empty table gives an empty result.  Other columns,
    whatever their names, are not read.

    What was read is written once and counted against what the writer put into each
    file; a difference raises."""
    uri, files = write_archives(pages, **columns)
    found = materialize(read_archives(pages.sparkSession, uri, files, with_payload), "warc-records")
    counted = found.groupBy("file").agg(F.count("*").alias("n")).withColumnRenamed("file", "of")
    wrong = files.join(counted, F.col("file") == F.col("of"), "left").where(F.coalesce("n", F.lit(0)) != F.col("records")).first()
    if wrong is not None:
        raise Damaged(f"{wrong['file']}: {wrong['records']} records written, {wrong['n'] or 0} read")
    return found


def resolve(found: DataFrame) -> DataFrame:
    """``found`` with the payload of revisit records taken from the response they refer to."""
    source = found.where("type = 'response'").select(F.col("id").alias("at"), F.col("digest").alias("same"), F.col("payload").alias("full")).dropDuplicates(["at", "same"])
    joined = found.join(source, F.col("refers_to").eqNullSafe(F.col("at")) & (F.col("digest") == F.col("same")) & (F.col("type") == "revisit"), "left")
    payload: Column = F.coalesce("payload", "full")
    return joined.select(*[c for c in found.columns if c != "payload"], payload.alias("payload"))
