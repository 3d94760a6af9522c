"""WARC archives as a chunked record table (operator 2).

Writing: each task streams its rows into one archive of gzip members, one member a record. A
payload is hashed and compressed in slices of its Arrow buffer; it is never copied as a whole.
Reading: each archive is decompressed as a stream and turned into rows (record id, chunk
number, bytes, digest so far); the digest of a record's last chunk is that of its payload and
is held against the header. No step holds more of a record than one chunk.

Archives are written to the folder that driver and executors share. A task that is run again
writes a file of a new name; only the names that successful tasks report are read back.

Cases: a null html is an empty payload; payloads of fewer than min_bytes bytes are all
responses; rows that repeat the smallest page_id of a payload are all its responses; a null
page_id is never one's first and its record stays a response; an empty table gives no records;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, table

CHUNK = 1 << 20
MIN_BYTES = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_references(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html and refers_to (null: a response).

    The smallest page_id of each digest is found by an aggregation over the narrow columns;
    only digests that occur twice or more take part in the join, whatever their number of
    pages."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.when(F.octet_length("html") >= min_bytes, F.sha2("html", 256)))
    first = (
        p.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "first")
    )
    return p.join(first, "digest", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def _slices(buf: memoryview, chunk: int) -> Iterator[memoryview]:
    for at in range(0, len(buf), chunk):
        yield buf[at: at + chunk]


def _views(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each string, as views of the column's buffer."""
    for x in column:
        buf = x.as_buffer()
        yield memoryview(buf) if buf is not None else memoryview(b"")


class _Member:
    """One gzip member, written piece by piece."""

    def __init__(self, out):
        self.out, self.z, self.n = out, zlib.compressobj(1, zlib.DEFLATED, 31), 0

    def write(self, data) -> None:
        got = self.z.compress(data)
        self.n += len(got)
        self.out.write(got)

    def close(self) -> int:
        got = self.z.flush()
        self.out.write(got)
        return self.n + len(got)


def _one_line(s: str | None) -> str:
    return (s or "").replace("\r", "%0D").replace("\n", "%0A")


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def write_record(out, page_id, url: str | None, payload: memoryview, refers_to, chunk: int = CHUNK) -> int:
    """Writes one record; returns its compressed size."""
    sha = hashlib.sha256()
    for part in _slices(payload, chunk):
        sha.update(part)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Target-URI", _one_line(url)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{sha.hexdigest()}"), ("Page-Id", "" if page_id is None else str(page_id)),
        ("Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else len(payload)))),
    ]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("Refers-To-Page-Id", str(refers_to))]
    m = _Member(out)
    m.write(_header(fields))
    m.write(http)
    if not revisit:
        for part in _slices(payload, chunk):
            m.write(part)
    m.write(b"\r\n\r\n")
    return m.close()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, n, size, out = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            ids, urls, refs = (b.column(i).to_pylist() for i in (0, 1, 3))
            for k, payload in enumerate(_views(b.column(2))):
                size += write_record(out, ids[k], urls[k], payload, refs[k])
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives; returns archive, records, bytes of each (already computed)."""
    return cut(
        with_references(pages, min_bytes).select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long"))
        .mapInArrow(_writer(folder), "archive string, records long, bytes long"),
        "warc-list",
    )


class _Stream:
    """Lines and bounded reads over the members of a gzip stream."""

    def __init__(self, raw, chunk: int):
        self.raw, self.chunk = raw, chunk
        self.z, self.buf, self.packed = zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.packed = self.z.unused_data + self.packed
                self.z = zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.raw.read(1 << 16)
                if not self.packed:
                    return False
            got = self.z.decompress(self.packed, self.chunk)
            self.packed = b"" if self.z.eof else self.z.unconsumed_tail
            if got:
                self.buf += got
                return True

    def line(self) -> bytes | None:
        while (at := self.buf.find(b"\n")) < 0:
            if not self._more():
                return None
        out, self.buf = self.buf[:at], self.buf[at + 1:]
        return out.rstrip(b"\r")

    def read(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        out, self.buf = self.buf[:n], self.buf[n:]
        return out


def read_records(raw, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, str, bool]]:
    """(header, chunk number, bytes, hex digest so far, last) of every chunk of every record; a
    record without body has one empty chunk."""
    s = _Stream(raw, chunk)
    while (line := s.line()) is not None:
        if not line:
            continue
        if line != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while line := s.line():
            k, _, v = line.decode().partition(": ")
            head[k] = v
        left = int(head["Content-Length"])
        while line := s.line():  # the HTTP header
            left -= len(line) + 2
        left -= 2
        sha, number = hashlib.sha256(), 0
        while True:
            data = s.read(min(left, chunk))
            if len(data) < min(left, chunk):
                raise ValueError("archive ends inside a record")
            left -= len(data)
            sha.update(data)
            yield head, number, data, sha.hexdigest(), left == 0
            number += 1
            if not left:
                break


def _reader(folder: str, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    length = 0
                    for head, k, data, digest, last in read_records(raw):
                        length = len(data) if k == 0 else length + len(data)
                        revisit = head["WARC-Type"] == "revisit"
                        said = head["WARC-Payload-Digest"].partition(":")[2]
                        if last and not revisit and (digest != said or length != int(head["Payload-Length"])):
                            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                        rows.append((
                            int(head["Page-Id"]) if head["Page-Id"] else None, head["WARC-Type"], k, data if with_bytes else None,
                            said if revisit else digest, int(head["Payload-Length"]) if revisit else length, last,
                            int(head["Refers-To-Page-Id"]) if revisit else None,
                        ))
                        held += len(data) if with_bytes else 100
                        if held > 8 * CHUNK:
                            yield _chunk_rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _chunk_rows(rows)

    return run


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
CHUNK_SCHEMA = "page_id long, record_type string, chunk long, data binary, digest string, bytes_so_far long, last boolean, refers_to long"


def _chunk_rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)],
        ["page_id", "record_type", "chunk", "data", "digest", "bytes_so_far", "last", "refers_to"])


def read_archives(archives: DataFrame, folder: str, with_bytes: bool = True) -> DataFrame:
    """The chunk table of the archives listed, a row for each chunk of each record; without
    bytes its data is null."""
    names = archives.select("archive")
    n = max(1, archives.count())
    return names.repartition(min(n, 10_000), "archive").mapInArrow(_reader(folder, with_bytes), CHUNK_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    chunks = read_archives(archives, folder, with_bytes=False)
    # the digest and the length so far at a record's last chunk are those of its payload
    return chunks.filter("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
h as (select page_id, octet_length(b) as n, sha256(b) as d from p),
f as (select d, min(page_id) as first from h where n >= 100 group by d)
select h.page_id, cast(n as bigint) as payload_bytes, h.d as payload_digest,
       case when first is null or first = h.page_id then 'response' else 'revisit' end as record_type,
       case when first <> h.page_id then first end as refers_to
from h left join f on h.d = f.d and h.n >= 100
"""
