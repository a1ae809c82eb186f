"""WARC archives: one gzip member per record, written and read sequentially.

Payload digests are grouped first, so that each distinct payload is stored once as a response and other
captures of it refer to that record. Every task writes one archive under a name of its own attempt; the
list of archives that the finished tasks wrote says which ones count.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import filesystem, materialize, scratch_dir

VERSION = b"WARC/1.1"
READ_BYTES = 1 << 16
_DATE = "1970-01-01T00:00:00Z"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(source: BinaryIO) -> Iterator[bytes]:
    """The content of each gzip member, read and inflated in small steps."""
    feed, held, parts = b"", None, []
    while True:
        if not feed:
            feed = source.read(READ_BYTES)
            if not feed:
                if held is not None:
                    raise ValueError("the archive ends within a record")
                return
        if held is None:
            held = zlib.decompressobj(31)
        parts.append(held.decompress(feed))
        feed = b""
        if held.eof:
            feed = held.unused_data
            yield b"".join(parts)
            held, parts = None, []


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record; framing and block digests are verified."""
    for data in members(source):
        head, found, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not found or not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        length = int(headers["content-length"])
        block, tail = rest[:length], rest[length:]
        if len(block) != length or tail != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')}: its length isn't its content's")
        if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + digest(block):
            raise ValueError(f"record {headers.get('warc-record-id')}: its block digest differs")
        yield headers, block


def _record_id(kind: str, number: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{number}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, own_digest: str, size: int, refers_to: int | None, level: int) -> bytes:
    kind = "revisit" if refers_to is not None else "response"
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = status + (payload if kind == "response" else b"")
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id("page", page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", "sha1:" + own_digest), ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Bytes", str(size))]
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id("page", refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    return record(headers, block, level)


def _writer(folder: str, level: int):
    def run(batches):
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, n = None, 0
        for batch in batches:
            ids, urls, sizes, firsts = (batch.column(c).to_pylist() for c in ("page_id", "url", "size", "first_id"))
            html = batch.column("payload")
            for i, page_id in enumerate(ids):
                if out is None:
                    out = files.open_output_stream(name)
                    out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("file", task.partitionId())), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                payload = html[i].as_py() or b""
                refers = firsts[i] if firsts[i] is not None and firsts[i] != page_id else None
                out.write(page_record(page_id, urls[i], payload, base32(batch.column("sha1")[i].as_py()), sizes[i], refers, level))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]})

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Writes the pages as archives into ``folder`` and returns their list: path, records.

    Of equal payloads with ``revisit_min_bytes`` bytes or more the smallest id is the response and others
    revisit it. A null html is empty; a page without an id revisits the smallest id, if there is one; repeated rows
    with the smallest id are all responses. A long page is one record. No pages give no archive; columns that aren't
    named aren't read, so that they may have any names. The join on digests may be split where one payload is common.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload").cast("long"))
    firsts = keyed.where(F.col("size") >= revisit_min_bytes).groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = keyed.join(firsts, "sha256", "left")
    # A revisit's payload isn't stored, so it needn't travel further than this; its digest does.
    slim = joined.select("page_id", "url", "size", "first_id", F.when(F.col("first_id").isNull() | (F.col("first_id") == F.col("page_id")), F.col("payload")).alias("payload"), F.sha1("payload").alias("sha1"))
    return materialize(slim.mapInArrow(_writer(folder, level), "path string, records long"), "warc-list")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def page_row(headers: dict[str, str], block: bytes, with_html: bool) -> tuple | None:
    """A page's row from its record, its payload digest verified; None for records of other kinds."""
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    own = headers["warc-payload-digest"].removeprefix("sha1:")
    _, _, payload = block.partition(b"\r\n\r\n")
    if kind == "response" and (digest(payload) != own or len(payload) != int(headers["x-payload-bytes"])):
        raise ValueError(f"record {headers['warc-record-id']}: its payload isn't what its header says")
    number = lambda k: int(headers[k]) if headers.get(k) else None
    return number("x-page-id"), int(headers["x-payload-bytes"]), own, kind, number("x-refers-to-page-id"), headers.get("warc-target-uri"), payload.decode("utf-8", "replace") if with_html and kind == "response" else None


def _reader(with_html: bool, rows_a_batch: int):
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, own = filesystem(path)
                rows, held = [], 0
                with files.open_input_stream(own) as source:
                    for headers, block in records(source):
                        if (row := page_row(headers, block, with_html)) is not None:
                            rows.append(row)
                            held += len(block) if with_html else 0
                        if len(rows) >= rows_a_batch or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

    return run


def read_archives(archives: DataFrame, with_html: bool = False, rows_a_batch: int = 2000) -> DataFrame:
    """One row per response or revisit record of the archives listed in column ``path``, one archive a task
    as far as there are tasks. ``html`` is null for revisits and unless it is asked for."""
    parts = max(1, min(archives.count(), 10_000))
    return archives.select("path").repartition(parts, "path").mapInArrow(_reader(with_html, rows_a_batch), READ_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages and reads the archives back."""
    return read_archives(write_archives(pages, folder or scratch_dir(pages.sparkSession, "warc")))
