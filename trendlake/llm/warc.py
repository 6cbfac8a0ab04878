"""WARC archives: written by tasks, read back by byte ranges.

Writing: every row becomes one record in a gzip member of its own. Each task
writes one file under a name of its own attempt and reports it in a manifest
row, so files of failed or repeated attempts are never read.

Reading: files are cut into byte ranges. A task looks for the gzip magic in
its range, takes a place as a member only if its header, its whole body and
what follows it decode (another member's header or the end of the file), and
owns the records that start inside its range, however far they reach. From
one member the next is found where it ends, so only the first is searched.

The folder may be on any file system that pyarrow can open from its URI.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.llm.tables import empty_if_null, written
from trendlake.session import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"\x1f\x8b\x08"
SPLIT = 32 << 20  # bytes of a range
_READ = 1 << 20
_HEX5 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(column: Column) -> Column:
    """Upper-case base32 of the SHA-1 of text in UTF-8."""
    h = F.sha1(column.cast("binary"))
    return F.concat(*[
        F.translate(F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0"), _HEX5, _BASE32) for i in range(8)
    ])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names its response's page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{refers_to}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_header(url) if url is not None else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass")
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(df: DataFrame, folder: str) -> DataFrame:
    """The written manifest (path, bytes, records) of archives of ``page_id, url, html, digest, refers_to``."""

    def run(frames):
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        system, path = _opened(name)
        out, size, count = None, 0, 0
        for frame in frames:
            if out is None:
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            for page, url, html, digest, refers in zip(*(frame[c] for c in ("page_id", "url", "html", "digest", "refers_to"))):
                page, refers = (None if pd.isna(v) else int(v) for v in (page, refers))
                part = _member(record(page, None if pd.isna(url) else url, html.encode("utf-8", "replace"), digest, refers))
                out.write(part)
                size, count = size + len(part), count + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "bytes": [size], "records": [count]})

    rows = df.select(
        F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), empty_if_null("html").alias("html"),
        "digest", F.col("refers_to").cast("string").alias("refers_to"),
    )
    return written(rows.mapInPandas(run, "path string, bytes long, records long"))


class _Window:
    """Bytes of a file, read in blocks as a reader moves on."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def take(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.file.seek(at)
            self.data, self.at = self.file.read(max(n, min(_READ, self.size - at))), at
        return self.data[at - self.at : at - self.at + n]


def _decoded(window: _Window, at: int, only_header: bool = False) -> tuple[bytes, int] | None:
    """The record in the member at ``at`` and where the member ends; None if there is none."""
    z, data, place = zlib.decompressobj(31), bytearray(), at
    try:
        while not z.eof:
            block = window.take(place, 512 if only_header else 64 << 10)
            if not block:
                return None
            data += z.decompress(block)
            place += len(block)
            if data[:5] != b"WARC/"[: len(data)]:
                return None
            if only_header and len(data) >= 5:
                return b"", place
    except zlib.error:
        return None
    return (bytes(data), place - len(z.unused_data)) if len(data) >= 5 else None


def records_in(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start in [start, end)."""
    window = _Window(file, size)
    at, chained, end = start, False, min(end, size)
    while at < end:
        if not chained:
            block = window.take(at, _READ)
            hit = block.find(MAGIC)
            if hit < 0:
                at += max(1, len(block) - len(MAGIC) + 1)
                continue
            at += hit
            if at >= end:
                return
        got = _decoded(window, at) if window.take(at, 3) == MAGIC else None
        if got and (chained or got[1] >= size or _decoded(window, got[1], only_header=True)):
            yield got[0]
            at, chained = got[1], True
        else:
            at, chained = at + 1, False


def parsed(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one record; the digest is checked."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    length = int(fields["Content-Length"])
    block = block[:length]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
    if fields["WARC-Type"] == "revisit":
        return page, int(fields["X-Payload-Length"]), digest, "revisit", int(fields["X-Refers-To-Page-ID"])
    payload = block.partition(b"\r\n\r\n")[2]
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if own != digest:
        raise ValueError(f"record of page {page}: digest {own}, expected {digest}")
    return page, len(payload), own, "response", None


def read_archives(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the manifest's files."""
    ranges = manifest.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start")
    ).repartition("path", "start")

    def run(frames):
        for frame in frames:
            for path, size, start in zip(frame["path"], frame["bytes"], frame["start"]):
                system, at = _opened(path)
                with system.open_input_file(at) as file:
                    rows = []
                    for data in records_in(file, size, start, start + split):
                        rows.append(parsed(data))
                        if len(rows) == 5000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    return ranges.mapInPandas(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: of equal payloads the largest page_id is kept as the response.

    Payloads below ``least`` bytes refer to nothing. Rows that repeat the
    largest page_id are responses too; rows without a page_id never revisit.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), empty_if_null("html").alias("html")
    ).withColumn("digest", base32_sha1(F.col("html")))
    largest = own.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return own.join(largest, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("largest") > F.col("page_id"), F.col("largest")).alias("refers_to")
    )


def archive_round_trip(pages: DataFrame, least: int = 0, split: int = SPLIT) -> DataFrame:
    """Pages written to archives in the shared folder and read back, one row per page.

    Null html is empty; null url is a urn of the page. An empty table writes
    nothing and gives no rows.
    """
    folder = f"{shared_folder(pages.sparkSession)}/trendlake/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(with_revisits(pages, least), folder), split)
