"""WARC records in a chunked table.

An archive is a table with one row for each chunk of each record: record id,
chunk number, the chunk's bytes and the CRC-32 of the record's block up to and
with this chunk; a record's first chunk also has the bytes of its WARC header.
Concatenating header and chunks of the records in order gives WARC/1.1 bytes.
No step holds more than one chunk and one batch of input rows: payloads are cut
while they are hashed, and read back chunk by chunk with a running digest.
What a record is, a reader learns from the bytes of its header alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, release, save, text_of

CHUNK_BYTES = 64 * 1024
#: Longest header that is read: more is no WARC record.
HEADER_BYTES = 1 << 20
#: Groups of copies that are looked up in a broadcast table, at most.
HOT_GROUPS = 20_000
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROWS = "record long, chunk_no int, n_chunks int, header binary, data binary, crc long"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header(page_id, url, kind: str, refers_to, payload_bytes: int, digest: str) -> bytes:
    """WARC header up to and with the empty line; a revisit has no block."""
    uri = "".join(c for c in (url or "about:blank") if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"X-Payload-Bytes: {payload_bytes}", "Content-Length: 0"]
    else:
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {payload_bytes}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def parse_header(lines: Iterable[bytes]) -> dict[str, str]:
    """Fields by lower-case name, from a record's lines up to its empty line.

    ValueError if it doesn't begin as a WARC record, has no whole number as its
    Content-Length or exceeds HEADER_BYTES; EOFError if the empty line is missing.
    """
    head, size = {}, 0
    for n, line in enumerate(lines):
        size += len(line)
        if not n and not line.startswith(b"WARC/"):
            raise ValueError("a record must begin with WARC/")
        if size > HEADER_BYTES:
            raise ValueError("a header is too long")
        if line in (b"\r\n", b"\n"):
            if not head.get("content-length", "").isdecimal():
                raise ValueError("a header must tell its Content-Length")
            return head
        if n:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
    raise EOFError("a header ends early")


def write_archive(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Archive table of ``pages`` (page_id, url, html), saved in the shared folder.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the
    response, the others are revisits.  Null html is empty.  Rows that repeat a
    page_id with the same payload repeat its type and its WARC-Record-ID; a null
    page_id is a response only where no other page has its payload.  Copies are
    found by SHA-1 and length, counted before the shuffle.  The largest groups
    of copies are looked up in a broadcast table of at most HOT_GROUPS rows, so
    no group's payloads meet in one task.
    """
    spark = bounded(pages.sparkSession)
    html = text_of(F.col("html")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("body"))
    keyed = base.withColumn("sha", F.unhex(F.sha1("body"))).withColumn("n", F.octet_length("body"))
    copies = keyed.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    copies = save(copies.where("copies > 1 and first is not null"), "warc-copies")
    most = copies.agg(F.sum("copies")).first()[0] or 0
    large = F.col("copies") > max(100, most // HOT_GROUPS)  # so many are fewer than HOT_GROUPS groups
    hot = copies.where(large).select("sha", "n", F.col("first").alias("hot"))
    rest = copies.where(~large).select("sha", "n", "first")
    told = keyed.join(F.broadcast(hot), ["sha", "n"], "left")
    # a row whose copies are known needs no partner and goes anywhere
    told = told.withColumn("sha", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.unhex(F.hex(F.xxhash64("page_id", "url")))))
    first = F.coalesce("hot", "first")
    typed = told.join(rest, ["sha", "n"], "left").select("page_id", "url", "body", F.when(~F.col("page_id").eqNullSafe(first), first).alias("refers_to"))
    typed = typed.withColumn("record", F.monotonically_increasing_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _ROWS.split(", ")]
        for b in batches:
            rows, held = [], 0
            for record, page, url, body, first in zip(*(b[c] for c in ("record", "page_id", "url", "body", "refers_to")), strict=True):
                page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                view, whole = memoryview(body), hashlib.sha1()
                cuts = range(0, max(1, len(view)), chunk_bytes)
                for at in cuts:
                    whole.update(view[at : at + chunk_bytes])
                kind = "response" if first is None else "revisit"
                head, crc = header(page, url, kind, first, len(view), base32_sha1(whole.digest())), 0
                if kind == "revisit":
                    rows.append((record, 0, 1, head, b"", 0))
                    continue
                for k, at in enumerate(cuts):
                    part = view[at : at + chunk_bytes]
                    crc = zlib.crc32(part, crc)
                    rows.append((record, k, len(cuts), head if not k else None, bytes(part), crc))
                    held += len(part)
                    if held > 4 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)
        release()

    return save(typed.mapInPandas(run, _ROWS), "warc", "zstd")


def read_archive(archive: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    All of it comes from the record's bytes: ids, type and announced digest and
    length from its header, length and digest of a response from its chunks.  A
    revisit has no block and takes both from its header.  A record is intact if
    its chunks are all there with the CRC-32 they carry and agree with the
    header; one whose header can't be read, or is missing, has nulls in what the
    header tells.  Records of one chunk are read where they lie.  Those of many
    chunks are dealt by record, sorted by chunk number and streamed with a
    running SHA-1, so memory holds a batch of chunks however long the record is.
    """
    bounded(archive.sparkSession)
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        now = None  # record, header bytes, running SHA-1, bytes, CRC-32, next chunk, chunks, whether all is well

        def close() -> None:
            if now is not None:
                rows.append(_record(now["header"], now["sha"].digest(), now["bytes"], now["fine"] and now["next"] == now["chunks"]))

        for b in batches:
            for record, k, chunks, head, data, crc in zip(*(b[c] for c in ("record", "chunk_no", "n_chunks", "header", "data", "crc")), strict=True):
                if now is None or record != now["record"]:
                    close()
                    now = {"record": record, "header": None, "sha": hashlib.sha1(), "bytes": 0, "crc": 0, "next": 0, "chunks": chunks, "fine": True}
                if k == 0:
                    now["header"] = head
                now["sha"].update(data)
                now["crc"] = zlib.crc32(data, now["crc"])
                now["fine"] &= bool(k == now["next"] and crc == now["crc"])
                now["bytes"] += len(data)
                now["next"] = k + 1
            if len(rows) > 5_000:
                yield _rows(rows)
                rows = []
        close()
        yield _rows(rows)
        release()

    cols = ["record", "chunk_no", "n_chunks", "header", "data", "crc"]
    many = archive.where("n_chunks > 1").select(*cols).repartition("record").sortWithinPartitions("record", "chunk_no")
    return archive.where("n_chunks = 1").select(*cols).mapInPandas(read, out).union(many.mapInPandas(read, out))


def _record(head: bytes | None, sha1: bytes, size: int, fine: bool) -> tuple:
    """A row of ``read_archive`` from a record's header and the digest, size and state of its block."""
    digest = base32_sha1(sha1)
    try:
        fields = parse_header(bytes(head or b"").splitlines(keepends=True))
        kind = fields["warc-type"]
        told = fields["warc-payload-digest"].removeprefix("sha1:")
        page = int(fields["x-page-id"]) if "x-page-id" in fields else None
        first = int(fields["x-refers-to-page-id"]) if kind == "revisit" else None
        fine = fine and size == int(fields["content-length"])
        if kind == "revisit":
            return page, int(fields["x-payload-bytes"]), told, kind, first, fine
        return page, size, digest, kind, None, fine and digest == told
    except (ValueError, KeyError, EOFError):
        return None, size, digest, None, None, False


def _rows(rows: list) -> pd.DataFrame:
    b = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])
    return b.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "intact": "bool"})


def archive_bytes(rows: Iterable) -> Iterator[bytes]:
    """WARC bytes, chunk by chunk, from an archive's rows in record and chunk order (``toLocalIterator`` of a sorted archive)."""
    for r in rows:
        if r["header"] is not None:
            yield bytes(r["header"])
        yield bytes(r["data"])
        if r["chunk_no"] + 1 == r["n_chunks"]:
            yield b"\r\n\r\n"


def parse_stream(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(record, chunk number, headers with the first chunk, bytes) of a WARC file, plain or gzip.

    A record that ends early raises EOFError, one that is none ValueError.
    Memory holds a chunk and a piece of the file, whatever the file says.
    """
    raw, box = _Unzipped(stream), 0
    while True:
        line = raw.line()
        while line in (b"\r\n", b"\n"):
            line = raw.line()
        if not line:
            return
        head = parse_header(_lines(line, raw))
        left, k = int(head["content-length"]), 0
        while left or not k:
            part = raw.read(min(left, chunk_bytes))
            if left and not part:
                raise EOFError("a record ends early")
            yield box, k, head if not k else None, part
            left -= len(part)
            k += 1
        box += 1


def _lines(first: bytes, raw: "_Unzipped") -> Iterator[bytes]:
    while first:
        yield first
        first = raw.line()


class _Unzipped:
    """Reads plain or gzip bytes, member after member; no piece that is held exceeds PIECE by more than what is asked for."""

    PIECE = 1 << 16

    def __init__(self, stream):
        self.stream, self.out = stream, b""
        self.raw = stream.read(2)
        self.zip = zlib.decompressobj(31) if self.raw == b"\x1f\x8b" else None

    def _more(self) -> bool:
        """Add a piece to ``out``; False if there is none."""
        if self.zip is None:
            piece, self.raw = self.raw or self.stream.read(self.PIECE), b""
            self.out += piece
            return bool(piece)
        while True:
            if self.zip.eof:  # the next member
                self.raw = self.zip.unused_data + self.raw
                self.zip = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(self.PIECE)
            if not self.raw:
                return False
            piece = self.zip.decompress(self.raw, self.PIECE)
            self.raw = b"" if self.zip.eof else self.zip.unconsumed_tail
            self.out += piece
            if piece:
                return True

    def line(self) -> bytes:
        """Up to and with the next line feed, cut at HEADER_BYTES."""
        while (at := self.out.find(b"\n")) < 0 and len(self.out) <= HEADER_BYTES and self._more():
            pass
        end = at + 1 if at >= 0 else len(self.out)
        got, self.out = self.out[:end], self.out[end:]
        return got

    def read(self, n: int) -> bytes:
        while len(self.out) < n and self._more():
            pass
        got, self.out = self.out[:n], self.out[n:]
        return got


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the archive of ``pages`` and read it back."""
    return read_archive(write_archive(pages, min_bytes, chunk_bytes))
