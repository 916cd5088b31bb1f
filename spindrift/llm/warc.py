"""WARC archives: a writer and a sequential reader.

A record is one gzip member.  The reader inflates member after member as bytes come in, frames a record's block by its
Content-Length, and verifies block and payload digests; it holds one record at a time and seeks nowhere.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import forget, heavy_rows, new_path, written

VERSION = b"WARC/1.1"
#: A fixed date, so that equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 18


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A record's URI; the page's id is its low half, a null one has a mark in its high half."""
    high = 0x5350494E00008000 | (1 if page_id is None else 0)
    return f"<urn:uuid:{uuid.UUID(int=(high << 64) | ((page_id or 0) & (2**64 - 1)))}>"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = number & (2**64 - 1)
    return None if (number >> 64) & 1 else low - 2**64 if low >= 2**63 else low


def _line(text: str | None) -> str:
    """A header value must stay on its line."""
    return "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in text or "")


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int | None, str | None] | None) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page in ``refers``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if refers:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0]))]
        if refers[1] is not None:
            head.append(("WARC-Refers-To-Target-URI", _line(refers[1])))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(lines + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers and payload of the block."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:])
        return {k.lower(): v.strip() for k, v in pairs}, payload


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member, as they come."""
    rest = b""
    while rest or (rest := stream.read(READ_BYTES)):
        inflater = zlib.decompressobj(31)

        def pieces(inflater=inflater) -> Iterator[bytes]:
            nonlocal rest
            while not inflater.eof:
                if not rest and not (rest := stream.read(READ_BYTES)):
                    raise ValueError("the archive ends within a gzip member")
                piece = inflater.decompress(rest, READ_BYTES)
                rest = inflater.unconsumed_tail if not inflater.eof else inflater.unused_data
                if piece:
                    yield piece

        own = pieces()
        yield own
        for _ in own:  # what the reader of the member left
            pass


def records(stream) -> Iterator[Record]:
    """Reads an archive from its start to its end; raises ValueError on what is not as its headers say."""
    for pieces in _members(stream):
        held = bytearray()
        while (split := held.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("a record ends within its headers")
            held += piece
        lines = bytes(held[:split]).decode().split("\r\n")
        if lines[0].encode() != VERSION:
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        length = int(headers["content-length"])
        for piece in pieces:
            held += piece
            if len(held) > split + 8 + length:
                break
        block = bytes(held[split + 4 : split + 4 + length])
        if len(block) < length or bytes(held[split + 4 + length :]) != b"\r\n\r\n":
            raise ValueError("a record's length is not its Content-Length")
        found = Record(headers, block)
        if headers.get("warc-block-digest", "").removeprefix("sha1:") != base32_sha1(block):
            raise ValueError(f"block digest of {headers.get('warc-record-id')}")
        if found.kind == "response" and headers["warc-payload-digest"].removeprefix("sha1:") != base32_sha1(found.http()[1]):
            raise ValueError(f"payload digest of {headers.get('warc-record-id')}")
        yield found


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        files, path = open_folder(folder)
        out, n, size = None, 0, 0
        for batch in batches:
            for page, url, html, digest, first, first_url, revisit in zip(*(batch[k] for k in ("page_id", "url", "html", "digest", "first", "first_url", "revisit")), strict=True):
                out = out or files.open_output_stream(f"{path}/{name}", compression=None)
                data = member(page.as_py(), url.as_py(), (html.as_py() or "").encode(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), (first.as_py(), first_url.as_py()) if revisit.as_py() else None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pa.record_batch({"archive": pa.array([name]), "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html, anything more); (folder, archive, records, bytes) of
    the archives written.

    The payload is html in UTF-8; null counts as empty.  Of records with equal payloads of at least ``least_bytes`` bytes
    the one with the largest page_id is a response and the others revisit it; all smaller ones are responses.  Rows that
    repeat that page_id, too, are responses.  A null page_id counts as smaller than any; where all are null, all are
    responses.  ``folder`` is a URI that all executors can write, by default one in the session's shared folder.  A task
    writes one archive under its attempt's own name, so an attempt that is lost leaves at most a file that is not listed.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    files, path = open_folder(folder)
    files.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # digests are Spark's own, in hexadecimal; the writer turns them to base 32
    body = F.coalesce("html", F.lit(""))
    keyed = rows.withColumns({"digest": F.sha1(body), "bytes": F.octet_length(body).cast("long")})
    last = keyed.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    last = written(last.where(f"n > 1 and first is not null and bytes >= {int(least_bytes)}"), "digests")
    # payloads that very many pages have are known by a list of bounded size, and their rows are dealt to no digest
    heavy = F.col("n") >= heavy_rows(rows.count())
    often = last.where(heavy).select("digest", "bytes", F.col("first").alias("first_a"), F.col("first_url").alias("url_a"))
    seldom = last.where(~heavy).select(F.col("digest").alias("meets"), F.col("bytes").alias("of"), F.col("first").alias("first_b"), F.col("first_url").alias("url_b"))
    known = keyed.join(F.broadcast(often), ["digest", "bytes"], "left")
    found = F.col("first_a").isNotNull()
    known = known.withColumns({"meets": F.when(found, F.hex(F.xxhash64(F.monotonically_increasing_id()))).otherwise(F.col("digest")), "of": F.when(found, F.lit(-1).cast("long")).otherwise(F.col("bytes"))})
    joined = known.join(seldom, ["meets", "of"], "left").withColumns({"first": F.coalesce("first_a", "first_b"), "first_url": F.when(found, F.col("url_a")).otherwise(F.col("url_b"))})
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = joined.select("page_id", "url", "html", "digest", "first", "first_url", revisit.alias("revisit"))
    manifest = out.mapInArrow(_write(folder), "archive string, records long, bytes long").withColumn("folder", F.lit(folder))
    listed = written(manifest.select("folder", "archive", "records", "bytes"), "manifest")
    forget(last)
    return listed


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, archive in zip(batch["folder"].to_pylist(), batch["archive"].to_pylist(), strict=True):
            files, path = open_folder(folder)
            cols: dict[str, list] = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            with files.open_input_stream(f"{path}/{archive}", compression=None) as stream:
                for record in records(stream):
                    h = record.headers
                    refers = h.get("warc-refers-to")
                    row = page_of(h["warc-record-id"]), h.get("warc-target-uri"), int(record.http()[0]["content-length"]), h["warc-payload-digest"].removeprefix("sha1:"), record.kind, page_of(refers) if refers else None
                    for c, v in zip(cols.values(), row, strict=True):
                        c.append(v)
                    if len(cols["url"]) == 4096:
                        yield _rows(cols)
                        cols = {k: [] for k in cols}
            yield _rows(cols)


def _rows(cols: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)], names=list(cols))


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the records in the archives that
    ``manifest`` (folder, archive) lists, each read in one pass and by a task of its own.  payload_bytes and payload_digest
    are of the full payload, of revisits too."""
    listed = manifest.select("folder", "archive")
    # a stated number of ranges is not merged again at run time, small as the names are
    dealt = listed.repartitionByRange(max(1, listed.count()), "folder", "archive")
    return dealt.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
