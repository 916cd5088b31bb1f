"""A page cache as a data source of Spark: folders by the hash of the URL, so that a lookup of some URLs reads only theirs.

A write adds Parquet files and then one manifest that names them; what no manifest names is not there.  Manifests only add:
of a URL's rows that of the latest ``cached_at`` is in force, of equal ones the greatest ``lastmod`` and then digest of the
html (null is least), whatever the order of writes, so writers need not wait for each other and a write that is made again
changes nothing.  A row without html removes the page.  Rows without a URL are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from spindrift.sources.store import PART_BYTES, parts_of

FORMAT = "spindrift_pages"
SCHEMA = "url string, html string, lastmod string, cached_at timestamp"
_OWN = pa.schema([("url", pa.string()), ("html", pa.large_string()), ("lastmod", pa.string()), ("cached_at", pa.timestamp("us", "UTC")), ("digest", pa.string()), ("gone", pa.bool_())])
_GIVEN = {"url": pa.string(), "html": pa.string(), "lastmod": pa.string(), "cached_at": pa.timestamp("us", "UTC")}

#: Bits of the hash that a lookup is told by, and so the most that folders can have.
MOST_BITS = 16
#: Characters of html that a folder is to have, where folders follow the data.
FOLDER_BYTES = 256 << 20
#: Rows that it is to have at most, removals included: a task holds their keys, about 300 bytes each.
FOLDER_ROWS = 1 << 18
#: Bytes of html after which a row group or a file ends; a longer page is a row group of its own.
GROUP_BYTES, FILE_BYTES = 16 << 20, 256 << 20


def bucket(url: Column) -> Column:
    """The first MOST_BITS bits of a URL's hash."""
    return F.shiftrightunsigned(F.crc32(url), 32 - MOST_BITS).cast("int")


def bits_for(size: int, rows: int = 0) -> int:
    """Bits for ``rows`` with ``size`` characters of html, so that a folder, which is a task's, has about FOLDER_BYTES and
    FOLDER_ROWS at most."""
    return min(MOST_BITS, max(0, -(-size // FOLDER_BYTES) - 1, -(-rows // FOLDER_ROWS) - 1).bit_length())


def _prefix(url: str, bits: int) -> int:
    return zlib.crc32(url.encode()) >> (32 - bits) if bits else 0


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


@dataclass(frozen=True)
class _File:
    path: str
    bits: int
    prefix: int
    size: int
    rows: int = 0  # manifests of before name none


def _manifests(folder: str) -> dict[str, dict]:
    """Manifests in force, by name."""
    files, own = _at(f"{folder}/manifests")
    found = {}
    for info in files.get_file_info(pafs.FileSelector(own, allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as stream:
                found[info.base_name] = json.loads(stream.read())
    replaced = {name for m in found.values() for name in m["replaces"]}
    return {name: m for name, m in sorted(found.items()) if name not in replaced}


def _files(folder: str) -> list[_File]:
    return [_File(f"{folder}/{path}", *rest) for m in _manifests(folder).values() for path, *rest in m["files"]]


@dataclass
class _Part(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        super().__init__(0)
        self.files = files


class _Reader(DataSourceReader):
    """A task for each folder of the fewest bits that any file has; the pages of a folder meet in it by their keys alone."""

    def __init__(self, columns: list[str], options: dict):
        self.columns, self.folder = columns, options["path"]
        self.gone = options.get("removed", "false") == "true"
        asked = options.get("buckets")
        self.asked = None if asked is None else np.unpackbits(np.frombuffer(bytes.fromhex(asked), np.uint8)).astype(bool)
        self.urls: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("url",):
                own = {u for u in ([f.value] if isinstance(f, EqualTo) else f.value) if u is not None}
                self.urls = own if self.urls is None else self.urls & own
            yield f  # what is pushed leaves out files and row groups; Spark still looks at each row

    def _wanted(self, file: _File) -> bool:
        if self.urls is not None and not any(_prefix(u, file.bits) == file.prefix for u in self.urls):
            return False
        width = 1 << (MOST_BITS - file.bits)
        return self.asked is None or bool(self.asked[file.prefix * width : (file.prefix + 1) * width].any())

    def partitions(self) -> list[InputPartition]:
        files = [f for f in _files(self.folder) if self._wanted(f)]
        bits = min((f.bits for f in files), default=0)
        groups: dict[int, list[str]] = {}
        for f in files:
            groups.setdefault(f.prefix >> (f.bits - bits), []).append(f.path)
        return [_Part(g) for _, g in sorted(groups.items())] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.files:
            return
        opened = [pq.ParquetFile(own, filesystem=files) for files, own in map(_at, partition.files)]
        keys = []
        for n, file in enumerate(opened):
            own = file.read(columns=["url", "lastmod", "cached_at", "digest", "gone"])
            keys.append(own.append_column("file", pa.array(np.full(len(own), n))).append_column("row", pa.array(np.arange(len(own)))))
        rows = pa.concat_tables(keys)
        if self.urls is not None:
            rows = rows.filter(pc.is_in(rows["url"], pa.array(sorted(self.urls), pa.string())))
        if not len(rows):
            return
        rows = rows.sort_by([("url", "ascending"), ("cached_at", "descending"), ("lastmod", "descending"), ("digest", "descending"), ("file", "ascending"), ("row", "ascending")])
        url = rows["url"].combine_chunks()
        first = np.ones(len(rows), bool)
        first[1:] = pc.not_equal(url[1:], url[:-1]).to_numpy(zero_copy_only=False)
        if not self.gone:
            first &= ~rows["gone"].to_numpy()
        at_file, at_row = rows["file"].to_numpy()[first], rows["row"].to_numpy()[first]
        for n, file in enumerate(opened):
            yield from self._taken(file, np.sort(at_row[at_file == n]))

    def _taken(self, file: pq.ParquetFile, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """These rows of a file in batches of about PART_BYTES; row groups without any are not read."""
        start = 0
        for group in range(file.num_row_groups):
            about = file.metadata.row_group(group)
            end = start + about.num_rows
            if np.searchsorted(rows, start) < np.searchsorted(rows, end):
                most = max(1, about.num_rows * PART_BYTES // max(1, about.total_byte_size))
                for batch in file.iter_batches(most, [group], self.columns or ["gone"]):
                    own = rows[np.searchsorted(rows, start) : np.searchsorted(rows, start + len(batch))] - start
                    start += len(batch)
                    if len(own):
                        taken = batch.take(pa.array(own))
                        given = [taken[c].cast(_GIVEN[c]) for c in self.columns]
                        yield pa.RecordBatch.from_arrays(given, self.columns)
            start = end


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int, int, int, int]]


class _Writer(DataSourceArrowWriter):
    """Writes a file for each run of rows of one folder: few where rows come sorted, right in any order."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.bits, self.overwrite = options["path"], int(options.get("bits", 8)), overwrite
        self.replaces = json.loads(options.get("replaces", "[]"))
        if not 0 <= self.bits <= MOST_BITS:
            raise ValueError(f"bits must be 0 to {MOST_BITS}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        written: list[tuple[str, int, int, int, int]] = []
        out, at, held, total, rows = None, None, 0, 0, 0
        parts: list[pa.RecordBatch] = []

        def flush() -> None:
            nonlocal held
            if parts:
                group = pa.Table.from_batches(parts)
                out.write_table(group, row_group_size=len(group))
            parts.clear()
            held = 0

        for batch in parts_of(iterator, "html"):
            batch = batch.filter(batch.column("url").is_valid())
            html = batch.column("html").to_pylist()
            prefixes = [_prefix(u, self.bits) for u in batch.column("url").to_pylist()]
            digests = [None if h is None else hashlib.sha256(h.encode()).hexdigest() for h in html]
            own = [batch.column(n).cast(_OWN.field(n).type) for n in _GIVEN]
            batch = pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.string()), pa.array([h is None for h in html], pa.bool_())], schema=_OWN)
            start = 0
            for k, prefix in enumerate(prefixes):
                size = len(html[k] or "")
                new = out is None or prefix != at or total >= FILE_BYTES
                if new or held + size > GROUP_BYTES:
                    if k > start:
                        parts.append(batch.slice(start, k - start))
                    start = k
                    flush()
                if new:
                    if out is not None:
                        out.close()
                        written.append((name, self.bits, at, total, rows))
                    at, total, rows = prefix, 0, 0
                    name = f"{self.bits:02d}/{prefix:04x}/{uuid.uuid4().hex}.parquet"
                    files, path = _at(f"{self.folder}/{name}")
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = pq.ParquetWriter(path, _OWN, filesystem=files, compression="zstd")
                held, total, rows = held + size, total + size, rows + 1
            if len(batch) > start:
                parts.append(batch.slice(start))
        if out is not None:
            flush()
            out.close()
            written.append((name, self.bits, at, total, rows))
        return _Written(written)

    def commit(self, messages: list[_Written | None]) -> None:
        replaced = list(_manifests(self.folder)) if self.overwrite else self.replaces
        body = {"files": [f for m in messages if m is not None for f in m.files], "replaces": replaced}
        if not body["files"] and not replaced:
            return
        name = uuid.uuid4().hex
        files, own = _at(f"{self.folder}/manifests")
        files.create_dir(own, recursive=True)
        with files.open_output_stream(f"{own}/.{name}") as stream:
            stream.write(json.dumps(body).encode())
        files.move(f"{own}/.{name}", f"{own}/{name}.json")

    def abort(self, messages: list[_Written | None]) -> None:
        for name, *_ in [f for m in messages if m is not None for f in m.files]:
            files, own = _at(f"{self.folder}/{name}")
            files.delete_file(own)


class PageSource(DataSource):
    """``spark.read.format(FORMAT).load(folder)``, after ``spark.dataSource.register``; a schema with some of the columns reads
    only these.  Filters ``url = ...`` and ``url IN ...`` choose the files.

    Options: ``bits`` of a write (2^bits folders, of 8 bits unless given), ``buckets`` of a read (a bitmap in hex digits of the buckets
    to read), ``removed`` (true: with what was removed, html null)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        unknown = set(schema.names) - set(_GIVEN)
        if unknown:
            raise ValueError(f"a page has no {', '.join(sorted(unknown))}")
        return _Reader(schema.names, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if set(schema.names) != set(_GIVEN):
            raise ValueError(f"pages are {SCHEMA}")
        return _Writer(self.options, overwrite)


@dataclass(frozen=True)
class PageCache:
    """The cache in ``folder``, which all executors share.  What is written next has 2^bits folders, as many as fit the data
    unless ``bits`` is given; a folder is one task's to read.  When a cache has grown, ``compact`` deals all pages anew."""

    spark: SparkSession
    folder: str
    bits: int | None = None

    def __post_init__(self) -> None:
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        self.spark.dataSource.register(PageSource)

    def read(self, *columns: str, **options: str) -> DataFrame:
        """Pages in force; of these columns, if any are named."""
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        reader = self.spark.read.format(FORMAT).schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds))
        return reader.options(**options).load(self.folder)

    def lookup(self, urls: DataFrame, *columns: str) -> DataFrame:
        """Pages of ``urls`` (url): only their folders are read.  The driver sees the buckets that are asked for, at most
        2^MOST_BITS numbers."""
        bits = np.zeros(1 << MOST_BITS, bool)
        bits[[r.b for r in urls.where("url is not null").select(bucket(F.col("url")).alias("b")).distinct().collect()]] = True
        names = dict.fromkeys(["url", *(columns or ("html", "lastmod", "cached_at"))])
        found = self.read(*names, buckets=np.packbits(bits).tobytes().hex())
        return found.join(urls.select("url").distinct(), "url", "left_semi")

    def _bits(self, size: int = 0, rows: int = 0) -> int:
        """Bits for what is there and so much more."""
        if self.bits is not None:
            return self.bits
        files = _files(self.folder)
        return bits_for(size + sum(f.size for f in files), rows + sum(f.rows for f in files))

    def _write(self, rows: DataFrame, bits: int, **options: str) -> None:
        folder = F.shiftrightunsigned(bucket(F.col("url")), MOST_BITS - bits)
        tasks = min(1 << bits, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.repartitionById(tasks, folder % tasks).sortWithinPartitions(folder, "url")
        dealt.write.format(FORMAT).options(bits=str(bits), **options).mode("append").save(self.folder)

    def save(self, rows: DataFrame) -> None:
        """Adds pages (url, html, lastmod, cached_at); more columns are left out.  Rows are gone through twice, so what is
        costly to make is best stored; where URLs repeat, the row in force of each is found before rows are dealt."""
        own = rows.where("url is not null").select("url", "html", "lastmod", F.col("cached_at").cast("timestamp").alias("cached_at"))
        per = own.groupBy("url").agg(F.count("*").alias("n"), F.sum(F.length("html").cast("long")).alias("size"))
        most, size, n = per.agg(F.max("n"), F.sum("size"), F.count("*")).first()
        if most is None:
            return
        if most > 1:
            last = F.max_by(F.struct("html", "lastmod", "cached_at"), F.struct("cached_at", "lastmod", F.sha2("html", 256)))
            own = own.groupBy("url").agg(last.alias("last")).select("url", "last.*")
        self._write(own, self._bits(size or 0, n))

    def remove(self, urls: DataFrame, now: Column) -> None:
        """From ``now`` on pages of ``urls`` (url) are not there, until they are saved again."""
        none = F.lit(None).cast("string")
        own = urls.where("url is not null").select("url").distinct()
        n = own.count() if self.bits is None else 0
        own = own.select("url", none.alias("html"), none.alias("lastmod"), now.cast("timestamp").alias("cached_at"))
        self._write(own, self._bits(rows=n))

    def compact(self, bits: int | None = None) -> None:
        """Writes what is in force, removals included, anew, in 2^bits folders.  What other writers add meanwhile stays."""
        before = list(_manifests(self.folder))
        self._write(self.read(removed="true"), self._bits() if bits is None else bits, replaces=json.dumps(before))

    def vacuum(self, hours: float = 24) -> int:
        """Deletes files that no manifest in force names and that are older than any read or write that still runs; how many."""
        files, own = _at(self.folder)
        kept = {_at(f.path)[1] for f in _files(self.folder)} | {f"{own}/manifests/{name}" for name in _manifests(self.folder)}
        old = [i.path for i in files.get_file_info(pafs.FileSelector(own, recursive=True, allow_not_found=True)) if i.type == pafs.FileType.File and i.path not in kept and i.mtime_ns < (time.time() - hours * 3600) * 1e9]
        # manifests that replace others outlive them, so files of the replaced ones can't come back
        for path in sorted(old, key=lambda p: "/manifests/" not in p):
            files.delete_file(path)
        return len(old)


def json_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a folder of JSON files, one object (url, html, lastmod, cached_at) each, as other caches keep them.  Files that
    are not such an object, or lack a URL or html, are left out; a time that is none is null."""
    rows = spark.read.schema("url string, html string, lastmod string, cached_at string, _bad string")
    rows = rows.option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(path)
    return rows.where("_bad is null and url <> '' and html <> ''").select("url", "html", "lastmod", F.try_to_timestamp("cached_at").alias("cached_at"))
