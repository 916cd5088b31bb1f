"""Tables in one folder with a log of commits, digests of their files, and the folder that a session shares.

A batch of a table is a folder of its own under a name that no other writer takes.  What is in force is what the last
entry of the log says; an entry is put in place in one step and only where no other writer was first, so a reader sees the
state before a change or the one after it, and a writer that comes too late makes its change again on the newer state.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ_BYTES = 1 << 20
#: Lines that one digest of a batch's tree is made of.
FAN = 1024
#: How often a change is made again when other writers were first.
TRIES = 20
#: Bytes of text of a batch that a task works on at once.
PART_BYTES = 1 << 20


def parts_of(batches: Iterator[pa.RecordBatch], column: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes of a string column, a longer text in one of its own: what is made of a part
    bounds a task's memory, whatever the number of rows that Spark sends at once."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(row, end - row)
            row = end


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; a temporary one only where all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spindrift-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Changed(ValueError):
    """Files of a batch are not those that were committed."""


@dataclass(frozen=True)
class Store:
    """Tables under ``folder``, each a list of batches, and the log of commits in ``_log``."""

    spark: SparkSession
    folder: str

    # ---- files

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _listed(self, path: str) -> list[tuple[str, int, int]]:
        """(name, bytes, time of change) of what lies in a folder, in order; none where there is no folder."""
        files, hadoop = self._files(path)
        if not files.exists(hadoop):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.listStatus(hadoop))

    def path(self, table: str, batch: str | int | None = None) -> str:
        return f"{self.folder}/{table}" + ("" if batch is None else f"/batch={batch}")

    # ---- tables

    def write(self, table: str, rows: DataFrame, batch: str | int | None = None) -> str:
        """Writes a batch, under a name that nothing else has unless one is given; its name."""
        batch = uuid.uuid4().hex if batch is None else str(batch)
        rows.write.mode("overwrite").parquet(self.path(table, batch))
        return batch

    def read(self, table: str, batches: list[str] | list[int], schema: str | None = None) -> DataFrame:
        """``schema`` is needed where there may be no batch, or one without a file."""
        if not batches:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*(self.path(table, b) for b in batches))

    def all(self, table: str) -> list[int]:
        """Numbers of the batches that are whole, of a table whose batches have numbers."""
        found = [int(name.split("=")[1]) for name, *_ in self._listed(self.path(table))]
        return sorted(n for n in found if any(name == "_SUCCESS" for name, *_ in self._listed(self.path(table, n))))

    def last(self, table: str, before: int | None = None) -> int | None:
        return max((n for n in self.all(table) if before is None or n < before), default=None)

    # ---- digests

    def _own_files(self, table: str, batch: str) -> list[tuple[str, int, int]]:
        return [x for x in self._listed(self.path(table, batch)) if x[0][0] not in "._"]

    def digests(self, batches: list[tuple[str, str]]) -> list[str]:
        """SHA-256 of each batch (table, name): of the lines (name, bytes, SHA-256) of its files, about FAN lines a digest,
        level by level.  Files are read by tasks, in blocks, each by one."""
        files = [(k, name, f"{self.path(*own)}/{name}") for k, own in enumerate(batches) for name, *_ in self._own_files(*own)]
        if not files:
            return [hashlib.sha256(b"").hexdigest()] * len(batches)
        listed = self.spark.createDataFrame(files, "batch int, name string, path string")
        lines = listed.repartition(min(len(files), 10_000), "path").mapInArrow(_hashed, "batch int, name string, line string")
        while len(files) > FAN * len(batches):
            lines = stored(lines, "digests")
            n = lines.groupBy("batch").agg((F.floor((F.count("*") - 1) / FAN) + 1).alias("parts"))
            of_part = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "line"))), lambda r: r["line"]), "\n"), 256)
            lines = lines.join(n, "batch").groupBy("batch", F.pmod(F.xxhash64("name"), F.col("parts")).alias("part")).agg(of_part.alias("line"))
            lines = stored(lines.select("batch", F.lpad(F.col("part").cast("string"), 20, "0").alias("name"), "line"), "digests")
            files = [None] * lines.count()
        found: dict[int, list[str]] = {}
        for r in sorted(lines.collect(), key=lambda r: r.name):
            found.setdefault(r.batch, []).append(r.line)
        return [hashlib.sha256("\n".join(found.get(k, [])).encode()).hexdigest() for k in range(len(batches))]

    def _mark(self, table: str, batch: str, digest: str) -> tuple[str, str]:
        listed = json.dumps([digest, self._own_files(table, batch)])
        return f"{self.folder}/_verified/{table}-{batch}", hashlib.sha256(listed.encode()).hexdigest()

    def seal(self, batches: list[tuple[str, str]]) -> list[str]:
        """Digests of batches that were just written, which count as verified."""
        found = self.digests(batches)
        for own, digest in zip(batches, found, strict=True):
            self._put(*self._mark(*own, digest))
        return found

    def changed(self, batches: list[tuple[str, str, str]], again: bool = False) -> list[tuple[str, str]]:
        """Of batches (table, name, digest) those whose files are not what was committed.  Files are read only where names,
        sizes and times of change are not those they had when they were last found right, or ``again`` is asked for."""
        doubtful = []
        for table, batch, digest in batches:
            mark, now = self._mark(table, batch, digest)
            files, hadoop = self._files(mark)
            if again or not files.exists(hadoop) or self._text(mark) != now:
                doubtful.append((table, batch, digest))
        if not doubtful:
            return []
        found = self.digests([(t, b) for t, b, _ in doubtful])
        for (table, batch, digest), now in zip(doubtful, found, strict=True):
            if now == digest:
                self._put(*self._mark(table, batch, digest))
        return [(t, b) for (t, b, digest), now in zip(doubtful, found, strict=True) if now != digest]

    # ---- commits

    def _text(self, path: str) -> str:
        files, hadoop = self._files(path)
        stream = files.open(hadoop)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        files, hadoop = self._files(path)
        stream = files.create(hadoop, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def state(self) -> tuple[int, dict] | None:
        """The last committed state and its number; None where there is none."""
        names = [name for name, *_ in self._listed(f"{self.folder}/_log") if name.endswith(".json") and name[0] != "."]
        if not names:
            return None
        return int(names[-1][:-5]), json.loads(self._text(f"{self.folder}/_log/{names[-1]}"))

    def commit(self, state: dict, number: int) -> bool:
        """Puts ``state`` in place as entry ``number``; false where that number is taken."""
        target = f"{self.folder}/_log/{number:012d}.json"
        own = f"{self.folder}/_log/.{uuid.uuid4().hex}"
        files, hadoop = self._files(own)
        self._put(own, json.dumps(state, sort_keys=True))
        try:
            if files.getScheme() == "file":
                # a rename takes the place of a file there, a link doesn't
                try:
                    os.link(pafs.FileSystem.from_uri(own)[1] if ":" in own else own, pafs.FileSystem.from_uri(target)[1] if ":" in target else target)
                except FileExistsError:
                    return False
                return True
            taken = files.exists(self._files(target)[1])
            return not taken and files.rename(hadoop, self._files(target)[1])  # false where the target exists
        finally:
            files.delete(hadoop, False)

    def transact(self, change: Callable[[int | None, dict | None], dict | None]) -> tuple[int, dict]:
        """Makes ``change`` of (number, state) until its result could be committed as the next entry; the entry in force then.
        A change that gives None leaves the state as it is."""
        for _ in range(TRIES):
            at = self.state()
            new = change(*(at or (None, None)))
            if new is None:
                if at is None:
                    raise ValueError("there is no state to keep")
                return at
            number = 0 if at is None else at[0] + 1
            if self.commit(new, number):
                return number, new
        raise TimeoutError(f"other writers were first {TRIES} times")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own_batch, name, path in zip(*(batch[c].to_pylist() for c in ("batch", "name", "path")), strict=True):
            files, own = pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")
            digest, size = hashlib.sha256(), 0
            with files.open_input_stream(own, compression=None) as stream:
                while piece := stream.read(READ_BYTES):
                    digest.update(piece)
                    size += len(piece)
            yield pa.record_batch({"batch": pa.array([own_batch], pa.int32()), "name": pa.array([name]), "line": pa.array([f"{name}:{size}:{digest.hexdigest()}"])})


_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_left: list[tuple[SparkSession, str]] = []


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows to the shared folder and reads them back: the plan begins anew, and a lost executor costs one read.  What
    is not forgotten before is deleted when the session's process ends."""
    spark = rows.sparkSession
    path = shared_folder(spark, name)
    _left.append((spark, path))
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    _stored[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(*tables: DataFrame) -> None:
    """Deletes stored rows that nothing needs any more."""
    for table in tables:
        if (path := _stored.pop(table, None)) is not None:
            _delete(table.sparkSession, path)
            _left.remove((table.sparkSession, path))


@atexit.register
def _clean_up() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended first
            return
