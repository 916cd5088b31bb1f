"""Helpers shared by the operators: the cluster's shared folder, written intermediates and Arrow access."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by the numpy kernels; bounds their temporary arrays.
SLICE_BYTES = (1 << 20) - 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one if all
    run in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spindrift-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended first
            return


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back, so a lost executor costs one read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Where written tables lie, as long as they are in use.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing needs any more: what was made of them has been written itself."""
    for table in tables:
        if (path := _paths.pop(table, None)) is not None:
            delete(table.sparkSession, path)
            _written.remove((table.sparkSession, path))


#: A key is heavy if this share of all rows have it, and at least so many: there are at most 10,000 of them, which can be
#: broadcast, and of any other key there are few rows beside what a task holds.
HEAVY_SHARE, HEAVY_ROWS = 10_000, 1024


def heavy_rows(total: int) -> int:
    return max(HEAVY_ROWS, -(-total // HEAVY_SHARE))


#: Rows that one row is repeated to where it lies.
RUN = 1 << 14


def repeated(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Each row as often as column ``times`` says, numbered from 0; rows of many repeats are dealt in runs to several tasks."""
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / RUN))).alias("_run")
    # a stated number is not lowered at run time, small as the runs are before they are written out
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where(F.col(times) > 0).select("*", runs).repartition(parts, *(F.col(f"`{c}`") for c in rows.columns), "_run")
    first = F.col("_run") * RUN
    each = F.explode(F.sequence(first, F.least(first + RUN, F.col(times).cast("long")) - 1)).alias(number)
    return dealt.select(*(F.col(f"`{c}`") for c in rows.columns), each)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text has a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(rows, max(row + 1, end))
        yield row, end
        row = end


def all_but_text(names: list[str]):
    """A struct of these columns without the texts, which are the bulk of a batch and go to the workers once."""
    return F.struct(*([F.col(f"`{c}`") for c in names if c != "text"] or [F.lit(0).alias("_")]))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE_BYTES of text: what is made of a part bounds a worker's memory."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        for lo, hi in slices(np.concatenate(([0], np.cumsum(lengths)))):
            yield batch.slice(lo, hi - lo)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive runs of ``values``."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def vectors(column: pa.Array) -> tuple[list[np.ndarray | None]]:
    """Each row's list as float64; None where it is null or holds a null."""
    out = []
    for row in column:
        values = row.values if row.is_valid else None
        out.append(None if values is None or values.null_count else np.asarray(values.to_numpy(zero_copy_only=False), np.float64))
    return out
