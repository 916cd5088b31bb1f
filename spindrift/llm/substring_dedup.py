"""Substring dedup by level-wise doubling of repeated word windows.

A window of ``length`` words can only repeat where the shorter windows inside it do.  So the levels double: windows
of about a quarter, then half, then the whole length are counted, and each level only looks at places where every
window of the level before was found repeated; when a level finds none, the rest are not run.

The first levels need not count every window: a window is represented by the shorter window of smallest hash among
those that start in it, which is the same wherever the long window stands.  So about one short window in fifteen is
counted, and none that could matter is missed.  The last level counts every window that is left, under 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import words as W
from spindrift.llm.common import all_but_text, forget, heavy_rows, lists, sliced, slices, utf8, written

U = np.uint64
_COUNTED = "h1 long, h2 long, key long, pos int, sure boolean"


def levels(length: int, least: int = 8) -> list[int]:
    """Window lengths, each about twice the one before, ending at ``length``."""
    out = [length]
    while (half := -(-out[0] // 2)) >= least:
        out.insert(0, half)
    return out


def _starts(at: np.ndarray, width: int) -> np.ndarray:
    """For each word whether a window of ``width`` words of its own row starts there."""
    per = np.diff(at)
    edge = np.zeros(int(at[-1]) + 1, np.int32)
    full = per >= width
    np.add.at(edge, at[:-1][full], 1)
    np.add.at(edge, at[1:][full] - width + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _minima(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` values."""
    low, reach = values, 1
    while reach < span and len(low):
        step = min(reach, span - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    return low


#: Windows that a task remembers to have passed on.
REMEMBERED_BITS = 18


class _Counter:
    """Rows to be counted, of one task.

    A window that repeats within a slice is sure, and so is one that the task remembers.  Two rows of it go on to be met by
    its equals elsewhere, and the rest are dealt out by their place, so a very common window is a few rows from each task.
    A window is remembered in the place of another that came once only."""

    def __init__(self) -> None:
        self.h1, self.h2, self.times = (np.zeros(1 << REMEMBERED_BITS, t) for t in (np.uint64, np.uint64, np.int8))

    def __call__(self, h1: np.ndarray, h2: np.ndarray, key: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        by = np.argsort(h1, kind="stable")
        s1, s2 = h1[by], h2[by]
        same = np.zeros(len(by) + 1, bool)
        same[1:-1] = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
        sure, later = same[:-1] | same[1:], same[:-1]
        slot = (s1 >> U(64 - REMEMBERED_BITS)).astype(np.int64)
        times = np.where((self.h1[slot] == s1) & (self.h2[slot] == s2), self.times[slot], 0)
        sure |= times > 0
        dealt = later | (times > 1)
        new = np.flatnonzero(~later & ((times > 0) | (self.times[slot] < 2)))
        self.h1[slot[new]], self.h2[slot[new]] = s1[new], s2[new]
        self.times[slot[new]] = np.minimum(times[new] + 1 + same[1:][new], 2)
        key, pos = key[by], pos[by]
        s1 = np.where(dealt, W.mix(key.view(np.uint64) ^ (pos.astype(np.uint64) << U(33))), s1)
        return pa.record_batch({"h1": pa.array(s1.view(np.int64)), "h2": pa.array(s2.view(np.int64)), "key": pa.array(key), "pos": pa.array(pos.astype(np.int32)), "sure": pa.array(sure)})


def _flat(column: pa.Array, lo: int, hi: int, at: np.ndarray, each: int = 1) -> np.ndarray:
    """Numbers of the rows lo to hi of a list column, each moved to its row's place in the slice."""
    offsets = column.offsets.to_numpy()
    own = column.values.to_numpy()[offsets[lo] : offsets[hi]].astype(np.int64)
    per = np.diff(offsets[lo : hi + 1])
    return np.minimum(own + np.repeat(at[:-1], per), np.repeat(at[1:], per))


def _places(batch: pa.RecordBatch, allowed: bool):
    """Slice by slice: first row, words' hashes, row bounds, rows' keys and, if asked for, the words in allowed spans."""
    data, offsets = utf8(batch["text"])
    keys = batch["key"].to_numpy()
    for lo, hi in slices(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        body = data[offsets[lo] : offsets[hi]]
        starts, ends, at = W.bounds(body, own)
        hashed = W.hashes(body, starts, ends, fold=False)
        ok = np.ones(len(hashed), bool)
        if allowed:
            spans = _flat(batch["spans"], lo, hi, at)
            edge = np.zeros(len(hashed) + 1, np.int32)
            np.add.at(edge, spans[0::2], 1)
            np.add.at(edge, spans[1::2], -1)
            ok = np.cumsum(edge[:-1]) > 0
        yield lo, hashed, at, keys[lo:hi], ok


def _sampled(width: int, length: int, allowed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, counted = length - width + 1, _Counter()
        for batch in batches:
            for _, hashed, at, keys, ok in _places(batch, allowed):
                if len(hashed) < length:
                    continue
                short = W.windows(hashed, width)
                low = _minima(short, span)
                longs = (_starts(at, length) & ok)[: len(low)]
                marks = np.zeros(len(short), bool)
                for shift in range(span):
                    marks[shift : shift + len(low)] |= (short[shift : shift + len(low)] == low) & longs
                place = np.flatnonzero(marks)
                row = np.searchsorted(at, place, "right") - 1
                yield counted(short[place], W.windows(hashed, width, 1)[place], keys[row], place - at[row])

    return run


def _every(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _Counter()
        for batch in batches:
            for _, hashed, at, keys, ok in _places(batch, True):
                if len(hashed) < length:
                    continue
                place = np.flatnonzero(_starts(at, length) & ok)
                row = np.searchsorted(at, place, "right") - 1
                yield counted(W.windows(hashed, length)[place], W.windows(hashed, length, 1)[place], keys[row], place - at[row])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h1, h2), the places of those that are sure or have an equal."""
    last: tuple | None = None  # the last row of the batch before: (h1, h2, key, pos, already out)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, key, pos = (batch[k].to_numpy() for k in ("h1", "h2", "key", "pos"))
        out = batch["sure"].to_numpy(zero_copy_only=False).copy()
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        out[1:] |= same
        out[:-1] |= same
        extra = ([], [])
        if last is not None and last[0] == h1[0] and last[1] == h2[0]:
            out[0] = True
            if not last[4]:
                extra = ([last[2]], [last[3]])
        last = (h1[-1], h2[-1], key[-1], pos[-1], bool(out[-1]))
        yield pa.record_batch({"key": pa.array(np.concatenate((key[out], np.array(extra[0], np.int64)))), "pos": pa.array(np.concatenate((pos[out], np.array(extra[1], np.int32))).astype(np.int32))})


def _repeats(counted: DataFrame) -> DataFrame:
    """(key, places sorted) of the repeated windows."""
    found = counted.repartition("h1").sortWithinPartitions("h1", "h2").mapInArrow(_repeated, "key long, pos int")
    return found.groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("places"))


def _survivors(width: int, length: int, allowed: bool):
    """Runs of long windows of which every counted short window was found repeated, as start, end, start, end, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = length - width + 1
        for batch in batches:
            runs, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hashed, at, keys, ok in _places(batch, allowed):
                short = W.windows(hashed, width)
                low = _minima(short, span)
                hit = np.zeros(len(hashed) + 1, bool)
                hit[_flat(batch["places"], lo, lo + len(keys), at)] = True
                fits = np.zeros(len(hashed) + 1, np.int8)
                for shift in range(span):
                    fits[: len(low)] |= (short[shift : shift + len(low)] == low) & hit[shift : shift + len(low)]
                fits[:-1] &= _starts(at, length) & ok
                edge = np.flatnonzero(np.diff(np.concatenate((np.zeros(1, np.int8), fits))))
                row = np.searchsorted(at, edge[0::2], "right") - 1
                runs.append(edge - np.repeat(at[row], 2))
                lengths.append(2 * np.bincount(row, minlength=len(keys)))
            yield pa.record_batch({"key": batch["key"], "spans": lists(np.concatenate(runs).astype(np.int32), np.concatenate(lengths), pa.int32())})

    return run


def repeated_windows(texts: DataFrame, length: int = 35) -> DataFrame | None:
    """(key, places): starts of the windows of ``length`` words that start more than once among ``texts`` (key, text).

    None where a level finds no repeat at all."""
    spans = None
    for width in levels(length)[:-1]:
        rows = texts if spans is None else texts.join(spans, "key")
        found = rows.selectExpr("key", "text", *(["spans"] if spans is not None else [])).mapInArrow(_sampled(width, length, spans is not None), _COUNTED)
        joined = rows.join(_repeats(found), "key")
        spans, old = written(joined.mapInArrow(_survivors(width, length, spans is not None), "key long, spans array<int>").where("size(spans) > 0"), "spans"), spans
        if old is not None:
            forget(old)
        if spans.isEmpty():
            return None
    rows = texts.join(spans, "key") if spans is not None else texts.withColumn("spans", F.array(F.lit(0), F.lit(2**31 - 1)))
    return _repeats(rows.select("key", "text", "spans").mapInArrow(_every(length), _COUNTED))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, removed, digests, texts = [], [], [], []
            places, place_at = batch["places"].values.to_numpy(), batch["places"].offsets.to_numpy()
            known = batch["places"].is_valid().to_numpy(zero_copy_only=False)
            copied = batch["copied"].to_numpy(zero_copy_only=False)
            for row, text in enumerate(batch["text"]):
                own = text.as_py()
                if own is None:
                    n.append(0), removed.append(0), digests.append(hashlib.sha256(b"").hexdigest()), texts.append(None)
                    continue
                parts = own.encode().split()
                n.append(len(parts))
                if copied[row] and len(parts) >= length:
                    parts = []
                elif known[row] and place_at[row + 1] > place_at[row]:
                    edge = np.zeros(len(parts) + 1, np.int32)
                    at = places[place_at[row] : place_at[row + 1]]
                    at = at[at + length <= len(parts)]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    parts = [p for p, g in zip(parts, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(parts))
                kept = b" ".join(parts)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(own if removed[-1] == 0 else kept.decode())
            yield pa.record_batch({"row_id": batch["row_id"], "text": batch["text"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(texts, pa.string())})

    return run


def first_key():
    """The key that stands for a text at first."""
    return F.xxhash64("text")


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a 64-bit ``key`` that only equal texts share, and (key, copied, copies) of the texts that have an equal.

    Equal means equal in 128 bits.  Where texts that differ share a key, they get other ones, until none do."""
    keyed, turn = docs.withColumns({"key": first_key(), "key2": F.xxhash64(F.lit(1), F.col("text"))}), 1
    while True:
        shared = keyed.where("text is not null").groupBy("key").agg(F.min("key2").alias("least"), F.max("key2").alias("most"), F.count("*").alias("copies"))
        shared = written(shared.where("copies > 1").select("key", (F.col("least") == F.col("most")).alias("copied"), "copies"), "copies")
        clash = shared.where("not copied")
        if clash.isEmpty():
            return keyed.drop("key2"), shared
        turn += 1
        other = F.when(F.col("copied").isNull(), F.col("key")).otherwise(F.xxhash64(F.lit(turn), F.col("key2")))
        keyed = keyed.join(clash, "key", "left").withColumn("key", other).drop("copied", "copies")


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """``docs`` (text, anything more) with n_words, n_removed, kept_sha256 and kept_text.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  A word goes if a window of ``length`` consecutive words
    covers it whose word sequence also starts anywhere else, in the same text or another.  kept_sha256 is the hex
    digest of the kept words joined by one space; kept_text is the text itself where nothing goes, else those words.
    A null text has no word and kept_text null; an empty one keeps an empty text.  A text shorter than the window
    loses nothing.  Rows with equal texts are copies of each other: each counts, and each loses all its windows.
    An incoming column named like an added one is replaced.
    """
    added = ("n_words", "n_removed", "kept_sha256", "kept_text")
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in added))
    names = docs.columns
    keyed, equal = _keyed(docs.select(all_but_text(names).alias("row_id"), F.col("text")))
    # texts that very many rows have are known by a list of bounded size, and their rows are dealt to no key
    heavy = equal.where(F.col("copies") >= heavy_rows(docs.count())).select("key", F.lit(True).alias("heavy"))
    keyed = keyed.join(F.broadcast(heavy), "key", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    equal = equal.drop("copies")
    # texts that have an equal are known to repeat wholly; one of them stands for all
    texts = keyed.where("text is not null and not heavy").select("key", "text")
    some = texts.join(equal.select("key"), "key", "left_semi").unionByName(keyed.where("heavy and text is not null").select("key", "text"))
    single = texts.join(equal, "key", "left_anti").unionByName(some.dropDuplicates(["key"]))
    places = repeated_windows(single, length)
    alone = F.col("heavy") | F.col("text").isNull()
    rows = keyed.withColumns({"meets": F.when(alone, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("key")), "alone": alone})
    on = lambda right: right.withColumnRenamed("key", "meets").withColumn("alone", F.lit(False))
    rows = rows.join(on(equal), ["meets", "alone"], "left").withColumn("copied", F.col("copied") | F.col("heavy"))
    rows = rows.join(on(places), ["meets", "alone"], "left") if places is not None else rows.withColumn("places", F.lit(None).cast("array<int>"))
    packed = rows.select("row_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "places")
    kind = packed.schema["row_id"].dataType.simpleString()
    out = packed.mapInArrow(_cut(length), f"row_id {kind}, text string, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(*(F.col("text") if c == "text" else F.col("row_id").getField(c).alias(c) for c in names), *added)
