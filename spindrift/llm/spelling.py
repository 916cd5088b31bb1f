"""Words that differ by one code point, found in forward and reversed sorted dictionaries.

Of two words one edit apart one half is intact: they share a prefix or a suffix of half the shorter one's length.  Words
are sorted by range with such a prefix first (the forward dictionary), and again with such a suffix first (the reversed
one), so that words which share it are a run, a block.  Blocks of a bounded size are scanned where they lie and their
pairs verified.  A block that is larger, or that a border of two ranges cuts, is subdivided: its edits lie in a range of
places, of which either half leaves what the other half covers intact, so both longer prefixes and longer suffixes part
it.  At a single place only as many words as letters are left, and two letters at the most for the longer ones.

An edit is counted at the first place where two words differ, so each pair is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import forget, sliced, written

#: Runs of letters.
LETTERS = "a-zA-ZÀ-ÿ"

#: Words of a block that is verified where it lies.
BLOCK = 256

#: Code points compared at once.
CELLS = 1 << 21

#: Distinct words counted in a task before they are sent on, and their code points.
HELD_WORDS, HELD_CHARS = 200_000, 1 << 22


def _count(one_in: int, least: int):
    # shorter runs are no words even where nothing is deleted
    find = re.compile(f"[{LETTERS}]{{{least},}}").findall

    def out(held: Counter[str]) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        chars = 0
        for batch in sliced(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                # of bytes only A-Z are lower-cased
                runs = find((text.as_py() or "").encode().lower().decode())
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                if one_in:
                    for k, word in enumerate(runs):
                        h = zlib.crc32(word.encode(), before)
                        if h % one_in == 0:
                            runs[k] = word[: h % len(word)] + word[h % len(word) + 1 :]
                held.update(word for word in runs if len(word) >= least)
                chars += sum(map(len, runs))
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield out(held)
                    held, chars = Counter(), 0
        yield out(held)

    return run


def count_words(docs: DataFrame, least_chars: int = 7, least_count: int = 2, one_in: int = 31) -> DataFrame:
    """(word, n) of the words of all texts of ``docs`` (doc_id, text, anything more).

    A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, of at least ``least_chars`` code
    points, that occurs at least ``least_count`` times.  One in ``one_in`` pairs of a document and a run loses the code
    point that the crc32 of both says (0: none does).  A null or empty text has no words; a null doc_id counts as an empty
    one."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(one_in, least_chars), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def pairs(codes: np.ndarray, shorter: np.ndarray, ends: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block each that one edit at a place of their block's range makes equal.

    ``codes`` has what lies between prefix and suffix, a place more than ``shorter`` rows have; these come first in a
    block, and ``ends`` says where each row's block ends.  ``last`` ranges end after the last code point."""
    width = codes.shape[1] - 1
    partners = np.where(shorter, ends - np.arange(len(codes)) - 1, 0)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stops = np.cumsum(partners)
    most = max(1, CELLS // (width + 1))
    for lo in range(0, int(stops[-1]) if len(stops) else 0, most):
        at = np.arange(lo, min(lo + most, int(stops[-1])))
        i = np.searchsorted(stops, at, "right")
        j = i + 1 + at - (stops[i] - partners[i])
        x, y = codes[i], codes[j]
        differ = x[:, :width] != y[:, :width]
        times = differ.sum(1)
        good = shorter[j] & (times == 1)
        longer = np.flatnonzero(~shorter[j])
        if len(longer):
            d = differ[longer]
            first = np.where(times[longer] > 0, d.argmax(1) if width else 0, width)
            shifted = x[longer, :width] != y[longer, 1:]
            # what follows the first difference must be equal one place further on
            after = np.arange(width) >= first[:, None]
            good[longer] = ~(shifted & after).any(1) & ((first < width) | last)
        found.append((i[good], j[good]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


SCANNED = "word string, n long, near string, near_n long, l int, lo int, hi int"


def _scanned(word=(), n=(), near=(), near_n=(), l=(), lo=(), hi=()) -> pa.RecordBatch:
    size = max(len(word), 0)
    full = lambda v, kind: pa.array(v, kind) if len(v) else pa.nulls(size, kind)
    return pa.record_batch([full(v, k) for v, k in ((word, pa.string()), (n, pa.int64()), (near, pa.string()), (near_n, pa.int64()), (l, pa.int32()), (lo, pa.int32()), (hi, pa.int32()))], names=["word", "n", "near", "near_n", "l", "lo", "hi"])


def _verified(blocks: list[tuple[tuple[int, int, int], list[str], list[int]]]) -> Iterator[pa.RecordBatch]:
    """Near words of these blocks, both ways.  The blocks share length and range of places, and are of a bounded size."""
    l, lo, hi = blocks[0][0]
    tail = max(0, l - hi)
    words = [w for _, own, _ in blocks for w in own]
    n = np.fromiter((x for _, _, own in blocks for x in own), np.int64, len(words))
    sizes = np.array([len(own) for _, own, _ in blocks])
    width = l - tail - lo
    codes = np.array([w[lo : len(w) - tail] for w in words], f"U{width + 1}").view(np.uint32).reshape(len(words), width + 1)
    shorter = np.fromiter((len(w) == l for w in words), bool, len(words))
    i, j = pairs(codes, shorter, np.repeat(np.cumsum(sizes), sizes), hi > l)
    for at in range(0, len(i), 50_000):
        a, b = np.concatenate((i[at : at + 50_000], j[at : at + 50_000])), np.concatenate((j[at : at + 50_000], i[at : at + 50_000]))
        yield _scanned([words[k] for k in a], n[a], [words[k] for k in b], n[b])


def _scan(most: int | None):
    """Goes through sorted rows and verifies the blocks of at most ``most`` words that lie within the task; rows of others,
    and of the first and the last one, which the tasks beside may hold more of, go on.  None: all blocks are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, n = None, [], []
        at_border = is_large = False
        waiting: list = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held
            if waiting:
                yield from _verified(waiting)
            waiting, held = [], 0

        def rest() -> pa.RecordBatch:
            m = len(words)
            return _scanned(words, n, [], [], [key[0]] * m, [key[1]] * m, [key[2]] * m)

        for batch in batches:
            for l, lo, hi, head, tail, word, count in zip(*(batch[k].to_pylist() for k in ("l", "lo", "hi", "head", "tail", "word", "n")), strict=True):
                own = (l, lo, hi, head, tail)
                if own != key:
                    if key is not None:
                        if at_border or is_large:
                            yield rest()
                        elif len(words) > 1:
                            if waiting and (waiting[0][0] != key[:3] or held > CELLS):
                                yield from flush()
                            waiting.append((key[:3], words, n))
                            held += len(words) * (key[0] + 1)
                    at_border, is_large = most is not None and key is None, False
                    key, words, n = own, [], []
                words.append(word)
                n.append(count)
                if most is not None and (len(words) > most or (len(words) > 2 and len(words) * (l + 1) > CELLS)):
                    yield rest()
                    words, n, is_large = [], [], True
        if key is not None:
            if most is not None and words:
                yield rest()
            elif len(words) > 1:
                if waiting and waiting[0][0] != key[:3]:
                    yield from flush()
                waiting.append((key[:3], words, n))
        yield from flush()

    return run


def _sorted(entries: DataFrame, whole: bool) -> DataFrame:
    """Entries in the order of the dictionaries: by length and range of places, prefix, reversed suffix and word."""
    rows = entries.selectExpr("l", "lo", "hi", "substring(word, 1, lo) AS head", "IF(hi < l, right(word, l - hi), '') AS tail", "word", "n", "char_length(word) AS size")
    keys = ["l", "lo", "hi", "head", F.reverse("tail")]
    # the blocks of a single place are bounded, so each is dealt to one task
    dealt = rows.repartition("l", "lo", "hi", "head", "tail") if whole else rows.repartitionByRange(*keys, "word")
    return dealt.sortWithinPartitions(*keys, "size", "word")


def near_words(words: DataFrame, least_chars: int = 7, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) of ``words`` (word, n, each word once): all pairs, both ways, that differ by exactly one inserted,
    deleted or replaced code point, both of at least ``least_chars`` code points.  A word has at most as many near words
    as there are letters for each of its places, so the result grows with the words."""
    own = F.char_length("word")
    lengths = F.explode(F.when(own > least_chars, F.array(own, own - 1)).otherwise(F.array(own)))
    entries = words.where(own >= least_chars).select("word", "n", lengths.alias("l"))
    halves = F.expr("explode(array(named_struct('lo', l div 2, 'hi', l + 1), named_struct('lo', 0, 'hi', l div 2)))")
    entries = entries.select("word", "n", "l", halves.alias("at")).selectExpr("word", "n", "l", "CAST(at.lo AS int) AS lo", "CAST(at.hi AS int) AS hi")
    found, last = [], None
    while True:
        scanned = written(_sorted(entries.where("hi - lo > 1"), False).mapInArrow(_scan(block), SCANNED), "near")
        # a single place is not subdivided
        single = written(_sorted(entries.where("hi - lo = 1"), True).mapInArrow(_scan(None), SCANNED), "near-single")
        found += [scanned, single]
        if last is not None:
            forget(last)
        left = scanned.where("near IS NULL")
        if left.isEmpty():
            break
        halved = F.expr("explode(array(named_struct('lo', lo, 'hi', (lo + hi) div 2), named_struct('lo', (lo + hi) div 2, 'hi', hi)))")
        last = written(left.select("word", "n", "l", halved.alias("at")).selectExpr("word", "n", "l", "CAST(at.lo AS int) AS lo", "CAST(at.hi AS int) AS hi"), "subdivided")
        entries = last
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.where("near IS NOT NULL").select("word", "near", "near_n")


#: Parts that the rows which lead to one word are dealt over.
SALTS = 16


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where the forms of forms end.  Each step doubles how far is looked; as many
    words may lead to one, both sides of a step are salted."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        left = at.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
        right = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        further = written(left.join(right, ["root", "salt"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = not further.where("moved").isEmpty()
        forget(at)
        at = further
        if not moved:
            return at.select("word", "root")


def group_variants(docs: DataFrame, least_chars: int = 7, least_count: int = 2, one_in: int = 31, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (see ``count_words``).

    n_near counts a word's near words.  form is the near word of largest n, of equal ones the first in code-point order,
    if that n is at least ``times`` the word's own; else null, and so is form_n.  root follows forms to the last one, and
    is the word itself where it has none.  A table without words gives no rows."""
    words = written(count_words(docs, least_chars, least_count, one_in), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best")
    near = near_words(words, least_chars).groupBy("word").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.rank") >= times * F.col("n")
    joined = words.join(near, "word", "left").select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.rank")).alias("form_n"))
    rows = written(joined, "forms")
    found = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
