"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent character n-grams in order.  A document's own list is compared with each
by out-of-place distance: for each of its n-grams the difference of the two ranks, or the profile's length where the
profile lacks it.  The nearest language wins.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import all_but_text, slices, utf8

#: N-grams of 1 to LONGEST letters; of a profile, the first PROFILE.
LONGEST = 3
PROFILE = 300
#: N-grams that a task holds before it passes its counts on.
HELD_GRAMS = 1 << 21
UNKNOWN = "und"
_BITS = 21  # of a code point


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a blank."""
    table = np.full(sys.maxunicode + 1, 0x20, np.int32)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def _grams(points: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of a text; runs of other characters count as one blank, and none starts or ends with more."""
    points = _letters()[points]
    blank = points == 0x20
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    points = np.concatenate(([0x20], points[keep], [0x20])).astype(np.int64)
    letter = points != 0x20
    out = [points[letter]]
    code = points
    for n in range(2, LONGEST + 1):
        code = (code[:-1] << _BITS) | points[n - 1 :]
        within = letter[: len(code)] | letter[n - 1 :]
        for k in range(1, n - 1):  # a blank only at either end
            within &= letter[k : k + len(code)]
        out.append(code[within])
    return np.concatenate(out)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and their counts."""
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[at], np.diff(np.append(at, len(values)))


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for row, text in enumerate(column):
        own = text.as_py()
        yield row, np.frombuffer((own or "").encode("utf-32-le", "replace"), np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang: str) -> pa.RecordBatch:
        grams, counts = held.pop(lang)
        return pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams), "n": pa.array(counts)})

    def merge(lang: str, parts: list[np.ndarray]) -> None:
        grams, counts = _runs(np.concatenate(parts))
        if lang in held:
            both = np.concatenate((held[lang][0], grams))
            weights = np.concatenate((held[lang][1], counts))
            grams, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, weights).astype(np.int64)
        held[lang] = grams, counts

    for batch in batches:
        langs = batch["lang"].to_pylist()
        for lo, hi in slices(utf8(batch["text"])[1]):
            parts: dict[str, list[np.ndarray]] = {}
            for row, points in _texts(batch["text"].slice(lo, hi - lo)):
                if len(points):
                    parts.setdefault(langs[lo + row], []).append(_grams(points))
            for lang, own in parts.items():
                merge(lang, own)
                if len(held[lang][0]) > HELD_GRAMS:
                    yield out(lang)
    for lang in list(held):
        yield out(lang)


def learn_profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams over all ``docs`` (text, lang), most frequent first, ties by code.

    Counts are added up in each task and then by Spark; PROFILE numbers a language come to the driver."""
    counts = docs.where("lang is not null").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list] = {}
    for lang, gram, _ in sorted(counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank").collect(), key=lambda r: (r[0], r[2])):
        profiles.setdefault(lang, []).append(gram)
    return {lang: np.array(own, np.int64) for lang, own in profiles.items()}


def _predict(shared, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        sorted_profiles = []
        for own in profiles.values():
            by = np.argsort(own)
            sorted_profiles.append((own[by], by))
        names = list(profiles)
        for batch in batches:
            preds, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for row, points in _texts(batch["text"]):
                if not len(points) or not names:
                    continue
                all_grams = _grams(points)
                if not len(all_grams):
                    continue
                grams, counts = _runs(all_grams)
                if not (grams < 1 << _BITS).any():  # no letter
                    continue
                top = np.lexsort((grams, -counts))[:PROFILE]
                own = grams[top]
                ranks = np.arange(len(own))
                best = None
                for k, (keys, at) in enumerate(sorted_profiles):
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    away = np.where(keys[place] == own, np.minimum(np.abs(at[place] - ranks), PROFILE), PROFILE).sum()
                    if best is None or away < best[0]:
                        best = away, k
                preds[row] = names[best[1]]
                scores[row] = 1 - best[0] / (PROFILE * len(own))
            texts = {"text": batch["text"]} if with_text else {}
            yield pa.record_batch({"row": batch["row"], **texts, "lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores)})

    return run


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (text, anything more), or its columns ``keep``, with lang_pred and score.

    lang_pred is a learned language, the first by name among equally near ones, or ``und`` where the text is null or
    has no letter, or where nothing was learned; then score is 0.  score is 1 - distance / greatest distance, in 0 to
    1.  Whole texts count.  An incoming column named like an added one is replaced.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")))
    shared = docs.sparkSession.sparkContext.broadcast(dict(sorted(profiles.items())))
    names = [c for c in docs.columns if keep is None or c in keep]
    packed = docs.select(all_but_text(names).alias("row"), F.col("text"))
    text = "text string, " if "text" in names else ""
    out = packed.mapInArrow(_predict(shared, bool(text)), f"row {packed.schema['row'].dataType.simpleString()}, {text}lang_pred string, score double")
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names), "lang_pred", "score")


#: Below this score a text resembles no learned language.  Labelled texts of the tables score 0.36 and more, unlearned
#: languages in Latin script up to 0.32 and random letters from 50 characters on mostly under 0.3.  A few n-grams tell
#: less: junk of one or two words often scores above.
LEAST_SCORE = 0.34


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the doc_id as text leaves 2 on division by 4; a null doc_id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
