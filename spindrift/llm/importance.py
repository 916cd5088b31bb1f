"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target texts and one of all texts, give each text a log
importance weight: the sum over its n-grams of the log ratio of the two models.  Gumbel noise, seeded by the doc_id, is
added and the k largest keys are taken, which samples k texts without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm import words as W
from spindrift.llm.common import repeated, slices, utf8, written

#: Buckets of the models: fixed, so a model is 2 * 8 bytes each, whatever the input.
BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Labelled rows that the target model is fitted on at most; their ids are broadcast.
MOST_LABELLED = 1 << 17
U = np.uint64


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets of all unigrams and bigrams, row of each)."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        body = data[offsets[lo] : offsets[hi]]
        starts, ends, at = W.bounds(body, own)
        hashed = W.hashes(body, starts, ends, fold=True)
        rows = np.repeat(np.arange(hi - lo), np.diff(at))
        pairs = W.windows(hashed, 2)
        inside = rows[1:] == rows[:-1]
        yield lo, np.concatenate((hashed, pairs[inside] if len(hashed) > 1 else pairs)) % U(BUCKETS), np.concatenate((rows, rows[1:][inside]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, buckets, _ in _features(batch["text"]):
            counts += np.bincount(buckets.astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    yield pa.record_batch({"bucket": pa.array(found, pa.int32()), "n": pa.array(counts[found], pa.int64())})


def labelled_texts(docs: DataFrame, ids: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(text) of the rows of ``docs`` (doc_id, text) whose doc_id is in ``ids`` (doc_id), to fit a model on.

    At most ``most`` distinct ids are used, those of smallest hash, so reruns agree; null ids match nothing.  Thus what is
    broadcast is bounded, and no text is shuffled however many labels there are.
    """
    ids = ids.select(F.col("doc_id").alias("_labelled")).where("_labelled is not null").distinct()
    ids = ids.orderBy(F.xxhash64("_labelled"), "_labelled").limit(most)
    return docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_labelled"), "left_semi").select("text")


def model(texts: DataFrame) -> np.ndarray:
    """Log share of each bucket in all of ``texts`` (text)."""
    counts = np.zeros(BUCKETS)
    for bucket, n in texts.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS))


def _weigh(ratio, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(ratio.value, np.float64)
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for lo, buckets, rows in _features(batch["text"]):
                if len(rows):
                    per = np.bincount(rows, minlength=int(rows.max()) + 1)
                    n[lo : lo + len(per)] += per
                    total[lo : lo + len(per)] += np.bincount(rows, table[buckets.astype(np.int64)], minlength=len(per))
            ids = batch["place"].to_numpy().view(np.uint64)
            uniform = ((W.mix(ids + U(seed)) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_features": pa.array(n), "log_weight": pa.array(total), "gumbel_key": pa.array(total - np.log(-np.log(uniform)))})

    return run


def _kth(keys: DataFrame, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest of a double column ``key``.

    The interval that holds it is narrowed by counts until it holds few rows or one value; only then rows are ordered."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        edges = np.unique(np.linspace(low, high, bins + 1))
        if len(edges) < 3 or inside.count() <= few:
            return inside.orderBy(F.desc("key")).limit(k).agg(F.min("key")).first()[0]
        width = (high - low) / bins
        place = F.greatest(F.lit(0), F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)))
        found = inside.groupBy(place.alias("bin")).agg(F.count("*"), F.min("key"), F.max("key")).collect()
        for _, n, least, most in sorted(found, reverse=True):
            if n >= k:
                low, high = least, most
                break
            k -= n


def resample(docs: DataFrame, target: DataFrame, share: float, seed: int = 29) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key, kept) for each row of ``docs`` (doc_id, text, anything more).

    ``target`` (text) are the texts to resemble.  kept marks the k rows of largest gumbel_key, ties to the smaller doc_id; k
    is ``share`` of all rows, rounded.  The noise depends on seed, doc_id and text alone, so reruns agree.  A null or empty
    text has no n-gram and log weight 0.  Without any target the model of the target is even.  Rows that are equal in every
    way tie and are kept in any order.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    ratio = spark.sparkContext.broadcast((model(target) - model(rows)).tobytes())
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("place")).mapInArrow(_weigh(ratio, seed), f"doc_id {kind}, n_features long, log_weight double, gumbel_key double")
    scored = written(scored, "weights")
    total = scored.count()
    k = min(total, round(total * share))
    if not k:
        return scored.withColumn("kept", F.lit(False))
    bar = _kth(scored.select(F.col("gumbel_key").alias("key")), k)
    above = scored.where(F.col("gumbel_key") > bar).count()
    # rows at the bar that are equal in every way are counted: of a count some are kept, and the rest is not
    same = ("doc_id", "n_features", "log_weight", "gumbel_key")
    at_bar = scored.where(F.col("gumbel_key") == bar).groupBy(*same).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "log_weight").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at_bar = written(at_bar.withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k - above) - before))), "bar")
    parts = [repeated(at_bar.select(*same, n.alias("n")), "n", "nth").select(*same, F.lit(kept).alias("kept")) for n, kept in ((F.col("take"), True), (F.col("n") - F.col("take"), False))]
    return scored.where(F.col("gumbel_key") != bar).withColumn("kept", F.col("gumbel_key") > bar).unionByName(parts[0]).unionByName(parts[1])
