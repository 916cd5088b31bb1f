"""Incremental upkeep: changes, versioned tombstones, updates, compaction, staleness, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import as_json


def lastmod_changed(old: Column, new: Column) -> Column:
    """A new date that differs; a date that is gone is no change."""
    return new.isNotNull() & ~old.eqNullSafe(new)


def changes(current: DataFrame, indexed: DataFrame, of: tuple[str, ...] = ()) -> DataFrame:
    """(url, change_type, new_lastmod, old_lastmod) between two tables (url, lastmod), of each value of columns ``of``."""
    key = [*of, "url"]
    new = current.select(*key, F.col("lastmod").alias("new_lastmod"), F.lit(True).alias("here"))
    old = indexed.select(*key, F.col("lastmod").alias("old_lastmod"), F.lit(True).alias("there"))
    kind = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed").when(lastmod_changed(F.col("old_lastmod"), F.col("new_lastmod")), "updated").otherwise("unchanged")
    return new.join(old, key, "full_outer").select(*key, kind.alias("change_type"), "new_lastmod", "old_lastmod")


def change_counts(rows: DataFrame, of: tuple[str, ...] = ()) -> DataFrame:
    counts = [F.count_if(F.col("change_type") == k).alias(f"n_{k}") for k in ("new", "updated", "removed", "unchanged")]
    out = (rows.groupBy(*of).agg(*counts) if of else rows.agg(*counts)).withColumn("total_changes", F.col("n_new") + F.col("n_updated") + F.col("n_removed"))
    return out.withColumn("has_changes", F.col("total_changes") > 0)


def change_report(rows: DataFrame, checked_at: Column, error: Column | None = None) -> DataFrame:
    """(report) of changes, as one JSON text: the URLs of each kind in order, updated ones with their new and old dates.  It is
    as long as the changes are."""
    of = lambda kind, value: F.array_sort(F.collect_list(F.when(F.col("change_type") == kind, value)))
    total = F.count_if(F.col("change_type") != "unchanged")
    values = [of("new", F.col("url")).alias("new_urls"), of("updated", F.array("url", "new_lastmod", "old_lastmod")).alias("updated_urls"), of("removed", F.col("url")).alias("removed_urls"), F.count_if(F.col("change_type") == "unchanged").alias("unchanged_count"), (total > 0).alias("has_changes"), total.alias("total_changes")]
    out = rows.agg(*values)
    return out.select(as_json(*out.columns, checked_at.alias("checked_at"), (error if error is not None else F.lit(None).cast("string")).alias("error")).alias("report"))


def tombstone(chunks: DataFrame, urls: DataFrame) -> DataFrame:
    """(chunk_id, url, version) of the chunks (chunk_id, url, version) of ``urls``."""
    return chunks.join(urls.select("url"), "url", "left_semi").select("chunk_id", "url", "version")


def active(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Chunks without a tombstone of their version, so a page that comes back is found again."""
    return chunks.join(tombstones.select("chunk_id", "version"), ["chunk_id", "version"], "left_anti")


def tombstone_stats(chunks: DataFrame, tombstones: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(n_chunks, n_tombstones, n_urls, ratio, rebuild_needed)."""
    one = chunks.agg(F.count("*").alias("n_chunks")).crossJoin(tombstones.agg(F.count("*").alias("n_tombstones"), F.countDistinct("url").alias("n_urls")))
    ratio = F.coalesce(F.try_divide(F.col("n_tombstones").cast("double"), F.col("n_chunks")), F.lit(0.0))
    return one.withColumn("ratio", F.round(ratio, 6)).withColumn("rebuild_needed", ratio >= threshold)


def update_batch(rows: DataFrame, most: int) -> DataFrame:
    """The new and updated URLs that are read this time, newest first."""
    ord_ = F.coalesce("new_lastmod", F.lit("")).desc()
    return rows.where(F.col("change_type").isin("new", "updated")).orderBy(ord_, "url").limit(most)


@dataclass(frozen=True)
class Applied:
    chunks: DataFrame
    tombstones: DataFrame


def apply_changes(chunks: DataFrame, tombstones: DataFrame, rows: DataFrame, fetched: DataFrame, most: int, version: int) -> Applied:
    """Chunks with ``fetched`` ones (chunk_id, url, ...) of this batch's URLs added as ``version``; tombstones of the removed
    URLs and of those read again, so a page left for a later batch stays found."""
    batch = update_batch(rows, most).select("url", "change_type")
    gone = rows.where("change_type = 'removed'").select("url").unionByName(batch.where("change_type = 'updated'").select("url"))
    fresh = fetched.join(batch.select("url"), "url", "left_semi").withColumn("version", F.lit(version))
    marked = tombstones.unionByName(tombstone(active(chunks, tombstones), gone))
    return Applied(chunks.unionByName(fresh, allowMissingColumns=True), marked)


def compact(chunks: DataFrame, parents: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active chunks, and the parents (parent_id, ...) that one of them refers to."""
    kept = active(chunks, tombstones)
    return kept, parents.join(kept.select("parent_id"), "parent_id", "left_semi")


def needs_update(state: DataFrame, version: str, model: str, most_pages: int, now: Column, hours: float) -> DataFrame:
    """Why an index of one state row (version, embedding_model, max_pages, last_update) is stale; null where it is not."""
    age = (now.cast("long") - F.col("last_update").cast("long")) >= hours * 3600
    why = F.when(F.col("last_update").isNull(), "never built").when(~F.col("version").eqNullSafe(F.lit(version)), "version").when(~F.col("embedding_model").eqNullSafe(F.lit(model)), "embedding model").when(F.col("max_pages") < most_pages, "more pages").when(age, "age")
    return state.withColumn("reason", why)


def running_totals(log: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Counters of updates so far, of (updater, checked_at, ...)."""
    so_far = Window.partitionBy("updater").orderBy("checked_at").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("updater", "checked_at", F.count("*").over(so_far).alias("checks"), *(F.sum(c).over(so_far).alias(c) for c in columns))


def keep_first_by_hash(pages: DataFrame, text: str, ord_: str) -> DataFrame:
    """Of rows with equal texts the first; only digests and places are dealt out to find them."""
    firsts = pages.groupBy(F.sha2(text, 256).alias("_h")).agg(F.min(ord_).alias("_first"))
    return pages.join(firsts, (F.sha2(F.col(text), 256) == F.col("_h")) & (F.col(ord_) == F.col("_first")), "left_semi")
