"""The periodic updater: snapshots of sites' sitemaps and commands come as streams, each site is a key with state and timers.

``decisions`` is the clock: of each site it keeps when it was last checked and whether it is paused, and timers say when a
check is due.  ``Updater`` makes the checks that are due: it compares a site's last snapshot with what is indexed of it,
applies the changes to the index, and takes over as indexed only the URLs that were dealt with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spindrift.operators import maintain
from spindrift.sources.store import Store, stored
from spindrift.streaming.events import ROCKS

#: Applies changes (site, url, change_type, new_lastmod, old_lastmod) of a round of checks; the URLs (site, url) that were
#: dealt with, or None where all were.  An error leaves all as it was.
Apply = Callable[[DataFrame, int], DataFrame | None]

INDEXED = "site string, url string, lastmod string"
LOG = "check_id long, site string, n_new long, n_updated long, n_removed long, n_unchanged long, has_changes boolean, n_applied long, error string"


@dataclass(frozen=True)
class Updater:
    """Checks of sites whose pages are in one index.  ``folder`` holds what is indexed after each round and a log row for each
    site's check.

    A round writes under its batch's number, so one that is run again after a lost driver replaces itself.  An error of
    ``apply`` is logged, what is indexed stays as it was, and the next round goes on.  A URL that ``apply`` did not deal with,
    as beyond a batch's limit or not read, stays as it was indexed, so the next check of its site finds it again."""

    spark: SparkSession
    folder: str
    apply: Apply = lambda changes, number: None

    @property
    def store(self) -> Store:
        return Store(self.spark, self.folder)

    def indexed(self, before: int | None = None) -> DataFrame:
        """(site, url, lastmod) after the last round, or the last one before a number."""
        last = self.store.last("indexed", before)
        return self.store.read("indexed", [] if last is None else [last], INDEXED)

    def check(self, snapshot: DataFrame, number: int, due: DataFrame | None = None) -> None:
        """One round over a snapshot (url, lastmod, optionally site) of the sites that are ``due`` (site), or of those in it.  A
        site that is due without a URL is logged as an error, as all its pages would have to be removed."""
        rows = snapshot if "site" in snapshot.columns else snapshot.withColumn("site", F.lit(""))
        rows = stored(rows.select("site", "url", "lastmod"), "snapshot")
        sites = stored((due.select("site") if due is not None else rows.select("site") if not rows.isEmpty() or "site" in snapshot.columns else self.spark.createDataFrame([("",)], "site string")).distinct(), "sites")
        known = stored(self.indexed(number), "known")
        rows = rows.join(sites, "site", "left_semi")
        empty = sites.join(rows.select("site"), "site", "left_anti")
        own = known.join(sites, "site", "left_semi")
        changes = stored(maintain.changes(rows, own, ("site",)), "changes")
        wanted = changes.where("change_type <> 'unchanged'").join(empty, "site", "left_anti")
        error, done = None, None
        if not wanted.isEmpty():
            try:
                done = self.apply(wanted, number)
            except Exception as failed:  # any error of a round is its result
                error = f"{type(failed).__name__}: {failed}"[:500]
        if error:
            applied = wanted.where("false")
        else:
            applied = wanted if done is None else wanted.join(done.select("site", "url").distinct(), ["site", "url"], "left_semi")
        applied = stored(applied, "applied")
        stays = known.join(applied.select("site", "url"), ["site", "url"], "left_anti")
        new = applied.where("change_type <> 'removed'").select("site", "url", F.col("new_lastmod").alias("lastmod"))
        self.store.write("indexed", stays.unionByName(new), number)
        counts = maintain.change_counts(changes, ("site",)).drop("total_changes")
        n_applied = applied.groupBy("site").agg(F.count("*").alias("n_applied"))
        told = empty.select("site", F.lit("ValueError: the snapshot has no URL").alias("none"))
        log = sites.join(counts, "site", "left").join(n_applied, "site", "left").join(told, "site", "left")
        failed_here = F.coalesce("none", F.when(F.col("has_changes"), F.lit(error)))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        log = log.select(F.lit(number).cast("long").alias("check_id"), "site", *(zero(c) for c in ("n_new", "n_updated", "n_removed", "n_unchanged")), F.coalesce("has_changes", F.lit(False)).alias("has_changes"), zero("n_applied"), failed_here.alias("error"))
        self.store.write("log", log.coalesce(1), number)

    def start(self, snapshots: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Checks each batch of a stream of snapshots, once over what is there or every so often."""
        writer = snapshots.writeStream.foreachBatch(self.check).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def start_timed(self, due: DataFrame, snapshot_of: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Checks the sites that ``decisions`` says are due (site, ...), each by the snapshot (site, url, lastmod) that
        ``snapshot_of`` gives for them."""

        def round_of(sites: DataFrame, number: int) -> None:
            sites = stored(sites.select("site").distinct(), "due")
            if not sites.isEmpty():
                self.check(snapshot_of(sites), number, sites)

        writer = due.writeStream.outputMode("append").foreachBatch(round_of).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def log(self) -> DataFrame:
        return self.store.read("log", self.store.all("log"), LOG)

    def status(self, last_check: Column, interval_hours: float) -> DataFrame:
        """(checks, checks_with_changes, errors, n_new, n_updated, n_removed, n_applied, next_check) so far."""
        totals = [F.sum(c).alias(c) for c in ("n_new", "n_updated", "n_removed", "n_applied")]
        out = self.log().agg(F.count("*").alias("checks"), F.count_if("has_changes").alias("checks_with_changes"), F.count("error").alias("errors"), *totals)
        return out.withColumn("next_check", F.timestamp_seconds(last_check.cast("double") + interval_hours * 3600))


#: Commands to the clock of a site, and what it says: a check is due, or a command was refused.
ADD, CHECK, PAUSE, RESUME, REMOVE, TICK = "add", "check", "pause", "resume", "remove", "tick"
DECISIONS = "site string, at timestamp, what string, reason string"


class _Clock(StatefulProcessor):
    """When checks of a site are due, by event time: the first ``first`` seconds after the site is added, then every
    ``interval``, at once by command but never within ``least`` of the last one, and none while paused.  A check that falls
    due in a pause is due when that ends."""

    def __init__(self, first: float, interval: float, least: float) -> None:
        self.first, self.interval, self.least = (round(s * 1000) for s in (first, interval, least))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Times in milliseconds; 0 is never.
        self.state = handle.getValueState("clock", "last long, next long, paused boolean")

    def _keep(self, held: tuple[int, int, bool] | None) -> None:
        """Keeps a site's state; when its next check is due is its only timer, and none while it is paused."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.state.clear()
            return
        if not held[2]:
            self.handle.registerTimer(held[1])
        self.state.update(held)

    def _due(self, held: tuple[int, int, bool], now: int) -> Iterator[tuple[int, tuple[int, int, bool]]]:
        """Checks that fall due up to now, whether or not the watermark has come so far."""
        while not held[2] and held[1] <= now:
            at = held[1]
            held = at, at + self.interval, False
            yield at, held

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["ms", "command"], kind="stable")
        held = tuple(self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        for now, command in zip(asked["ms"].tolist(), asked["command"], strict=True):
            for due, held in self._due(held, now) if held else ():  # noqa: B020
                out.append((due, "due", "timer"))
            refused = None
            if command == TICK:
                continue
            if command == ADD:
                held = held or (0, now + self.first, False)
            elif held is None:
                refused = "unknown site"
            elif command == REMOVE:
                held = None
            elif command == PAUSE:
                held = held[0], held[1], True
            elif command == RESUME:
                held = (held[0], max(held[1], now + 1), False) if held[2] else held
            elif command != CHECK:
                refused = "unknown command"
            elif held[2]:
                refused = "paused"
            elif held[0] and now - held[0] < self.least:
                refused = "checked lately"
            else:
                held = now, now + self.interval, False
                out.append((now, "due", "command"))
            if refused:
                out.append((now, "refused", refused))
        if held is not None or self.state.exists():
            self._keep(held)
        yield self._said(key, out)

    def _said(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *said) for said in out], columns=["site", "ms", "what", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        out = []
        # up to the watermark, as a timer that is set here is looked at with the next batch only
        for due, held in self._due(held, timerValues.getCurrentWatermarkInMs()) if held else ():  # noqa: B020
            out.append((due, "due", "timer"))
        if out:
            self._keep(held)
        yield self._said(key, out)

    def close(self) -> None:
        pass


def decisions(commands: DataFrame, first: float = 60, interval: float = 6 * 3600, least: float = 300, late: str = "0 seconds") -> DataFrame:
    """(site, at, what, reason) of a stream of commands (site, at, command): the checks that are due, and commands refused.

    Commands are add, check, pause, resume, remove and tick, which does nothing.  Times are event times,
    so timers fire as the stream's watermark, ``late`` behind the newest command of any site, goes on: ticks keep the time.
    State is one row a site, dealt by site, in the session's state store, which is set to the one that has timers."""
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = F.col("at").cast("timestamp")
    rows = commands.select("site", at.alias("at"), F.unix_millis(at).alias("ms"), "command").withWatermark("at", late)
    said = rows.groupBy("site").transformWithStateInPandas(statefulProcessor=_Clock(first, interval, least), outputStructType="site string, ms long, what string, reason string", outputMode="append", timeMode="eventTime")
    return said.select("site", F.timestamp_millis("ms").alias("at"), "what", "reason")

