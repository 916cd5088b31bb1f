"""Event streams: windows, sessions, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows; works on streams and tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): a session ends when nothing comes for ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Bucket(StatefulProcessor):
    """A bucket of ``burst`` tokens a key, one more every ``every`` microseconds; a request takes one or is refused.

    The level is kept in microseconds, so it is exact.  State that nothing asked for in ``ttl`` milliseconds, in which a
    bucket fills up, is dropped."""

    def __init__(self, burst: int, every: int, ttl: int) -> None:
        self.burst, self.every, self.ttl = burst, every, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level long, at long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["at", "request"], kind="stable")
        full = self.burst * self.every
        level, before = self.level.get() if self.level.exists() else (full, None)
        allowed = []
        for at in asked["at"].tolist():
            # a request that comes late finds the level as it is
            level = min(full, level + max(0, at - before)) if before is not None else level
            before = at if before is None else max(before, at)
            allowed.append(level >= self.every)
            level -= self.every * allowed[-1]
        self.level.update((level, before))
        yield pd.DataFrame({"address": key[0], "request": asked["request"].to_numpy(), "at": asked["at"].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


#: State with time to live is kept by this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_limited(requests: DataFrame, burst: int = 100, every_seconds: float = 0.6) -> DataFrame:
    """(address, request, at, allowed) of a stream of requests (address, request, ts): a token bucket for each address.

    ``request`` is a number that orders requests of one time; ``at`` is the time in microseconds.  Requests of a micro-batch
    are taken in order of time, so one that comes in a later batch than a younger one finds the younger one's level.  The
    requests of one address in one micro-batch are one task's; limit a batch by the source's options.  The session's state
    store is set to the one that keeps time to live."""
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    every = round(every_seconds * 1_000_000)
    rows = requests.select("address", F.col("request").cast("long").alias("request"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    processor = _Bucket(burst, every, max(60_000, 2 * burst * every // 1000))
    return rows.groupBy("address").transformWithStateInPandas(statefulProcessor=processor, outputStructType="address string, request long, at long, allowed boolean", outputMode="append", timeMode="processingTime")
