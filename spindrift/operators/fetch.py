"""Fetching of many URLs: few calls a host at a time, retries with growing pauses, a log row for each attempt."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.url import site

#: Calls one URL: (final_url, content_type, status, body).  An error is a network error.
Get = Callable[[str], tuple[str | None, str | None, int, str | None]]

#: No answer, and answers that may be better later.
NETWORK = 0
AGAIN = (NETWORK, 408, 425, 429, 500, 502, 503, 504)
ATTEMPT = "url string, attempt int, waited double, status int, error string, last boolean, final_url string, content_type string, body string"


def _called(get: Get, tries: int, pause: float, most_pause: float, sleep: Callable[[float], None]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for url in part["url"]:
                rows, wait = [], 0.0
                for attempt in range(1, tries + 1):
                    if attempt > 1:
                        wait = min(most_pause, pause * 2 ** (attempt - 2))
                        sleep(wait)
                    error = None
                    try:
                        final, kind, status, body = get(url)
                    except Exception as failed:  # any error of a call is its answer
                        final, kind, status, body, error = None, None, NETWORK, None, f"{type(failed).__name__}: {failed}"[:500]
                    last = status not in AGAIN or attempt == tries
                    rows.append((url, attempt, wait, status, error, last, final, kind, body if last else None))
                    if last:
                        break
                yield pd.DataFrame(rows, columns=["url", "attempt", "waited", "status", "error", "last", "final_url", "content_type", "body"])

    return run


def attempts(urls: DataFrame, get: Get, per_host: int = 2, tries: int = 3, pause: float = 1.0, most_pause: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, attempt, waited, status, error, last, final_url, content_type, body): each attempt to fetch ``urls`` (url).

    A host's URLs are dealt to ``per_host`` lanes by a hash of the URL, and a lane is one task's, which calls one URL after
    the other: so no host has more calls at a time, and a host with very many URLs is as many tasks as it allows calls.
    Answers that may be better later, and errors, are tried up to ``tries`` times with pauses that double.  A URL that is
    repeated is called once; a null one is left out.  An attempt that is run again by Spark calls again, so store the rows."""
    lane = F.pmod(F.xxhash64("url"), F.lit(per_host)).alias("lane")
    rows = urls.where("url is not null").select("url", F.coalesce(site(F.col("url")), F.lit("")).alias("host"), lane).dropDuplicates(["url"])
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "host", "lane").sortWithinPartitions("host", "lane", "url")
    return dealt.select("url").mapInPandas(_called(get, tries, pause, most_pause, sleep), ATTEMPT)


def fetched(log: DataFrame) -> DataFrame:
    """(url, final_url, content_type, status, body) of the last attempts of a stored log, as ``crawl.accepted`` takes them."""
    return log.where("last").select("url", "final_url", "content_type", "status", "body")
