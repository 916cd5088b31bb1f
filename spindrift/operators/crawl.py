"""Discovery: URL tables, order and limits, caches, failures, robots rules, link graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.url import root_domain
from spindrift.sources.store import shared_folder


def last_value_first_place(urls: DataFrame) -> DataFrame:
    """One row a URL of (url, lastmod, ord): the last row's lastmod at the first row's place."""
    return urls.groupBy("url").agg(F.max_by("lastmod", "ord").alias("lastmod"), F.min("ord").alias("ord"))


def newest_first(urls: DataFrame, most: int | None = None) -> DataFrame:
    """By lastmod, newest first, none last, ties in order; at most ``most``."""
    out = urls.orderBy(F.coalesce("lastmod", F.lit("")).desc(), "ord")
    return out.limit(most) if most else out


def discover(manual: DataFrame, found: DataFrame, manual_only: bool = False, most: int | None = None) -> DataFrame:
    """Manual URLs and found ones, (url, lastmod, ord) each; manual ones alone skip deduplication and limit."""
    if manual_only:
        return manual
    both = manual.withColumn("side", F.lit(0)).unionByName(found.withColumn("side", F.lit(1)))
    both = both.withColumn("ord", F.col("side") * F.lit(1 << 62) + F.col("ord")).drop("side")
    return newest_first(last_value_first_place(both), most)


def cache_state(urls: DataFrame, cache: DataFrame, now: Column, ttl_hours: float, force: bool = False) -> DataFrame:
    """``urls`` (url, lastmod) with hit: cached under an equal lastmod or, without one, young enough (0 hours: any age)."""
    kept = cache.select("url", F.col("lastmod").alias("cached_lastmod"), "cached_at")
    young = F.lit(True) if ttl_hours == 0 else (now.cast("long") - F.col("cached_at").cast("long")) < ttl_hours * 3600
    hit = F.col("cached_at").isNotNull() & F.when(F.col("lastmod").isNotNull(), F.coalesce(F.col("cached_lastmod") == F.col("lastmod"), F.lit(False))).otherwise(young)
    return urls.join(kept, "url", "left").withColumn("hit", F.lit(False) if force else F.coalesce(hit, F.lit(False)))


def accepted(fetched: DataFrame, start: Column) -> DataFrame:
    """Fetched rows (url, final_url, content_type, status, body): html only of pages on the site, well and in HTML."""
    from spindrift.functions.url import same_site

    ok = same_site(F.coalesce("final_url", "url"), start) & F.col("status").between(200, 399) & F.lower("content_type").contains("text/html")
    return fetched.withColumn("html", F.when(F.coalesce(ok, F.lit(False)), F.col("body")).otherwise(""))


def status_histogram(log: DataFrame) -> DataFrame:
    """(status, n, percent), failures without a status last."""
    total = F.sum("n").over(Window.partitionBy())
    out = log.groupBy("status").agg(F.count("*").alias("n"))
    return out.withColumn("percent", F.round(F.col("n") * 100.0 / total, 6)).orderBy(F.col("status") <= 0, "status")


def failures(log: DataFrame) -> DataFrame:
    """(url, failure_count, first_error, last_error, last_attempt) since each URL's last success, of (url, attempt, ok, error)."""
    last_ok = log.where("ok").groupBy("url").agg(F.max("attempt").alias("ok_at"))
    bad = log.where("not ok").join(last_ok, "url", "left").where("ok_at is null or attempt > ok_at")
    return bad.groupBy("url").agg(F.count("*").alias("failure_count"), F.min_by("error", "attempt").alias("first_error"), F.max_by("error", "attempt").alias("last_error"), F.max("attempt").alias("last_attempt"))


def fetch_set(urls: DataFrame, failed: DataFrame, indexed: DataFrame | None = None, most_failures: int = 3) -> DataFrame:
    """``urls`` that have not failed too often and, unless all are read again, are not indexed."""
    out = urls.join(failed.where(F.col("failure_count") >= most_failures).select("url"), "url", "left_anti")
    return out if indexed is None else out.join(indexed.select("url"), "url", "left_anti")


def reachable(links: DataFrame, start: DataFrame, depth: int, wanted: Callable[[Column], Column] | None = None, most: int | None = None) -> DataFrame:
    """(node, depth) within ``depth`` steps of ``start`` (node) along ``links`` (src, dst), breadth first.

    Nodes that are not ``wanted`` are neither given nor followed.  At most ``most`` nodes are given, those nearest to the start,
    and of one depth the first by name.  Each level joins only the level before and leaves out what was seen, so no path is walked twice.  Levels are written, so
    the plan does not grow with the depth; it ends early where a level is empty."""
    spark = links.sparkSession
    folder = shared_folder(spark, "levels")
    level_at = lambda n: f"{folder}/depth={n}"
    read = lambda last: spark.read.option("basePath", folder).parquet(*(level_at(n) for n in range(last + 1)))
    fit = lambda rows: rows if wanted is None else rows.where(wanted(F.col("node")))
    fit(start.select("node").distinct()).write.parquet(level_at(0))
    last = 0
    for level in range(1, depth + 1):
        frontier = spark.read.parquet(level_at(last)).join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fit(frontier).join(read(last).select("node"), "node", "left_anti").write.parquet(level_at(level))
        last = level
        if spark.read.parquet(level_at(level)).isEmpty() or (most is not None and read(last).count() >= most):
            break
    out = read(last).select("node", F.col("depth").cast("int").alias("depth"))
    return out if most is None else out.orderBy("depth", "node").limit(most)


def robots_places(url: Column) -> Column:
    """Where a site's robots file may be: on its host, then on its root domain if the host has more labels."""
    scheme, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("AUTHORITY"))
    own = F.concat(scheme, F.lit("://"), host, F.lit("/robots.txt"))
    return F.array_distinct(F.array(own, F.concat(scheme, F.lit("://"), root_domain(url), F.lit("/robots.txt"))))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(site, ord, url) of the sitemaps that robots files (site, text) name."""
    lines = files.select("site", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("ord", "line"))
    return lines.select("site", "ord", F.trim(F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(.*)$", 1)).alias("url")).where("url <> ''")


# Where sitemaps are looked for when a robots file names none.
SITEMAP_PLACES = ("/sitemap.xml", "/sitemap_index.xml", "/server-sitemap.xml")


def sitemap_places(sites: DataFrame, named: DataFrame) -> DataFrame:
    """(site, priority, sitemap) to try for sites (site, url): those that robots files name, (site, ord, url), come first."""
    root = F.concat(F.try_parse_url("url", F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url("url", F.lit("AUTHORITY")))
    usual = sites.select("site", F.posexplode(F.array(*(F.concat(root, F.lit(p)) for p in SITEMAP_PLACES))).alias("n", "sitemap"))
    usual = usual.select("site", (F.col("n") + F.lit(1 << 40)).alias("priority"), "sitemap")
    return named.select("site", F.col("ord").cast("long").alias("priority"), F.col("url").alias("sitemap")).unionByName(usual)


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(site, rules) of robots files (site, text): the rules for ``agent``, each allow and path, in order.  A robots file is read
    as Python's own parser does; one without rules for the agent gives an empty array."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for text in part["text"]:
                parser = RobotFileParser()
                parser.parse((text or "").splitlines())
                entry = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
                found.append([(line.allowance, unquote(line.path)) for line in entry.rulelines] if entry else [])
            yield pd.DataFrame({"site": part["site"], "rules": found})

    return files.select("site", "text").mapInPandas(run, "site string, rules array<struct<allow:boolean,path:string>>")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (site, url, ...) with allowed: by the first of the site's rules that the URL's path and query start with;
    allowed without any, and on sites without a robots file."""
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    rows = urls.join(rules.select("site", F.col("rules").alias("_rules")), "site", "left")
    rows = rows.withColumn("_path", F.when(path == "", "/").otherwise(path))
    first = F.try_element_at(F.filter("_rules", lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"])), F.lit(1))
    return rows.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("_rules", "_path")
