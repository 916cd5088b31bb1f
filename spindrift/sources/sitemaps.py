"""Sitemaps: URL sets, indexes with a cache, discovery order, links in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.store import stored

_ENTRY = "array<struct<loc:string,lastmod:string>>"


def _plain(xml: Column) -> Column:
    """Without prolog, namespaces and prefixes, which hide elements from a schema."""
    out = F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(out, r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", ""), r"<(/?)\w+:", "<$1")


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(sitemap, kind, ord, loc, lastmod) of files (sitemap, xml): ``url`` rows of URL sets, ``sitemap`` rows of indexes.

    A file that does not parse gives no row."""
    body = F.from_xml(_plain(F.col("xml")), f"url {_ENTRY}, sitemap {_ENTRY}", {"mode": "PERMISSIVE"})
    parsed = files.withColumn("body", body)
    rows = None
    for kind in ("url", "sitemap"):
        own = parsed.select("sitemap", F.lit(kind).alias("kind"), F.posexplode(f"body.{kind}").alias("ord", "e")).select("sitemap", "kind", "ord", F.trim("e.loc").alias("loc"), F.trim("e.lastmod").alias("lastmod"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.where("coalesce(loc, '') <> ''")


def newest_rank(group: list[str]) -> Column:
    """Place within the group by lastmod, newest first, none last, ties in order (ord)."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(F.coalesce("lastmod", F.lit("")).desc(), "ord"))


def to_fetch(subs: DataFrame, cache: DataFrame) -> DataFrame:
    """Sub-sitemaps (sitemap, lastmod) with fetch: not cached under an equal lastmod; else the cached urls."""
    joined = subs.join(cache.select("sitemap", F.col("lastmod").alias("cached"), "urls"), "sitemap", "left")
    fresh = F.col("lastmod").isNotNull() & F.coalesce(F.col("cached") == F.col("lastmod"), F.lit(False))
    return joined.withColumns({"fetch": ~fresh, "urls": F.when(fresh, F.col("urls"))}).drop("cached")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their number from 1 in this order: dealt by range, so the driver sees a count for each range and no task
    has all rows."""
    spark = rows.sparkSession
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    before, firsts = 1, []
    for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        firsts.append((r.part, before))
        before += r.n
    own = spark.createDataFrame(firsts, "_part long, _first long")
    return dealt.withColumn("_part", part).join(F.broadcast(own), "_part").withColumn("number", F.col("_first") + within).drop("_part", "_first", "_id")


def resolve(files: DataFrame, roots: DataFrame, cache: DataFrame | None = None, most_depth: int = 8) -> DataFrame:
    """(url, lastmod, place, from_cache) of the URL sets under ``roots`` (sitemap, optionally ord): files (sitemap, xml) are read
    level by level.

    Roots stand in the order of ``ord``, or else of their names.  Sub-sitemaps of an index stand newest first and so do the
    URLs of a set; ordering by ``place`` gives that order.  A sub-sitemap cached under an equal lastmod, in cache (sitemap,
    lastmod, urls: array of loc and lastmod), gives its cached URLs; others are looked up in files, and one that is not there
    or does not parse gives none.  Indexes deeper than ``most_depth`` are not followed, so those that refer to each other end."""
    spark = files.sparkSession
    cache = cache if cache is not None else spark.createDataFrame([], f"sitemap string, lastmod string, urls {_ENTRY}")
    order = ["ord", "sitemap"] if "ord" in roots.columns else ["sitemap"]
    at = numbered(roots.select(*order), *order).select("sitemap", F.lit(None).cast("string").alias("lastmod"), F.array(F.col("number").cast("int")).alias("place"))
    found = None
    for _ in range(most_depth + 1):
        known = stored(to_fetch(at, cache), "sitemaps")
        kept = known.where("not fetch").select(F.posexplode("urls").alias("ord", "e"), "place").select("place", "ord", F.col("e.loc").alias("loc"), F.col("e.lastmod").alias("lastmod"), F.lit(True).alias("from_cache"))
        read = known.where("fetch").select("sitemap", "place").join(files, "sitemap")
        entries = stored(sitemap_entries(read).join(read.select("sitemap", "place"), "sitemap"), "entries")
        own = entries.where("kind = 'url'").select("place", "ord", "loc", "lastmod", F.lit(False).alias("from_cache")).unionByName(kept)
        found = own if found is None else found.unionByName(own)
        subs = entries.where("kind = 'sitemap'").withColumn("rank", newest_rank(["place"]))
        at = subs.select(F.col("loc").alias("sitemap"), "lastmod", F.concat("place", F.array("rank")).alias("place"))
        if entries.where("kind = 'sitemap'").isEmpty():
            break
    return found.withColumn("rank", newest_rank(["place"])).select(F.col("loc").alias("url"), "lastmod", F.concat("place", F.array("rank")).alias("place"), "from_cache")


def first_filled(candidates: DataFrame) -> DataFrame:
    """Of (site, priority, n_urls, sitemap), each site's first candidate that has URLs."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy("priority"))
    return candidates.where("n_urls > 0").withColumn("rank", rank).where("rank = 1").drop("rank")


def links(pages: DataFrame) -> DataFrame:
    """(page, href) of the links in pages (page, html), but for mail, telephone, script and fragment links."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"'>]*)[\"']"), F.lit(1))
    rows = pages.select("page", F.explode(found).alias("href")).withColumn("href", F.trim("href"))
    return rows.where(~F.lower("href").rlike(r"^(mailto:|tel:|javascript:|#)") & (F.col("href") != ""))


def absolute(page: Column, href: Column) -> Column:
    """A link's URL: absolute as it is, from the host's root, or beside the page."""
    scheme = F.try_parse_url(page, F.lit("PROTOCOL"))
    root = F.concat(scheme, F.lit("://"), F.try_parse_url(page, F.lit("AUTHORITY")))
    beside = F.concat(F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"/[^/]*$", "/"), href)
    return F.when(href.rlike(r"(?i)^https?://"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(beside)
