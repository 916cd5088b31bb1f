"""Crawl and index: what to read, pages from a cache or a fetcher, chunks, contexts, and the index of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as texts
from spindrift.functions.url import crawlable, same_site
from spindrift.operators import chunks, crawl, maintain, search
from spindrift.operators.index import Embedder, SearchIndex
from spindrift.sources import sitemaps
from spindrift.sources.pages import PageCache
from spindrift.sources.store import stored

#: Reads URLs (url, lastmod): (url, final_url, content_type, status, body), status 0 for a network error, -1 for a ban.
Fetcher = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Crawled:
    """pages (url, html, lastmod, from_cache), the page cache (url, html, lastmod, cached_at) after it, and the log of reads
    (url, status, ok)."""

    pages: DataFrame
    cache: DataFrame
    log: DataFrame

    def counts(self) -> dict:
        hits = self.pages.where("from_cache").count()
        bad = self.log.where("not ok").count()
        return {"hits": hits, "fetched": self.log.count(), "failed": bad, "by_status": {r.status: r.n for r in crawl.status_histogram(self.log).collect()}}


def discover_urls(manual: DataFrame, files: DataFrame, roots: DataFrame, start: str, cache: DataFrame | None = None, links: DataFrame | None = None, depth: int = 3, include: list[str] | None = None, exclude: list[str] | None = None, most: int | None = None, manual_only: bool = False) -> DataFrame:
    """(url, lastmod, ord) of a site: manual URLs (url, lastmod, ord), and those of its sitemaps under ``roots`` (sitemap), read
    from files (sitemap, xml) or a cache; where these give none, the pages within ``depth`` of ``start`` along links (src, dst).

    Sitemap URLs and pages stay on the site of ``start`` and fit the patterns.  A URL's last date counts, at its first place;
    newest first, at most ``most``.  ``manual_only`` gives the manual ones as they are."""
    if manual_only:
        return manual
    fits = lambda u: same_site(u, F.lit(start)) & crawlable(u, include or [], exclude or [])
    named = stored(sitemaps.resolve(files, roots, cache).where(fits(F.col("url"))), "named")
    if links is not None and named.isEmpty():
        spark = manual.sparkSession
        at = crawl.reachable(links, spark.createDataFrame([(start,)], "node string"), depth, fits, most)
        found = at.orderBy("depth", "node").select(F.col("node").alias("url"), F.lit(None).cast("string").alias("lastmod"))
    else:
        found = named.orderBy("place").select("url", "lastmod")
    # ranges of a sorted table follow each other, and so do their numbers
    return crawl.discover(manual.select("url", "lastmod", "ord"), found.withColumn("ord", F.monotonically_increasing_id()), most=most)


def read_pages(urls: DataFrame, cache: DataFrame | PageCache, fetch: Fetcher, start: Column, now: Column, ttl_hours: float = 0, force: bool = False) -> Crawled:
    """Pages of ``urls`` (url, lastmod) from the cache where that is valid, else from ``fetch``; what is read well goes to the
    cache under its lastmod.  Pages off the site of ``start``, not well or not HTML have no html and are not kept.

    The cache is a table, of which the next one is returned, or a stored one: of that only folders of ``urls`` are read, and
    what is read well is saved in it."""
    kept_on_disk = isinstance(cache, PageCache)
    known = cache.lookup(urls, "lastmod", "cached_at") if kept_on_disk else cache
    state = crawl.cache_state(urls.select("url", "lastmod"), known, now, ttl_hours, force)
    if kept_on_disk:  # asked for twice, and before anything is saved
        state = stored(state, "cache_state")
    valid = state.where("hit").select("url", "lastmod")
    bodies = cache.lookup(valid, "html") if kept_on_disk else cache.select("url", "html")
    hits = valid.join(bodies, "url").withColumn("from_cache", F.lit(True))
    asked = state.where("not hit").select("url", "lastmod")
    read = stored(crawl.accepted(fetch(asked), start).join(asked, "url"), "fetched")
    good = read.where("html <> ''").select("url", "lastmod", "html", F.lit(False).alias("from_cache"))
    fresh = good.select("url", "html", "lastmod", now.cast("timestamp").alias("cached_at"))
    log = read.select("url", "status", (F.col("html") != "").alias("ok"))
    if kept_on_disk:
        cache.save(fresh)
        return Crawled(hits.unionByName(good), cache.read(), log)
    kept = cache.select("url", "html", "lastmod", "cached_at").join(fresh.select("url"), "url", "left_anti")
    return Crawled(hits.unionByName(good), kept.unionByName(fresh), log)


def page_chunks(pages: DataFrame, limits: chunks.Limits = chunks.Limits()) -> tuple[DataFrame, DataFrame]:
    """(chunks, parents) to index, of pages (url, html): of pages with equal html the first by URL; children, and parents
    that have none."""
    rows = stored(chunks.chunk_pages(maintain.keep_first_by_hash(pages.where("html <> ''"), "html", "url"), limits), "chunks")
    alone = chunks.parents_without_children(rows)
    own = rows.where("kind = 'child'").unionByName(alone.withColumn("parent_id", F.col("chunk_id")))
    columns = ("chunk_id", "url", "parent_id", "heading_path", F.col("content").alias("text"), "tokens", "doc_type", "version", "code_identifiers")
    parents = rows.where("kind = 'parent'").select(F.col("chunk_id").alias("parent_id"), "content")
    return own.select(*columns).withColumnRenamed("version", "doc_version"), parents


#: Makes (chunk_id, context) of (chunk_id, url, text, document); a chunk it leaves out, or with a short context, has none.
Writer = Callable[[DataFrame], DataFrame]


def headline_contexts(rows: DataFrame) -> DataFrame:
    """The built-in stand-in for a language model: where a chunk stands, by the first sentence of its page."""
    first = F.try_element_at(texts.sentences(F.col("document")), F.lit(1))
    return rows.select("chunk_id", F.concat(F.lit("From a page that begins: "), texts.shortened(first, 200)).alias("context"))


def contexts_of(rows: DataFrame, documents: DataFrame, cache: DataFrame | None = None, write: Writer = headline_contexts) -> DataFrame:
    """(chunk_id, cache_key, context, from_cache) for chunks (chunk_id, url, text) and documents (url, document).

    A context cached under the chunk's id and text, in cache (cache_key, context), is kept; others are written from chunk and
    document.  A chunk without a document has none, nor one whose context is not valid.  What is returned, without
    from_cache, is the next cache."""
    keyed = rows.select("chunk_id", "url", "text", texts.context_key(F.col("chunk_id"), F.col("text")).alias("cache_key"))
    if cache is None:
        missing, kept = keyed, None
    else:
        kept = keyed.join(cache.select("cache_key", "context"), "cache_key").select("chunk_id", "cache_key", "context", F.lit(True).alias("from_cache"))
        missing = keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    made = write(missing.join(documents.select("url", "document"), "url").select("chunk_id", "url", "text", "document"))
    made = made.select("chunk_id", texts.valid_context(F.col("context")).alias("context")).where("context is not null").join(missing.select("chunk_id", "cache_key"), "chunk_id")
    made = made.select("chunk_id", "cache_key", "context", F.lit(False).alias("from_cache"))
    return made if kept is None else kept.unionByName(made)


def contextualized(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Chunks with their context in front of the text."""
    own = rows.join(contexts.select("chunk_id", F.col("context").alias("_context")), "chunk_id", "left")
    return own.withColumn("text", texts.with_context(F.col("_context"), F.col("text"))).drop("_context")


def index_updates(spark: SparkSession, folder: str, chunks_of: Callable[[DataFrame], tuple[DataFrame, DataFrame]], most: int, threshold: float = 0.1, embed: Embedder = search.hashed_vector) -> Callable[[DataFrame, int], DataFrame]:
    """What an updater applies to the index in ``folder``: of changes (site, url, change_type, new_lastmod, ...) at most ``most``
    new and updated URLs are read, newest first, and all removed ones go, in one commit; (site, url) of what was dealt with.

    ``chunks_of`` reads URLs (site, url): their chunks, and (url) of those that were read well."""

    def apply(changes: DataFrame, number: int) -> DataFrame:
        batch = stored(maintain.update_batch(changes, most), "batch")
        rows, read = chunks_of(batch.select("site", "url"))
        rows = stored(rows, "chunks")
        index = SearchIndex.load(spark, folder, embed)
        if index is None:
            if not rows.isEmpty():
                SearchIndex.build(spark, folder, rows, None, embed)
            return batch.join(read.select("url"), "url", "left_semi").select("site", "url")
        done = index.update(changes, rows, None, most, threshold, read)
        return done.applied.join(changes.select("site", "url"), "url").select("site", "url")

    return apply


@dataclass(frozen=True)
class Built:
    index: SearchIndex
    crawled: Crawled
    counts: dict


def crawl_and_index(spark: SparkSession, folder: str, urls: DataFrame, fetch: Fetcher, start: Column, now: Column, cache: DataFrame | PageCache | None = None, failed: DataFrame | None = None, limits: chunks.Limits = chunks.Limits(), ttl_hours: float = 0, rebuild: bool = False, refresh: bool = True, embed: Embedder = search.hashed_vector, contexts: Writer | None = None) -> Built:
    """Builds the index of ``folder`` over ``urls`` (url, lastmod), or brings it up to date.

    Without an index, or with ``rebuild``, all pages are read (from the cache where that is valid) and indexed.  With one,
    ``refresh`` reads all URLs again and pages that come from the cache and are indexed are left out: the others' old chunks
    get tombstones and the new ones are added, so a page that has not changed is not indexed twice, and one that was read by a
    run that stopped before indexing it is.  Without ``refresh`` only URLs that are not indexed are read.  URLs that ``failed`` (url, failure_count) too often are left out."""
    cache = cache if cache is not None else spark.createDataFrame([], "url string, html string, lastmod string, cached_at timestamp")
    index = None if rebuild else SearchIndex.load(spark, folder, embed)
    none_failed = failed if failed is not None else spark.createDataFrame([], "url string, failure_count long")
    wanted = crawl.fetch_set(urls, none_failed, index.urls() if index is not None and not refresh else None)
    crawled = read_pages(wanted, cache, fetch, start, now, ttl_hours)
    pages = crawled.pages
    if index is not None:
        known = stored(index.urls().select("url", F.lit(True).alias("_indexed")), "indexed")
        pages = pages.join(known, "url", "left").where("not from_cache or _indexed is null").drop("_indexed")
        # a cached page that was left out as the copy of one that is indexed still is
        indexed_pages = cache.lookup(known, "html") if isinstance(cache, PageCache) else cache.join(known, "url", "left_semi")
        theirs = indexed_pages.select(F.sha2("html", 256).alias("_h")).distinct()
        copies = pages.where("from_cache").join(theirs, F.sha2("html", 256) == F.col("_h"), "left_semi").select("url")
        pages = stored(pages.join(copies, "url", "left_anti"), "pages")
    rows, parents = page_chunks(pages, limits)
    if contexts is not None:
        documents = chunks.page_texts(pages).select("url", F.col("text").alias("document"))
        rows = contextualized(rows, contexts_of(rows, documents, write=contexts))
    counts = crawled.counts() | {"urls": urls.count(), "chunks": rows.count()}
    if index is None:
        return Built(SearchIndex.build(spark, folder, rows, parents, embed), crawled, counts)
    again = pages.select("url").join(index.urls().select("url"), "url", "left_semi")
    return Built(index.replaced(again, rows, parents), crawled, counts)
