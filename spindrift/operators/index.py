"""A stored search index: build, load, append, search, tombstones, contexts, new vectors, compaction.

One folder holds chunks, parents, postings, term statistics, vectors and tombstones, each written batch by batch, and a log
whose last entry says which batches count: a change is one entry, whatever tables it writes, and is made again where
another writer was first.  Postings lie in blocks of a term and a slot of documents, sorted by term, so a search reads the
blocks of its terms, and of these only the slots that can hold one of the best.  Term statistics are kept by difference:
each change adds rows for what it adds and, negative, for what it takes away, and rows are merged level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import text as texts
from spindrift.operators import maintain, search
from spindrift.sources.store import Changed, Store, stored

Embedder = Callable[[Column], Column]
#: Batches of term statistics of one level that are merged to one of the next.
MERGED = 4
#: How postings are written.
FORMAT = 2
#: Slots of one version.
SLOTS = 1 << 44
TERMS, SPREAD, PARENTS, TOMBSTONES = "term string, df long", "df long, terms long", "parent_id string, content string, version int", "chunk_id string, url string, version int, doc string, slot long"
VECTORS = "docs array<string>, length int, block binary"
#: What search needs of a chunk; more columns are kept as they are.
CHUNK = ("chunk_id", "url", "parent_id", "heading_path", "text")
_OWN = ("vector", "version", "doc", "slot", "n_terms", "text_hash")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, vector) as blocks: the vectors of one length side by side."""
    for batch in batches:
        for rows, x in search._matrix(batch["vector"]):
            if len(rows):
                docs = batch["doc"].take(pa.array(rows))
                yield pa.record_batch([pa.array([docs.to_pylist()], pa.list_(pa.string())), pa.array([x.shape[1]], pa.int32()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], names=["docs", "length", "block"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, length, block in zip(batch["docs"], batch["length"].to_pylist(), batch["block"], strict=True):
            flat = np.frombuffer(block.as_buffer(), np.float64)
            ends = pa.array(np.arange(0, len(flat) + 1, length, dtype=np.int32))
            yield pa.record_batch({"doc": docs.values, "vector": pa.ListArray.from_arrays(ends, pa.array(flat))})


@dataclass(frozen=True)
class Updated:
    """What an update did: the index after it, counters, and the URLs (url, change_type) that are dealt with."""

    index: SearchIndex
    counts: dict
    applied: DataFrame


@dataclass(frozen=True)
class SearchIndex:
    """A state of the index in ``store``; every change gives a new one, made on the last committed state.

    A chunk's doc is its chunk_id and the version that it was added as, so a page that comes back is found again."""

    store: Store
    number: int
    state: dict
    embed: Embedder

    # ---- build and load

    @classmethod
    def build(cls, spark: SparkSession, folder: str, chunks: DataFrame, parents: DataFrame | None = None, embed: Embedder = search.hashed_vector, model: str = "hashed", **more: str) -> SearchIndex:
        """Writes a new index over chunks (chunk_id, url, parent_id, heading_path, text, optionally vector) and parents
        (parent_id, content); null texts count as empty.  An index that is there is replaced once the new one is whole.  A
        table without chunks is an error."""
        if chunks.isEmpty():
            raise ValueError("no chunks to index")
        own = cls(Store(spark, folder), -1, {}, embed)
        return own._changed(lambda at: at._emptied(model=model, **more)._plus(chunks, parents))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, embed: Embedder = search.hashed_vector, verify: bool = False) -> SearchIndex | None:
        """The last committed index; None where there is none.

        Files whose names, sizes or times are not those that were verified last, or all with ``verify``, are held against the
        digests that were committed.  Vectors, postings and statistics that differ, or are of an older format, are made anew from
        the chunks; chunks, parents or tombstones that differ are an error."""
        store = Store(spark, folder)
        last = store.state()
        if last is None:
            return None
        found = cls(store, *last, embed)
        bad = {table for table, _ in store.changed([(t, b["batch"], b["digest"]) for t, own in found.state["tables"].items() for b in own], verify)}
        if bad & {"chunks", "parents", "tombstones"}:
            raise Changed(f"files of {', '.join(sorted(bad))} are not those that were committed")
        return found.rebuild_vectors() if bad or found.state.get("format") != FORMAT else found

    def _changed(self, change: Callable[[SearchIndex], SearchIndex | None]) -> SearchIndex:
        """Commits what ``change`` makes of the last state, in one entry of the log."""

        def step(number: int | None, state: dict | None) -> dict | None:
            at = replace(self, number=-1 if number is None else number, state=state or {})
            new = change(at)
            return None if new is None else new._sealed().state

        number, state = self.store.transact(step)
        return replace(self, number=number, state=state)

    def _sealed(self) -> SearchIndex:
        """With digests of the batches that have none yet."""
        new = [(t, b["batch"]) for t, own in self.state["tables"].items() for b in own if "digest" not in b]
        found = dict(zip(new, self.store.seal(new), strict=True)) if new else {}
        tables = {t: [b if "digest" in b else b | {"digest": found[t, b["batch"]]} for b in own] for t, own in self.state["tables"].items()}
        return replace(self, state=self.state | {"tables": tables})

    def _emptied(self, **more: str) -> SearchIndex:
        kept = {"version": self.state.get("version", -1), **more, "format": FORMAT}
        return replace(self, state=kept | {"tables": {}, "n": 0, "total": 0, "mean": 1.0, "low": 0.0})

    def batches(self, table: str) -> list[str]:
        return [b["batch"] for b in self.state["tables"].get(table, [])]

    def _and(self, table: str, rows: DataFrame, level: int = 0) -> SearchIndex:
        """With one more batch of a table, written but not committed."""
        own = [*self.state["tables"].get(table, []), {"batch": self.store.write(table, rows), "level": level}]
        return replace(self, state=self.state | {"tables": self.state["tables"] | {table: own}})

    def _plus(self, chunks: DataFrame, parents: DataFrame | None = None) -> SearchIndex:
        """With new chunks, their postings and vectors, and statistics that count them."""
        version = int(self.state["version"]) + 1
        at = replace(self, state=self.state | {"version": version})
        text = F.coalesce("text", F.lit(""))
        columns = [c for c in chunks.columns if c not in _OWN]
        made = chunks.withColumn("version", F.lit(version)).withColumn("doc", F.concat_ws("@", "chunk_id", "version"))
        vector = (F.col("vector") if "vector" in chunks.columns else self.embed(text)).alias("vector")
        slotted = search.with_slots(made.select(*columns, "doc", "version", vector), "url", "chunk_id").withColumn("slot", F.col("slot") + F.lit(version) * F.lit(SLOTS))
        rows = stored(slotted.select("doc", "version", "slot", F.size(search.terms(text)).alias("n_terms"), F.sha2(text, 256).alias("text_hash"), *columns, "vector"), "added")
        at = at._and("chunks", rows.drop("vector"))
        at = at._and("vectors", rows.select("doc", "vector").where("vector is not null").mapInArrow(_packed, VECTORS))
        at = at._and("postings", search.by_term(stored(search.blocks(rows), "postings")))
        if parents is not None:
            at = at._and("parents", parents.select("parent_id", "content", F.lit(version).alias("version")))
        n, total = rows.agg(F.count("*"), F.sum("n_terms")).first()
        df = search.frequencies(at.store.read("postings", at.batches("postings")[-1:]))
        return at._counted(df, n, total or 0)

    def _minus(self, urls: DataFrame) -> SearchIndex:
        """With tombstones for all active chunks of ``urls``, and statistics without them.  Of what is stored only the chunks of
        these URLs are read again."""
        gone = stored(self.active().join(urls.select("url").distinct(), "url", "left_semi"), "gone")
        n, total = gone.agg(F.count("*"), F.sum("n_terms")).first()
        if not n:
            return self
        at = self._and("tombstones", gone.select("chunk_id", "url", "version", "doc", "slot"))
        df = gone.select(F.explode(F.array_distinct(search.terms(F.coalesce("text", F.lit(""))))).alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        return at._counted(df, -n, -(total or 0))

    def _counted(self, df: DataFrame, n: int, total: int) -> SearchIndex:
        """Statistics with a difference: df (term, df) of each term, n chunks and total terms.

        How many terms have each df is kept, too, from which the mean idf follows for any number of chunks; only terms of the
        difference are looked up."""
        change = stored(df, "difference")
        before = self.terms().join(change.select("term"), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("old"))
        moved = change.join(before, "term", "left").select(F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.col("df")).alias("new"))
        spread = moved.select(F.explode(F.array(F.struct(F.col("old").alias("df"), F.lit(-1).alias("t")), F.struct(F.col("new").alias("df"), F.lit(1).alias("t")))).alias("m"))
        spread = spread.select("m.*").where("df > 0").groupBy("df").agg(F.sum("t").alias("terms")).where("terms <> 0")
        at = self._and("terms", change.select("term", "df").repartitionByRange("term").sortWithinPartitions("term"))._and("spread", spread)
        at = at._merged("terms", "term", "df")._merged("spread", "df", "terms")
        n, total = int(self.state["n"]) + n, int(self.state["total"]) + total
        whole = at.store.read("spread", at.batches("spread"), SPREAD).groupBy("df").agg(F.sum("terms").alias("terms"))
        mean, low = search.collection(whole, n, total)
        return replace(at, state=at.state | {"n": n, "total": total, "mean": mean, "low": low})

    def _merged(self, table: str, key: str, value: str) -> SearchIndex:
        """As long as MERGED batches share a level they become one of the next, so each row is written again a few times only,
        and there are as many batches as the logarithm of the changes."""
        at = self
        while True:
            own = at.state["tables"][table]
            level = next((b["level"] for b in own if sum(x["level"] == b["level"] for x in own) >= MERGED), None)
            if level is None:
                return at
            some = at.store.read(table, [b["batch"] for b in own if b["level"] == level])
            rows = some.groupBy(key).agg(F.sum(value).alias(value)).where(F.col(value) != 0)
            rest = replace(at, state=at.state | {"tables": at.state["tables"] | {table: [b for b in own if b["level"] != level]}})
            at = rest._and(table, rows.repartitionByRange(key).sortWithinPartitions(key), level + 1)

    # ---- tables

    def chunks(self) -> DataFrame:
        return self.store.read("chunks", self.batches("chunks"))

    def terms(self) -> DataFrame:
        """(term, df), rows of which are to be summed up by term."""
        return self.store.read("terms", self.batches("terms"), TERMS)

    def parents(self) -> DataFrame:
        rows = self.store.read("parents", self.batches("parents"), PARENTS)
        return rows.groupBy("parent_id").agg(F.max_by("content", "version").alias("content"))

    def vectors(self) -> DataFrame:
        """(doc, vector)."""
        return self.store.read("vectors", self.batches("vectors"), VECTORS).mapInArrow(_unpacked, "doc string, vector array<double>")

    def tombstones(self) -> DataFrame:
        """(chunk_id, url, version, doc, slot)."""
        return self.store.read("tombstones", self.batches("tombstones"), TOMBSTONES)

    def active(self) -> DataFrame:
        return maintain.active(self.chunks(), self.tombstones()) if self.batches("tombstones") else self.chunks()

    def urls(self, page_cache: DataFrame | None = None) -> DataFrame:
        """(url, lastmod) of the indexed URLs; lastmod from a page cache (url, lastmod) where it has one."""
        own = self.active().select("url").distinct()
        return own.withColumn("lastmod", F.lit(None).cast("string")) if page_cache is None else own.join(page_cache.select("url", "lastmod"), "url", "left")

    # ---- changes

    def _appended(self, chunks: DataFrame, parents: DataFrame | None) -> SearchIndex | None:
        new = chunks.join(self.active().select("chunk_id"), "chunk_id", "left_anti") if self.batches("chunks") else chunks
        return None if new.isEmpty() else self._plus(new, parents)

    def append(self, chunks: DataFrame, parents: DataFrame | None = None) -> SearchIndex:
        """With the chunks whose chunk_id is not active yet; where none is new, the same index."""
        return self._changed(lambda at: at._appended(chunks, parents))

    def replaced(self, urls: DataFrame, chunks: DataFrame, parents: DataFrame | None = None) -> SearchIndex:
        """With these chunks in place of all that ``urls`` (url) have, in one commit."""

        def change(at: SearchIndex) -> SearchIndex:
            marked = at._minus(urls)
            return marked._appended(chunks, parents) or marked

        return self._changed(change)

    def without(self, urls: DataFrame) -> SearchIndex:
        """With tombstones for all active chunks of ``urls`` (url)."""
        return self._changed(lambda at: at._minus(urls))

    def rebuild_vectors(self, embed: Embedder | None = None, model: str | None = None) -> SearchIndex:
        """With vectors, postings and statistics made anew from the stored chunks, which are not read from pages again."""
        new = replace(self, embed=embed or self.embed)
        return new._changed(lambda at: at._rewritten(at.active(), model))

    def compact(self) -> SearchIndex:
        """Without tombstoned chunks and the parents that none of the others refers to."""
        return self._changed(lambda at: at._rewritten(at.active(), None))

    def with_contexts(self, contexts: DataFrame) -> SearchIndex:
        """With (chunk_id, context) in front of the chunks' texts, and vectors of these; chunks without one stay."""

        def change(at: SearchIndex) -> SearchIndex:
            rows = at.active().join(contexts.select("chunk_id", texts.valid_context(F.col("context")).alias("_context")), "chunk_id", "left")
            return at._rewritten(rows.withColumn("text", texts.with_context(F.col("_context"), F.col("text"))).drop("_context"), None)

        return self._changed(change)

    def _rewritten(self, chunks: DataFrame, model: str | None) -> SearchIndex:
        parents = self.parents().join(self.active().select("parent_id"), "parent_id", "left_semi") if self.batches("parents") else None
        more = {k: v for k, v in self.state.items() if k not in ("tables", "n", "total", "mean", "low", "version")}
        return self._emptied(**more | ({"model": model} if model else {}))._plus(chunks.drop(*_OWN), parents)

    def update(self, changes: DataFrame, fetched: DataFrame, parents: DataFrame | None = None, most: int = 1 << 30, threshold: float = 0.1, read: DataFrame | None = None) -> Updated:
        """Applies changes (url, change_type, new_lastmod, ...) of which ``fetched`` are the new chunks, in one commit: removed
        URLs and those of this batch's updated ones that were read again get tombstones, new chunks are added, and the index is
        compacted where tombstones reach ``threshold``.  ``read`` (url) are the URLs that were read well, also those without a
        chunk; by default those of ``fetched``.  What is beyond ``most`` or was not read is not dealt with."""
        batch = stored(maintain.update_batch(changes, most).select("url", "change_type"), "batch")
        well = read if read is not None else fetched
        done = batch.join(well.select("url").distinct(), "url", "left_semi")
        new = fetched.join(done.select("url"), "url", "left_semi")
        gone = changes.where("change_type = 'removed'").select("url", "change_type")
        applied = stored(done.unionByName(gone), "applied")
        counted: dict = {}

        def change(at: SearchIndex) -> SearchIndex:
            before = at.active().count()
            marked = at._minus(applied.where("change_type <> 'new'"))
            left = marked.active().count()
            added = marked._appended(new, parents) or marked
            stats = maintain.tombstone_stats(added.chunks(), added.tombstones(), threshold).first()
            after = added.active().count()
            counted.update({"chunks_removed": before - left, "chunks_added": after - left, "rebuilt": bool(stats.rebuild_needed and after)})
            return added._rewritten(added.active(), None) if counted["rebuilt"] else added

        found = self._changed(change)
        kinds = {r.change_type: r.n for r in applied.groupBy("change_type").agg(F.count("*").alias("n")).collect()}
        return Updated(found, {"removed": kinds.get("removed", 0), "updated": kinds.get("updated", 0), "added": kinds.get("new", 0), **counted}, applied)

    # ---- search

    def bm25(self) -> search.Bm25Index:
        """What BM25 needs; tombstoned chunks are neither counted nor found."""
        gone = self.tombstones().select("doc", "slot").distinct() if self.batches("tombstones") else None
        return search.Bm25Index(self.store.read("postings", self.batches("postings")), self.terms(), int(self.state["n"]), self.state["mean"], self.state["low"], gone)

    def search(self, queries: DataFrame, config: search.SearchConfig = search.SearchConfig(), top_k: int | None = None, with_parents: bool = True, rerank: Callable[[Column, Column], Column] | None = search.coverage, parent_most: int = 0) -> DataFrame:
        """(query, rank, score, chunk_id, url, heading_path, text, parent_text) of queries (query, text, optionally vector).

        Both retrievers' lists are fused, results of equal texts being one; tombstoned chunks go; what is left is re-ranked
        over the query's text and the chunk's, unless ``rerank`` is None; the first top_k stay.  Texts are told apart by the
        digest stored with them, and only slots of chunks that were found are read."""
        k = top_k or config.top_k
        asked = queries if "vector" in queries.columns else queries.withColumn("vector", self.embed(F.coalesce("text", F.lit(""))))
        chunks = self.chunks()
        vectors = self.store.read("vectors", self.batches("vectors"), VECTORS)
        found = stored(search.hybrid(self.bm25(), vectors, asked, config, k * config.multiplier, chunks.select("doc", "text_hash", "slot")), "found")
        slots = [r.slot for r in found.select("slot").distinct().limit(search.LISTED + 1).collect()]
        own = chunks.where(F.col("slot").isin(slots)) if len(slots) <= search.LISTED else chunks
        rows = maintain.active(found.drop("slot").join(own.select("doc", "version", *CHUNK), "doc"), self.tombstones())
        if rerank is None:
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
        else:
            rows = search.rerank(rows.join(queries.select("query", F.col("text").alias("_asked")), "query"), rerank(F.col("_asked"), F.col("text")))
        rows = rows.where(F.col("rank") <= k)
        rows = search.with_parents(rows, self.parents(), parent_most) if with_parents else rows.withColumn("parent_text", F.lit(None).cast("string"))
        return rows.select("query", "rank", "score", "chunk_id", "url", "heading_path", "text", "parent_text")
