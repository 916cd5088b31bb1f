"""Queries by name over the tables of a folder, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import chat, text, url
from spindrift.operators import build, chunks, contexts, crawl, evaluate, fetch, index, maintain, search
from spindrift.sources import sitemaps
from spindrift.sources.pages import PageCache
from spindrift.sources.store import shared_folder, stored
from spindrift.streaming import chat as chat_streams
from spindrift.streaming import events as event_streams
from spindrift.streaming import updater

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NORMAL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')"
TOKENS = r"len(regexp_extract_all({}, '\p{{L}}+|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]+'))"
SENTENCES = r"str_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"

# ---- URLs


@query(f"SELECT page_id, {NORMAL} AS norm FROM pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", url.normalize_url(F.col("url")).alias("norm"))


@query(r"""SELECT page_id, s AS site, s = 'site3.example.com' AS same FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') AS s FROM pages)""")
def url_same_site(spark, d):
    rows = table(spark, d, "pages")
    return rows.select("page_id", url.site(F.col("url")).alias("site"), url.same_site(F.col("url"), F.lit("https://www.site3.example.com/x")).alias("same"))


@query(f"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '[?]utm_') AND NOT regexp_matches(url, '#top') AND (regexp_matches(url, '[02468]') OR regexp_matches(url, 'html$'))")
def url_filter_patterns(spark, d):
    return table(spark, d, "pages").select("page_id", "url").where(url.crawlable(F.col("url"), ["[02468]", "html$"], [r"[?]utm_", "#top"]))


@query(f"SELECT url, max_by(lastmod, ord) AS lastmod, min(ord)::BIGINT AS ord FROM (SELECT {NORMAL} AS url, CASE WHEN page_id % 5 <> 0 THEN strftime(DATE '2024-01-01' + (page_id % 30)::INTEGER, '%Y-%m-%d') ELSE '' END AS lastmod, page_id AS ord FROM pages) GROUP BY url")
def url_dedup_last_wins(spark, d):
    return crawl.last_value_first_place(_dated(spark, d).select("url", F.coalesce("lastmod", F.lit("")).alias("lastmod"), "ord"))


def _dated(spark, d) -> DataFrame:
    """Normal URLs with dates made from page ids."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int")), "yyyy-MM-dd")
    return table(spark, d, "pages").select("page_id", url.normalize_url(F.col("url")).alias("url"), F.when(F.col("page_id") % 5 != 0, day).alias("lastmod"), F.col("page_id").alias("ord"))


_DATED = f"(SELECT page_id, {NORMAL} AS url, CASE WHEN page_id % 5 <> 0 THEN strftime(DATE '2024-01-01' + (page_id % 30)::INTEGER, '%Y-%m-%d') END AS lastmod, page_id AS ord FROM pages)"


@query(f"SELECT url, coalesce(lastmod, '') AS lastmod, ord FROM {_DATED} ORDER BY coalesce(lastmod, '') DESC, ord LIMIT 40")
def crawl_order_limit(spark, d):
    return crawl.newest_first(_dated(spark, d).select("url", "lastmod", "ord"), 40).withColumn("lastmod", F.coalesce("lastmod", F.lit("")))


# ---- upkeep


def _sitemaps(spark, d) -> tuple[DataFrame, DataFrame]:
    one = Window.partitionBy("url").orderBy("page_id")
    rows = _dated(spark, d).withColumn("r", F.row_number().over(one)).where("r = 1")
    shifted = F.when(F.col("page_id") % 3 == 0, F.date_format(F.date_add(F.col("lastmod").cast("date"), 1), "yyyy-MM-dd")).otherwise(F.col("lastmod"))
    indexed = rows.where("page_id % 10 <> 0").select("url", F.when(F.col("page_id") % 4 != 0, shifted).alias("lastmod"))
    return rows.where("page_id % 7 <> 0").select("url", "lastmod"), indexed


_DIFF = f"""WITH p AS (SELECT * FROM {_DATED} QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
n AS (SELECT url, lastmod FROM p WHERE page_id % 7 <> 0),
o AS (SELECT url, CASE WHEN page_id % 4 <> 0 THEN CASE WHEN page_id % 3 = 0 THEN strftime(lastmod::DATE + 1, '%Y-%m-%d') ELSE lastmod END END AS lastmod FROM p WHERE page_id % 10 <> 0),
c AS (SELECT coalesce(n.url, o.url) AS url, CASE WHEN o.url IS NULL THEN 'new' WHEN n.url IS NULL THEN 'removed' WHEN n.lastmod IS NOT NULL AND n.lastmod IS DISTINCT FROM o.lastmod THEN 'updated' ELSE 'unchanged' END AS change_type, n.lastmod AS new_lastmod, o.lastmod AS old_lastmod FROM n FULL OUTER JOIN o ON n.url = o.url)
"""


@query(_DIFF + "SELECT * FROM c")
def sitemap_diff(spark, d):
    return maintain.changes(*_sitemaps(spark, d))


@query(_DIFF + ", k AS (SELECT count(*) FILTER (WHERE change_type = 'new') AS n_new, count(*) FILTER (WHERE change_type = 'updated') AS n_updated, count(*) FILTER (WHERE change_type = 'removed') AS n_removed, count(*) FILTER (WHERE change_type = 'unchanged') AS n_unchanged FROM c) SELECT *, n_new + n_updated + n_removed AS total_changes, n_new + n_updated + n_removed > 0 AS has_changes FROM k")
def sitemap_change_counts(spark, d):
    return maintain.change_counts(maintain.changes(*_sitemaps(spark, d)))


def _log(spark, d) -> DataFrame:
    k = F.col("page_id") % 20
    status = F.when(k == 0, 404).when(k == 1, 500).when(k == 2, -1).when(k == 3, 0).otherwise(200)
    return table(spark, d, "pages").select("page_id", "url", status.alias("status"))


@query("SELECT status, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM (SELECT CASE page_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE 200 END AS status FROM pages) GROUP BY status")
def http_status_histogram(spark, d):
    return crawl.status_histogram(_log(spark, d))


@query("""WITH l AS (SELECT user_id::VARCHAR AS url, event_id AS attempt, event_type = 'purchase' AS ok, event_type AS error FROM events),
s AS (SELECT url, max(attempt) AS ok_at FROM l WHERE ok GROUP BY url)
SELECT url, count(*) AS failure_count, min_by(error, attempt) AS first_error, max_by(error, attempt) AS last_error, max(attempt) AS last_attempt
FROM l LEFT JOIN s USING (url) WHERE NOT ok AND (ok_at IS NULL OR attempt > ok_at) GROUP BY url""")
def failed_url_tracking(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("attempt"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("error"))
    return crawl.failures(rows)


@query(f"""WITH u AS (SELECT page_id, url, lastmod FROM {_DATED}), one AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT url, CASE WHEN page_id % 3 = 0 THEN false WHEN lastmod IS NOT NULL THEN page_id % 2 = 0 ELSE page_id % 24 < 12 END AS hit FROM one""")
def page_cache_validity(spark, d):
    rows = _dated(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("page_id"))).where("r = 1")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    cache = rows.where("page_id % 3 <> 0").select("url", F.when(F.col("page_id") % 2 == 0, F.col("lastmod")).otherwise("old").alias("lastmod"), (now.cast("long") - (F.col("page_id") % 24) * 3600).cast("timestamp").alias("cached_at"))
    return crawl.cache_state(rows.select("url", "lastmod"), cache, now, 12).select("url", "hit")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), e AS (SELECT page_id AS src, (page_id * 3 + 1) % n AS dst FROM pages, n UNION ALL SELECT page_id, (page_id * 5 + 2) % n FROM pages, n),
r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 4)
SELECT node::BIGINT AS node, min(depth)::INTEGER AS depth FROM r GROUP BY node""")
def link_bfs(spark, d):
    pages = table(spark, d, "pages").select("page_id")
    n = pages.count()
    links = pages.select(F.col("page_id").alias("src"), F.explode(F.array((F.col("page_id") * 3 + 1) % n, (F.col("page_id") * 5 + 2) % n)).alias("dst"))
    return crawl.reachable(links, spark.createDataFrame([(0,)], "node long"), 4)


@query(r"SELECT page_id, unnest(list_filter(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*\"([^\">]*)\"', 1), lambda h: NOT regexp_matches(h, '^(mailto:|tel:|javascript:|#)') AND h <> '')) AS href FROM pages")
def page_links(spark, d):
    return sitemaps.links(table(spark, d, "pages").select(F.col("page_id").alias("page"), "html")).withColumnRenamed("page", "page_id")


# ---- text


@query("SELECT min(doc_id)::BIGINT AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_dedup_sha256(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    copies = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("copies"))
    kept = maintain.keep_first_by_hash(docs, "text", "doc_id").withColumn("h", F.sha2("text", 256))
    return kept.join(copies, "h").select("doc_id", "copies")


@query(f"SELECT doc_id, {TOKENS.format('text')}::INTEGER AS tokens, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))::INTEGER AS terms FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"), F.size(search.terms(F.col("text"))).alias("terms"))


@query(f"SELECT doc_id, len(s)::INTEGER AS n, sha256(array_to_string(s, chr(1))) AS digest FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents)")
def sentence_split(spark, d):
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.sha2(F.array_join(s, "\x01"), 256).alias("digest"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {SENTENCES.format('text')} AS x FROM documents)),
t AS (SELECT doc_id, i, part, {TOKENS.format('part')} AS n FROM s),
r AS (SELECT doc_id, i, 1 AS pack, n AS held, part <> '' AS filled FROM t WHERE i = 1
      UNION ALL SELECT t.doc_id, t.i, CASE WHEN r.filled AND r.held + t.n > 350 THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.filled AND r.held + t.n > 350 THEN t.n ELSE r.held + t.n END, r.filled OR t.part <> '' FROM r JOIN t ON t.doc_id = r.doc_id AND t.i = r.i + 1)
SELECT doc_id, pack::INTEGER AS pack, max(held)::INTEGER AS tokens FROM r GROUP BY doc_id, pack HAVING bool_or(filled)""")
def sentence_pack(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.pack(text.sentences(F.col("text")), 350)).alias("i", "p"))
    return rows.select("doc_id", (F.col("i") + 1).alias("pack"), F.col("p.tokens").alias("tokens"))


_TYPES = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(u), {part!r})' for part in parts)} THEN '{name}'" for name, parts in url.DOC_TYPES) + " ELSE 'docs' END"


@query(f"SELECT page_id, {_TYPES} AS doc_type FROM (SELECT page_id, url || CASE page_id % 7 WHEN 0 THEN '/api/x' WHEN 1 THEN '/CLI' WHEN 2 THEN '/releases' WHEN 3 THEN '/guide' WHEN 4 THEN '/tutorial' ELSE '' END AS u FROM pages)")
def doc_type(spark, d):
    k = F.col("page_id") % 7
    more = F.when(k == 0, "/api/x").when(k == 1, "/CLI").when(k == 2, "/releases").when(k == 3, "/guide").when(k == 4, "/tutorial").otherwise("")
    return table(spark, d, "pages").select("page_id", url.doc_type(F.concat("url", more)).alias("doc_type"))


@query(f"SELECT page_id, substr(sha256({NORMAL} || '||' || 'Top > Part ' || (page_id % 3)::VARCHAR || '::' || (page_id % 5)::VARCHAR), 1, 16) AS chunk_id, substr(sha256(url), 1, 32) AS url_key FROM pages")
def chunk_id(spark, d):
    headings = F.array(F.lit("Top"), F.concat(F.lit("Part "), (F.col("page_id") % 3).cast("string")))
    return table(spark, d, "pages").select("page_id", text.chunk_id(url.normalize_url(F.col("url")), headings, F.col("page_id") % 5).alias("chunk_id"), url.url_key(F.col("url")).alias("url_key"))


#: Python's white space, as RE2 writes it.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '\A[{_WHITE}]+|[{_WHITE}]+\z', '', 'g'), '[^\p{{L}}\p{{N}}_{_WHITE}-]', '', 'g'), '[{_WHITE}_]+', '-', 'g') AS slug FROM documents")
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(r"SELECT doc_id, coalesce(nullif(regexp_extract('Release ' || CASE WHEN doc_id % 3 = 0 THEN 'v' || (doc_id % 9)::VARCHAR || '.' || (doc_id % 5)::VARCHAR || '.x' ELSE 'notes' END, 'v?(\d+\.\d+(?:\.\d+)?(?:\.x)?)', 1), ''), nullif(regexp_extract(substr(text, 1, 200), 'v?(\d+\.\d+(?:\.\d+)?(?:\.x)?)', 1), ''), '') AS version FROM documents")
def version_extract(spark, d):
    v = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("v"), (F.col("doc_id") % 9).cast("string"), F.lit("."), (F.col("doc_id") % 5).cast("string"), F.lit(".x"))).otherwise("notes")
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.version(F.array(F.concat(F.lit("Release "), v)), F.col("text")), F.lit("")).alias("version"))


#: Letters, marks and numbers beyond ASCII: RE2 takes a word to end at them, so the SQL first puts signs in their place.
_BEYOND = r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]"


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(calls, '(?i)\b([a-z_][a-z0-9_]*)[{_WHITE}]*\(', 1) || regexp_extract_all(text, '--([a-z][a-z0-9-]+)', 1) || regexp_extract_all(names, '\b([A-Z][A-Z0-9_]{{2,}})\b', 1)))[1:20], ' ') AS identifiers
FROM (SELECT doc_id, text, regexp_replace(text, '{_BEYOND}[A-Za-z0-9_]*', '%', 'g') AS calls, regexp_replace(text, '{_BEYOND}', 'a', 'g') AS names FROM documents)""")
def code_identifiers(spark, d):
    return table(spark, d, "documents").select("doc_id", text.code_identifiers(F.col("text")).alias("identifiers"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<context>' || chr(10) || 'From ' || source || ' in ' || lang || chr(10) || '</context>' || chr(10, 10) || text ELSE text END AS content,
doc_id::VARCHAR || ':' || substr(sha256(text), 1, 16) AS cache_key FROM documents""".replace("chr(10, 10)", "chr(10) || chr(10)"))
def context_prefix(spark, d):
    context = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("From "), "source", F.lit(" in "), "lang"))
    return table(spark, d, "documents").select("doc_id", text.with_context(context, F.col("text")).alias("content"), text.context_key(F.col("doc_id").cast("string"), F.col("text")).alias("cache_key"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def context_cache_miss(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.context_key(F.col("doc_id").cast("string"), F.col("text")).alias("cache_key"))
    cache = docs.where("doc_id % 3 = 0").select("cache_key")
    return docs.join(cache, "cache_key", "left_anti").select("doc_id")


@query()
def html_chunks(spark, d):
    return chunks.chunk_pages(table(spark, d, "pages"), chunks.Limits(20, 60, 120, 200))


@query()
def page_text(spark, d):
    return chunks.page_texts(table(spark, d, "pages"))


@query()
def parents_without_children(spark, d):
    return chunks.parents_without_children(chunks.chunk_pages(table(spark, d, "pages")))


# ---- search


def _queries(spark, d) -> DataFrame:
    """All benchmark passages as queries."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


def _vector_queries(spark, d) -> DataFrame:
    """The queries that have a vector, which is that of the row with their number."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return _queries(spark, d).join(vectors, "query")


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))


_BM25 = r"""WITH b AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS ts FROM documents),
p AS (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM b), tf AS (SELECT doc, dl, term, count(*) AS tf FROM p GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS mean FROM b), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, n), low AS (SELECT avg(idf) * 0.25 AS low FROM raw), idf AS (SELECT term, CASE WHEN idf < 0 THEN low ELSE idf END AS idf FROM raw, low),
q AS (SELECT item_id AS query, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS term FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)),
qt AS (SELECT query, term, count(*) AS times FROM q GROUP BY ALL),
bs AS (SELECT query, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term), n GROUP BY query, doc),
bm AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bs WHERE score > 0 QUALIFY rank <= 15),
ks AS (SELECT a.vec_id AS query, c.vec_id AS doc, round(list_dot_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings c),
kn AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ks QUALIFY rank <= 15),
fu AS (SELECT query, doc, round(sum(w / (60 + rank)), 9) AS score, min(s + rank) AS seen FROM (SELECT query, doc, rank, 0.3 AS w, 0 AS s FROM bm UNION ALL SELECT query, doc, rank, 0.7, 1048576 FROM kn) GROUP BY query, doc),
rr AS (SELECT query, doc, score::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen)::INTEGER AS rank FROM fu)
"""


@query(_BM25 + "SELECT query, doc, score, rank::INTEGER AS rank FROM bm")
def bm25_topk(spark, d):
    return search.bm25(search.bm25_index(_docs(spark, d)), _queries(spark, d), 15)


@query(_BM25 + "SELECT query, doc, score, rank::INTEGER AS rank FROM kn")
def knn_topk(spark, d):
    return search.nearest(_vectors(spark, d), _vector_queries(spark, d), 15)


@query(_BM25.replace("0.3 AS w", "0.3::DOUBLE AS w").replace("0.7, 1048576", "0.7::DOUBLE, 1048576") + "SELECT query, doc, score, rank FROM rr WHERE rank <= 5")
def rrf_hybrid(spark, d):
    return search.hybrid(search.bm25_index(_docs(spark, d)), _vectors(spark, d), _vector_queries(spark, d))


@query(_BM25 + """, c AS (SELECT bm.query, bm.rank, bm.doc, len(list_intersect(list_distinct(qx.ts), dx.ts))::DOUBLE / len(list_distinct(qx.ts)) AS s FROM bm
JOIN (SELECT item_id AS query, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS ts FROM benchmark) qx USING (query)
JOIN (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS ts FROM documents) dx USING (doc)),
m AS (SELECT *, min(s) OVER (PARTITION BY query) AS a, max(s) OVER (PARTITION BY query) AS z FROM c), x AS (SELECT query, doc, rank, CASE WHEN a = z THEN 1.0::DOUBLE ELSE round((s - a) / (z - a), 6) END AS score FROM m)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank)::INTEGER AS rank FROM x""")
def rerank_minmax(spark, d):
    docs, asked = _docs(spark, d), _queries(spark, d)
    rows = search.bm25(search.bm25_index(docs), asked, 15).join(docs.withColumnRenamed("text", "found"), "doc").join(asked.select("query", "text"), "query")
    return search.rerank(rows, search.coverage(F.col("text"), F.col("found"))).select("query", "doc", "score", "rank")


@query("""SELECT a.doc_id, CASE WHEN length(b.text) > 80 THEN substr(b.text, 1, 80) || '...' ELSE b.text END AS parent_text FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id * 2""")
def parent_context_join(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", (F.col("doc_id") * 2).alias("parent_id"))
    return search.with_parents(rows, docs.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("content")), 80).select("doc_id", "parent_text")


# ---- the stored index

_ASK = """ts AS (SELECT doc_id, {doc} AS doc, text FROM documents),
{found}
li AS (SELECT query, text, ts.doc, rank, 0.3::DOUBLE AS w, 0 AS s FROM bm JOIN ts USING (doc) UNION ALL SELECT query, text, ts.doc, rank, 0.7::DOUBLE, 1048576 FROM kn JOIN ts USING (doc)),
fu AS (SELECT query, min_by(doc, s + rank) AS doc, round(sum(w / (60 + rank)), 9) AS score, min(s + rank) AS seen FROM li GROUP BY query, text),
rr AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen) AS rank FROM fu QUALIFY rank <= 15),
c AS (SELECT query, rank, doc_id, len(list_intersect(list_distinct({low_q}), {low_t}))::DOUBLE / len(list_distinct({low_q})) AS cover, ts.text AS body FROM rr JOIN ts USING (doc) JOIN benchmark b ON b.item_id = rr.query WHERE doc_id % 13 <> 0),
m AS (SELECT *, min(cover) OVER (PARTITION BY query) AS a, max(cover) OVER (PARTITION BY query) AS z FROM c),
x AS (SELECT *, CASE WHEN a = z THEN 1.0::DOUBLE ELSE round((cover - a) / (z - a), 6) END AS score FROM m),
y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank)::INTEGER AS place FROM x)
SELECT query, place AS rank, score, doc_id::VARCHAR AS chunk_id, 'u' || doc_id % 13 AS url, sha256(body) AS text_sha256, 'parent ' || doc_id % 50 AS parent_text FROM y WHERE place <= 5"""


def _stored_sql(doc: str) -> str:
    low = lambda t: f"list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda t: t <> '')"
    found = _BM25[len("WITH ") : _BM25.index("fu AS (")].replace("SELECT doc_id AS doc,", f"SELECT {doc} AS doc,").replace("c.vec_id AS doc", "c.doc AS doc")
    found = found.replace("embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings c)", f"embeddings a JOIN benchmark ON item_id = a.vec_id, (SELECT {doc} AS doc, embedding FROM embeddings JOIN documents ON doc_id = vec_id) c)")
    # BM25 neither counts nor finds tombstoned chunks; vectors find them, and they are left out afterwards
    found = found.replace("AS ts FROM documents),", "AS ts FROM documents WHERE doc_id % 13 <> 0),", 1)
    return "WITH " + _ASK.format(doc=doc, found=found.strip(), low_q=low("b.text"), low_t=low("ts.text"))


def _index_chunks(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    name = lambda k, n: F.concat(F.lit(k), (F.col("doc_id") % n).cast("string"))
    rows = rows.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), name("u", 13).alias("url"), name("", 50).alias("parent_id"), F.col("lang").alias("heading_path"), "text", "vector")
    parents = spark.range(50).select(F.col("id").cast("string").alias("parent_id"), F.concat(F.lit("parent "), F.col("id").cast("string")).alias("content"))
    return rows, parents


def _searched(spark, d, built: index.SearchIndex) -> DataFrame:
    gone = spark.createDataFrame([("u0",)], "url string")
    found = built.without(gone).search(_vector_queries(spark, d))
    return found.select("query", "rank", "score", "chunk_id", "url", F.sha2("text", 256).alias("text_sha256"), "parent_text")


@query(_stored_sql("doc_id::VARCHAR || '@0'"))
def index_search(spark, d):
    rows, parents = _index_chunks(spark, d)
    return _searched(spark, d, index.SearchIndex.build(spark, shared_folder(spark, "index"), rows.drop("doc_id"), parents))


@query(_stored_sql("doc_id::VARCHAR || CASE WHEN doc_id % 10 < 7 THEN '@0' ELSE '@1' END"))
def index_append(spark, d):
    rows, parents = _index_chunks(spark, d)
    folder = shared_folder(spark, "index")
    index.SearchIndex.build(spark, folder, rows.where("doc_id % 10 < 7").drop("doc_id"), parents)
    return _searched(spark, d, index.SearchIndex.load(spark, folder).append(rows.drop("doc_id")))


# ---- crawling

_SITE = "https://docs.example.com/"


def _fetched(spark, d) -> DataFrame:
    k = F.col("page_id")
    status = F.when(k % 20 == 0, 404).when(k % 20 == 1, 500).when(k % 20 == 2, -1).when(k % 20 == 3, 0).otherwise(200)
    rows = table(spark, d, "pages").withColumn("url", F.concat(F.lit(_SITE), k.cast("string")))
    return rows.select("page_id", "url", F.when(k % 17 == 0, F.concat(F.lit("https://other.org/"), k.cast("string"))).otherwise(F.col("url")).alias("final_url"), F.when(k % 13 == 0, "application/pdf").otherwise("Text/HTML; charset=utf-8").alias("content_type"), status.alias("status"), F.col("html").alias("body"))


_OK = "(page_id % 20 >= 4 AND page_id % 17 <> 0 AND page_id % 13 <> 0)"
_STATUS = "CASE page_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE 200 END"


@query(f"SELECT page_id, CASE WHEN {_OK} THEN length(html) ELSE 0 END::INTEGER AS n_chars, {_STATUS}::INTEGER AS status FROM pages")
def fetch_accept(spark, d):
    return crawl.accepted(_fetched(spark, d), F.lit(_SITE)).select("page_id", F.length("html").alias("n_chars"), "status")


_DAY = "CASE WHEN page_id % 5 <> 0 THEN strftime(DATE '2024-01-01' + (page_id % 30)::INTEGER, '%Y-%m-%d') END"


@query(f"""WITH p AS (SELECT page_id, html, {_DAY} AS lastmod, page_id % 3 = 0 AND (page_id % 5 = 0 OR page_id % 9 <> 0) AS hit FROM pages WHERE page_id % 11 <> 0)
SELECT page_id, hit AS from_cache, CASE WHEN NOT hit THEN {_STATUS} END::INTEGER AS status, CASE WHEN hit OR {_OK} THEN length(html) END::INTEGER AS n_chars,
page_id % 3 = 0 OR (NOT hit AND {_OK}) AS cached FROM p""")
def crawl_refresh(spark, d):
    k = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")), "yyyy-MM-dd")
    rows = _fetched(spark, d).withColumn("lastmod", F.when(k % 5 != 0, day))
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    cache = rows.where("page_id % 3 = 0").select("url", F.col("body").alias("html"), F.when(k % 9 == 0, F.concat(F.lit("old "), "lastmod")).otherwise(F.col("lastmod")).alias("lastmod"), now.alias("cached_at"))
    failed = rows.where("page_id % 11 = 0").select("url", F.lit(3).alias("failure_count"))
    wanted = crawl.fetch_set(rows.select("url", "lastmod"), failed)
    pages = PageCache(spark, shared_folder(spark, "pages"))
    pages.save(cache)
    done = build.read_pages(wanted, pages, lambda asked: rows.drop("lastmod").join(asked.select("url"), "url"), F.lit(_SITE), now)
    out = wanted.join(rows.select("url", "page_id"), "url").join(done.pages.select("url", "from_cache", F.length("html").alias("n_chars")), "url", "left").join(done.log.select("url", "status"), "url", "left").join(done.cache.select("url", F.lit(True).alias("cached")), "url", "left")
    return out.select("page_id", F.coalesce("from_cache", F.lit(False)).alias("from_cache"), "status", "n_chars", F.coalesce("cached", F.lit(False)).alias("cached"))


@query("""WITH r AS (SELECT page_id, 1 + page_id % 5 AS day, 'v1' AS lastmod, html FROM pages UNION ALL SELECT page_id, 3, 'v2', html || '!' FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 4, NULL, NULL FROM pages WHERE page_id % 11 = 0 UNION ALL SELECT page_id, 6, 'v3', 'again' FROM pages WHERE page_id % 22 = 0),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY day DESC, lastmod DESC NULLS LAST) = 1)
SELECT page_id, lastmod, length(html)::INTEGER AS n_chars, sha256(html) AS digest, page_id % 2 = 0 AS asked FROM f WHERE html IS NOT NULL""")
def page_cache(spark, d):
    """All pages after saves, a removal and a compaction; those that a lookup of URLs finds are marked."""
    k = F.col("page_id")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n).cast("timestamp")
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit(_SITE), k.cast("string")).alias("url"), "html")
    cache = PageCache(spark, shared_folder(spark, "pages"))
    cache.save(rows.withColumns({"lastmod": F.lit("v1"), "cached_at": day((k % 5).cast("int"))}))
    cache.save(rows.where(k % 3 == 0).withColumns({"html": F.concat("html", F.lit("!")), "lastmod": F.lit("v2"), "cached_at": day(F.lit(2))}))
    cache.remove(rows.where(k % 11 == 0).select("url"), day(F.lit(3)))
    cache.compact()
    cache.save(rows.where(k % 22 == 0).withColumns({"html": F.lit("again"), "lastmod": F.lit("v3"), "cached_at": day(F.lit(5))}))
    found = cache.lookup(rows.where(k % 2 == 0).select("url"), "url").select("url", F.lit(True).alias("asked"))
    out = cache.read().join(found, "url", "left")
    return out.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "lastmod", F.length("html").alias("n_chars"), F.sha2("html", 256).alias("digest"), F.coalesce("asked", F.lit(False)).alias("asked"))


@query("""WITH p AS (SELECT page_id, page_id // 50 AS s, CASE WHEN page_id % 5 <> 0 THEN strftime(DATE '2024-01-01' + (page_id % 30)::INTEGER, '%Y-%m-%d') END AS lastmod FROM pages),
s AS (SELECT DISTINCT s, s // 50 AS m, CASE WHEN s % 3 <> 0 THEN strftime(DATE '2024-02-01' + (s % 28)::INTEGER, '%Y-%m-%d') END AS sm FROM p),
r AS (SELECT s, m, sm, row_number() OVER (PARTITION BY m ORDER BY coalesce(sm, '') DESC, s) AS place FROM s),
m AS (SELECT m, row_number() OVER (ORDER BY m) AS place FROM (SELECT DISTINCT m FROM s))
SELECT page_id, lastmod, CASE WHEN s % 3 <> 0 AND s % 4 = 1 THEN true ELSE false END AS from_cache, m.place::INTEGER AS at_index, r.place::INTEGER AS at_set,
row_number() OVER (PARTITION BY s ORDER BY coalesce(lastmod, '') DESC, page_id)::INTEGER AS at_url FROM p JOIN r USING (s) JOIN m USING (m)""")
def sitemap_recursion(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.floor(k / 50).alias("s"), F.when(k % 5 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")), "yyyy-MM-dd")).alias("lastmod"))
    entry = lambda kind, loc, day: F.concat(F.lit(f"<{kind}><loc> "), loc, F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>")), F.lit("")), F.lit(f"</{kind}>"))
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("v")))), lambda x: x["v"]), "")
    head, space = F.lit('<?xml version="1.0"?>'), "xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'"
    name = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    # 50 URLs a set and 50 sets an index
    leaves = rows.groupBy("s").agg(ordered("page_id", entry("url", name("https://docs.example.com/", k), F.col("lastmod"))).alias("body"))
    leaves = leaves.withColumn("day", F.when(F.col("s") % 3 != 0, F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), (F.col("s") % 28).cast("int")), "yyyy-MM-dd")))
    sets = leaves.select(name("set", F.col("s")).alias("sitemap"), F.concat(head, F.lit(f"<urlset {space}>"), "body", F.lit("</urlset>")).alias("xml"))
    middle = leaves.groupBy(F.floor(F.col("s") / 50).alias("m")).agg(ordered("s", entry("sitemap", name("set", F.col("s")), F.col("day"))).alias("body"))
    indexes = middle.select("m", name("index", F.col("m")).alias("sitemap"), F.concat(head, F.lit(f"<sitemapindex {space}>"), "body", F.lit("<sitemap><loc>missing</loc></sitemap></sitemapindex>")).alias("xml"))
    cached = rows.where("s % 4 = 1").groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "lastmod"))), lambda x: F.struct(F.concat(F.lit("https://docs.example.com/"), x["page_id"].cast("string")).alias("loc"), x["lastmod"].alias("lastmod"))).alias("urls"))
    cache = cached.join(leaves.select("s", "day"), "s").select(name("set", F.col("s")).alias("sitemap"), F.col("day").alias("lastmod"), "urls")
    found = sitemaps.resolve(sets.unionByName(indexes.drop("m")), indexes.select("sitemap", F.col("m").alias("ord")), cache)
    return found.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "lastmod", "from_cache", F.col("place")[0].alias("at_index"), F.col("place")[1].alias("at_set"), F.col("place")[2].alias("at_url"))


@query("""WITH s AS (SELECT k, page_id, 'v' || (page_id * k) % 3 AS lastmod FROM pages, range(3) AS r(k) WHERE page_id % 7 <> k + 1),
c AS (SELECT a.k, count(*) FILTER (WHERE b.page_id IS NULL) AS n_new, count(*) FILTER (WHERE b.lastmod <> a.lastmod) AS n_updated, count(*) FILTER (WHERE b.lastmod = a.lastmod) AS n_unchanged FROM s a LEFT JOIN s b ON b.page_id = a.page_id AND b.k = a.k - 1 GROUP BY a.k),
g AS (SELECT a.k + 1 AS k, count(*) AS n_removed FROM s a LEFT JOIN s b ON b.page_id = a.page_id AND b.k = a.k + 1 WHERE b.page_id IS NULL AND a.k < 2 GROUP BY a.k)
SELECT k::BIGINT AS check_id, n_new::BIGINT AS n_new, n_updated::BIGINT AS n_updated, coalesce(n_removed, 0)::BIGINT AS n_removed, n_unchanged::BIGINT AS n_unchanged FROM c LEFT JOIN g USING (k)""")
def stream_updater(spark, d):
    folder = shared_folder(spark, "updater")
    for k in range(3):
        snapshot = table(spark, d, "pages").where(f"page_id % 7 <> {k + 1}").select(F.concat(F.lit(_SITE), F.col("page_id").cast("string")).alias("url"), F.concat(F.lit("v"), ((F.col("page_id") * k) % 3).cast("string")).alias("lastmod"))
        snapshot.coalesce(1).write.mode("append").parquet(f"{folder}/snapshots")
    stream = spark.readStream.schema("url string, lastmod string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/snapshots")
    own = updater.Updater(spark, f"{folder}/state")
    own.start(stream, f"{folder}/checkpoint").awaitTermination()
    return own.log().select("check_id", "n_new", "n_updated", "n_removed", "n_unchanged")


_MOST = 60
_LEFT = "SELECT page_id, s, lastmod FROM i{k} WHERE page_id NOT IN (SELECT page_id FROM a{k})"


def _updates_sql() -> str:
    """Three checks: what is new, updated or removed; of the first two the newest, over all sites; what is indexed then."""
    steps = ["i0 AS (SELECT page_id, page_id % 3 AS s, NULL::VARCHAR AS lastmod FROM pages WHERE false)"]
    for k in range(3):
        steps.append(f"s{k} AS (SELECT page_id, page_id % 3 AS s, 'v' || (page_id * {k}) % 3 AS lastmod FROM pages WHERE page_id % 7 <> {k + 1})")
        steps.append(f"c{k} AS (SELECT coalesce(n.page_id, o.page_id) AS page_id, coalesce(n.s, o.s) AS s, n.lastmod, CASE WHEN o.page_id IS NULL THEN 'new' WHEN n.page_id IS NULL THEN 'removed' WHEN n.lastmod <> o.lastmod THEN 'updated' ELSE 'unchanged' END AS kind FROM s{k} n FULL JOIN i{k} o ON n.page_id = o.page_id)")
        steps.append(f"a{k} AS (SELECT * FROM c{k} WHERE kind = 'removed' UNION ALL (SELECT * FROM c{k} WHERE kind IN ('new', 'updated') ORDER BY lastmod DESC, 'https://site' || s || '.org/' || page_id LIMIT {_MOST}))")
        steps.append(f"i{k + 1} AS ({_LEFT.format(k=k)} UNION ALL SELECT page_id, s, lastmod FROM a{k} WHERE kind <> 'removed')")
    count = lambda kind: f"count(*) FILTER (WHERE c.kind = '{kind}') AS n_{kind}"
    rows = [f"SELECT {k}::BIGINT AS check_id, 'site' || c.s AS site, {', '.join(map(count, ('new', 'updated', 'removed', 'unchanged')))}, count(a.page_id) AS n_applied FROM c{k} c LEFT JOIN a{k} a USING (page_id) GROUP BY c.s" for k in range(3)]
    return f"WITH {', '.join(steps)}, r AS ({' UNION ALL '.join(rows)}) SELECT r.*, (SELECT count(*) FROM i3 WHERE 'site' || s = r.site) AS n_indexed FROM r"


@query(_updates_sql())
def updater_index(spark, d):
    """Checks of three sites that change a stored index, a limited number of URLs at a time; the rest comes with the next check."""
    folder = shared_folder(spark, "updates")
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("site"), (F.col("page_id") % 3).cast("string")).alias("site"), F.concat(F.lit("https://site"), (F.col("page_id") % 3).cast("string"), F.lit(".org/"), F.col("page_id").cast("string")).alias("url"), "html")

    def chunks_of(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = pages.join(urls.select("url"), "url")
        return rows.select(F.col("page_id").cast("string").alias("chunk_id"), "url", F.lit("p").alias("parent_id"), F.col("site").alias("heading_path"), F.coalesce("html", F.lit("")).alias("text")), rows.select("url")

    own = updater.Updater(spark, f"{folder}/state", build.index_updates(spark, f"{folder}/index", chunks_of, _MOST))
    for k in range(3):
        own.check(pages.where(f"page_id % 7 <> {k + 1}").select("site", "url", F.concat(F.lit("v"), ((F.col("page_id") * k) % 3).cast("string")).alias("lastmod")), k)
    indexed = index.SearchIndex.load(spark, f"{folder}/index").active().groupBy(F.col("heading_path").alias("site")).agg(F.count("*").alias("n_indexed"))
    return own.log().join(indexed, "site").select("check_id", "site", "n_new", "n_updated", "n_removed", "n_unchanged", "n_applied", "n_indexed")


@query()
def updater_clock(spark, d):
    """When checks of sites are due: commands are events, of which each user's first adds the site."""
    k = F.col("event_id") % 7
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    command = F.when(first, updater.ADD).when(k == 0, updater.CHECK).when(k == 1, updater.PAUSE).when(k == 2, updater.RESUME).otherwise(updater.TICK)
    folder = shared_folder(spark, "clock")
    table(spark, d, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("site"), F.col("ts").cast("timestamp").alias("at"), command.alias("command")).write.parquet(f"{folder}/commands")
    stream = spark.readStream.schema("site string, at timestamp, command string").parquet(f"{folder}/commands")
    said = updater.decisions(stream, first=3600, interval=48 * 3600, least=6 * 3600)
    said.writeStream.format("parquet").option("path", f"{folder}/said").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(updater.DECISIONS).parquet(f"{folder}/said").withColumn("at", F.col("at").cast("timestamp_ntz"))


# ---- fetching

_ANSWERS = """CASE WHEN k % 11 = 0 THEN 404 WHEN k % 7 = 0 AND attempt <= k % 4 THEN 503 WHEN k % 13 = 0 AND attempt = 1 THEN 0 ELSE 200 END"""


class _Site:
    """Answers of pages by the number that their URL ends with, some only when asked again."""

    def __init__(self) -> None:
        self.asked: dict[str, int] = {}

    def __call__(self, page: str) -> tuple[str, str, int, str]:
        k, n = int(page.rsplit("/", 1)[1]), self.asked.get(page, 0) + 1
        self.asked[page] = n
        if k % 11 == 0:
            return page, "text/html", 404, ""
        if k % 7 == 0 and n <= k % 4:
            return page, "text/html", 503, "busy"
        if k % 13 == 0 and n == 1:
            raise ConnectionError(page)
        return page, "text/html", 200, f"<p>page {k}</p>"


@query(f"""WITH p AS (SELECT page_id AS k, attempt, {_ANSWERS} AS status FROM pages, range(1, 4) AS r(attempt)),
f AS (SELECT k, coalesce(min(attempt) FILTER (WHERE status NOT IN (0, 503)), 3) AS n FROM p GROUP BY k)
SELECT k AS page_id, attempt::INTEGER AS attempt, status::INTEGER AS status, CASE attempt WHEN 1 THEN 0.0::DOUBLE ELSE 0.002::DOUBLE * (attempt - 1) END AS waited, attempt = n AS last,
CASE WHEN status = 0 THEN 'ConnectionError: https://host' || k % 5 || '.org/' || k END AS error, CASE WHEN attempt = n AND status = 200 THEN '<p>page ' || k || '</p>' WHEN attempt = n AND status = 404 THEN '' WHEN attempt = n AND status = 503 THEN 'busy' END AS body FROM p JOIN f USING (k) WHERE attempt <= n""")
def fetch_attempts(spark, d):
    urls = table(spark, d, "pages").select(F.concat(F.lit("https://host"), (F.col("page_id") % 5).cast("string"), F.lit(".org/"), F.col("page_id").cast("string")).alias("url"))
    log = stored(fetch.attempts(urls, _Site(), per_host=2, tries=3, pause=0.002), "attempts")
    return log.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "attempt", "status", "waited", "last", "error", "body")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, t, i, true AS allowed, 2 * 43200000000 AS level FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.t, e.i, least(3 * 43200000000, r.level + e.t - r.t) >= 43200000000, least(3 * 43200000000, r.level + e.t - r.t) - CASE WHEN least(3 * 43200000000, r.level + e.t - r.t) >= 43200000000 THEN 43200000000 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, allowed FROM r""")
def rate_limit(spark, d):
    folder = shared_folder(spark, "limits")
    table(spark, d, "events").select(F.col("user_id").cast("string").alias("address"), F.col("event_id").alias("request"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{folder}/requests")
    stream = spark.readStream.schema("address string, request long, ts timestamp").parquet(f"{folder}/requests")
    rows = event_streams.rate_limited(stream, burst=3, every_seconds=12 * 3600)
    # with state that ends by the clock a query goes on without new rows, so one batch is asked for
    rows.writeStream.format("parquet").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(once=True).start().awaitTermination()
    told = spark.read.schema("address string, request long, at long, allowed boolean").parquet(f"{folder}/told")
    return told.select(F.col("address").cast("long").alias("user_id"), F.col("request").alias("event_id"), "allowed")


# ---- contexts


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'page ' || doc_id || ' of ' || source END AS context FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0""")
def contexts_resumed(spark, d):
    """Contexts of all documents that have a page, by two runs: the first one pauses itself in its third part."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "text", "source")
    pages = rows.where("CAST(chunk_id AS long) % 7 <> 0").select("url", F.concat(F.lit("page "), "chunk_id", F.lit(" of "), "source").alias("document"))
    job = contexts.ContextJob(spark, shared_folder(spark, "contexts"), save_every=-(-docs.count() // 5))
    job.plan(rows, pages)
    parts = []

    def write(asked: DataFrame) -> DataFrame:
        parts.append(1)
        if len(parts) == 3:
            job.pause()
        return asked.select("chunk_id", F.when(F.col("chunk_id").cast("long") % 5 == 0, "short").otherwise(F.col("document")).alias("context"))

    job.run(write)
    job.resume()
    contexts.ContextJob(spark, job.folder).run(write)
    return job.contexts().select(F.col("chunk_id").cast("long").alias("doc_id"), "context")


@query("""WITH c AS (SELECT *, doc_id % 3 = 0 AS kept FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id, CASE WHEN kept THEN 'cached context ' || doc_id ELSE 'page ' || doc_id || ' of ' || source END AS context, kept AS from_cache, sha256('<context>' || chr(10) || CASE WHEN kept THEN 'cached context ' || doc_id ELSE 'page ' || doc_id || ' of ' || source END || chr(10) || '</context>' || chr(10) || chr(10) || text) AS content_sha256 FROM c WHERE kept OR doc_id % 5 <> 0
UNION ALL SELECT doc_id, NULL, NULL, sha256(text) FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 3 <> 0 AND doc_id % 5 = 0)""")
def contextualize(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "text", "source")
    # pages of some chunks are missing, contexts of some are cached, and the writer says too little about some
    pages = rows.where("doc_id % 7 <> 0").select("url", F.concat(F.lit("page "), "chunk_id", F.lit(" of "), "source").alias("document"))
    cache = rows.where("doc_id % 3 = 0 and doc_id % 7 <> 0").select(text.context_key(F.col("chunk_id"), F.col("text")).alias("cache_key"), F.concat(F.lit("cached context "), "chunk_id").alias("context"))
    write = lambda asked: asked.select("chunk_id", F.when(F.col("chunk_id").cast("long") % 5 == 0, "short").otherwise(F.col("document")).alias("context"))
    made = build.contexts_of(rows, pages, cache, write)
    out = build.contextualized(rows, made).select("doc_id", "chunk_id", F.sha2("text", 256).alias("content_sha256"))
    return out.join(made.select("chunk_id", "context", "from_cache"), "chunk_id", "left").select("doc_id", "context", "from_cache", "content_sha256")


# ---- tombstones and updates


def _chunks(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("url"), F.lit(1).alias("version"), (F.col("doc_id") % 50).alias("parent_id"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 13 <> 0")
def tombstone_filter(spark, d):
    rows = _chunks(spark, d)
    return maintain.active(rows, rows.where("doc_id % 13 = 0").select("chunk_id", "url", "version")).select("doc_id")


@query("SELECT count(*) AS n_chunks, count(*) FILTER (WHERE doc_id % 13 = 0) AS n_tombstones, count(DISTINCT source) FILTER (WHERE doc_id % 13 = 0) AS n_urls, round(count(*) FILTER (WHERE doc_id % 13 = 0) / count(*)::DOUBLE, 6) AS ratio, count(*) FILTER (WHERE doc_id % 13 = 0) / count(*)::DOUBLE >= 0.1 AS rebuild_needed FROM documents")
def tombstone_stats(spark, d):
    rows = _chunks(spark, d)
    return maintain.tombstone_stats(rows, rows.where("doc_id % 13 = 0").select("chunk_id", "url", "version"))


@query("""WITH c AS (SELECT doc_id, source, CASE source WHEN 'src1' THEN 'removed' WHEN 'src2' THEN 'updated' WHEN 'src3' THEN 'updated' END AS k FROM documents)
SELECT doc_id, 1 AS version FROM c WHERE k IS NULL OR source = 'src3' UNION ALL SELECT doc_id, 2 FROM c WHERE source = 'src2'""")
def incremental_apply(spark, d):
    rows = _chunks(spark, d)
    change = spark.createDataFrame([("src1", "removed", None, "2024-01-01"), ("src2", "updated", "2024-01-03", None), ("src3", "updated", "2024-01-02", None)], "url string, change_type string, new_lastmod string, old_lastmod string")
    none = rows.where("false").select("chunk_id", "url", "version")
    done = maintain.apply_changes(rows, none, change, rows.drop("version"), 1, 2)
    return maintain.active(done.chunks, done.tombstones).select("doc_id", "version")


# ---- evaluation


def _cases(spark, d, top_k: int) -> DataFrame:
    """Benchmark passages as test cases: a source's pages and texts with the passage are relevant."""
    wanted = F.concat(F.lit("https://src"), (F.col("query") % 20).cast("string"), F.lit("/"))
    return _queries(spark, d).select("query", F.col("text").alias("question"), F.array(wanted).alias("relevant_urls"), F.array("text").alias("relevant_keywords"), F.lit(top_k).alias("top_k"))


def _retriever(spark, d) -> evaluate.Retriever:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", F.concat(F.lit("https://"), "source", F.lit("/"), "lang").alias("url"))
    made = search.bm25_index(docs)
    return lambda asked: search.bm25(made, asked.withColumnRenamed("question", "text"), 5).join(docs, "doc")


_JUDGED = _BM25 + """, j AS (SELECT bm.query, rank, coalesce(contains(lower(d.text), lower(b.text)) OR contains('https://' || d.source || '/' || d.lang, 'https://src' || bm.query % 20 || '/'), false)::INTEGER AS rel FROM bm JOIN documents d ON d.doc_id = bm.doc JOIN benchmark b ON b.item_id = bm.query WHERE rank <= {k}),
a AS (SELECT query, sum(rel) AS hits, count(*) AS n, min(rank) FILTER (WHERE rel = 1) AS first, sum(rel / log2(rank + 1)) AS dcg FROM j GROUP BY query),
i AS (SELECT query, sum(1 / log2(g + 1)) AS ideal FROM a, unnest(range(1, hits::BIGINT + 1)) AS r(g) GROUP BY query),
m AS (SELECT q.query, round(coalesce(hits, 0)::DOUBLE, 6) AS recall, round(coalesce(hits::DOUBLE / n, 0), 6) AS precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg, coalesce(hits, 0)::BIGINT AS n_found, 2 AS n_relevant, coalesce(hits, 0) > 0 AS passed FROM (SELECT DISTINCT query FROM q) q LEFT JOIN a USING (query) LEFT JOIN i USING (query))
"""


@query(_JUDGED.format(k=5) + "SELECT * FROM m")
def relevance_metrics(spark, d):
    return evaluate.run_cases(_cases(spark, d, 5), _retriever(spark, d)).drop("search_time", "settings")


@query(_JUDGED.format(k=5) + "SELECT count(*) AS total, coalesce(sum(passed::INTEGER), 0)::BIGINT AS n_passed, round(avg(passed::INTEGER), 6) AS pass_rate, round(avg(recall), 6) AS avg_recall, round(avg(precision), 6) AS avg_precision, round(avg(mrr), 6) AS avg_mrr, round(avg(ndcg), 6) AS avg_ndcg FROM m")
def eval_summary(spark, d):
    return evaluate.summary(evaluate.run_cases(_cases(spark, d, 5), _retriever(spark, d)))


_AVERAGES = "SELECT unnest(['recall', 'precision', 'mrr', 'ndcg']) AS metric, unnest([round(avg(recall), 6), round(avg(precision), 6), round(avg(mrr), 6), round(avg(ndcg), 6)]) AS v FROM m"


@query(f"WITH x AS ({_JUDGED.format(k=1)}{_AVERAGES}), y AS ({_JUDGED.format(k=5)}{_AVERAGES}) SELECT metric, x.v AS a, y.v AS b, round(y.v - x.v, 6) AS delta FROM x JOIN y USING (metric)")
def ab_compare(spark, d):
    retrieve = _retriever(spark, d)
    return evaluate.ab_deltas(*(evaluate.run_cases(_cases(spark, d, k), retrieve) for k in (1, 5)))


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(text) < 100 THEN 'too short: ' || length(text) END, CASE WHEN length(text) > 900 THEN 'too long: ' || length(text) END,
CASE WHEN NOT contains(lower(text), 'the') THEN 'missing: the' END, CASE WHEN contains(lower(text), 'que') THEN 'unexpected: que' END], lambda x: x IS NOT NULL), '; ') AS issues FROM conversations WHERE role = 'assistant'""")
def response_validation(spark, d):
    issues = evaluate.response_issues(F.col("text"), F.lit(100), F.lit(900), F.array(F.lit("The")), F.array(F.lit("QUE")))
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.array_join(issues, "; ").alias("issues"))


# ---- chats


@query("SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def transcript_assemble(spark, d):
    rows = chat_streams.transcripts(table(spark, d, "conversations"))
    return rows.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"), 256).alias("digest"))


@query("SELECT conv_id, role, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id, role")
def turn_stats(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def _marked(spark, d) -> DataFrame:
    k = F.col("turn") % 4
    marked = F.concat(F.lit("think "), F.lit(chat.BEGIN), F.lit(" "), "text", F.lit('<tool_calls>[{"name":"search","arguments":"{}"}]</tool_calls> '), F.lit(chat.END))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(k == 1, marked).when(k == 2, F.concat(F.lit("<|start|>x<|message|>"), "text")).otherwise(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, turn % 4 = 2 AS malformed FROM conversations")
def malformed_tokens(spark, d):
    return _marked(spark, d).select("conv_id", "turn", chat.malformed(F.col("text")).alias("malformed"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN '<|start|>x<|message|>' || text WHEN turn % 4 = 1 THEN trim(text, ' ' || chr(10)) ELSE text END AS answer, (turn % 4 = 1)::INTEGER AS n_calls FROM conversations")
def thinker_extract(spark, d):
    return _marked(spark, d).select("conv_id", "turn", chat.final_response(F.col("text")).alias("answer"), F.size(chat.embedded_calls(F.col("text"))).alias("n_calls"))


_SUMS = (("2 + 3 * 4", "14"), ("2 ** 10", "1024"), ("7 / 2", "3.5"), ("8 / 2", "4"), ("7 // 2", "3"), ("-7 % 3", "2"), ("1 / 0", "Error: division by zero"), ("True", "Error: unsupported expression"), ("'a'", "Error: unsupported expression"))


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in row) + ')' for row in _SUMS)}) AS t(expression, result)")
def calculator_udf(spark, d):
    return spark.createDataFrame([(e,) for e, _ in _SUMS], "expression string").select("expression", chat.calculate("expression").alias("result"))


# ---- events and streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_log_windows(spark, d):
    return event_streams.event_windows(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return event_streams.event_sessions(table(spark, d, "events")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT user_id::VARCHAR AS updater, event_id AS checked_at, count(*) OVER w AS checks, (sum(length(event_type)) OVER w)::BIGINT AS pages FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def updater_running_totals(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("updater"), F.col("event_id").alias("checked_at"), F.length("event_type").alias("pages"))
    return maintain.running_totals(rows, ("pages",))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def stream_marker_filter(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("piece"))
    ends = rows.groupBy("conv_id").agg(F.min("seq").alias("a"), F.max("seq").alias("z"))
    whole = rows.join(ends, "conv_id").select("conv_id", "seq", F.concat(F.when(F.col("seq") == F.col("a"), F.lit("x" + chat.BEGIN)).otherwise(""), "piece", F.when(F.col("seq") == F.col("z"), F.lit(chat.END + "y")).otherwise("")).alias("piece"))
    return chat_streams.filter_markers_batch(whole)
