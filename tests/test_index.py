"""The stored index, crawls that are built and refreshed, sitemaps, contexts, the updater."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spindrift.functions import html
from spindrift.operators import build, chunks, crawl, index, maintain, search
from spindrift.sources import sitemaps
from spindrift.sources.store import Changed, Store, shared_folder
from spindrift.streaming import updater

CHUNKS = "chunk_id string, url string, parent_id string, heading_path string, text string"


def some_chunks(spark, rows):
    return spark.createDataFrame([(k, u, p, "h", t) for k, u, p, t in rows], CHUNKS)


@pytest.fixture
def built(spark):
    rows = some_chunks(spark, [("a", "u1", "p1", "spark joins rows"), ("b", "u1", "p1", "spark sorts rows"), ("c", "u2", "p2", "trees and leaves"), ("d", "u3", "p3", None), ("e", "u3", "p3", "trees and leaves")])
    parents = spark.createDataFrame([("p1", "all about spark"), ("p2", "all about trees")], "parent_id string, content string")
    return index.SearchIndex.build(spark, shared_folder(spark, "index"), rows, parents)


def asked(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query int, text string")


def test_search_of_a_stored_index(spark, built):
    again = index.SearchIndex.load(spark, built.store.folder)
    assert again.state == built.state and built.state["n"] == 5
    rows = again.search(asked(spark, "spark rows", "leaves"), top_k=2).collect()
    assert [(r.chunk_id, r.rank, r.parent_text) for r in sorted(rows, key=lambda r: (r.query, r.rank)) if r.query == 0] == [("a", 1, "all about spark"), ("b", 2, "all about spark")]
    # equal texts are one result, of the chunk that is seen first
    leaves = {r.chunk_id for r in rows if r.query == 1}
    assert len(leaves & {"c", "e"}) == 1
    assert [r.rank for r in again.search(asked(spark, "spark rows"), top_k=2, rerank=None, with_parents=False).orderBy("rank").collect()] == [1, 2]
    assert index.SearchIndex.load(spark, shared_folder(spark, "none")) is None
    with pytest.raises(ValueError):
        index.SearchIndex.build(spark, shared_folder(spark, "index"), some_chunks(spark, []))


def test_tombstones_appends_and_compaction(spark, built):
    marked = built.without(spark.createDataFrame([("u1",)], "url string"))
    assert {r.chunk_id for r in marked.active().collect()} == {"c", "d", "e"}
    assert not {"a", "b"} & {r.chunk_id for r in marked.search(asked(spark, "spark rows")).collect()}
    # a page that comes back under the same ids is found again; what is active is not added twice
    more = marked.append(some_chunks(spark, [("a", "u1", "p1", "spark joins rows again"), ("c", "u2", "p2", "trees and leaves")]))
    assert sorted(r.chunk_id for r in more.active().collect()) == ["a", "c", "d", "e"] and more.state["n"] == 4
    assert more.search(asked(spark, "spark rows again"), top_k=1).first().text == "spark joins rows again"
    assert more.append(some_chunks(spark, [("c", "u2", "p2", "x")])).number == more.number
    small = more.compact()
    assert small.chunks().count() == 4 and small.tombstones().count() == 0 and {r.parent_id for r in small.parents().collect()} == {"p1", "p2"}
    assert small.search(asked(spark, "trees"), top_k=1).first().text == "trees and leaves"
    # what was committed before is read until the next commit, and a batch that was never committed is not
    small.store.write("chunks", small.chunks())
    assert index.SearchIndex.load(spark, small.store.folder).chunks().count() == 4


def test_vectors_and_contexts_are_made_anew(spark, built):
    zeros = lambda text: F.array_repeat(F.when(text.contains("trees"), 1.0).otherwise(0.0), 2)
    new = built.rebuild_vectors(zeros, "two")
    assert new.state["model"] == "two" and {tuple(r.vector) for r in new.vectors().collect()} == {(1.0, 1.0), (0.0, 0.0)}
    # vectors that are not those committed are made anew on loading
    new.store.write("vectors", new.store.read("vectors", new.batches("vectors")).limit(0), new.batches("vectors")[0])
    assert new.vectors().count() == 0
    healed = index.SearchIndex.load(spark, new.store.folder, zeros)
    assert healed.number > new.number and healed.vectors().count() == 5
    told = built.with_contexts(spark.createDataFrame([("a", "about joining of tables"), ("b", "short")], "chunk_id string, context string"))
    texts = {r.chunk_id: r.text for r in told.chunks().collect()}
    assert texts["a"].startswith("<context>\nabout joining of tables\n</context>") and texts["b"] == "spark sorts rows"
    assert told.search(asked(spark, "joining tables"), top_k=1).first().chunk_id == "a"


def test_update_counts_what_it_does(spark, built):
    changes = spark.createDataFrame([("u1", "updated", "2024-02-01", None), ("u2", "removed", None, None), ("u4", "new", None, None), ("u5", "updated", "2024-01-01", None)], "url string, change_type string, new_lastmod string, old_lastmod string")
    fetched = some_chunks(spark, [("a", "u1", "p1", "spark joins new rows"), ("f", "u4", "p4", "fresh page"), ("g", "u9", "p9", "not asked for")])
    done = built.update(changes, fetched, threshold=0.9)
    assert done.counts == {"removed": 1, "updated": 1, "added": 1, "chunks_removed": 3, "chunks_added": 2, "rebuilt": False} and done.index.number == built.number + 1
    assert sorted((r.url, r.change_type) for r in done.applied.collect()) == [("u1", "updated"), ("u2", "removed"), ("u4", "new")]
    now = done.index
    assert {r.chunk_id: r.text for r in now.active().collect()} == {"a": "spark joins new rows", "f": "fresh page", "d": None, "e": "trees and leaves"}
    assert {r.url for r in now.urls().collect()} == {"u1", "u3", "u4"}
    assert {(r.url, r.lastmod) for r in now.urls(spark.createDataFrame([("u4", "2024")], "url string, lastmod string")).collect()} == {("u1", None), ("u3", None), ("u4", "2024")}
    rebuilt = now.update(changes, fetched, threshold=0.1)
    assert rebuilt.counts["rebuilt"] and rebuilt.index.tombstones().count() == 0 and rebuilt.index.number == now.number + 1


def statistics(own):
    df = {r.term: r.df for r in own.terms().groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect()}
    return df, own.state["n"], own.state["total"], round(own.state["mean"], 9), round(own.state["low"], 9)


def test_statistics_by_difference_equal_a_rebuild(spark, built, monkeypatch):
    monkeypatch.setattr(index, "MERGED", 2)
    own = built
    for k in range(4):
        own = own.append(some_chunks(spark, [(f"n{k}", f"v{k % 4}", "p1", f"rows number {k} of spark"), (f"m{k}", "w", "p1", "leaves " * k)]))
        if k % 2:
            own = own.without(spark.createDataFrame([(f"v{k % 4}",), ("none",)], "url string"))
    own = own.replaced(spark.createDataFrame([("w",)], "url string"), some_chunks(spark, [("m1", "w", "p1", "leaves and rows")]))
    assert len(own.batches("terms")) <= 4 and max(b["level"] for b in own.state["tables"]["terms"]) >= 2
    anew = index.SearchIndex.build(spark, shared_folder(spark, "index"), own.active().select(*index.CHUNK))
    assert statistics(own) == statistics(anew)
    assert own.search(asked(spark, "rows of spark"), top_k=1).count() == 1


def test_an_append_reads_no_old_postings_and_a_load_no_vectors(spark, built, monkeypatch):
    read = []
    real = Store.read
    monkeypatch.setattr(Store, "read", lambda self, table, batches, *a: read.append((table, tuple(batches))) or real(self, table, batches, *a))
    old = set(built.batches("postings"))
    more = built.append(some_chunks(spark, [("z", "u9", "p1", "rows of z")]))
    assert not any(old & set(b) for t, b in read if t == "postings") and not any(t == "vectors" for t, _ in read)
    files = []
    hashed = Store.digests
    monkeypatch.setattr(Store, "digests", lambda self, batches: files.extend(batches) or hashed(self, batches))
    assert index.SearchIndex.load(spark, more.store.folder).state == more.state and not files
    assert index.SearchIndex.load(spark, more.store.folder, verify=True).state == more.state and len(files) == sum(map(len, more.state["tables"].values()))


def files_of(own, table):
    folder = own.store.path(table, own.batches(table)[0]).removeprefix("file:")
    return sorted(p for p in Path(folder).iterdir() if p.suffix == ".parquet")


@pytest.mark.parametrize("how", ["changed", "missing", "doubled"])
def test_damaged_files_are_found(spark, built, how):
    def damage(own, table):
        one = files_of(own, table)[0]
        if how == "changed":
            data = bytearray(one.read_bytes())
            data[len(data) // 2] ^= 1
            one.with_name(f".{one.name}.crc").unlink(missing_ok=True)
            one.write_bytes(data)
        elif how == "missing":
            one.unlink()
        else:
            shutil.copy(one, one.with_name("copy.parquet"))

    damage(built, "postings")
    healed = index.SearchIndex.load(spark, built.store.folder)
    assert healed.number == built.number + 1 and statistics(healed) == statistics(built)
    assert healed.search(asked(spark, "leaves"), top_k=1).count() == 1
    damage(healed, "tombstones" if healed.batches("tombstones") else "parents")
    with pytest.raises(Changed):
        index.SearchIndex.load(spark, built.store.folder)


def test_digests_of_many_files_are_a_tree(spark, monkeypatch):
    store = Store(spark, shared_folder(spark, "digests"))
    a, b = (store.write("x", spark.range(40).repartition(n, "id")) for n in (7, 2))
    whole = store.digests([("x", a), ("x", b)])
    monkeypatch.setattr("spindrift.sources.store.FAN", 2)
    tree = store.digests([("x", a), ("x", b)])
    assert store.digests([("x", a)])[0] != whole[0] and tree == store.digests([("x", a), ("x", b)]) and len(set(whole + tree)) >= 3
    files_ = sorted(p for p in Path(store.path("x", a).removeprefix("file:")).iterdir() if p.suffix == ".parquet")
    files_[0].unlink()
    assert store.digests([("x", a), ("x", b)])[0] != tree[0]


class Stopped(BaseException):
    pass


def test_a_change_that_stops_leaves_the_state_before_it(spark, built, monkeypatch):
    """An update is stopped after each of its writes, and just before its commit."""
    changes = spark.createDataFrame([("u1", "updated", "2024-02-01", None), ("u2", "removed", None, None)], "url string, change_type string, new_lastmod string, old_lastmod string")
    fetched = some_chunks(spark, [("a", "u1", "p1", "spark joins new rows")])
    before = {r.chunk_id: r.text for r in built.active().collect()}
    write, commit = Store.write, Store.commit
    steps = 0
    while True:
        left = [steps]

        def stop(*_, left=left):
            if left[0] == 0:
                raise Stopped
            left[0] -= 1

        monkeypatch.setattr(Store, "write", lambda self, *a, stop=stop: (write(self, *a), stop())[0])
        monkeypatch.setattr(Store, "commit", lambda self, *a, stop=stop: (stop(), commit(self, *a))[1])
        try:
            built.update(changes, fetched, threshold=0.9)
            break
        except Stopped:
            steps += 3
        monkeypatch.setattr(Store, "write", write)
        monkeypatch.setattr(Store, "commit", commit)
        at = index.SearchIndex.load(spark, built.store.folder)
        assert at.number == built.number and {r.chunk_id: r.text for r in at.active().collect()} == before
    assert steps > 5
    after = {r.chunk_id: r.text for r in index.SearchIndex.load(spark, built.store.folder).active().collect()}
    assert after == {"a": "spark joins new rows", "d": None, "e": "trees and leaves"}


def test_two_writers_both_succeed(spark, built, monkeypatch):
    """Another writer commits between a change's reading and its commit: the change is made again."""
    commit, other = Store.commit, []

    def first(self, *a):
        if not other:
            other.append(True)
            other.append(index.SearchIndex.load(spark, built.store.folder).append(some_chunks(spark, [("y", "u8", "p1", "theirs"), ("z", "u9", "p1", "both")])))
        return commit(self, *a)

    monkeypatch.setattr(Store, "commit", first)
    own = built.append(some_chunks(spark, [("x", "u7", "p1", "ours"), ("z", "u9", "p1", "both")]))
    assert own.number == built.number + 2 == other[1].number + 1
    assert sorted(r.chunk_id for r in own.active().collect()) == ["a", "b", "c", "d", "e", "x", "y", "z"] and own.state["n"] == 8
    assert not own.store.commit(own.state, own.number) and own.store.commit(own.state, own.number + 1)


SITE = "https://site.org/"


def page(body):
    return f"<html><body><h1>Title</h1><p>{body} is a text of some length that counts as content here</p></body></html>"


def fetcher(spark, pages, seen):
    def fetch(asked):
        rows = [r.url for r in asked.collect()]
        seen.append(sorted(rows))
        return spark.createDataFrame([(u, u, "text/html", 200 if u in pages else 404, pages.get(u, "")) for u in rows], "url string, final_url string, content_type string, status int, body string")

    return fetch


def test_a_refresh_with_cached_pages_adds_nothing_twice(spark):
    pages = {SITE + "a": page("first"), SITE + "b": page("second"), SITE + "copy": page("first")}
    seen, folder, now = [], shared_folder(spark, "crawl"), F.lit("2024-05-01").cast("timestamp")
    urls = spark.createDataFrame([(u, "2024-01-01") for u in [*pages, SITE + "gone"]], "url string, lastmod string")
    limits = chunks.Limits(5, 50, 80, 100)
    run = lambda urls, **how: build.crawl_and_index(spark, folder, urls, fetcher(spark, pages, seen), F.lit(SITE), now, limits=limits, **how)
    one = run(urls)
    assert one.counts["by_status"] == {200: 3, 404: 1} and one.counts["failed"] == 1 and len(seen[0]) == 4
    first = {r.chunk_id: r.text for r in one.index.active().collect()}
    assert {r.url for r in one.index.urls().collect()} == {SITE + "a", SITE + "b"}  # the copy is left out
    cache = one.crawled.cache
    two = run(urls, cache=cache)
    assert seen[1] == [SITE + "gone"] and {r.chunk_id: r.text for r in two.index.active().collect()} == first and two.index.chunks().count() == len(first)
    pages[SITE + "b"] = page("changed")
    newer = spark.createDataFrame([(SITE + "a", "2024-01-01"), (SITE + "b", "2024-02-02")], "url string, lastmod string")
    three = run(newer, cache=two.crawled.cache)
    assert seen[2] == [SITE + "b"]
    texts = {r.text for r in three.index.active().collect()}
    assert any("changed" in t for t in texts) and not any("second" in t for t in texts) and len(texts) == len(first)
    # without a refresh, URLs that are indexed are not read; those that failed too often never are
    bad = spark.createDataFrame([(SITE + "gone", 3)], "url string, failure_count long")
    run(urls, cache=three.crawled.cache, refresh=False, failed=bad)
    assert seen[3] == []
    # a page that is cached but was never indexed, as after a run that stopped in between, is
    lost = spark.createDataFrame([(SITE + "lost", page("lost one"), "2024-01-01", None)], "url string, html string, lastmod string, cached_at timestamp").withColumn("cached_at", now)
    found = run(spark.createDataFrame([(SITE + "a", "2024-01-01"), (SITE + "lost", "2024-01-01")], "url string, lastmod string"), cache=three.crawled.cache.unionByName(lost), refresh=False)
    assert seen[4] == [] and any("lost one" in r.text for r in found.index.active().collect())
    told = run(urls, rebuild=True, cache=three.crawled.cache, contexts=build.headline_contexts)
    assert all(r.text.startswith("<context>\nFrom a page that begins: ") for r in told.index.chunks().collect())


def test_fetched_pages_off_site_or_of_another_kind_are_empty(spark):
    rows = spark.createDataFrame([("https://a.org/x", "https://b.org/x", "text/html", 200, "x"), ("https://a.org/x", "https://a.org/y", "application/pdf", 200, "x"), ("https://a.org/x", None, "text/html", 200, "x"), ("https://a.org/x", None, None, 0, None)], "url string, final_url string, content_type string, status int, body string")
    assert [r.html for r in crawl.accepted(rows, F.lit("https://a.org/")).collect()] == ["", "", "x", ""]


def test_sitemaps_of_sitemaps(spark):
    entry = lambda kind, *rows: "".join(f"<{kind}><loc>{loc}</loc>{f'<lastmod>{day}</lastmod>' if day else ''}</{kind}>" for loc, day in rows)
    files = [("root", "<sitemapindex>" + entry("sitemap", ("old", "2024-01-01"), ("new", "2024-03-01"), ("kept", "2024-02-01"), ("none", None), ("loop", None)) + "</sitemapindex>"), ("old", "<urlset>" + entry("url", ("o1", None), ("o2", "2024-01-05")) + "</urlset>"), ("new", "<urlset>" + entry("url", ("n1", None)) + "</urlset>"), ("kept", "broken <"), ("loop", "<sitemapindex>" + entry("sitemap", ("root", None)) + "</sitemapindex>")]
    cache = spark.createDataFrame([("kept", "2024-02-01", [("k1", "2024-01-01"), ("k2", "2024-01-02")]), ("old", "2023-01-01", [("stale", None)])], "sitemap string, lastmod string, urls array<struct<loc:string,lastmod:string>>")
    rows = sitemaps.resolve(spark.createDataFrame(files, "sitemap string, xml string"), spark.createDataFrame([("root",)], "sitemap string"), cache, most_depth=1).orderBy("place").collect()
    assert [(r.url, r.from_cache) for r in rows] == [("n1", False), ("k2", True), ("k1", True), ("o2", False), ("o1", False)]
    deep = sitemaps.resolve(spark.createDataFrame(files, "sitemap string, xml string"), spark.createDataFrame([("root",)], "sitemap string"), cache, most_depth=3)
    assert deep.count() == 10  # once more through the loop, and no further


def test_updater_logs_errors_and_goes_on(spark):
    def apply(changes, number):
        if number == 1:
            raise RuntimeError("no network")

    own = updater.Updater(spark, shared_folder(spark, "updater"), apply)
    days = lambda *rows: spark.createDataFrame(list(rows), "url string, lastmod string")
    own.check(days(("a", "1"), ("b", "1")), 0)
    own.check(days(("a", "2")), 1)
    own.check(days(("a", "2"), ("c", None)), 2)
    own.check(days(("a", "2"), ("c", None)), 2)  # again, after a lost driver
    own.check(days(), 3)
    got = [tuple(r) for r in own.log().orderBy("check_id").select("n_new", "n_updated", "n_removed", "error").collect()]
    assert got == [(2, 0, 0, None), (0, 1, 1, "RuntimeError: no network"), (1, 1, 1, None), (0, 0, 2, "ValueError: the snapshot has no URL")]
    assert {r.url for r in own.indexed().collect()} == {"a", "c"}
    status = own.status(F.lit("2024-01-01 00:00:00").cast("timestamp"), 6).first()
    assert (status.checks, status.checks_with_changes, status.errors, str(status.next_check)) == (4, 4, 2, "2024-01-01 06:00:00")


def test_breadth_first_plans_do_not_grow_with_depth(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(3, 0)], "src int, dst int")
    plan = lambda depth: crawl.reachable(links, spark.createDataFrame([(0,)], "node int"), depth)
    deep = plan(8)
    assert {(r.node, r.depth) for r in deep.collect()} == {(k, k) for k in range(9)}
    size = lambda rows: len(rows._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(deep) == size(plan(2)) <= 4
    assert plan(3).schema["depth"].dataType.simpleString() == "int"
    odd = crawl.reachable(links, spark.createDataFrame([(0,)], "node int"), 9, wanted=lambda n: n != 4)
    assert {r.node for r in odd.collect()} == {0, 1, 2, 3}
    assert [(r.node, r.depth) for r in crawl.reachable(links, spark.createDataFrame([(0,)], "node int"), 9, most=3).collect()] == [(0, 0), (1, 1), (2, 2)]


def test_change_report(spark):
    rows = spark.createDataFrame([("b", "new", "1", None), ("a", "new", None, None), ("c", "updated", "2", "1"), ("d", "removed", None, "1"), ("e", "unchanged", "1", "1")], "url string, change_type string, new_lastmod string, old_lastmod string")
    got = json.loads(maintain.change_report(rows, F.lit("2024-01-02 03:04:05").cast("timestamp")).first().report)
    assert got == {"new_urls": ["a", "b"], "updated_urls": [["c", "2", "1"]], "removed_urls": ["d"], "unchanged_count": 1, "has_changes": True, "total_changes": 4, "checked_at": "2024-01-02T03:04:05.000000", "error": None}


def test_pages_nested_deeper_than_the_stack(spark):
    deep = "<body>" + "<span>" * 5000 + "inner text of the page" + "</span>" * 5000 + "<p>one" * 2000 + "</body>"
    found = html.sections(deep, chunks.slug)
    assert found[0].blocks[0] == ("text", "inner text of the page") and len(found[0].blocks) > 1000
    rows = spark.createDataFrame([("https://a.org/1", deep), ("https://a.org/2", "<p>before</p><![bad"), ("https://a.org/3", None), ("https://a.org/4", page("good"))], "url string, html string")
    assert {r.url for r in chunks.chunk_pages(rows, chunks.Limits(5, 50, 80, 100)).collect()} >= {"https://a.org/1", "https://a.org/4"}
    assert chunks.page_texts(rows).count() == 4


def test_store_reads_only_whole_batches(spark):
    store = Store(spark, shared_folder(spark, "store"))
    assert store.state() is None and store.last("x") is None
    for n in range(2):
        store.write("x", spark.range(n + 1), n)
    assert store.commit({"a": "1"}, 4) and not store.commit({"a": "2"}, 4)
    assert store.state() == (4, {"a": "1"}) and store.all("x") == [0, 1] and store.last("x", 1) == 0
    assert store.read("x", [0, 1]).count() == 3


def test_hashed_vectors_are_unit_vectors(spark):
    rows = spark.createDataFrame([("a b b",), ("",), (None,), ("A B b",)], "t string").select(search.hashed_vector(F.col("t")).alias("v")).collect()
    assert sum(x * x for x in rows[0].v) == pytest.approx(1) and len(rows[0].v) == 64 and sum(rows[1].v) == sum(rows[2].v) == 0 and rows[3].v == rows[0].v
