"""The page cache against a dictionary: what is in force, what a lookup reads, writers at once, JSON files."""

import json
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spindrift.operators import build
from spindrift.sources import pages as sources
from spindrift.sources.pages import FORMAT, PageCache, json_pages
from spindrift.sources.store import shared_folder

ROWS = "url string, html string, lastmod string, cached_at timestamp"
DAY = "2024-05-{:02d} 00:00:00"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string, lastmod string, at string").select("url", "html", "lastmod", F.col("at").cast("timestamp").alias("cached_at"))


def held(frame):
    return {r.url: (r.html, r.lastmod, r.cached_at) for r in frame.collect()}


def test_the_latest_row_of_a_url_is_in_force_whatever_the_order(spark):
    rng = random.Random(3)
    rows = [(f"https://a.org/{rng.randrange(40)}", rng.choice(["x", "", "é" * 500, None, "y"]), rng.choice([None, "1", "2"]), rng.choice([None, *(DAY.format(k) for k in range(1, 9))])) for _ in range(300)]
    rows += [(None, "no url", None, DAY.format(9)), ("", "empty url", None, None)]
    import hashlib

    best = {}
    rank = lambda r: (r[3] or "", r[2] is not None, r[2] or "", r[1] is not None, hashlib.sha256((r[1] or "").encode()).hexdigest())
    for r in rows:
        if r[0] is not None and (r[0] not in best or rank(r) > rank(best[r[0]])):
            best[r[0]] = r
    want = held(rows_of(spark, *(r for r in best.values() if r[1] is not None)))
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        cache = PageCache(spark, shared_folder(spark, "cache"), bits=3)
        for k in range(3):
            cache.save(rows_of(spark, *rows[k::3]))
        assert held(cache.read()) == want
        cache.save(rows_of(spark, *rows[:50]))  # a write that is made again
        assert held(cache.read()) == want
        before = len(sources._files(cache.folder))
        cache.compact(bits=1)
        assert held(cache.read()) == want and len(sources._files(cache.folder)) <= 2 < before
        assert cache.vacuum() == 0 and cache.vacuum(hours=-1) > before and held(cache.read()) == want
    assert sorted(cache.read("lastmod", "url").columns) == ["lastmod", "url"] and cache.read("url").count() == cache.read().count() == len(want)


def test_a_lookup_reads_only_folders_of_its_urls(spark):
    """Files of all other folders are damaged, so reading one would be an error."""
    cache = PageCache(spark, shared_folder(spark, "cache"), bits=6)
    cache.save(rows_of(spark, *((f"https://a.org/{k}", f"page {k}", None, DAY.format(1)) for k in range(400))))
    asked = ["https://a.org/7", "https://a.org/8", "https://a.org/none"]
    own = {sources._prefix(u, 6) for u in asked}
    spared = 0
    for file in sources._files(cache.folder):
        if file.prefix in own:
            spared += 1
        else:
            Path(file.path).write_bytes(b"damaged")
    assert 0 < spared <= 3
    urls = spark.createDataFrame([(u,) for u in [*asked, None, asked[0]]], "url string")
    assert sorted(r.html for r in cache.lookup(urls).collect()) == ["page 7", "page 8"]
    assert {tuple(r) for r in cache.lookup(urls, "lastmod").collect()} == {(asked[0], None), (asked[1], None)}
    assert [r.html for r in cache.read().where(F.col("url") == asked[0]).collect()] == ["page 7"]
    assert sorted(r.html for r in cache.read("html", "url").where(F.col("url").isin(asked)).collect()) == ["page 7", "page 8"]
    assert cache.lookup(urls.where("false")).count() == 0 and cache.read().where("url = 'a' and url = 'b'").count() == 0
    with pytest.raises(Exception, match="(?i)parquet"):
        cache.read().collect()


def test_an_empty_cache_removed_pages_and_wide_rows(spark):
    cache = PageCache(spark, shared_folder(spark, "cache"), bits=0)
    assert cache.read().count() == 0
    cache.save(rows_of(spark).where("false"))
    cache.save(rows_of(spark, ("a", "1", None, DAY.format(1)), ("b", "2", None, DAY.format(1))).withColumn("digest", F.lit(1)).withColumn("gone", F.lit(True)))
    gone = spark.createDataFrame([("a",)], "url string")
    cache.remove(gone, F.lit(DAY.format(2)))
    assert list(held(cache.read())) == ["b"]
    cache.compact(bits=4)
    cache.save(rows_of(spark, ("a", "late", None, DAY.format(1))))  # older than the removal
    assert list(held(cache.read())) == ["b"]
    cache.save(rows_of(spark, ("a", "again", None, DAY.format(3))))
    assert {u: r[0] for u, r in held(cache.read()).items()} == {"a": "again", "b": "2"}
    rows_of(spark, ("c", "3", None, None)).write.format(FORMAT).mode("overwrite").save(cache.folder)
    assert list(held(cache.read())) == ["c"]
    with pytest.raises(Exception, match="pages are"):
        gone.write.format(FORMAT).mode("append").save(cache.folder)


def test_long_pages_end_row_groups_and_files(spark, monkeypatch):
    monkeypatch.setattr(sources, "GROUP_BYTES", 100)
    monkeypatch.setattr(sources, "FILE_BYTES", 300)
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = shared_folder(spark, "cache")
    writer = sources._Writer({"path": folder, "bits": "0"}, False)
    rows = [{"url": f"u{k:02d}", "html": "x" * (10 * k), "lastmod": None, "cached_at": None} for k in range(20)]
    message = writer.write(iter([pa.RecordBatch.from_pylist(rows, pa.schema([(n, t) for n, t in sources._GIVEN.items()]))]))
    writer.commit([message, None])
    files = [pq.ParquetFile(f"{folder}/{name}") for name, *_ in message.files]
    assert len(files) > 3 and max(f.num_row_groups for f in files) > 1
    assert {u: len(r[0]) for u, r in held(PageCache(spark, folder).read()).items()} == {f"u{k:02d}": 10 * k for k in range(20)}
    writer.abort([message])
    assert not any(Path(folder, name).exists() for name, *_ in message.files)


def test_what_a_task_holds_does_not_grow_with_its_batch(spark):
    """A batch of 24 MB is written from parts, and its row groups of 16 MB are read in batches of about 1 MB."""
    import tracemalloc

    import pyarrow as pa

    folder = shared_folder(spark, "cache")
    rng = random.Random(5)
    html = [rng.randbytes(4000).hex() for _ in range(3000)]
    batch = pa.record_batch([[f"u{k:04d}" for k in range(3000)], html, [None] * 3000, [None] * 3000], schema=pa.schema([(n, t) for n, t in sources._GIVEN.items()]))
    writer = sources._Writer({"path": folder, "bits": "0"}, False)
    tracemalloc.start()
    message = writer.write(iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20  # Python strings of a part, not of the batch
    writer.commit([message])
    reader = sources._Reader(["html", "url"], {"path": folder})
    made = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(made) > 12 and max(b.nbytes for b in made) < 3 << 20
    assert {u: h for b in made for u, h in zip(b["url"].to_pylist(), b["html"].to_pylist(), strict=True)} == {f"u{k:04d}": h for k, h in enumerate(html)}


def test_folders_follow_rows_without_html(spark, monkeypatch):
    """Removals and empty pages have no html, but keys that a task holds."""
    monkeypatch.setattr(sources, "FOLDER_ROWS", 10)
    cache = PageCache(spark, shared_folder(spark, "cache"))
    urls = spark.createDataFrame([(f"u{k}",) for k in range(80)], "url string")
    cache.remove(urls, F.lit(DAY.format(2)))
    assert {f.bits for f in sources._files(cache.folder)} == {3} and sum(f.rows for f in sources._files(cache.folder)) == 80
    cache.save(urls.select("url", F.lit("").alias("html"), F.lit(None).cast("string").alias("lastmod"), F.lit(DAY.format(1)).alias("cached_at")))
    assert {f.bits for f in sources._files(cache.folder)} == {3, 4} and cache.read().count() == 0
    cache.compact()
    assert {f.bits for f in sources._files(cache.folder)} == {4} and cache.read(removed="true").count() == 80
    # a manifest of before has no rows
    for path in Path(cache.folder.removeprefix("file://"), "manifests").glob("*.json"):
        body = json.loads(path.read_text())
        path.write_text(json.dumps({**body, "files": [f[:4] for f in body["files"]]}))
    assert cache.read(removed="true").count() == 80 and {f.rows for f in sources._files(cache.folder)} == {0}


def test_a_compaction_keeps_what_is_added_meanwhile(spark, monkeypatch):
    cache = PageCache(spark, shared_folder(spark, "cache"), bits=1)
    cache.save(rows_of(spark, ("a", "1", None, DAY.format(1)), ("b", "1", None, DAY.format(1))))
    plain = PageCache._write

    def late(self, rows, bits, **options):
        if "replaces" in options:
            monkeypatch.setattr(PageCache, "_write", plain)
            cache.save(rows_of(spark, ("b", "2", None, DAY.format(2)), ("c", "1", None, DAY.format(1))))
            cache.compact()  # another one is first
        plain(self, rows, bits, **options)

    monkeypatch.setattr(PageCache, "_write", late)
    cache.compact()
    assert {u: r[0] for u, r in held(cache.read()).items()} == {"a": "1", "b": "2", "c": "1"}


def test_pages_are_read_through_the_cache(spark):
    """Hits, changed dates and failures, with the same rows as a cache that is a table."""
    now = F.lit(DAY.format(20)).cast("timestamp")
    rows = rows_of(spark, *((f"https://a.org/{k}", f"old {k}", "1", DAY.format(1)) for k in range(12)))
    urls = spark.createDataFrame([(f"https://a.org/{k}", "1" if k % 2 else "2") for k in range(8)], "url string, lastmod string")

    def fetch(asked):
        return asked.select("url", F.col("url").alias("final_url"), F.lit("text/html").alias("content_type"), F.when(F.col("url").endswith("4"), 500).otherwise(200).alias("status"), F.concat(F.lit("new "), "url").alias("body"))

    cache = PageCache(spark, shared_folder(spark, "cache"), bits=2)
    cache.save(rows)
    through = build.read_pages(urls, cache, fetch, F.lit("https://a.org/"), now)
    plain = build.read_pages(urls, rows, fetch, F.lit("https://a.org/"), now)
    for part in ("pages", "cache", "log"):
        a, b = getattr(through, part), getattr(plain, part)
        assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect())), part
    assert through.counts() == plain.counts() and held(cache.read()) == held(plain.cache)


def test_folders_follow_the_data(spark, monkeypatch):
    assert [sources.bits_for(n * sources.FOLDER_BYTES) for n in (0, 1, 2, 3, 4, 5, 1 << 20)] == [0, 0, 1, 2, 2, 3, sources.MOST_BITS]
    monkeypatch.setattr(sources, "FOLDER_BYTES", 1000)
    cache = PageCache(spark, shared_folder(spark, "cache"))
    many = [(f"u{k}", "x" * 100, None, DAY.format(1)) for k in range(80)]
    cache.save(rows_of(spark, *many, *[("hot", "y" * 9, str(k % 7), DAY.format(1)) for k in range(500)]))
    assert {f.bits for f in sources._files(cache.folder)} == {4} and len(sources._files(cache.folder)) == 16
    assert sum(f.size for f in sources._files(cache.folder)) == 8009 and held(cache.read())["hot"][1] == "6"
    cache.save(rows_of(spark, *[(f"v{k}", "x" * 100, None, DAY.format(1)) for k in range(80)]))
    assert {f.bits for f in sources._files(cache.folder)} == {4, 5}
    cache.compact()
    assert {f.bits for f in sources._files(cache.folder)} == {5} and cache.read().count() == 161


def test_json_files_of_another_cache(spark, tmp_path):
    good = {"url": "https://a.org/x", "html": "<p>\n1", "lastmod": None, "cached_at": "2024-05-01T10:00:00.250000", "status_code": 200}
    for name, text in (("a", json.dumps(good)), ("b", "{broken"), ("c", json.dumps({"url": "https://a.org/y"})), ("d", json.dumps({**good, "url": "https://a.org/z", "cached_at": "never"})), ("e", "")):
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "f.txt").write_text(json.dumps(good))
    found = held(json_pages(spark, str(tmp_path)))
    assert set(found) == {"https://a.org/x", "https://a.org/z"} and found["https://a.org/x"][2].microsecond == 250000 and found["https://a.org/z"][2] is None
    cache = PageCache(spark, shared_folder(spark, "cache"))
    cache.save(json_pages(spark, str(tmp_path)))
    shutil.rmtree(tmp_path)
    assert held(cache.read()) == found
