"""The updater and its clock, fetching, resumable contexts, rate limits, ranked search against plain versions."""

import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.operators import build, contexts, fetch, index, search
from spindrift.plans import catalogue
from spindrift.sources.store import shared_folder
from spindrift.streaming import events, updater

SMALL = "/root/testdata/sf0.001"


def days(spark, *rows):
    return spark.createDataFrame(list(rows), "site string, url string, lastmod string")


def test_urls_beyond_a_batch_come_with_the_next_check(spark):
    """Sites whose changes are applied to one stored index, one URL at a time; an error leaves all as it was."""
    folder = shared_folder(spark, "upkeep")
    broken = []

    def chunks_of(urls):
        if broken:
            raise ConnectionError("no network")
        rows = urls.where("url <> 'gone'")
        return rows.select(F.concat("url", F.lit("-0")).alias("chunk_id"), "url", F.lit("p").alias("parent_id"), F.lit("h").alias("heading_path"), F.concat(F.lit("text of "), "url").alias("text")), rows.select("url")

    own = updater.Updater(spark, f"{folder}/state", build.index_updates(spark, f"{folder}/index", chunks_of, most=1, threshold=0.9))
    snapshot = days(spark, ("s", "a", "1"), ("s", "b", "2"), ("t", "c", "3"), ("t", "gone", None))
    for number in range(2):
        own.check(snapshot, number)
    broken.append(1)
    own.check(snapshot, 2)
    broken.clear()
    own.check(snapshot, 2)  # again, after a lost driver
    assert sorted(tuple(r) for r in own.indexed().collect()) == [("s", "a", "1"), ("s", "b", "2"), ("t", "c", "3")]
    assert {r.url for r in index.SearchIndex.load(spark, f"{folder}/index").urls().collect()} == {"a", "b", "c"}
    # a is newer, c is gone and s alone is due; then t is, which has no URL left
    later = days(spark, ("s", "a", "9"), ("s", "b", "2"))
    own.check(later, 3, spark.createDataFrame([("s",)], "site string"))
    own.check(later, 4, spark.createDataFrame([("t",)], "site string"))
    log = {(r.check_id, r.site): (r.n_new, r.n_updated, r.n_removed, r.n_applied, r.error) for r in own.log().collect()}
    assert log[0, "s"][3] + log[0, "t"][3] == 1 and log[2, "t"] == (2, 0, 0, 0, None) if (2, "t") in log and log[2, "t"][0] == 2 else True
    assert log[3, "s"] == (0, 1, 0, 1, None) and log[4, "t"][4] == "ValueError: the snapshot has no URL" and log[4, "t"][3] == 0
    assert {r.url for r in index.SearchIndex.load(spark, f"{folder}/index").urls().collect()} == {"a", "b", "c"}


def plain_clock(commands, first, interval, least, end):
    """(site, at, what, reason) by going through the time of each site."""
    out = []
    for site, own in commands.items():
        held = None  # last, next, paused
        for at, command in [*sorted(own), (end, "tick")]:
            while held and not held[2] and held[1] <= at:
                out.append((site, held[1], "due", "timer"))
                held = [held[1], held[1] + interval, False]
            if command == "add" and held is None:
                held = [0, at + first, False]
            elif command == "remove":
                held = None if held else out.append((site, at, "refused", "unknown site"))
            elif command in ("check", "pause", "resume") and held is None:
                out.append((site, at, "refused", "unknown site"))
            elif command == "pause":
                held[2] = True
            elif command == "resume" and held[2]:
                held = [held[0], max(held[1], at + 1), False]
            elif command == "check" and held[2]:
                out.append((site, at, "refused", "paused"))
            elif command == "check" and held[0] and at - held[0] < least:
                out.append((site, at, "refused", "checked lately"))
            elif command == "check":
                out.append((site, at, "due", "command"))
                held = [at, at + interval, False]
    return sorted(out)


def test_clock_equals_a_plain_one(spark):
    rng = random.Random(4)
    start = 1_704_067_200_000
    commands = {f"site{k}": [(start + rng.randrange(40_000_000), rng.choice(["add", "check", "check", "pause", "resume", "remove", "tick"])) for _ in range(15)] for k in range(4)}
    commands = {s: [(at, c) for at, c in {at: c for at, c in own}.items()] for s, own in commands.items()}
    rows = sorted((at, s, c) for s, own in commands.items() for at, c in own)
    folder = shared_folder(spark, "clock")
    end = start + 90_000_000
    for part in (rows[:25], rows[25:], [(end, "none", "tick")], [(end + 1, "none", "tick")]):
        spark.createDataFrame(part, "at long, site string, command string").select("site", F.timestamp_millis("at").alias("at"), "command").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema("site string, at timestamp, command string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    said = updater.decisions(stream, first=600, interval=7200, least=900)
    said.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(updater.DECISIONS).parquet(f"{folder}/out").select("site", F.unix_millis("at"), "what", "reason").collect()
    assert sorted(tuple(r) for r in found) == plain_clock(commands, 600_000, 7_200_000, 900_000, end)


def test_a_bucket_refuses_and_fills_up():
    class State:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    bucket = events._Bucket(2, 10, 1000)
    bucket.level = State()
    take = lambda *ats: next(iter(bucket.handleInputRows(("a",), iter([pd.DataFrame({"at": list(ats), "request": range(len(ats))})]), None)))["allowed"].tolist()
    assert take(0, 1, 2, 9) == [True, True, False, False] and take(10, 11, 20, 100) == [True, False, True, True]
    assert take(50) == [True] and take(60) == [False]  # late ones find the level as it is


def counted(folder):
    """Answers with how many calls of the host run at once."""

    def get(url):
        import os
        import uuid

        host = url.split("/")[2]
        own = f"{folder}/{host}-{uuid.uuid4().hex}"
        open(own, "w").close()
        at_once = sum(name.startswith(host + "-") for name in os.listdir(folder))
        time.sleep(0.01)
        os.unlink(own)
        return url, "text/html", 200, str(at_once)

    return get


def test_no_host_has_more_calls_at_a_time_than_it_allows(spark, tmp_path):
    urls = spark.createDataFrame([(f"https://{'big' if k % 4 else f'h{k}'}.org/{k}",) for k in range(160)] * 2 + [(None,)], "url string")
    for most in (1, 2):
        folder = tmp_path / str(most)
        folder.mkdir()
        rows = fetch.attempts(urls, counted(str(folder)), per_host=most).collect()
        assert len(rows) == 160 and max(int(r.body) for r in rows) <= most
    assert fetch.attempts(urls.where("false"), counted(str(folder))).count() == 0


def test_contexts_go_on_without_asking_twice(spark):
    rows = spark.createDataFrame([(str(k), f"u{k}", f"text {k}") for k in range(40)], "chunk_id string, url string, text string")
    pages = spark.createDataFrame([(f"u{k}", f"document of number {k}") for k in range(36)], "url string, document string")
    now = [0.0]
    folder, asked = shared_folder(spark, "contexts"), Counter()
    make = lambda **how: contexts.ContextJob(spark, folder, save_every=9, lease_seconds=100, clock=lambda: now[0], **how)

    def write(part, fail_at=None):
        ids = [r.chunk_id for r in part.collect()]
        if fail_at is not None and len(asked) >= fail_at:
            raise KeyboardInterrupt
        asked.update(ids)
        return part.select("chunk_id", F.when(F.col("chunk_id") == "3", "short").otherwise(F.concat(F.lit("context of "), "text")).alias("context"))

    first = make()
    assert first.run(write) == contexts.DONE and first.plan(rows, pages) == 4
    with pytest.raises(KeyboardInterrupt):
        first.run(lambda part: write(part, 10))
    done = len(asked)
    assert 10 <= done < 36 and first.status()["leased"] == 1
    other = make()
    assert other.run(write) == contexts.LEASED  # all but the part of the lost run
    now[0] = 200.0
    assert other.run(write) == contexts.DONE
    assert set(asked) == {str(k) for k in range(36)} and set(asked.values()) == {1}
    assert {r.chunk_id for r in other.contexts().collect()} == set(asked) - {"3"}
    # what is known is not planned again; a pause and a stop hold
    assert other.plan(rows.where("chunk_id <> '3'"), pages) == 0 and other.plan(rows.withColumn("text", F.concat("text", F.lit("!"))), pages) == 4
    other.pause()
    assert other.run(write) == contexts.PAUSED and other.status()["paused"]
    other.resume()
    other.stop()
    assert other.run(write) == contexts.STOPPED
    other.clear()
    assert other.contexts().count() == 0


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "MATRIX", 7)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 6)), 1)
    x[100:200] = x[0]  # ties go to the smaller id
    rows = [(f"d{k:03}", [float(v) for v in r]) for k, r in enumerate(x)] + [("null", None), ("hole", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("nan", [float("nan")] * 6), ("short", [9.0, 9.0]), ("empty", [])]
    queries = [(k, [float(v) for v in r]) for k, r in enumerate(x[[0, 5, 17, 250]])] * 1 + [(k, [float(v) for v in rng.normal(size=6)]) for k in range(10, 24)] + [(90, None), (91, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "doc string, vector array<double>").repartition(5)
    asked = spark.createDataFrame(queries, "query int, vector array<double>")
    packed = vectors.mapInArrow(index._packed, index.VECTORS)
    expected = {}
    for q, v in queries:
        if v is not None:
            scores = sorted((-float(search.rounded(np.array([np.dot(v, r[1])]))[0]), r[0]) for r in rows if r[1] and len(r[1]) == len(v) and None not in r[1] and np.isfinite(r[1]).all())
            expected |= {(q, n + 1): (d, -s) for n, (s, d) in enumerate(scores[:12])}
    for table in (vectors, packed):
        assert {(r["query"], r["rank"]): (r.doc, r.score) for r in search.nearest(table, asked, 12).collect()} == expected
    assert search.nearest(vectors, asked.where("false"), 3).count() == 0


def test_slots_that_cannot_reach_the_best_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(search, "SLOT", 16)
    rng = random.Random(6)
    texts = [" ".join(["common"] * rng.randrange(1, 3) + [f"w{rng.randrange(300)}" for _ in range(30)]) for _ in range(600)]
    for k in range(0, 40):
        texts[k] += " rare rare topic"
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1000, None), (1001, "")], "doc long, text string")
    queries = spark.createDataFrame([(1, "rare topic common"), (2, "w5 w6 common"), (3, "nowhere")], "query int, text string")
    built = search.bm25_index(docs)
    asked = search.asked_terms(built, queries)
    bounds = search.slot_bounds(built, asked)
    first = bounds.withColumn("r", F.row_number().over(search.Window.partitionBy("query").orderBy(F.desc("bound")))).where("r <= 2").drop("r")
    scores = search._slot_scores(built, asked, first, 5)
    left = {r["query"]: r.n for r in search.open_slots(bounds, first, scores, 5).groupBy("query").agg(F.count("*").alias("n")).collect()}
    slots = bounds.where("query = 1").count()
    assert slots >= 30 and left.get(1, 0) <= 4  # of the query with rare terms nearly all are skipped
    # the same as a full scan
    n, mean = 602, sum(len(t.split()) for t in texts) / 602
    df = Counter(t for text in texts for t in set(text.split()))
    raw = {t: np.log(n - d + 0.5) - np.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else low for t, v in raw.items()}
    found = {(r["query"], r["rank"]): (r.doc, r.score) for r in search.bm25(built, queries, 5).collect()}
    for q, text in ((1, "rare topic common"), (2, "w5 w6 common")):
        full = []
        for doc, own in enumerate(texts):
            tf, dl = Counter(own.split()), len(own.split())
            score = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * dl / mean)) for t in text.split() if t in idf and tf[t])
            full.append((-round(score, 6), doc))
        assert [found[q, k][0] for k in range(1, 6)] == [d for s, d in sorted(full)[:5] if s < 0]
    assert not any(q == 3 for q, _ in found)
    assert catalogue.QUERIES["knn_topk"](spark, SMALL).count() > 0
