"""Operators on small inputs: edge cases, and brute-force versions where SQL can't express the result."""

import base64
import hashlib
import io
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import bpe, chat_format, common, components, embedding_dedup, importance, language_id, mixing, ngram_jaccard, substring_dedup, vector_search, warc
from spindrift.llm import queries as Q
from spindrift.llm import words as W

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs_of(spark, texts):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t or ""), "x", "y") for k, t in enumerate(texts)], DOCS)


def odd_texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = [None, "", "  \t\n", "one", "one two three", "One TWO three", " ".join(base), " ".join(base), "été ñ   日本"]
    texts += [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(5, 120, 6)]  # near copies: a long list
    texts += [" ".join([*(rng.choice(vocabulary) for _ in range(60)), *base[20:70], *(rng.choice(vocabulary) for _ in range(60))]) for _ in range(6)]
    return [*texts, " ".join(rng.choice(vocabulary) for _ in range(30_000))]


def brute_components(texts, width=5, percent=80):
    sets = []
    for t in texts:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    edges = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]]
    top = components.forest(edges)
    return {k: (len(s), top.get(k, k)) for k, s in enumerate(sets)}


def test_jaccard_equals_brute_force(spark, monkeypatch):
    texts = odd_texts()
    expected = brute_components(texts)
    for dense, turns, part in ((4, (8, 64), 1 << 13), (0, (), 1 << 13), (0, (1,), 5), (1, (1, 2, 3), 4)):
        monkeypatch.setattr(ngram_jaccard, "DENSE", dense)
        monkeypatch.setattr(ngram_jaccard, "TURNS", turns)
        monkeypatch.setattr(ngram_jaccard, "PART", part)
        got = {r[0]: (r[1], r[2]) for r in ngram_jaccard.link_components(docs_of(spark, texts)).collect()}
        assert got == expected


def test_jaccard_nulls_repeats_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(ngram_jaccard.link_components(rows).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)], key=str)
    assert ngram_jaccard.link_components(rows.where("false")).count() == 0
    # one doc_id with two texts is one node that has the links of both
    base = [f"w{k}" for k in range(60)]
    two = [(5, " ".join(base)), (5, " ".join(f"v{k}" for k in range(60))), (6, " ".join([*base[:-1], "x"])), (7, " ".join([*(f"v{k}" for k in range(59)), "y"])), (8, " ".join(f"u{k}" for k in range(60)))]
    assert sorted(tuple(r) for r in ngram_jaccard.link_components(spark.createDataFrame(two, "doc_id long, text string")).collect()) == [(5, 56, 5), (5, 56, 5), (6, 56, 5), (7, 56, 5), (8, 56, 8)]
    assert sorted((r.doc_id is None, r.doc_id) for r in ngram_jaccard.one_of_each(rows).collect()) == [(False, 1), (True, None)]


@pytest.mark.parametrize("rows_at_once", [0, 1 << 20], ids=["steps", "one_task"])
@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components_equal_forest(spark, rows_at_once, pairs):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(components, "CONTRACT_ROWS", rows_at_once)
        got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    top = components.forest(pairs)
    assert got == {x: top.get(x, x) for p in pairs if p[0] != p[1] for x in p}


def brute_cut(texts, length=35):
    lists = [words(t) for t in texts]
    seen = Counter(tuple(w[k : k + length]) for w in lists for k in range(len(w) - length + 1))
    out = {}
    for i, w in enumerate(lists):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("length", [35, 7])
def test_substring_dedup_equals_brute_force(spark, length):
    texts = [*odd_texts(), "a b " * 200, "x " + "a b " * 20]
    rows = docs_of(spark, texts).withColumns({c: F.lit("clash") for c in ("n_words", "key", "key2", "copied", "places", "row_id")})
    out = substring_dedup.remove_repeats(rows, length)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
    assert got == brute_cut(texts, length)
    assert {(r.key, r.key2, r.copied, r.places, r.row_id) for r in out.collect()} == {("clash",) * 5}
    assert substring_dedup.remove_repeats(rows.where("false")).count() == 0


def test_texts_of_one_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "first_key", lambda: F.length("text").cast("long") % 3)
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40 + k % 4)) for k in range(20)]
    texts += [texts[0], None, "", ""]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == brute_cut(texts) and sum(v[1] > 0 for v in got.values()) == 2


@pytest.mark.parametrize("bits", [1, 18])
def test_a_common_window_is_two_rows_of_a_task(monkeypatch, bits):
    monkeypatch.setattr(substring_dedup, "REMEMBERED_BITS", bits)
    rng, counted, sent, seen = np.random.default_rng(3), substring_dedup._Counter(), [], Counter()
    seven, nine = 7 << 50, 9 << 59
    for _ in range(50):
        h = np.append(rng.integers(0, 2**64, 30, dtype=np.uint64), [np.uint64(seven), *([np.uint64(nine)] * 2)])
        at = np.arange(33, dtype=np.int64)
        seen.update(h.tolist())
        out = counted(h, h, at + 100 * len(sent), at)
        sent.append(out)
        assert sorted(out["pos"].to_pylist()) == at.tolist()  # every window once
    rows = [(np.uint64(a & (2**64 - 1)), b & (2**64 - 1), sure) for o in sent for a, b, sure in zip(o["h1"].to_pylist(), o["h2"].to_pylist(), o["sure"].to_pylist(), strict=True)]
    met = Counter(int(a) for a, b, _ in rows if int(a) == b)
    for window, n in seen.items():  # what repeats is sure or meets an equal; what does not is neither
        own = [(int(a) == b, sure) for a, b, sure in rows if b == window]
        assert all(sure or (at_home and met[window] > 1) for at_home, sure in own) == (n > 1) and met[window] >= 1
    assert bits == 1 or (met[seven] == 2 and met[nine] == 1)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = Q.op2_language_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and own and sum(r.lang == r.lang_pred for r in own) / len(own) >= 0.95
    odd = docs_of(spark, [None, "", "123 ... !!", "日本語", "the and of"]).withColumn("score", F.lit("clash"))
    got = [(r.lang_pred, r.score) for r in language_id.identify(odd, language_id.learn_profiles(docs)).orderBy("doc_id").collect()]
    assert [g[0] for g in got[:3]] == ["und"] * 3 and [g[1] for g in got[:4]] == [0.0] * 4 and all(0 <= g[1] <= 1 for g in got)
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert language_id.learn_profiles(docs.where("false")) == {} and language_id.identify(docs.where("false"), {}).count() == 0
    # a long text and its repeats have one answer each, and an equal number of all languages' texts ties to the first by name
    profiles = language_id.learn_profiles(docs)
    long = docs_of(spark, [(docs.where("lang = 'de'").first().text + " ") * 300] * 3)
    assert len({(r.lang_pred, r.score) for r in language_id.identify(long, profiles, keep=["doc_id"]).collect()}) == 1
    assert {r.lang_pred for r in language_id.identify(long, {"b": profiles["de"], "a": profiles["de"]}).collect()} == {"a"}


def brute_languages(rows, longest=3, most=300):
    """(predicted, score) of each text by profiles of the labelled ones that are not held out; rows are (doc_id, text, lang)."""

    def grams(text):
        shown = re.sub(" +", " ", " " + "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in text or "") + " ")
        return Counter(g for n in range(1, longest + 1) for k in range(len(shown) - n + 1) if " " not in (g := shown[k : k + n])[1:-1] and g[0] + g[-1] != "  ")  # a blank at one end at most

    first = lambda counts: sorted(counts, key=lambda g: (-counts[g], sum(ord(c) << 21 * k for k, c in enumerate(g[::-1]))))[:most]
    seen = {}
    for doc_id, text, lang in rows:
        if lang is not None and (doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 != 2):
            seen.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(first(counts))} for lang, counts in sorted(seen.items())}
    out = {}
    for doc_id, text, _ in rows:
        own = first(grams(text))
        away = {lang: sum(min(abs(p[g] - k), most) if g in p else most for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(away, key=away.get) if own else "und"
        out[doc_id] = (best, 1 - away[best] / (most * len(own)) if own else 0.0)
    return out


def test_language_id_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = brute_languages([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    got = {r.doc_id: (r.lang_pred, r.score) for r in Q.op2_language_id(spark, SMALL).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(got[k][1] == pytest.approx(expected[k][1], abs=1e-12) for k in expected)


def test_first_stages_of_the_pipeline_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    found = brute_languages([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    rows = {k: t for k, t in sorted(rows.items()) if found[k][0] != "und" and found[k][1] >= language_id.LEAST_SCORE}
    at = corpus_pipeline.known_language(spark, docs, SMALL)
    assert {r.doc_id: r.text for r in at.collect()} == rows
    ids = list(rows)
    rows = {ids[k]: rows[ids[k]] for k, (_, top) in brute_components(list(rows.values())).items() if top == k}
    at = spark.createDataFrame(corpus_pipeline.one_of_each_group(spark, at, SMALL).toPandas(), docs.schema)
    assert {r.doc_id: r.text for r in at.collect()} == rows
    cut = dict(zip(rows, brute_cut(list(rows.values())).values(), strict=True))
    kept = {k: digest for k, (n, gone, digest) in cut.items() if n == 0 or gone < n}
    assert {r.doc_id: hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest() for r in corpus_pipeline.without_repeats(spark, at, SMALL).collect()} == kept


def test_known_language_drops_junk_and_unlearned_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rng = random.Random(4)
    letters, signs = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    junk = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 10))) for _ in range(60)), "".join(rng.choice(signs) for _ in range(800)), "".join(rng.choice("0123456789abcdef") for _ in range(800))]
    junk += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."]
    clean = ["The cat sat on the mat.", "This is the end of the story.", *(r.text for r in docs.where("n_chars < 150").collect())]
    assert len(clean) > 4
    odd = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate([*junk, *clean])], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id - 10**6 for r in corpus_pipeline.known_language(spark, docs.unionByName(odd.select(docs.columns)), SMALL).where("doc_id >= 1000000").collect()}
    assert kept == set(range(len(junk), len(junk) + len(clean)))


def test_vectors_link_as_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(k, [float(x) for x in base[k % 40] + rng.normal(size=16) * 0.08 * (k % 4)], k % 3) for k in range(160)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [1.0, None], 1), (203, [float("nan")] * 16, 1), (204, rows[0][1], None), (205, rows[0][1], 0), (206, rows[0][1], 0), (207, [], 1), (208, [1.0, 2.0], 1), (209, [2.0, 4.0], 1), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = (np.array(v) / np.linalg.norm(v), label)
    edges = [(a, b) for a in ok for b in ok if a != b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= 0.98 - 1e-12]
    n, top = Counter(a for a, _ in edges), components.forest(edges)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(frame).collect()}
    assert got == {i: (n[i], top.get(i, i), i is not None and top.get(i, i) == i) for i, _, _ in rows}
    assert embedding_dedup.link_vectors(frame.where("false")).count() == 0


def vectors_with_copies(n, length, rank, seed=8, least=0.02):
    """Unit vectors near a space of few dimensions, and a copy of each at a cosine of 0.98 and more."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.normal(size=(length, rank)))[0]
    base = (rng.normal(size=(n, rank)) + 2 * rng.normal(size=(12, rank))[rng.integers(0, 12, n)]) @ axes.T
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    offset = rng.normal(size=(n, rank)) @ axes.T
    offset -= (offset * base).sum(1, keepdims=True) * base
    offset /= np.linalg.norm(offset, axis=1, keepdims=True)
    copies = base + offset * rng.uniform(least, 0.2, (n, 1))
    return base, copies / np.linalg.norm(copies, axis=1, keepdims=True)


@pytest.mark.parametrize(("length", "rank"), [(64, 2), (64, 64), (384, 6), (768, 8), (1536, 8)])
@pytest.mark.parametrize("words", [8, 128, 512])
def test_no_pair_costs_more_than_the_radius(length, rank, words):
    x, y = vectors_with_copies(1200, length, rank)
    books = {length: (embedding_dedup.fit_codebook(x[:, : length // 2], words, 1), embedding_dedup.fit_codebook(x[:, length // 2 :], words, 2))}
    near = (x * y).sum(1) >= 0.98
    costs = embedding_dedup.cost(x[near], y[near], books)
    assert near.sum() > 1000 and costs.max() <= 0.2 * (1 + 1e-9)


@pytest.mark.parametrize(("length", "rank", "rows"), [(64, 64, 512), (64, 2, 512), (384, 6, 512), (384, 6, 0.02)])
def test_no_link_is_lost_whatever_the_grid(spark, monkeypatch, length, rank, rows):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", rows)
    x = np.concatenate(vectors_with_copies(400, length, rank))
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_vectors(frame).collect()}
    top = components.forest([(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert got == {k: (int(near[k].sum()), top.get(k, k)) for k in range(len(x))}


@pytest.mark.parametrize(("length", "rank"), [(64, 64), (384, 6)])
def test_target_recall_of_vector_links(spark, monkeypatch, length, rank):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)
    x = np.concatenate(vectors_with_copies(1500, length, rank))
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    reaches = []
    measured = embedding_dedup.measured_reach
    monkeypatch.setattr(embedding_dedup, "measured_reach", lambda *a: reaches.append(measured(*a)) or reaches[-1])
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(frame, target=0.95).collect()}
    assert all(got[k] <= near[k].sum() for k in got) and sum(got.values()) >= 0.95 * near.sum() and 0 <= reaches[0] < 1
    monkeypatch.setattr(embedding_dedup, "LEAST_LINKS", 10**9)  # too few to tell: all are found
    assert {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(frame, target=0.95).collect()} == {k: int(near[k].sum()) for k in got}


def test_cells_that_are_left_out_hold_no_near_duplicate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.06
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    books = [embedding_dedup.fit_codebook(x[:, s], 8, 1) for s in (slice(0, 4), slice(4, 8))]
    halves = [x[:, :4], x[:, 4:]]
    own = [embedding_dedup.nearest(h, b) for h, b in zip(halves, books, strict=True)]
    far = [embedding_dedup.plane_distances(h, b, o) for h, b, o in zip(halves, books, own, strict=True)]
    there = [embedding_dedup.nearest(y[:, s], b) for s, b in zip((slice(0, 4), slice(4, 8)), books, strict=True)]
    for k in np.flatnonzero((x * y).sum(1) >= 0.98):
        assert (there[0][k], there[1][k]) in embedding_dedup.visit(far[0][k], far[1][k], 0.04 * (1 + 1e-9))


def test_apportion_equals_seat_by_seat():
    rng = random.Random(2)
    for _ in range(60):
        votes = [rng.choice([0, rng.randrange(1, 1000), rng.randrange(1, 7), rng.random() * 50]) for _ in range(rng.randrange(1, 8))]
        seats, most = rng.randrange(0, 60), [rng.randrange(0, 30) for _ in votes]
        out = [0] * len(votes)
        for _ in range(seats):
            best = max((v / (2 * s + 1), -i) for i, (v, s) in enumerate(zip(votes, out, strict=True)))if any(v > 0 and s < m for v, s, m in zip(votes, out, most, strict=True)) else None
            if best is None:
                break
            open_ = [(v / (2 * s + 1), -i) for i, (v, s, m) in enumerate(zip(votes, out, most, strict=True)) if v > 0 and s < m]
            out[-max(open_)[1]] += 1
        got = mixing.apportion(votes, seats, most)
        assert got == out
    assert mixing.apportion([5, 5, 5], 4) == [2, 1, 1] and mixing.apportion([3, 1, 9], 2) == [1, 0, 1]  # ties to the earlier: 3 / 1 and 9 / 3


def test_mixing(spark):
    assert mixing.targets([100, 10, 1000, 0], [5, 2, 1, 5]) == [300.0, 30.0, 780.0, 0.0]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "a b c", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in rows:
        assert r["size"] == len(words(texts[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
        by.setdefault((r.source, r.target, r.source_size), []).append(r)
    for (_, target, size), own in by.items():
        assert sum(r["size"] for r in own) == size and abs(sum(r.taken for r in own) - target) <= max(130, 0.02 * target)
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixing_passes_ids_and_shares_among_many_shards(spark, monkeypatch):
    large = 2**53 + 1
    rows = [(large + k if k % 5 else None, f"w{k} " * (k % 90), f"s{k % 2}") for k in range(3000)] + [(7, "same text " * 9, "s0")] * 40 + [(8, "long " * 30_000, "s1"), (9, "", "s2"), (10, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = None
    for words, groups in ((1 << 20, 1024), (2000, 1024), (2000, 3)):
        monkeypatch.setattr(mixing, "SHARD_WORDS", words)
        monkeypatch.setattr(mixing, "GROUPS", groups)
        got = mixing.mix(docs).collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
        for source in ("s0", "s1"):
            own = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target and all(0 <= r.taken <= 3 * r["size"] for r in own)
        assert first is None or sum(r.taken for r in got) == pytest.approx(first, rel=0.01)
        first = first or sum(r.taken for r in got)


def test_mixed_texts_follow_each_row_where_ids_are_null_or_repeated(spark):
    sizes = [400, 3, 90, 1, 250, 30, 700, 12, 5]
    text = lambda k, n: " ".join(f"r{k}w{j}" for j in range(n))
    rows = [(doc_id, text(f"{doc_id}{s}{k}", n), s, k) for doc_id in (None, 7) for s in ("a", "b", None) for k, n in enumerate(sizes)]
    rows += [(None, text("same", 300), "c", 100 + k) for k in range(4)] + [(8, text("same", 300), "c", 200 + k) for k in range(3)] + [(9, text("own", 200), "c", 300), (None, None, "c", 301)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    planned = Counter()
    for r in mixing.mix(docs).collect():
        planned[r.doc_id, r.source, r["size"]] += r.taken
    assert any(0 < v % k[2] for k, v in planned.items() if k[2])  # some text is taken in part
    mixed, whole, got = mixing.mixed_texts(docs).collect(), {(r[0], r[2], r[3]): r[1] for r in rows}, Counter()
    for r in mixed:
        own = words(whole[r.doc_id, r.source, r.n])
        assert set(words(r.text)) <= set(own) and len(set(words(r.text))) == len(words(r.text))
        got[r.doc_id, r.source, len(own)] += len(words(r.text))
    assert got == +planned
    texts = lambda rows: sorted(str((r.doc_id, r.source, r.text)) for r in rows)
    assert texts(mixed) == texts(mixing.mixed_texts(docs.repartition(5)).collect())


def test_importance(spark):
    rows = Q.op5_importance(spark, SMALL).collect()
    again = {r.doc_id: r.gumbel_key for r in Q.op5_importance(spark, SMALL).collect()}
    assert all(again[r.doc_id] == r.gumbel_key for r in rows)
    kept, rest = [r.gumbel_key for r in rows if r.kept], [r.gumbel_key for r in rows if not r.kept]
    share = spark.read.parquet(f"{SMALL}/labels.parquet").agg(F.avg(F.col("quality").cast("double"))).first()[0]
    assert len(kept) == round(share * len(rows)) and min(kept) >= max(rest)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    judged = [(quality[r.doc_id] == 1) == r.kept for r in rows if r.doc_id in quality]
    assert sum(judged) / len(judged) > 0.8
    odd = docs_of(spark, [None, "", "a", "a", "b c"])
    assert importance.resample(odd, odd.select("text"), 0.4).where("kept").count() == 2
    assert importance.resample(odd.where("false"), odd.select("text"), 0.4).count() == 0
    ids = spark.createDataFrame([(2,), (2,), (3,), (None,), (99,)], "doc_id long")
    assert sorted(r.text for r in importance.labelled_texts(odd, ids).collect()) == ["a", "a"]
    assert importance.labelled_texts(odd, ids, most=1).count() <= 1 and importance.labelled_texts(odd, ids.where("false")).count() == 0
    long = docs_of(spark, ["word " * 200_000, "word " * 200_000, "other"])
    assert sorted(r.n_features for r in importance.resample(long, long.select("text"), 0.4).collect()) == [1, 399_999, 399_999]
    same = spark.createDataFrame([(1, "a b")] * 10, "doc_id long, text string")  # ties at the bar
    assert importance.resample(same, same.select("text"), 0.4).where("kept").count() == 4
    assert importance._kth(spark.range(30_000).selectExpr("cast(id % 7 as double) as key"), 10_000) == 4.0


def test_importance_equals_brute_force(spark):
    m, codes = 1 << 64, [int(x) for x in W.FOLDED_CODES]

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % m
        x = (x ^ x >> 27) * 0x94D049BB133111EB % m
        return x ^ x >> 31

    def features(text):
        own = [mix(sum(codes[b] * pow(W.BYTE_BASE, k, m) for k, b in enumerate(w.encode())) % m) for w in words(text)]
        return [x % importance.BUCKETS for x in own + [mix((a + b * W.WINDOW_BASES[0] + 2) % m) for a, b in zip(own, own[1:], strict=False)]]

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("place")).collect()
    good, own = {r.doc_id for r in labels if r.quality == 1}, {r.doc_id: features(r.text) for r in rows}
    fits = []
    for ids in (good, set(own)):
        n = Counter(b for k in own if k in ids for b in own[k])
        fits.append([math.log((n[b] + 1) / (n.total() + importance.BUCKETS)) for b in range(importance.BUCKETS)])
    weight = {k: sum(fits[0][b] - fits[1][b] for b in f) for k, f in own.items()}
    key = {r.doc_id: weight[r.doc_id] - math.log(-math.log(((mix((r.place + 29) % m) >> 11) + 0.5) * 2.0**-53)) for r in rows}
    kept = set(sorted(key, key=key.get)[-round(len(rows) * sum(r.quality for r in labels) / len(labels)) :])
    got = Q.op5_importance(spark, SMALL).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.kept} == kept
    for r in got:
        assert r.n_features == len(own[r.doc_id])
        assert (r.log_weight, r.gumbel_key) == pytest.approx((weight[r.doc_id], key[r.doc_id]), abs=1e-6)


def test_search_takes_components_of_any_size(spark):
    """Whole numbers beyond 64 bits whose scores fit them."""
    rows = [(0, [1.0, -1.0]), *((i, [1e17 + 16000.0 * i, 1e17]) for i in range(1, 11))]  # the case of equal saturated numbers
    rows += [(50, [0.0, 0.0, 1.0, 2.0]), (51, [1e30, -1e25, 3.0, 1e-30]), (52, [-1e30, 1e30, 2.0, 0.5]), (53, [1e30, 2e30, 2.0, 0.25]), (54, [0.0, 5e29, -7.0, -1e-30]), (55, [1e-30, -1e-30, 1e10, -1e10])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(x * 256) for x in v] for i, v in rows}
    for k in (1, 3, 5):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_search.search(frame, frame.where("vec_id in (0, 50)"), k=k).collect()}
        for query in (0, 50):
            scores = sorted((-sum(a * b for a, b in zip(whole[query], v, strict=False)), i) for i, v in whole.items() if i != query)
            assert [got[query, n + 1] for n in range(k)] == [(i, -s) for s, i in scores[:k]]


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, [float(x) for x in rng.normal(size=12)]) for k in range(120)] + [(120 + k, [1.0] * 12) for k in range(8)] + [(200, None), (201, [None]), (202, [float("inf")] * 12), (203, [0.5]), (None, [1.0] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    ok = {i: np.pad(np.floor(256 * np.array(v, float)), (0, 12 - len(v))).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    expected = {(q, n + 1, i, s) for q in ok if q % 10 == 0 for n, (s, i) in enumerate(sorted(((int(ok[q] @ ok[i]), i) for i in ok if i != q), key=lambda x: (-x[0], x[1]))[:5])}
    assert {tuple(r) for r in vector_search.search(frame, frame.where("vec_id % 10 = 0")).collect()} == expected
    # many lanes and blocks, repeated ids, tied scores; the scan leaves few vectors to be read
    monkeypatch.setattr(vector_search, "CHUNK", 16)
    monkeypatch.setattr(vector_search, "QUERIES", 4)
    monkeypatch.setattr(vector_search, "LANE", 2)
    monkeypatch.setattr(vector_search, "PART", 3)
    assert {tuple(r) for r in vector_search.search(frame, frame.where("vec_id % 10 = 0")).collect()} == expected
    left = vector_search.candidates(frame, frame.where("vec_id % 10 = 0 and vec_id < 120"), 5, 256)
    assert left.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 16
    for r in left.collect():
        assert r.lower <= ok[r.query_id] @ ok[r.vec_id] <= r.upper
    twice = frame.unionByName(frame.where("vec_id = 3"))
    assert [r.vec_id for r in vector_search.search(twice, frame.where("vec_id = 3"), k=200).collect()].count(3) == 0
    assert vector_search.search(frame, twice.where("vec_id = 3")).count() == 5
    assert vector_search.search(twice, frame.where("vec_id = 0"), k=200).where("vec_id = 3").count() == 2
    # a vector that very many rows have, one id repeated: candidates stay few, and ties go to the smaller ids
    hot = frame.unionByName(spark.range(1000, 4000).select(F.when(F.col("id") < 1300, 999).otherwise(F.col("id")).alias("vec_id"), F.array(*[F.lit(1.001)] * 12).alias("embedding"), F.lit("x").alias("score")))
    answers = [(r.query_id, r.vec_id) for r in vector_search.search(hot, hot.where("vec_id in (120, 2000)")).orderBy("query_id", "rank").collect()]
    assert answers == [(120, k) for k in range(121, 126)] + [(2000, k) for k in range(120, 125)]
    alone = hot.where("vec_id >= 999")
    answers = [(r.query_id, r.vec_id) for r in vector_search.search(alone, alone.where("vec_id in (2000, 1301)")).orderBy("query_id", "rank").collect()]
    assert answers == [(1301, 999)] * 5 + [(2000, 999)] * 5
    own = vector_search.search(alone, alone.where("vec_id = 999").limit(1)).orderBy("rank").collect()
    assert [r.vec_id for r in own] == [1300, 1301, 1302, 1303, 1304]
    assert vector_search.candidates(alone, alone.where("vec_id = 2000"), 5, 256).count() <= 30
    empty = spark.createDataFrame([(1, []), (2, []), (3, [0.5])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in vector_search.search(empty, empty).collect()) == sorted((a, b, 0) for a in (1, 2, 3) for b in (1, 2, 3) if a != b)
    few = frame.where("vec_id in (0, 10, 203)")
    assert vector_search.search(few, few).count() == 6 and vector_search.search(few.where("false"), few).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="<[\\|>/sINST]ab é日", max_size=12), min_size=1, max_size=5))
def test_escapes_are_reversible(texts):
    import pyarrow as pa

    out, at, begin, end = chat_format.assemble(pa.array(texts), pa.array(texts[::-1]))
    whole = out.tobytes().decode()
    assert chat_format.parse(whole) == list(zip(texts, texts[::-1], strict=True))
    for b, e in zip(begin, end, strict=True):
        inside = out[b:e].tobytes().decode()
        assert not any(mark in inside for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_chats(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, "user", "x"), (1, None, None, "first"), (2, 0, "assistant", ""), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(rows)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"\nfirst\nuser\n\nassistant\nb\nassistant\nb\n").hexdigest() and got[1].loss_chars == 2
    assert got[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and got[None].n_turns == 1
    assert chat_format.format_chats(rows.where("false")).count() == 0


def test_long_chats_and_chats_across_buffers(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BUFFER_BYTES", 300)
    rng = random.Random(6)
    turns = [(c if c else None, k, rng.choice(["user", "assistant", "system"]), rng.choice(["", "é<[", "x" * 50, "日本\\\\<"])) for c in range(40) for k in range(rng.randrange(1, 9))]
    turns += [(99, 0, "user", "long <[" * 200_000), (99, 1, "assistant", "answer\\ " * 100_000)]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == conv]
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u1", "same"), (2, None, "same"), (3, "a\r\nb", "é"), (4, "u4", None), (5, "u5", ""), (None, "n", "same"), (2, None, "same")], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages)).collect()], key=str)
    assert got == sorted([(1, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (3, 2, "response", None), (4, 0, "revisit", 5), (5, 0, "response", None), (None, 4, "revisit", 2)], key=str)
    long = "".join(chr(97 + k * k % 26) + str(k) for k in range(200_000))  # longer than the read buffer
    many = spark.range(40).selectExpr("id as page_id", "'u' as url", "concat(id % 37, '-x') as html").unionByName(spark.createDataFrame([(100, "u", long), (101, "u", long)], "page_id long, url string, html string")).repartition(6, "page_id")
    manifest = warc.write_archives(many)
    reader = warc.read_archives(manifest)
    assert reader.rdd.getNumPartitions() == manifest.count() > 1
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in reader.collect()}
    assert len(got) == 42 and got[100] == (len(long), "revisit", 101) and got[0] == (3, "revisit", 37) and got[101][1] == "response"
    large = warc.read_archives(warc.write_archives(pages, least_bytes=5)).collect()
    assert {r.record_type for r in large} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_warc_reader_finds_damage():
    one = warc.member(7, "u", b"payload " * 100_000, warc.base32_sha1(b"payload " * 100_000), None)
    got = list(warc.records(io.BytesIO(one * 3)))
    assert len(got) == 3 and got[2].http()[1] == b"payload " * 100_000 and warc.page_of(got[0].headers["warc-record-id"]) == 7
    wrong = warc.member(7, "u", b"payload", "A" * 32, None)
    for bad in (one[:-20], wrong, b"junk"):
        with pytest.raises(Exception):
            list(warc.records(io.BytesIO(bad)))


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path(Q.RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_encoding():
    with open(public_tokenizers.path(Q.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "é", "\n", "日", "aa", "ab", "ion", "0", "!?", "'s", " ", "🎉"]), max_size=40).map("".join))
def test_bpe_equals_the_library(codec, reference_encoding, text):
    ids = codec.encode(text)
    assert ids == list(map(str, reference_encoding.encode_ordinary(text))) and codec.decode(ids).decode() == text


def test_bpe_forgets_and_still_agrees(reference_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    own = bpe.Codec(bpe.Vocabulary.read(public_tokenizers.path(Q.RANKS)), public_tokenizers.PATTERN)
    text = " ".join(f"zq{k % 7}xv unprecedentedly{k}" for k in range(60))
    for _ in range(3):
        assert own.encode(text) == list(map(str, reference_encoding.encode_ordinary(text)))
        assert len(own.young) <= 3 and len(own.old) <= 3 and len(own.vocabulary.beside) <= 5


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=20), st.integers(0, 60), st.integers(0, 60))
def test_prefix_table_appends_and_edits(codec, reference_encoding, data, more, a, b):
    own = bpe.PrefixTable(codec.vocabulary, data)
    own.append(more)
    assert own.last == bpe.PrefixTable(codec.vocabulary, data + more).last
    a, b = sorted((min(a, len(own.data)), min(b, len(own.data))))
    own.replace(a, b, more)
    whole = (data + more)[:a] + more + (data + more)[b:]
    assert own.data == whole and own.last == bpe.PrefixTable(codec.vocabulary, whole).last
    if whole and whole not in codec.vocabulary.ranks:
        assert own.tokens() == reference_encoding._core_bpe.encode_single_piece(whole)


def test_edit_of_a_long_text_is_local(codec):
    own = bpe.PrefixTable(codec.vocabulary, b"the quick brown fox jumps over it " * 400)
    assert own.replace(5000, 5003, b"cat") < 1000


def test_bpe_of_documents_equals_the_library(spark, reference_encoding):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(docs.limit(3))
    own = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_texts(docs, public_tokenizers.path(Q.RANKS), public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False).collect()}
    for r in docs.collect():
        ids = reference_encoding.encode_ordinary(r.text or "")
        assert own[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bpe.encode_texts(docs.where("false"), public_tokenizers.path(Q.RANKS), public_tokenizers.PATTERN).count() == 0


def test_bpe_rows(spark):
    rows = docs_of(spark, [None, "", "hello world", "hello " * 20_000]).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.encode_texts(rows, public_tokenizers.path(Q.RANKS), public_tokenizers.PATTERN).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].decoded_sha256 == hashlib.sha256(("hello " * 20_000).encode()).hexdigest() and len(got[2].token_ids) == 2


def test_mixing_equals_a_plain_version_by_rows(spark):
    """Words of all texts of a source in a row, cut into blocks, and seats given one by one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id % 3 = 0")
    docs = docs.unionByName(docs.where("doc_id % 30 = 0")).unionByName(spark.createDataFrame([(None, "same text " * 40, "en", None, 1)] * 5 + [(None, None, "en", "src0", 0)], docs.schema))
    found = Counter((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect())
    places = mixing._marked(docs).groupBy(*docs.columns, *mixing.MARKS).count().withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    rows = places.withColumn("place", F.xxhash64(F.lit(17), *mixing.MARKS, "nth")).collect()
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sorted((r for r in rows if r.source == s), key=lambda r: r.place) for s in sources}
    sizes = {s: sum(len(words(r.text)) for r in own[s]) for s in sources}
    left, goal, open_ = sum(sizes.values()), {}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    while open_:
        full = [s for s in open_ if left * open_[s] / sum(open_.values()) > 3 * sizes[s]]
        for s in full or list(open_):
            goal[s] = 3 * sizes[s] if full else left * open_[s] / sum(open_.values())
        if not full:
            break
        left -= sum(goal[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s not in full}
    blocks = {s: -(-sizes[s] // 64) for s in sources}
    votes = {s: goal[s] * blocks[s] / sizes[s] for s in sources}
    seats = dict.fromkeys(sources, 0)
    for _ in range(round(sum(votes.values()))):
        best = max((s for s in sources if seats[s] < 3 * blocks[s]), key=lambda s: (votes[s] / (2 * seats[s] + 1), -sources.index(s)))
        seats[best] += 1
    expected = Counter()
    for s in sources:
        stream = [k for k, r in enumerate(own[s]) for _ in words(r.text)]
        order = W.mix(np.arange(blocks[s], dtype=np.uint64) + W.mix(np.array([17 ^ len(own[s])], np.uint64)))
        rounds, rest = divmod(seats[s], blocks[s])
        taken = Counter()
        for b in np.argsort(order, kind="stable")[:rest].tolist():
            taken.update(stream[b * sizes[s] // blocks[s] : (b + 1) * sizes[s] // blocks[s]])
        for k, r in enumerate(own[s]):
            n = len(words(r.text))
            expected[r.doc_id, s, n, sizes[s], round(goal[s], 6), rounds * n + taken[k]] += 1
    assert found == expected


def test_rows_that_are_repeated_lie_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "RUN", 100)
    rows = spark.createDataFrame([("a", 10_000), ("b", 1), (None, 250), ("none", 0)], "k string, n long")
    out = common.repeated(rows, "n", "nth").withColumn("task", F.spark_partition_id()).collect()
    assert Counter((r.k, r.nth) for r in out) == Counter([("a", k) for k in range(10_000)] + [("b", 0)] + [(None, k) for k in range(250)])
    assert max(Counter(r.task for r in out).values()) < 2 * 10_251 / 4


def test_very_many_equal_rows(spark, monkeypatch):
    """Equal texts, pages and documents, of which no key is dealt to one task."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 50)
    monkeypatch.setattr(common, "HEAVY_SHARE", 10)
    common_text = " ".join(f"word{k}" for k in range(40))
    texts = [common_text] * 900 + [None] * 300 + ["", "short"] * 100 + [common_text + " and more", "x " + common_text] + [f"own {k} " + " ".join(f"v{k}x{j}" for j in range(50)) for k in range(40)] * 2
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    for k, t in enumerate(texts):
        n = len(words(t))
        assert found[k] == (n, 0 if n < 35 else 40 if k in (1400, 1401) else n)
    pages = spark.createDataFrame([(k, f"u{k}", "" if k < 700 else "<p>seen</p>" if k < 730 else f"<p>{k}</p>") for k in range(800)] + [(None, "n", "")] * 5, "page_id long, url string, html string").repartition(6)
    rows = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(rows) == 805 and all((r.record_type, r.refers_to) == (("revisit", 699) if r.page_id is None or r.page_id < 699 else ("revisit", 729) if 700 <= r.page_id < 729 else ("response", None)) for r in rows)
    assert {r.payload_digest for r in rows if r.page_id is None} == {warc.base32_sha1(b"")}
    same = spark.createDataFrame([(None, "good words " * 5)] * 500 + [(k, f"text {k}") for k in range(100)], "doc_id long, text string")
    kept = importance.resample(same, same.where("doc_id is null").limit(20), 0.5).collect()
    assert len(kept) == 600 and sum(r.kept for r in kept) == 300
