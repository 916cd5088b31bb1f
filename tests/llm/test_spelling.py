"""Spelling variants against brute force; the queries' SQL is held in test_llm_queries.py."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import spelling as S


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, least=7, one_in=31):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        form = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [form if form and words[form] >= 10 * n else None, n, len(near)]
    roots = {}
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        roots[w] = root
    return {w: (form, roots[w], n, near, words[form] if form else None) for w, (form, n, near) in out.items()}


def variants(rng, words, alphabet):
    out = list(words)
    for w in words:
        k = rng.randrange(len(w))
        out += [w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :], w + w[-1], w[0] + w]
    return out


def held(spark, docs, **more):
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, n int").repartition(5)
    found = S.group_variants(rows, **more).collect()
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}, len(found)


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 13))) for _ in range(40)] + ["a" * k for k in range(6, 12)] + ["é" * 7 + "z", "ÀÀÀÀÀÀÀÀ", "ababababab", "x" * 3000, "x" * 2999 + "y", "x" * 3001]
    words = variants(rng, base, "abcézÿ")
    docs = [(None, None), (None, ""), (5, "1234 --- 日本語"), (6, "short words only")]
    for k in range(60):
        docs.append((k if k % 7 else None, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weights=[1 / (i % 50 + 1) for i in range(len(words))], k=120))))
    docs += [(9, " ".join([base[0]] * 4000)), (9, " ".join([base[0]] * 4000))]
    found, rows = held(spark, docs)
    expected = brute(docs)
    assert found == expected and rows == len(expected) and any(f for f, *_ in expected.values())


@pytest.mark.parametrize("block", [1, 2, 7])
def test_large_and_cut_blocks_are_subdivided(spark, block):
    rng = random.Random(block)
    words = sorted({"prefix" + "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(300)} | {"".join(rng.choice("ab") for _ in range(7)) + "suffixed" for _ in range(90)})
    rows = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long").repartition(3)
    found = sorted((r.word, r.near, r.near_n) for r in S.near_words(rows, block=block).collect())
    assert found == sorted((a, b, len(b)) for a in words for b in words if one_edit(a, b))


def test_chains_of_forms_lead_to_their_root(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(19)] + [(f"leaf{k}", "w0") for k in range(500)]
    found = {r.word: r.root for r in S.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert set(found.values()) == {"w19"} and len(found) == len(forms)


def test_no_documents_and_no_words(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert S.group_variants(rows).count() == 0 and S.group_variants(rows.where("false")).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text("ab", min_size=4, max_size=5), unique=True, max_size=12), st.integers(0, 4))
def test_pairs_of_a_block_are_found_at_one_place(words, lo):
    """Over all ranges that begin at ``lo``, and the one before it, each pair of a length is found once."""
    l = 4
    found = Counter()
    for a, b in ((lo, l + 1), (0, lo)):
        if b <= a:
            continue
        tail = max(0, l - b)
        groups = {}
        for w in words:
            groups.setdefault((w[:a], w[len(w) - tail :]), []).append(w)
        for own in groups.values():
            own.sort(key=len)
            codes = np.array([w[a : len(w) - tail] for w in own], f"U{l - tail - a + 1}").view(np.uint32).reshape(len(own), -1)
            i, j = S.pairs(codes, np.array([len(w) == l for w in own]), np.full(len(own), len(own)), b > l)
            found.update(frozenset((own[x], own[y])) for x, y in zip(i, j, strict=True))
    assert found == Counter({frozenset((a, b)): 1 for a in words for b in words if one_edit(a, b) and l in (len(a), len(b)) and min(len(a), len(b)) == l})
