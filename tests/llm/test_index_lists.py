"""Index lists: blocks that are read are those that the bounds allow, and pairs are not lost wherever rows are cut."""

import numpy as np
import pyarrow as pa
import pytest

from spindrift.llm import index_lists, ngram_jaccard


def some_lists(seed, lists=12, most=60):
    rng = np.random.default_rng(seed)
    rows = sorted((k, int(n), int(rng.integers(0, n // 5 + 1)), int(d)) for k in range(lists) for d, n in enumerate(rng.choice([10, 11, 12, 30, 31, 40, 200], rng.integers(1, most))))
    return {c: np.array(v, np.int64) for c, v in zip(("of", "n", "pos", "doc"), zip(*rows, strict=True), strict=True)}


def all_possible(x, percent):
    rows = range(len(x["of"]))
    return {(i, j) for i in rows for j in rows if i != j and x["of"][i] == x["of"][j] and index_lists.possible(x["n"][i], x["n"][j], x["pos"][i], x["pos"][j], percent)}


@pytest.mark.parametrize("at_once", [7, 1 << 19])
def test_only_possible_blocks_are_read(monkeypatch, at_once):
    monkeypatch.setattr(index_lists, "AT_ONCE", at_once)
    x = some_lists(1)
    lists, rows = index_lists.Lists(x["of"], x["n"], x["pos"]), np.arange(len(x["of"]))
    got = set()
    for own, start, end in lists.runs(x["of"], x["n"], x["pos"], 80):
        got |= {(int(own[r]), int(m)) for run, member in index_lists.spread(start, end) for r, m in zip(run, member, strict=True)}
    expected = all_possible(x, 80)
    assert {p for p in got if p[0] != p[1]} == expected
    # nothing but these and the sets themselves is touched, and the greater part of the lists is not
    itself = int(index_lists.possible(x["n"], x["n"], x["pos"], x["pos"], 80).sum())
    assert lists.read == len(expected) + itself
    assert lists.read + lists.skipped == int((np.bincount(x["of"]) ** 2).sum()) and lists.skipped > 2 * lists.read
    pairs = [(int(a), int(b)) for x_, y_ in index_lists.partners(x, rows, rows, 80, larger=True) for a, b in zip(x_, y_, strict=True)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {p for p in expected if p[0] < p[1]}


def test_lists_that_are_done_have_given_all_their_pairs():
    x = some_lists(2)
    pairs, more = index_lists.first_pairs(x, np.array([3]), 80, dense=4, leading=2)
    assert more[x["of"] == 3].all() and 0 < more.sum() < len(more)
    pairs = [(int(a), int(b)) for x_, y_ in pairs for a, b in zip(x_, y_, strict=True)]
    done = {p for p in all_possible(x, 80) if p[0] < p[1] and not more[p[0]] and x["doc"][p[0]] != x["doc"][p[1]]}
    assert {p for p in pairs if not more[p[0]]} == done
    # a list that goes on gives a few pairs for each of its sets: two leaders of each of three classes of sizes
    assert sum(bool(more[a]) for a, _ in pairs) <= 2 * 3 * more.sum()


def test_open_pairs_are_complete_without_a_limit_and_decided_by_references():
    x = some_lists(3, lists=4, most=40)
    size = len(x["of"])
    rng = np.random.default_rng(4)
    x["component"] = rng.integers(0, 3, size)
    x["major"] = np.zeros(size, np.int64)
    home = {**x, "visitor": np.zeros(size, bool)}
    guest = {k: v[x["component"] != 0] for k, v in {**x, "visitor": np.ones(size, bool)}.items()}
    both = {k: np.concatenate((home[k], guest[k])) for k in home}
    by = np.lexsort((both["doc"], both["pos"], both["n"], both["of"]))
    both = {k: v[by] for k, v in both.items()}
    both |= {"ref": both["doc"], "n_ref": both["n"], "shared": both["n"]}
    found, more = index_lists.open_pairs(both, 80, 4, None, 1)
    key = lambda k: (int(both["of"][k]), int(both["doc"][k]))
    got = sorted(tuple(sorted((key(a), key(b)))) for a_, b_, _ in found for a, b in zip(a_, b_, strict=True))
    own = lambda k: (int(x["of"][k]), int(x["doc"][k]))
    assert not more and got == sorted(tuple(sorted((own(a), own(b)))) for a, b in all_possible(x, 80) if a < b and x["component"][a] != x["component"][b])
    few, more = index_lists.open_pairs(both, 80, 0, 1, 1)
    assert more and 0 < sum(len(a) for a, _, _ in few) < len(got)
    # one reference of all: what both share with it settles pairs
    both |= {"ref": np.zeros(len(by), np.int64), "n_ref": both["n"], "shared": both["n"]}
    assert all(sure.all() for a, b, sure in index_lists.open_pairs(both, 80, 4, None, 1)[0] if (both["n"][a] == both["n"][b]).all())
    both |= {"n_ref": both["n"] * 9, "shared": both["n"] * 0 + 1}
    assert all(not sure.any() for _, _, sure in index_lists.open_pairs(both, 80, 4, None, 1)[0])


def test_groups_and_firsts_across_batches(monkeypatch):
    x = some_lists(5)
    batch = pa.record_batch({k: pa.array(v) for k, v in x.items()})
    for held in (1, 25, 10**6):
        monkeypatch.setattr(ngram_jaccard, "HELD", held)
        for step in (1, 7, 10**6):
            parts = list(ngram_jaccard._groups((batch.slice(k, step) for k in range(0, batch.num_rows, step)), ("of",), ("of", "doc")))
            assert np.concatenate([rows["doc"] for rows, _, _ in parts]).tolist() == x["doc"].tolist()
            assert parts[0][1] and parts[-1][2]
            for (one, _, goes_on), (two, began, _) in zip(parts, parts[1:], strict=False):
                assert (goes_on and began) or one["of"][-1] != two["of"][0]
    rows = pa.record_batch({"hi": pa.array([1, 1, 1, 2, 3, 3]), "lo": pa.array([0] * 6), "n": pa.array([5] * 6), "doc": pa.array([4, 4, 9, 1, 2, 8]), "head": pa.array([[k] for k in range(6)])})
    for step in (1, 2, 6):
        out = pa.Table.from_batches(list(ngram_jaccard._firsts(rows.slice(k, step) for k in range(0, 6, step)))).to_pylist()
        assert [(r["doc"], r["first"], r["head"]) for r in out if not r["border"]] == [(4, 4, [0]), (4, 4, None), (9, 4, None), (1, 1, [3]), (2, 2, [4]), (8, 2, None)]
        assert [(r["hi"], r["doc"], r["head"]) for r in out if r["border"]] == [(1, 4, None), (3, 2, None)]
