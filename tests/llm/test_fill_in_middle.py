"""Fill-in-the-middle against plain versions; the query's SQL is held in test_llm_queries.py."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import fill_in_middle as M


def plain(doc_id, text, seed=7, percent=100, percent_spm=50, unit="line", marks=M.SENTINELS):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in marks) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < percent_spm
    return n, "spm" if spm else "psm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m if spm else marks[0] + p + marks[1] + s + marks[2] + m


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\ntwo", "one\ntwo\n", "a<P>b", "a<\nP>b", "<P", "<M>", "<<S>", "<P<M", "é\n日本\n🙂🙂\n\nñ", "\r\n\r\n", "x" * 5000 + "\n" + "日" * 5000, "a\n" * 3000, "tail<", "<S", ">", "M>"]


def rows(spark):
    own = [(None if k % 5 == 0 else k % 9, t, "x", "y", k) for k, t in enumerate(TEXTS * 3)]
    return own, spark.createDataFrame(own, "doc_id long, text string, form string, row string, k long").repartition(3)


@pytest.mark.parametrize(("unit", "percent", "spm"), [("line", 100, 50), ("char", 100, 50), ("line", 40, 0), ("line", 70, 100), ("char", 0, 50)])
def test_equals_a_plain_version(spark, unit, percent, spm):
    own, df = rows(spark)
    made = M.fill_in_middle(df, seed=3, percent=percent, percent_spm=spm, unit=unit)
    assert made.columns == ["doc_id", "row", "k", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = {r.k: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.withColumn("back", M.restored(F.col("form"), F.col("output"))).collect()}
    assert found == {k: (*plain(d, t, 3, percent, spm, unit), t or "") for d, t, _, _, k in own}
    assert M.fill_in_middle(df.where("false"), unit=unit).count() == 0


def test_other_sentinels(spark):
    own, df = rows(spark)
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    made = M.fill_in_middle(df, sentinels=marks, keep=["k"])
    found = {r.k: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.withColumn("back", M.restored(F.col("form"), F.col("output"), marks)).collect()}
    assert found == {k: (*plain(d, t, marks=marks), t or "") for d, t, _, _, k in own}
    with pytest.raises(ValueError):
        M.Scanner(("é", "b", "c"), "line")


@pytest.mark.parametrize("unit", ["line", "char"])
def test_a_state_depends_on_the_last_bytes_alone(unit):
    assert M.scanner(M.SENTINELS, unit).settles()


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(st.one_of(st.sampled_from("<PSM>\n"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=6), st.sampled_from([1, 2, 7, 1 << 20]))
def test_scan_counts_characters_units_and_sentinels(texts, block):
    import numpy as np

    table = M.scanner(M.SENTINELS, "line")
    classes = np.concatenate([np.append(table.class_of[np.frombuffer(t.encode(), np.uint8)], np.uint8(table.end)) for t in texts])
    before, M.BLOCK = M.BLOCK, block
    try:
        flags = table.scan(classes)
    finally:
        M.BLOCK = before
    at = 0
    for t in texts:
        own = flags[at : at + len(t.encode()) + 1]
        at += len(own)
        assert np.count_nonzero(own & M.CHAR) == len(t)
        assert np.count_nonzero(own & M.UNIT) == len(re.findall(r"[^\n]*\n|[^\n]+", t))
        assert np.count_nonzero(own & M.SENTINEL) == sum(t.count(m) for m in M.SENTINELS)
