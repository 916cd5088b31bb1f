import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from held import differences  # noqa: E402

import corpus_pipeline  # noqa: E402
from spindrift.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL) == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    at = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SMALL)
        assert at.columns == docs.columns
        at = spark.createDataFrame(at.toPandas(), docs.schema)
        seen.append(at.count())
    assert docs.count() == seen[0] and seen[1] < seen[0] and corpus_pipeline.run(spark, SMALL).count() == seen[3]


def test_stages_take_odd_rows_and_none(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = " ".join(f"word{k % 977}" for k in range(50_000))
    text = docs.where("lang = 'en' and n_chars > 400").first().text
    odd = [(None, None, None, None, None), (None, text, "en", "src0", 5), (None, text + " and one more", None, None, 5), (1, "", "en", "src0", 0), (1, text, "en", "src1", 5), (1, text, "en", "src1", 5), (10**6, long, "en", None, 9), (10**6 + 1, "the cat sat on the mat and the dog ran", None, "", None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit("own") for c in ("key", "n_words", "score", "component_id", "size", "shard", "place", "row")}
    rows = docs.unionByName(odd.select(docs.columns)).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SMALL)
        found = out.collect()
        if name != "bpe":
            assert out.columns == rows.columns and {r.key for r in found} == {"own"} and len(found) > docs.count() // 2
        none = stage(spark, rows.where("false"), SMALL)
        assert none.count() == 0 and none.columns == out.columns
    kept = corpus_pipeline.one_of_each_group(spark, odd, SMALL).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1000000", "1000001", "None", "None", "None"]
