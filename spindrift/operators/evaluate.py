"""Evaluation: relevance, recall, precision, reciprocal rank, nDCG, summaries, A/B deltas, response checks, reports."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.sources.store import stored


def relevant(url: Column, text: Column, urls: Column, keywords: Column) -> Column:
    """1 where a result's URL contains a relevant one or is contained in it, or its text has a keyword; else 0."""
    by_url = F.exists(urls, lambda u: (u != "") & (url.contains(u) | u.contains(url)))
    by_word = F.exists(keywords, lambda k: F.lower(text).contains(F.lower(k)))
    return F.coalesce((by_url & (url != "")) | by_word, F.lit(False)).cast("int")


def retrieval_metrics(judged: DataFrame, cases: DataFrame) -> DataFrame:
    """For cases (query, n_urls, has_keywords) and judged results (query, rank, rel): recall, precision, mrr, ndcg, found, total,
    passed.  Recall divides by the relevant URLs, so several results of one URL can bring it above 1; a case without results
    has zeros."""
    gain = F.col("rel") / F.log2(F.col("rank") + 1.0)
    per = judged.groupBy("query").agg(F.sum("rel").alias("hits"), F.count("*").alias("n"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("hits").cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = cases.join(per, "query", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    hits = F.coalesce("hits", F.lit(0))
    return out.select(
        "query",
        zero(hits / F.greatest(F.col("n_urls"), F.lit(1))).alias("recall"),
        zero(F.try_divide(F.col("hits").cast("double"), F.col("n"))).alias("precision"),
        zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.when(F.col("hits") > 0, F.col("dcg") / ideal)).alias("ndcg"),
        hits.alias("n_found"),
        (F.col("n_urls") + F.col("has_keywords").cast("int")).alias("n_relevant"),
        (hits > 0).alias("passed"),
    )


#: Finds (query, rank, url, text) for questions (query, question, top_k).
Retriever = Callable[[DataFrame], DataFrame]


def run_cases(cases: DataFrame, retrieve: Retriever, settings: dict[str, str] | None = None) -> DataFrame:
    """The metrics of cases (query, question, relevant_urls, relevant_keywords, top_k), with settings (a map) and search_time.

    All cases are searched at once, so search_time is an equal share of the search's seconds.  Results beyond a case's top_k
    do not count; null URLs and texts are relevant to nothing; a case without results has zeros."""
    began = time.perf_counter()
    found = stored(retrieve(cases.select("query", "question", "top_k")).select("query", "rank", "url", "text"), "found")
    share = (time.perf_counter() - began) / max(1, cases.count())
    judged = found.join(cases.select("query", "relevant_urls", "relevant_keywords", "top_k"), "query").where("rank <= top_k")
    judged = judged.select("query", "rank", relevant(F.col("url"), F.col("text"), F.col("relevant_urls"), F.col("relevant_keywords")).alias("rel"))
    asked = cases.select("query", F.size("relevant_urls").alias("n_urls"), (F.size("relevant_keywords") > 0).alias("has_keywords"))
    own = F.create_map(*(F.lit(x) for pair in (settings or {}).items() for x in pair)).cast("map<string,string>")
    return retrieval_metrics(judged, asked).withColumns({"search_time": F.lit(round(share, 6)), "settings": own})


METRICS = ("recall", "precision", "mrr", "ndcg")


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Number, passed, pass rate and mean metrics; zeros without results."""
    mean = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(f"avg_{m}") for m in METRICS]
    passed = F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0))
    return results.groupBy(*by).agg(F.count("*").alias("total"), passed.alias("n_passed"), F.round(F.coalesce(F.try_divide(passed.cast("double"), F.count("*")), F.lit(0.0)), 6).alias("pass_rate"), *mean)


def ab_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta) of two results' summaries."""
    long = lambda d, name: summary(d).select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"avg_{m}").alias(name)) for m in METRICS))).alias("x")).select("x.*")
    return long(a, "a").join(long(b, "b"), "metric").withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def response_issues(response: Column, least: Column, most: Column, expected: Column, unexpected: Column) -> Column:
    """What is wrong with a response: too short, too long, any expected keyword missing, any unexpected one there."""
    low = F.lower(response)
    none = F.array().cast("array<string>")
    missing = F.filter(expected, lambda k: ~low.contains(F.lower(k)))
    there = F.filter(unexpected, lambda k: low.contains(F.lower(k)))
    n = F.length(response)
    return F.concat(
        F.when(n < least, F.array(F.concat(F.lit("too short: "), n.cast("string")))).otherwise(none),
        F.when(n > most, F.array(F.concat(F.lit("too long: "), n.cast("string")))).otherwise(none),
        F.coalesce(F.transform(missing, lambda k: F.concat(F.lit("missing: "), F.lower(k))), none),
        F.coalesce(F.transform(there, lambda k: F.concat(F.lit("unexpected: "), F.lower(k))), none),
    )


def custom_issues(response: Column, check: Callable[[str], tuple[bool, list[str]]]) -> Column:
    """Issues that a check of one's own finds in a response, to be added to the others; an error of the check is one."""

    @F.arrow_udf("array<string>")
    def found(responses: pa.Array) -> pa.Array:
        out = []
        for response in responses.to_pylist():
            try:
                passed, issues = check(response or "")
                out.append([] if passed else list(issues))
            except Exception as error:  # a check may raise anything
                out.append([f"Custom validator error: {error}"])
        return pa.array(out, pa.list_(pa.string()))

    return found(response)


def mean_by_metadata(results: DataFrame, key: str) -> DataFrame:
    """Mean response time by a key of the free metadata map."""
    return results.groupBy(F.col("metadata")[key].alias(key)).agg(F.round(F.avg("response_time"), 6).alias("avg_response_time"), F.count("*").alias("n"))


CASE_SCHEMA = "query string, description string, relevant_urls array<string>, relevant_keywords array<string>, top_k int, metadata map<string,string>"


def read_cases(spark, path: str) -> DataFrame:
    """Retrieval cases of a JSON array, with defaults; one without URLs and keywords is an error."""
    rows = spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"relevant_urls": F.coalesce("relevant_urls", empty), "relevant_keywords": F.coalesce("relevant_keywords", empty), "top_k": F.coalesce("top_k", F.lit(5))})
    fine = F.assert_true(F.size("relevant_urls") + F.size("relevant_keywords") > 0, F.lit("a case needs relevant_urls or relevant_keywords"))
    return rows.where(fine.isNull())


def write_cases(cases: DataFrame, path: str) -> None:
    """Cases in the order of their queries as one JSON array, which read_cases reads; bounded by the test suite."""
    names = [c.split()[0] for c in CASE_SCHEMA.split(", ")]
    rows = [r.asDict(True) for r in cases.select(*names).orderBy("query").collect()]
    Path(path).write_text(json.dumps(rows, indent=2))


def json_report(results: DataFrame, path: str, generated_at: str) -> None:
    """A report of results (test rows, bounded by the test suite): summary and numbered results."""
    rows = [r.asDict(True) for r in results.collect()]
    passed = sum(bool(r["passed"]) for r in rows)
    seconds = sum(r.get("response_time") or 0.0 for r in rows)
    counts = {"total": len(rows), "passed": passed, "failed": len(rows) - passed, "success_rate": passed / len(rows) * 100 if rows else 0, "total_time": seconds, "avg_time": seconds / len(rows) if rows else 0}
    body = {"generated_at": generated_at, "summary": counts, "results": [{"test_number": n, **r} for n, r in enumerate(rows, 1)]}
    Path(path).write_text(json.dumps(body, indent=2, default=str))


def html_report(results: DataFrame, path: str, long: int = 300) -> None:
    """The same as a page; responses longer than ``long`` are folded."""
    parts = []
    for n, r in enumerate(results.collect(), 1):
        body = html.escape(r["response"] or "")
        body = f"<details><summary>{body[:long]}...</summary><pre>{body}</pre></details>" if len(r["response"] or "") > long else f"<pre>{body}</pre>"
        issues = "".join(f"<li>{html.escape(i)}</li>" for i in r["issues"] or [])
        parts.append(f"<section class='{'pass' if r['passed'] else 'fail'}'><h2>{n}. {html.escape(r['description'] or '')}</h2><p>{html.escape(r['question'] or '')}</p>{body}<ul>{issues}</ul></section>")
    Path(path).write_text(f"<!doctype html><meta charset='utf-8'><title>Evaluation</title>{''.join(parts)}")
