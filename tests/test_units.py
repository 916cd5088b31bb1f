import json
import re
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.functions import chat, html, text, url
from spindrift.operators import build, chunks, crawl, evaluate, maintain, search
from spindrift.plans import catalogue
from spindrift.sources import sitemaps
from spindrift.streaming import chat as streams


def test_url_functions(spark):
    rows = spark.createDataFrame([("https://a.b.Example.com:80/x/?q#f",), ("http://www.example.com//",)], "u string")
    got = rows.select(url.normalize_url(F.col("u")).alias("n"), url.site(F.col("u")).alias("s"), url.root_domain(F.col("u")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("https://a.b.Example.com:80/x", "a.b.example.com:80", "Example.com"), ("http://www.example.com", "example.com", "example.com")]


def test_sitemaps_and_cache(spark):
    xml = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x/a </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://x/b</loc></url></urlset>'
    index = '<s:sitemapindex xmlns:s="u"><s:sitemap><s:loc>https://x/s1.xml</s:loc><s:lastmod>1</s:lastmod></s:sitemap></s:sitemapindex>'
    files = spark.createDataFrame([("m", xml), ("i", index), ("bad", "<urlset><url>")], "sitemap string, xml string")
    got = {(r.sitemap, r.kind, r.loc, r.lastmod) for r in sitemaps.sitemap_entries(files).collect()}
    assert got == {("m", "url", "https://x/a", "2024-01-02"), ("m", "url", "https://x/b", None), ("i", "sitemap", "https://x/s1.xml", "1")}
    subs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "sitemap string, lastmod string")
    cache = spark.createDataFrame([("a", "1", ["u"]), ("b", "1", ["v"]), ("c", None, ["w"])], "sitemap string, lastmod string, urls array<string>")
    assert {r.sitemap: r.fetch for r in sitemaps.to_fetch(subs, cache).collect()} == {"a": False, "b": True, "c": True}


def test_robots(spark):
    file = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /private/ok\nDisallow: /private\nDisallow: /find?q=\nSitemap: https://x/s.xml\n# end"
    files = spark.createDataFrame([("s", file), ("open", "User-agent: *\nDisallow:"), ("empty", None)], "site string, text string")
    assert [r.url for r in crawl.robots_sitemaps(files).collect()] == ["https://x/s.xml"]
    pages = spark.createDataFrame([(s, f"https://x{p}") for s in ("s", "open", "empty", "none") for p in ("", "/a", "/private/1", "/private/ok", "/find?q=1", "/find")], "site string, url string")
    refused = {(r.site, r.url[9:]) for r in crawl.robots_allowed(pages, crawl.robots_rules(files)).collect() if not r.allowed}
    assert refused == {("s", "/private/1"), ("s", "/find?q=1")}
    assert {r.allowed for r in crawl.robots_allowed(pages.where("site = 's'"), crawl.robots_rules(files, "other")).collect()} == {False}
    places = spark.createDataFrame([("https://docs.x.org/a",), ("https://x.org/a",)], "url string").select(crawl.robots_places(F.col("url")).alias("p")).collect()
    assert [r.p for r in places] == [["https://docs.x.org/robots.txt", "https://x.org/robots.txt"], ["https://x.org/robots.txt"]]
    tried = crawl.sitemap_places(spark.createDataFrame([("s", "https://x/a/b")], "site string, url string"), crawl.robots_sitemaps(files)).orderBy("priority")
    assert [r.sitemap for r in tried.collect()] == ["https://x/s.xml", "https://x/sitemap.xml", "https://x/sitemap_index.xml", "https://x/server-sitemap.xml"]


def test_absolute_links(spark):
    rows = spark.createDataFrame([(h,) for h in ("/r", "c.html", "//h/x", "https://o/p")], "h string")
    got = [r[0] for r in rows.select(sitemaps.absolute(F.lit("https://s.com/a/b.html?q=1"), F.col("h"))).collect()]
    assert got == ["https://s.com/r", "https://s.com/a/c.html", "https://h/x", "https://o/p"]


def test_sections_follow_headings():
    page = "<html><body><nav>menu</nav><p>before it all</p><h1>A</h1><p>one</p><h2 id='x'>B</h2><div><p>two</p><pre><code class='language-py'>f()</code></pre></div><h1>C</h1><table><tr><td>1</td><td>2</td></tr></table></body></html>"
    got = [(s.headings, s.blocks) for s in html.sections(page, chunks.slug)]
    assert got == [([], [("text", "before it all")]), (["A"], [("text", "one")]), (["A", "B"], [("text", "two"), ("code", "```py\nf()\n```")]), (["C"], [("table", "1 2")])]
    assert html.sections("", chunks.slug) == [] and html.page_text(None) == ""


def test_children_refer_to_parents(spark):
    body = "".join(f"<h2>Part {k}</h2>" + "".join(f"<p>{'Some words of content here. ' * n}</p>" for n in (1, 8, 60)) for k in range(3))
    rows = chunks.chunk_pages(spark.createDataFrame([("https://x/docs/", f"<html><body><h1>Top v2.1</h1>{body}</body></html>"), ("https://x/none", None)], "url string, html string"), chunks.Limits(10, 60, 120, 200)).collect()
    parents = {r.chunk_id for r in rows if r.kind == "parent"}
    children = [r for r in rows if r.kind == "child"]
    assert parents and children and {r.parent_id for r in children} <= parents
    assert all(r.tokens <= 60 for r in children) and {r.version for r in rows} == {"2.1"}


def test_text_functions(spark):
    row = spark.range(1).select(text.slug(F.lit(" Hello, Wörld_x! ")).alias("a"), text.shortened(F.lit("abcdef"), 3).alias("b"), text.valid_context(F.lit("short")).alias("c"), text.code_fence(F.lit("language-py"), F.lit("x")).alias("d"), text.spoken_time(F.lit("2024-03-05 04:07:00").cast("timestamp")).alias("e"), text.status_name(F.lit(204)).alias("f"), text.logged_response(F.lit("abcdef"), 2).alias("g")).first()
    assert tuple(row) == ("hello-wörld-x", "abc...", None, "```py\nx\n```", "Tuesday, March 05, 2024 at 4:07 AM UTC", "Success", "ab\n... (truncated, total: 6 chars)")


def test_calculator():
    assert [chat.evaluate(e) for e in ("2*(3+4)", "-2**2", "10/4", "9/3", None, "__import__('os')", "9**9**9", "1/0")] == ["14", "-4", "2.5", "3", "Error: invalid expression", "Error: unsupported expression", "Error: exponent too large", "Error: division by zero"]


def test_messages(spark):
    calls = json.dumps({"choices": [{"message": {"role": "assistant", "content": None, "tool_calls": [{"id": "1", "type": "function", "function": {"name": "t", "arguments": "{}"}}]}}]})
    plain = json.dumps({"message": {"role": "assistant", "content": "hi"}})
    rows = spark.createDataFrame([(calls,), (plain,)], "r string").select(chat.message(F.col("r")).alias("m")).collect()
    assert rows[0].m.tool_calls[0].function.name == "t" and rows[1].m.content == "hi"
    lines = spark.createDataFrame([('data: {"choices":[{"delta":{"content":"Hi"}}]}',), ("data: [DONE]",), ('{"message":{"content":"x"},"done":false}',)], "l string")
    assert [r[0] for r in lines.select(chat.stream_delta(F.col("l"))).collect()] == ["Hi", None, "x"]
    errors = spark.createDataFrame([(None,), ("{}",), ("[]",), ('[{"role":"user"}]',)], "m string").select(chat.request_error(F.col("m"))).collect()
    assert [r[0] for r in errors] == ["messages is required", "messages must be a list", "messages must not be empty", None]


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_marker_filter_in_any_pieces(size):
    whole = f"think {chat.BEGIN}answer [END of it{chat.END} rest"
    own = streams.MarkerFilter()
    out = "".join(own.push(whole[i : i + size]) for i in range(0, len(whole), size)) + own.finish()
    assert out == "answer [END of it"
    own = streams.MarkerFilter()
    assert own.push("no marks") + own.finish() == "no marks"


def test_tool_loop():
    asked = []

    def backend(talk, choice):
        asked.append(choice)
        if talk[-1]["role"] == "tool":
            return {"content": f"it is {talk[-1]['content']}"}
        return {"tool_calls": [{"id": "1", "function": {"name": "add", "arguments": '{"a": 1, "b": 2}'}}]}

    assert streams.tool_loop([{"role": "user", "content": "1 + 2"}], backend, {"add": lambda a, b: a + b}) == ("it is 3", ["add"])
    assert streams.tool_loop([], lambda talk, choice: {"content": ""}, {})[0] == streams.FALLBACK
    assert "not found" in streams.run_tool({}, "x", None)[0]


def test_metrics_by_hand(spark):
    judged = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 0)], "query long, rank int, rel int")
    cases = spark.createDataFrame([(1, 1, False), (2, 2, True), (3, 1, False)], "query long, n_urls int, has_keywords boolean")
    got = {r["query"]: r for r in evaluate.retrieval_metrics(judged, cases).collect()}
    assert (got[1].recall, got[1].precision, got[1].mrr, got[1].ndcg) == (2.0, 0.666667, 0.5, 0.693426)
    assert (got[2].recall, got[2].n_relevant, got[2].passed) == (0.0, 3, False) and got[3].ndcg == 0.0


def test_cases_are_run_at_once(spark):
    cases = spark.createDataFrame([(1, "a", ["u1"], [], 2), (2, "b", [], ["Word"], 1), (3, "none", ["u3"], ["x"], 5)], "query long, question string, relevant_urls array<string>, relevant_keywords array<string>, top_k int")
    found = spark.createDataFrame([(1, 1, "u9", "t", 0), (1, 2, "u1/x", "t", 0), (1, 3, "u1", "t", 0), (2, 1, None, None, 0), (2, 2, "", "a word", 0)], "query long, rank int, url string, text string, rel int")
    got = {r["query"]: r for r in evaluate.run_cases(cases, lambda asked: found.join(asked.select("query"), "query"), {"k": "2"}).collect()}
    assert (got[1].mrr, got[1].precision, got[1].n_relevant, got[1].settings) == (0.5, 0.5, 1, {"k": "2"}) and got[1].search_time > 0
    assert not got[2].passed and not got[3].passed and got[3].n_relevant == 2
    none = evaluate.run_cases(cases.where("false"), lambda asked: found.where("false"))
    assert none.count() == 0


def test_search_config_weights():
    with pytest.raises(ValueError):
        search.SearchConfig(0.5, 0.6)


def test_returned_page_is_found_again(spark):
    rows = spark.createDataFrame([("c1", "u1", 1), ("c2", "u2", 1)], "chunk_id string, url string, version int")
    change = spark.createDataFrame([("u1", "updated", "2", "1")], "url string, change_type string, new_lastmod string, old_lastmod string")
    done = maintain.apply_changes(rows, rows.where("false"), change, rows.drop("version"), 50, 2)
    assert {(r.chunk_id, r.version) for r in maintain.active(done.chunks, done.tombstones).collect()} == {("c1", 2), ("c2", 1)}


def test_streamed_markers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "x" + chat.BEGIN + "he", False), (1, 1, "llo" + chat.END, True), (2, 0, "plain", True)], "conv_id long, seq int, piece string, last boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    asked = streams.filter_markers(stream).writeStream.format("memory").queryName("marked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    asked.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("select * from marked").collect()} == {(1, "hello"), (2, "plain")}


def slug_of(whole):
    return None if whole is None else re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", whole.lower().strip()))


def test_slugs_of_whole_texts_equal_brute_force(spark, tmp_path):
    odd = [None, "", " \n\t", "\u00a0 Hello, Wörld_x!\n", "cafe\u0301 na\u00efve \u0939\u093f\u0928\u094d\u0926\u0940 \u0e44\u0e17\u0e22", "x\u200by\x1cz\u2028a \u00b2\u2167\u24b6 a\u203fb \u2014 🎉", "\u0130\u03a3 \u039f\u03a3 " + "long text, " * 50]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(odd)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    expected = {r.doc_id: slug_of(r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert {r.doc_id: r.slug for r in catalogue.QUERIES["slugify"](spark, str(tmp_path)).collect()} == expected


def test_bm25_queries_need_no_vector(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        shutil.copy(f"{small}/{name}.parquet", tmp_path)
    spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 2 = 0").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = lambda name, d: sorted(map(str, catalogue.QUERIES[name](spark, str(d)).collect()))
    for name in ("bm25_topk", "rerank_minmax", "relevance_metrics", "eval_summary", "ab_compare"):
        assert rows(name, tmp_path) == rows(name, small) != []
    assert {r["query"] % 2 for r in catalogue.QUERIES["knn_topk"](spark, str(tmp_path)).collect()} == {0}


def identifiers_of(code):
    if code is None:
        return ""
    found = re.findall(r"\b([a-z_][a-z0-9_]*)\s*\(", code, re.IGNORECASE) + re.findall(r"--([a-z][a-z0-9-]+)", code) + re.findall(r"\b([A-Z][A-Z0-9_]{2,})\b", code)
    return " ".join(sorted(set(found))[:20])


def test_identifiers_of_whole_texts_equal_brute_force(spark, tmp_path):
    odd = [None, "", " ".join(f"call_{k}(x, MAX_{k}) --opt-{k}" for k in range(30)), "A_B (1) éabc(2) été(3) a\u00a0(4) x\n\t(5) ÉABC ABCÉ _x() 9y() --A --a --ab- f(g(h()))", "word " * 5000 + "last_call(1)"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(odd)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    expected = {r.doc_id: identifiers_of(r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    got = {r.doc_id: r.identifiers or "" for r in catalogue.QUERIES["code_identifiers"](spark, str(tmp_path)).collect()}
    assert got == expected and len(expected[-3].split()) == 20 and expected[-5] == "last_call"


def test_tool_answers_and_stream_lines(spark):
    rows = spark.createDataFrame([(1, 1, "u", "A > B", "t", "whole t"), (1, 2, "v", "", "w", "w")], "query int, rank int, url string, heading_path string, text string, parent_text string")
    got = {r.query: r.text for r in search.formatted(rows, spark.createDataFrame([(1,), (2,)], "query int")).collect()}
    assert got == {1: "**Result 1**\nSource: u\nSection: A > B\n\nt\n\n---\nBroader context:\nwhole t\n\n\n**Result 2**\nSource: v\n\nw\n", 2: "No relevant documentation found for your query."}
    web = spark.createDataFrame([("q", [("T", "U", "D")] * 3), ("q", [])], "q string, r array<struct<title:string,url:string,description:string>>")
    assert [r.x for r in web.select(search.web_results(F.col("q"), F.col("r"), 1).alias("x")).collect()] == ["Found 1 web result(s):\n\n\n1. T\n   URL: U\n   D\n", "No web results found for query: 'q'"]
    lines = spark.range(1).select(chat.stream_lines(F.array(F.lit("a"), F.lit(""), F.lit("b")), F.lit(7)).alias("x"), chat.stream_lines(F.array(F.lit("a")), F.lit(7), F.lit("broken")).alias("y")).first()
    bodies = [json.loads(x.removeprefix("data: ")) for x in lines.x[:-1]]
    assert [b["choices"][0] for b in bodies] == [{"index": 0, "delta": {"content": "a"}, "finish_reason": None}, {"index": 0, "delta": {"content": "b"}, "finish_reason": None}, {"index": 0, "delta": {}, "finish_reason": "stop"}]
    assert lines.x[-1] == "data: [DONE]\n\n" and bodies[0]["created"] == 7 and json.loads(lines.y[1][6:])["choices"][0] == {"index": 0, "delta": {"content": "broken"}, "finish_reason": "error"}


def test_cases_and_checks_of_ones_own(spark, tmp_path):
    cases = spark.createDataFrame([("q2", "d", ["u"], [], 3, {"k": "v"}), ("q1", None, [], ["w"], 5, None)], evaluate.CASE_SCHEMA)
    evaluate.write_cases(cases, str(tmp_path / "cases.json"))
    assert sorted(map(str, evaluate.read_cases(spark, str(tmp_path / "cases.json")).collect())) == sorted(map(str, cases.collect()))

    def check(response):
        if response == "bad":
            raise RuntimeError("no")
        return response == "fine", ["not fine"]

    rows = spark.createDataFrame([("fine",), ("bad",), ("x",), (None,)], "r string").select(evaluate.custom_issues(F.col("r"), check).alias("i"))
    assert [r.i for r in rows.collect()] == [[], ["Custom validator error: no"], ["not fine"], ["not fine"]]
    evaluate.json_report(spark.createDataFrame([(True, 2.0), (False, None)], "passed boolean, response_time double"), str(tmp_path / "r.json"), "now")
    assert json.loads((tmp_path / "r.json").read_text())["summary"] == {"total": 2, "passed": 1, "failed": 1, "success_rate": 50.0, "total_time": 2.0, "avg_time": 1.0}


def test_first_filled_and_discovery(spark):
    rows = spark.createDataFrame([("a", 2, 5, "a2"), ("a", 1, 0, "a1"), ("a", 3, 9, "a3"), ("b", 1, 0, "b1")], "site string, priority int, n_urls int, sitemap string")
    assert [(r.site, r.sitemap) for r in sitemaps.first_filled(rows).collect()] == [("a", "a2")]
    files = spark.createDataFrame([("root", "<urlset><url><loc>https://a.org/1</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a.org/2</loc></url><url><loc>https://b.org/x</loc></url><url><loc>https://a.org/3</loc><lastmod>2024-03-02</lastmod></url></urlset>")], "sitemap string, xml string")
    roots = spark.createDataFrame([("root",), ("none",)], "sitemap string")
    manual = spark.createDataFrame([("https://a.org/2", "2024-02-02", 0), ("https://c.org/m", None, 1)], "url string, lastmod string, ord long")
    links = spark.createDataFrame([("https://a.org/", "https://a.org/p"), ("https://a.org/p", "https://b.org/q"), ("https://a.org/p", "https://a.org/r")], "src string, dst string")
    start = "https://a.org/"
    find = lambda **how: [(r.url, r.lastmod) for r in build.discover_urls(manual, files, roots, start, **how).collect()]
    assert find() == [("https://a.org/3", "2024-03-02"), ("https://a.org/1", "2024-01-02"), ("https://a.org/2", None), ("https://c.org/m", None)]
    assert find(most=2) == find()[:2] and find(manual_only=True) == [("https://a.org/2", "2024-02-02"), ("https://c.org/m", None)]
    empty = [(r.url, r.lastmod) for r in build.discover_urls(manual, files.where("false"), roots, start, links=links).collect()]
    assert empty == [("https://a.org/2", "2024-02-02"), ("https://c.org/m", None), ("https://a.org/", None), ("https://a.org/p", None), ("https://a.org/r", None)]


def test_small_parts_that_no_query_reaches(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    state = spark.createDataFrame([("1", "m", 5, "2024-01-01 20:00:00"), ("0", "m", 5, "2024-01-01 20:00:00"), ("1", "x", 5, "2024-01-01 20:00:00"), ("1", "m", 3, "2024-01-01 20:00:00"), ("1", "m", 5, "2023-01-01 00:00:00"), ("1", "m", 5, None)], "version string, embedding_model string, max_pages int, last_update string").withColumn("last_update", F.col("last_update").cast("timestamp"))
    assert [r.reason for r in maintain.needs_update(state, "1", "m", 4, now, 6).collect()] == [None, "version", "embedding model", "more pages", "age", "never built"]
    rows = spark.createDataFrame([({"k": "a"}, 1.0), ({"k": "a"}, 2.0), ({}, 4.0)], "metadata map<string,string>, response_time double")
    assert {(r.k, r.avg_response_time, r.n) for r in evaluate.mean_by_metadata(rows, "k").collect()} == {("a", 1.5, 2), (None, 4.0, 1)}
    seen = search.inspected(spark.createDataFrame([(1, 1, "u", 0.5, "h", "x" * 9)], "query int, rank int, url string, score double, heading_path string, text string"), 5).first()
    assert (seen.heading, seen.text_preview) == ("h", "xxxxx...")
    told = spark.range(1).select(chat.tool_definition(F.lit("t"), F.lit('says "x"'), F.lit('{"type":"object"}')).alias("d")).first().d
    assert json.loads(told) == {"type": "function", "function": {"name": "t", "description": 'says "x"', "parameters": {"type": "object"}}}


def test_rows_of_postings_do_not_grow_with_the_vocabulary():
    """A slot is a row for each bucket of terms and one of its own, however many terms its texts have."""
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) + " all  all" for k in range(100)] + [None, "\t"]
    rows = pa.record_batch({"slot": pa.array([7] * len(texts), pa.int64()), "doc": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    made = pa.Table.from_batches(list(search._posted(iter([rows]))))
    assert made.num_rows <= search.BUCKETS + 1
    df = {r["term"]: r["df"] for b in search._frequencies(iter(made.slice(1).combine_chunks().to_batches())) for r in b.to_pylist()}
    assert len(df) == 4001 and df["all"] == 100 and df["w3x4"] == 1
    assert made["texts"][0].as_py() == 102 and made["words"][0].as_py() == 4200
