"""HTML extraction, link graphs, readers and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import crawl, html, joins
from corpusloom.operators.keys import one_per_key
from corpusloom.sources import readers, sinks

PAGE = """<html><head><title> T &amp; x </title><meta name="description" content=" d "><script>var t="</p>";</script></head>
<body><header><p>no</p></header><nav><a href="/n">n</a></nav><main><p>intro</p><h2>One</h2><ul><li>a</li><li>b</li></ul><h2>Empty</h2><h2>Two</h2><p>t <b>w</b></p>
<div class="sidebar"><p>side</p></div><h2>One</h2><p>again</p></main><footer>f</footer><a href="x?q#z">l</a><a href="/d.pdf">p</a></body></html>"""


def test_sections():
    p = html.parse(PAGE)
    assert p["title"] == "T & x" and p["description"] == "d"
    assert [(s["section"], s["content"]) for s in p["sections"]] == [("introduction", "intro"), ("One", "again"), ("Two", "t w")]
    assert html.parse(None)["sections"] == [] and html.parse("<p>x")["sections"] == []
    nested = html.parse("<main><ul><li>a</li></ul></main>")
    assert nested["sections"][0]["content"] == "a a"  # the list and its item both count
    assert html.parse('<meta property="og:title" content="O"><title>x</title>')["title"] == "O"


def test_documents(spark):
    df = spark.createDataFrame([(1, "https://www.some.org/a", PAGE), (2, "https://www.some.org/b", None), (3, None, "<p>plain <i>text</i>")], "id int, url string, html string")
    got = {r.id: r for r in html.build_documents(df, "id", "url", "html").collect()}
    assert got[1].content == "introduction: intro One: again Two: t w"
    assert (got[1].word_count, got[1].content_length, got[1].chunk_count) == (7, len(got[1].content), 1)
    assert got[2].title == "Some" and got[2].content == "" and got[2].chunk_count == 0
    assert got[3].content == "plain text"
    l = df.withColumn("base", F.lit("https://www.some.org/"))
    assert sorted((r.id, r.link) for r in html.links(l, "id", "html", "base").collect()) == [(1, "https://www.some.org/n"), (1, "https://www.some.org/x")]
    f = html.with_fallback(html.build_documents(df, "id", "url", "html"), html.build_documents(df.filter("id = 2").withColumn("html", F.lit(PAGE)), "id", "url", "html", "selenium"), "id", 3)
    assert {r.id: r.method for r in f.collect()} == {1: "requests", 2: "selenium", 3: "requests"}


def test_bfs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("c", None), ("b", "d"), ("x", "y")], "src string, dst string")
    s = spark.createDataFrame([("a",), (None,)], "url string")
    assert sorted((r.url, r.depth) for r in crawl.bfs(e, s).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert sorted(r.url for r in crawl.bfs(e, s, most=3).collect()) == ["a", "b", "c"]
    assert crawl.bfs(e.limit(0), s).count() == 1


def test_json_files(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    meta = {"url": "http://h/a", "title": "T", "scraped_at": "2025"}
    (d / "b.json").write_text(json.dumps({"metadata": meta, "content": "c", "chunks": ["x y", "  ", "z"]}, indent=1))
    (d / "a.json").write_text(json.dumps({"metadata": {**meta, "title": ""}, "content": "c", "chunks": [], "text": "flat"}))
    (d / "bad.json").write_text("{")
    p = readers.scraped_json(spark, str(d))
    assert sorted(r.file_name for r in p.collect()) == ["a", "b"]
    r = {x.id: x for x in readers.page_records(p).collect()}
    assert set(r) == {"T_chunk_0", "T_chunk_2", "a"} and r["T_chunk_2"].metadata.total_chunks == 3 and not r["a"].metadata.pre_chunked
    sinks.write_pages(p, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_jsonl_and_manifest(spark, tmp_path):
    f = tmp_path / "r.jsonl"
    f.write_text('{"id": "a", "text": "x", "metadata": {"k": "v"}}\n\nnot json\n{"id": "", "text": "y"}\n{"id": "c", "text": " "}\n')
    assert [(r.line_no, r.id, r.text) for r in readers.jsonl_records(spark, str(f)).orderBy("line_no").collect()] == [(1, "a", "x"), (4, "jsonl_doc_4", "y")]
    m = tmp_path / "m"
    df = spark.createDataFrame([("a", "é𝄞", ("f",)), ("b", None, ("g",))], "id string, text string, metadata struct<source_file:string>")
    sinks.write_manifest(df, str(m))
    assert sorted((r.id, r.chars) for r in readers.manifest(spark, str(m)).collect()) == [("a", 2), ("b", 0)]
    (tmp_path / "bad").write_text('{"chars": 1}\n')
    with pytest.raises(Exception, match="bad manifest line 1"):
        readers.manifest(spark, str(tmp_path / "bad")).collect()


def test_line_numbers_over_splits(spark, tmp_path):
    d = tmp_path / "lines"
    d.mkdir()
    want = {}
    for k in range(3):
        lines = [f"{k}-{i}" + "x" * (i % 50) if i % 7 else "" for i in range(3000)]
        (d / f"{k}.txt").write_text("\n".join(lines) + "\n")
        want |= {(f"{k}.txt", i + 1): x for i, x in enumerate(lines)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        n = readers.numbered_lines(spark, str(d))
        assert n.rdd.getNumPartitions() > 5
        assert {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in n.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_index(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "row_id bigint, embedding array<float>")
    r = spark.createDataFrame([(1, "a"), (2, "b")], "row_id bigint, text string")
    assert readers.checked_index(v, r).count() == 2
    with pytest.raises(Exception, match="differ in number"):
        readers.checked_index(v, r.limit(1)).collect()
    sinks.write_index(v, r, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).columns == ["row_id", "embedding", "text"]
    sinks.write_report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "rep"))
    assert spark.read.text(str(tmp_path / "rep/txt")).count() == 2


def test_one_per_key(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, None, "z"), (2, None, "z"), (None, 1, "n")], "k int, o int, count string")
    assert sorted((r.k, r["count"]) for r in one_per_key(df, "k", "o").collect()) == [(1, "y"), (2, "z")]
    assert one_per_key(df.limit(0), "k", "o").count() == 0


def test_crawl_filters_and_cap(spark):
    r = spark.createDataFrame([(200, "text/html; charset=utf-8"), (404, "text/html"), (200, "image/png"), (None, None)], "s int, t string")
    assert [x[0] for x in r.select(crawl.valid_response(F.col("s"), F.col("t"))).collect()] == [True, False, False, False]
    t = spark.createDataFrame([("x" * 121,), ("  " + "y" * 60 + " \n " + "z" * 60,), ("",), (None,)], "t string")
    assert [x[0] for x in t.select(crawl.has_content(F.col("t"))).collect()] == [True, False, False, False]
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    s = spark.createDataFrame([("n0",), ("n3",)], "url string")
    got = sorted((r.seed, r.url, r.depth) for r in crawl.bfs(e, s, most=3).collect())
    assert got == [("n0", f"n{i}", i) for i in range(3)] + [("n3", f"n{i}", i - 3) for i in range(3, 6)]


def test_asof_and_interval_joins(spark):
    left = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 1, "x"), (3, "b", 9, None), (4, None, 3, "x"), (1, "a", 5, "x")], "id int, k string, t int, v string")
    right = spark.createDataFrame([("a", 2, 1.0, "e"), ("a", 5, 2.0, "e"), ("a", 5, 3.0, "e"), ("a", 6, 4.0, "e"), (None, 1, 9.0, "e"), ("c", 1, 9.0, "e")], "k string, t int, w double, extra string")
    assert sorted((r.id, r.w) for r in joins.asof_join(left, right, "k", "t", "w").collect() if r.w is not None) == [(1, 3.0), (1, 3.0)]
    assert joins.asof_join(left, right, "k", "t", "w").count() == 5 and joins.asof_join(left, right.limit(0), "k", "t", "w").filter("w is null").count() == 5
    p = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (-3.0,), (None,)], "x double")
    q = spark.createDataFrame([(1, 0.0, 5.0), (2, -10.0, 100.0), (3, 5.0, 5.0), (4, None, 1.0)], "s int, lo double, hi double")
    got = sorted((r.x, r.s) for r in joins.interval_join(p, q, "x", "lo", "hi", 2.0).collect())
    assert got == sorted((x, s) for x in (0.0, 4.9, 5.0, -3.0) for s, lo, hi in ((1, 0, 5), (2, -10, 100)) if lo <= x < hi)
