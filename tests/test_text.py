"""Text, chunk and cleaning operators against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators import chunk, clean, dedup

TEXTS = ["", "   ", "the the bank", "Le Le café café noir", "a b c d a b c d e", "Hello Login Register world Select a Select b Select tail", "x" * 5000, "one\ttwo\n\nthree  four", "© 2020 Bank All Rights Reserved. rest", None]


def py_words(t):
    return t.split()


def py_chunks(t, size, overlap):
    w = t.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), max(1, size - overlap))]


def py_chars(t, most, overlap):
    step = most - min(overlap, most - 1)
    return [p for p in (t[i : i + most].strip() for i in range(0, len(t), step)) if p]


def py_clean(t):
    t = " ".join(t.split())
    seen, out = set(), []
    w = t.split(" ")
    for i, x in enumerate(w):
        p = " ".join(w[i : i + 4])
        if p not in seen:
            seen.add(p)
            out.append(x)
    t = " ".join(out)
    for p in T.BOILERPLATE:
        t = re.sub(p, " ", t, flags=re.I)
    return " ".join(re.sub(r"\b(\w+)\s+(?=\1\b)", "", t, flags=re.I).split())


def rows(spark, texts, col):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return {r.id: r.x for r in df.select("id", col.alias("x")).collect()}


def test_clean_equals_python(spark):
    more = ["Close Menu foo x x اردو bar", "Connect with us on Share now Connect with us", "facebook linkedin whatsapp email print end", "select one Select two then select"]
    texts = TEXTS + more
    got = rows(spark, texts, clean.clean(F.col("t")))
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else py_clean(t)), t


def test_words_and_quality(spark):
    got = rows(spark, TEXTS, T.quality(F.col("t")))
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = py_words(t)
        q = got[i]
        assert (q.length, q.word_count, q.sentence_count) == (len(t), len(w), sum(t.count(c) for c in ".!?"))
        assert q.avg_word_length == pytest.approx(sum(map(len, w)) / len(w) if w else 0)
        assert q.paragraph_count == len([p for p in t.split("\n") if p.strip()])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab \n.", max_size=60), min_size=1, max_size=6), st.integers(1, 7), st.integers(0, 9))
def test_chunks_equal_python(spark, texts, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = sorted((r.id, r.chunk_index, r.chunk) for r in chunk.word_chunks(df, "id", "t", size, overlap).collect())
    assert got == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(py_chunks(t, size, overlap))]
    got = sorted((r.id, r.chunk_index, r.chunk) for r in chunk.char_chunks(df, "id", "t", size, overlap).collect())
    assert got == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(py_chars(t, size, overlap))]


def test_word_chunks_of_460_words(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(460))))], "id int, t string")
    assert [T_ for T_ in sorted(len(r.chunk.split()) for r in chunk.word_chunks(df, "id", "t").collect())] == [10, 460]


def test_phrase_dedup_native_equals_arrow(spark):
    texts = [t for t in TEXTS if t and t.strip()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", T.collapse(F.col("t")).alias("t"))
    a = {r.id: r.x for r in df.select("id", clean.phrase_dedup("t").alias("x")).collect()}
    b = {r.id: r.t for r in clean.phrase_dedup_native(df, "id", "t").collect()}
    assert a == b


def test_file_names(spark):
    got = rows(spark, ['a<b>:"/\\|?*c', "   ", "", None, "y" * 150], T.file_name(F.col("t")))
    assert list(got.values()) == ["abc", "page", "page", "page", "y" * 100]


def test_urls(spark):
    got = rows(spark, ["https://h:8080/a/?q=1#x", "HTTP://Ex.org", "mailto:x@y", None], U.normalize(F.col("t")))
    assert list(got.values()) == ["https://h:8080/a", "http://Ex.org", "mailto://x@y", None]
    bad = ["http://h/a.PDF", "http://h/ur-x", "http://h/api/x", "tel:1", "http://h/#a"]
    assert list(rows(spark, [*bad, "http://h/ur", "http://h/a.pdf?x"], U.is_valid(F.col("t"))).values()) == [False] * 5 + [True, True]
    base = F.lit("https://h.org/site/start")
    want = {"/x": "https://h.org/x", "y": "https://h.org/site/y", "//o.org/z": "https://o.org/z", "http://q/": "http://q/", "": "https://h.org/site/start"}
    assert list(rows(spark, list(want), U.resolve(base, F.col("t"))).values()) == list(want.values())


def test_dedup(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), ("b", 4, None)], "id string, ord int, text string")
    got = {r.id: r.text for r in dedup.keep_first(df, "id", "ord").collect()}
    assert got == {"a": "y", None: "z", "b": None}
    c = dedup.duplicate_count(df, "id").first()
    assert (c.rows, c.distinct_ids, c.duplicates) == (4, 3, 1)
    assert dedup.duplicate_count(df.limit(0), "id").first().rows == 0
    with pytest.raises(ValueError):
        dedup.ordered_union()
    assert [r.id for r in dedup.difference(df.filter("id is not null"), df.filter("id = 'a'"), "id").collect()] == ["b"]
