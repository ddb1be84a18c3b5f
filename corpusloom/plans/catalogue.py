"""The queries of the core operators, each over its whole tables, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators import answers, chunk, clean, crawl, dedup, evaluate, html, joins, vector
from corpusloom.operators.keys import one_per_key
from corpusloom.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return one_per_key(_t(s, d, "scraped_pages"), "page_id", "loaded_at")


PAGES = "pg AS (SELECT * FROM scraped_pages WHERE page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
RECORDS = "rec AS (SELECT DISTINCT row_id, id, text, metadata FROM doc_records WHERE row_id IS NOT NULL)"


def _records(s: SparkSession, d: str) -> DataFrame:
    return one_per_key(_t(s, d, "doc_records").select("row_id", "id", "text", "metadata"), "row_id")


# --- search and vectors --------------------------------------------------------------------------------------------

_HITS = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
v AS (SELECT vec_id AS vector_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT query_id, vector_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM q, v),
h AS (SELECT query_id, vector_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, vector_id) AS rank FROM d QUALIFY rank <= {k})
"""


def _hits(s: SparkSession, d: str, k: int = 5) -> DataFrame:
    e = _t(s, d, "embeddings")
    return vector.knn(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "vector_id"), k)


@_query(f"WITH {_HITS.format(k=5)} SELECT query_id, vector_id, rank::INT AS rank, round(1 / (1 + d2), 6) AS score FROM h")
def knn_topk(s: SparkSession, d: str) -> DataFrame:
    return vector.with_score(_hits(s, d)).select("query_id", "vector_id", "rank", F.round("score", 6).alias("score"))


@_query(f"WITH {_HITS.format(k=5)} SELECT query_id, vector_id, rank::INT AS rank, round(d2, 6) AS d2 FROM h")
def knn_raw(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d).select("query_id", "vector_id", "rank", F.round("d2", 6).alias("d2"))


@_query(f"WITH {_HITS.format(k=20)}, c AS (SELECT h.*, e.label = p.label AS same FROM h JOIN embeddings e ON e.vec_id = h.vector_id JOIN embeddings p ON p.vec_id = h.query_id WHERE 1 / (1 + d2) >= 0.3) SELECT query_id, vector_id, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + d2), 6) + same::INT DESC, vector_id)::INT AS rank FROM c")
def knn_rerank(s: SparkSession, d: str) -> DataFrame:
    """Second stage over 20 hits: score threshold, then same label first."""
    e = _t(s, d, "embeddings").select("vec_id", "label")
    h = vector.with_score(_hits(s, d, 20)).filter("score >= 0.3").join(e.select(F.col("vec_id").alias("vector_id"), "label"), "vector_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return vector.rerank(h, F.round("score", 6) + (F.col("label") == F.col("own")).cast("int")).select("query_id", "vector_id", "rank")


@_query("SELECT count(*) AS index_size, count(DISTINCT vec_id) AS ids, max(len(embedding)) AS dimension FROM embeddings")
def retriever_info(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "embeddings").agg(F.count(F.lit(1)).alias("index_size"), F.count_distinct("vec_id").alias("ids"), F.max(F.size("embedding")).alias("dimension"))


@_query("SELECT sum(len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))))::BIGINT AS nonfinite, count(*) AS vectors FROM doc_vectors WHERE embedding IS NOT NULL")
def nonfinite_count(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "doc_vectors").filter("embedding is not null").agg(F.sum(S.nonfinite(F.col("embedding"))).alias("nonfinite"), F.count(F.lit(1)).alias("vectors"))


@_query("WITH n AS (SELECT sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings) SELECT count(*) AS vectors, round(min(norm), 6) AS min_norm, round(quantile_cont(norm, 0.01), 6) AS p01_norm, round(avg(norm), 6) AS mean_norm, round(quantile_cont(norm, 0.99), 6) AS p99_norm, round(max(norm), 6) AS max_norm FROM n")
def norm_stats(s: SparkSession, d: str) -> DataFrame:
    n = vector.norm_stats(_t(s, d, "embeddings"))
    return n.select("vectors", *[F.round(c, 6).alias(c) for c in n.columns[1:]])


@_query("WITH c AS (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT dim::INT AS dim, round(var_pop(x), 9) AS variance, var_pop(x) < 1e-12 AS dead FROM c GROUP BY dim")
def dim_variance(s: SparkSession, d: str) -> DataFrame:
    return vector.dim_variance(_t(s, d, "embeddings")).select("dim", F.round("variance", 9).alias("variance"), "dead")


@_query("""
WITH b AS (SELECT min(vec_id) AS lo, max(vec_id) - min(vec_id) + 1 AS w FROM embeddings),
s AS (SELECT (i * 7919 + 42) % w + lo AS a, ((i * 7919 + 42) % w + (i * 104729 + 1302) % greatest(1, w - 1) + 1) % w + lo AS b FROM range(2000) r(i), b),
c AS (SELECT list_sum(list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), lambda p: p[1] * p[2]))
    / (sqrt(list_sum(list_transform(x.embedding::DOUBLE[], lambda p: p * p))) * sqrt(list_sum(list_transform(y.embedding::DOUBLE[], lambda p: p * p)))) AS c
  FROM s JOIN embeddings x ON x.vec_id = s.a JOIN embeddings y ON y.vec_id = s.b WHERE s.a <> s.b)
SELECT count(*) AS pairs, round(avg(c), 6) AS mean_cos, round(stddev_pop(c), 6) AS std_cos, round(quantile_cont(c, 0.95), 6) AS p95_cos, round(quantile_cont(c, 0.99), 6) AS p99_cos, round(max(c), 6) AS max_cos, count(*) FILTER (c >= 0.98) AS near_pairs FROM c""")
def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    c = vector.cosine_pairs(_t(s, d, "embeddings"), "vec_id")
    return c.select("pairs", *[F.round(x, 6).alias(x) for x in c.columns[1:6]], "near_pairs")


@_query("""
WITH dims AS (SELECT run_id, max(embedding_dimension) AS dim, bool_or(normalize_embeddings) AS normalized FROM run_reports WHERE run_id IS NOT NULL GROUP BY run_id),
v AS (SELECT d.run_id, d.row_id, normalized, dim, embedding::DOUBLE[] AS e, len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) AS bad FROM doc_vectors d LEFT JOIN dims USING (run_id)),
n AS (SELECT *, CASE WHEN e IS NOT NULL AND bad = 0 THEN sqrt(list_sum(list_transform(e, lambda x: x * x))) END AS norm FROM v),
a AS (SELECT run_id, count(*) AS rows, count(*) FILTER (e IS NULL) AS null_vectors, count(*) FILTER (e IS NOT NULL AND len(e) <> dim) AS wrong_length, count(*) FILTER (e IS NOT NULL AND bad > 0) AS nonfinite,
  count(*) FILTER (norm = 0) AS zero_vectors, count(*) FILTER (coalesce(normalized, false) AND norm > 0 AND NOT norm BETWEEN 0.95 AND 1.05) AS norm_outside, count(*) - count(DISTINCT row_id) AS duplicate_ids FROM n GROUP BY run_id)
SELECT *, CASE WHEN duplicate_ids + null_vectors + wrong_length + nonfinite + norm_outside > 0 THEN 'critical' WHEN zero_vectors > 0 THEN 'warning' ELSE 'pass' END AS verdict FROM a""")
def embedding_checks(s: SparkSession, d: str) -> DataFrame:
    return vector.run_checks(_t(s, d, "doc_vectors"), _t(s, d, "run_reports"))


@_query(f"WITH {RECORDS} SELECT v.run_id, v.row_id, r.id, coalesce(length(r.text), 0) AS chars FROM (SELECT DISTINCT run_id, row_id FROM doc_vectors) v JOIN rec r USING (row_id)")
def index_join(s: SparkSession, d: str) -> DataFrame:
    """Vector rows with their records: the positional lookup as an equi-join on the key."""
    v = _t(s, d, "doc_vectors").select("run_id", "row_id").distinct()
    return v.join(_records(s, d), "row_id").select("run_id", "row_id", "id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))


@_query()
def encode_records(s: SparkSession, d: str) -> DataFrame:
    return vector.encode(_records(s, d).select("row_id", "text"), "text").select("row_id", F.size("embedding").alias("dimension"), F.round(S.norm(F.col("embedding")), 4).alias("norm"))


# --- chunks and cleaning -------------------------------------------------------------------------------------------


@_query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, unnest(range(0, len(w), 450)) AS s FROM w)
SELECT doc_id, (s / 450)::INT AS chunk_index, len(w[s + 1 : s + 500]) AS words, md5(array_to_string(w[s + 1 : s + 500], ' ')) AS digest FROM c""")
def word_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunk.word_chunks(_t(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", T.word_count(F.col("chunk")).alias("words"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


_CHARS = """
c AS (SELECT k, x, unnest(range(0, length(x), 1150)) AS s FROM t WHERE x IS NOT NULL),
p AS (SELECT k, s, regexp_replace(substr(x, s + 1, 1200), '^\\s+|\\s+$', '', 'g') AS piece FROM c),
o AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, piece FROM p WHERE piece <> '')
"""


@_query(f"WITH t AS (SELECT doc_id AS k, text AS x FROM documents), {_CHARS} SELECT k AS doc_id, i::INT AS chunk_index, length(piece) AS chars, md5(piece) AS digest FROM o")
def char_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunk.char_chunks(_t(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


@_query(f"""WITH {RECORDS}, t AS (SELECT row_id AS k, text AS x FROM rec WHERE NOT coalesce(metadata.pre_chunked, false)), {_CHARS},
ids AS (SELECT row_id, id FROM rec)
SELECT row_id, id, 0 AS chunk_index, 1 AS total_chunks, length(text) AS chars FROM rec WHERE coalesce(metadata.pre_chunked, false) AND text IS NOT NULL
UNION ALL SELECT k, id || '_chunk_' || i, i::INT, n::INT, length(piece) FROM o JOIN ids ON row_id = k""")
def record_chunks(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).select("row_id", "id", "text", F.col("metadata.pre_chunked").alias("pre_chunked")).filter("text is not null")
    return chunk.chunk_records(r).select("row_id", "id", "chunk_index", "total_chunks", F.length("chunk").alias("chars"))


@_query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def whitespace_norm(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))


@_query("""
WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM t),
p AS (SELECT doc_id, i, w[i + 1] AS x, array_to_string(w[i + 1 : i + 4], ' ') AS p FROM e)
SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, p) AS f FROM p) WHERE i = f GROUP BY doc_id""")
def phrase_dedup(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "documents").filter("text is not null").select("doc_id", clean.phrase_dedup(T.collapse(F.col("text"))).alias("text"))


@_query()
def clean_text(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "documents").select("doc_id", clean.clean(F.col("text")).alias("text"))


@_query()
def html_documents(s: SparkSession, d: str) -> DataFrame:
    """Pages as HTML (a heading for the title, a paragraph for each line) through extraction and the document record."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    page = F.concat(F.lit("<html><head><title>"), esc(F.col("metadata.title")), F.lit("</title></head><body><nav>Home</nav><main><h1>"), esc(F.col("metadata.title")), F.lit("</h1>"), body, F.lit("</main></body></html>"))
    return html.build_documents(_pages(s, d).select("page_id", F.col("metadata.url").alias("url"), page.alias("html")), "page_id", "url", "html")


@_query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, length(t) AS length, len(w)::INT AS word_count, round(coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0), 6) AS avg_word_length,
  length(t) - length(translate(t, '.!?', '')) AS sentence_count, len(list_filter(string_split(t, chr(10)), lambda p: trim(regexp_replace(p, '\\s+', '', 'g')) <> ''))::INT AS paragraph_count FROM t""")
def text_quality(s: SparkSession, d: str) -> DataFrame:
    q = _t(s, d, "documents").select("doc_id", T.quality(F.col("text")).alias("q"))
    return q.select("doc_id", "q.length", "q.word_count", F.round("q.avg_word_length", 6).alias("avg_word_length"), "q.sentence_count", "q.paragraph_count")


# --- sources, ids, sets --------------------------------------------------------------------------------------------


@_query(f"""WITH {PAGES}, c AS (SELECT page_id, coalesce(nullif(metadata.title, ''), page_id::VARCHAR) AS title, len(chunks) AS n, unnest(chunks) AS c, generate_subscripts(chunks, 1) - 1 AS i FROM pg)
SELECT title || '_chunk_' || i AS id, i::INT AS chunk_index, n::INT AS total_chunks, length(c) AS chars FROM c WHERE regexp_replace(c, '[\\s\\x{{00a0}}]+', '', 'g') <> ''""")
def scraped_records(s: SparkSession, d: str) -> DataFrame:
    r = readers.page_records(_pages(s, d).withColumn("file_name", F.col("page_id").cast("string")))
    return r.select("id", "metadata.chunk_index", "metadata.total_chunks", F.length("text").alias("chars"))


@_query(f"WITH {PAGES} SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(coalesce(metadata.title, ''), '[<>:\"/\\\\|?*]', '', 'g'), '^\\s+|\\s+$', '', 'g'), 100), ''), 'page') || '_' || left(md5(coalesce(metadata.url, '')), 10) || '.json' AS file FROM pg")
def file_keys(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", T.file_key(F.col("metadata.title"), F.col("metadata.url")).alias("file"))


@_query(f"WITH {RECORDS} SELECT row_id, id, length(coalesce(text, '')) AS chars FROM rec")
def manifest(s: SparkSession, d: str) -> DataFrame:
    line = sinks.manifest_line(F.col("id"), F.col("text"), F.col("metadata"))
    back = F.from_json(line, "id string, chars bigint")
    return _records(s, d).select("row_id", back["id"].alias("id"), back["chars"].alias("chars"))


@_query(f"WITH {RECORDS}, {PAGES} SELECT 0 AS src_ord, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM rec UNION ALL SELECT 1, count(*), sum(length(coalesce(content, '')))::BIGINT FROM pg")
def ordered_union(s: SparkSession, d: str) -> DataFrame:
    a = _records(s, d).select("id", "text")
    b = _pages(s, d).select(F.col("metadata.title").alias("id"), F.col("content").alias("text"))
    return dedup.ordered_union(a, b).groupBy("src_ord").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@_query(f"WITH {RECORDS} SELECT id, row_id, coalesce(length(text), 0) AS chars FROM rec QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1")
def dedup_keep_first(s: SparkSession, d: str) -> DataFrame:
    return dedup.keep_first(_records(s, d).select("id", "row_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")), "id", "row_id")


@_query(f"WITH {RECORDS} SELECT count(*) AS rows, count(DISTINCT coalesce(id, chr(0))) AS distinct_ids, count(*) - count(DISTINCT coalesce(id, chr(0))) AS duplicates FROM rec")
def duplicate_ids(s: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_count(_records(s, d), "id")


@_query("SELECT count(DISTINCT coalesce(metadata.source_url, 'Unknown')) AS sources FROM doc_records")
def distinct_sources(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "doc_records").agg(F.count_distinct(F.coalesce("metadata.source_url", F.lit("Unknown"))).alias("sources"))


# --- urls and crawls -----------------------------------------------------------------------------------------------

_NORM = "lower(regexp_extract({u}, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 1)) || '://' || regexp_extract({u}, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 2) || regexp_replace(regexp_extract({u}, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 3), '/+$', '')"
_VALID = "NOT (regexp_matches(lower({u}), '\\.(pdf|jpg|jpeg|png|gif|svg|css|js|ico|zip|rar|doc|docx|xls|xlsx|mp4|webp)$') OR contains({u}, '#') OR contains({u}, '/ur-') OR contains({u}, '/ur/') OR contains({u}, '/api/') OR contains({u}, 'graphql') OR starts_with({u}, 'mailto:') OR starts_with({u}, 'tel:') OR starts_with({u}, 'javascript:'))"


@_query(f"WITH {PAGES} SELECT page_id, {_NORM.format(u='metadata.url')} AS url FROM pg")
def url_normalize(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", U.normalize(F.col("metadata.url")).alias("url"))


@_query(f"WITH l AS (SELECT crawl_id, unnest(links) AS u FROM crawl_runs) SELECT crawl_id, count(*) AS links, count(*) FILTER ({_VALID.format(u='u')}) AS valid FROM l WHERE u IS NOT NULL GROUP BY crawl_id")
def url_filter(s: SparkSession, d: str) -> DataFrame:
    l = _t(s, d, "crawl_runs").select("crawl_id", F.explode("links").alias("u")).filter("u is not null")
    return l.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(U.is_valid(F.col("u"))).alias("valid"))


@_query(f"WITH l AS (SELECT crawl_id, base_url, unnest(links) AS u FROM crawl_runs), n AS (SELECT DISTINCT crawl_id, {_NORM.format(u='u')} AS link, {_NORM.format(u='base_url')} AS b FROM l WHERE u IS NOT NULL AND regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.\\-]*:')) SELECT crawl_id, link FROM n WHERE {_VALID.format(u='link')} AND regexp_extract(link, '//([^/]*)', 1) = regexp_extract(b, '//([^/]*)', 1)")
def crawl_links(s: SparkSession, d: str) -> DataFrame:
    """The distinct valid internal links of each crawl, normalised; relative ones are left to the page extraction."""
    l = _t(s, d, "crawl_runs").select("crawl_id", "base_url", F.explode("links").alias("u")).filter(F.col("u").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))
    n = l.select("crawl_id", "base_url", U.normalize(F.col("u")).alias("link"))
    return n.filter(U.is_valid(F.col("link")) & U.is_internal(F.col("link"), F.col("base_url"))).select("crawl_id", "link").distinct()


_EDGES = f"""u AS (SELECT DISTINCT {_NORM.format(u='metadata.url')} AS url FROM scraped_pages WHERE metadata.url IS NOT NULL),
e AS (SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS src, url AS dst FROM u WHERE regexp_matches(url, '^[a-z]+://[^/]+/.') UNION
  SELECT DISTINCT regexp_replace(regexp_replace(url, '/[^/]*$', ''), '/[^/]*$', ''), regexp_replace(url, '/[^/]*$', '') FROM u WHERE regexp_matches(url, '^[a-z]+://[^/]+/[^/]+/.'))"""


@_query(f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+') AS seed FROM u),
b AS (SELECT seed, seed AS url, 0 AS depth FROM s UNION SELECT b.seed, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 8)
SELECT seed, url, min(depth)::INT AS depth FROM b GROUP BY seed, url""")
def crawl_bfs(s: SparkSession, d: str) -> DataFrame:
    """Breadth-first waves over the folders of each site."""
    u = _t(s, d, "scraped_pages").filter("metadata.url is not null").select(U.normalize(F.col("metadata.url")).alias("url")).distinct()
    up = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    e = u.filter(F.col("url").rlike("^[a-z]+://[^/]+/.")).select(up(F.col("url")).alias("src"), F.col("url").alias("dst"))
    e = e.union(u.filter(F.col("url").rlike("^[a-z]+://[^/]+/[^/]+/.")).select(up(up(F.col("url"))).alias("src"), up(F.col("url")).alias("dst")))
    return crawl.bfs(e, u.select(F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("url")))


@_query(f"WITH c AS (SELECT DISTINCT {_NORM.format(u='u')} AS url FROM (SELECT unnest(links) AS u FROM crawl_runs) WHERE u IS NOT NULL), p AS (SELECT DISTINCT {_NORM.format(u='metadata.url')} AS url FROM scraped_pages WHERE metadata.url IS NOT NULL) SELECT url FROM c WHERE url NOT IN (SELECT url FROM p)")
def links_not_scraped(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "crawl_runs").select(F.explode("links").alias("u")).filter("u is not null").select(U.normalize(F.col("u")).alias("url"))
    p = _t(s, d, "scraped_pages").filter("metadata.url is not null").select(U.normalize(F.col("metadata.url")).alias("url"))
    return dedup.difference(c, p, "url")


@_query("""SELECT crawl_id, total_valid_pages, skipped_pages, coalesce(len(links), 0)::INT AS links, coalesce(len(list_distinct(links)), 0)::INT + (CASE WHEN len(list_filter(links, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END) AS distinct_links,
coalesce(len(details), 0)::INT AS pages_with_details, coalesce(list_sum(list_transform(details, lambda x: coalesce(x.links_found, 0))), 0)::BIGINT AS links_found,
round(crawl_time_sec / nullif(coalesce(total_valid_pages, 0) + coalesce(skipped_pages, 0), 0), 6) AS sec_per_page FROM crawl_runs""")
def crawl_summary(s: SparkSession, d: str) -> DataFrame:
    return crawl.crawl_summary(_t(s, d, "crawl_runs"))


# --- contexts and answers ------------------------------------------------------------------------------------------

_DOCS = f"""{_HITS.format(k=5)}, m AS (SELECT query_id, rank, 'L' || e.label AS source, 'vector ' || vector_id AS content FROM h JOIN embeddings e ON e.vec_id = vector_id)"""


def _docs(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "embeddings")
    meta = e.select(F.col("vec_id").alias("vector_id"), F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("source"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("content"))
    return answers.retrieved(vector.with_score(_hits(s, d)), meta)


@_query(f"WITH {_DOCS} SELECT query_id, '## Relevant Context' || chr(10) || chr(10) || string_agg('### Source ' || rank || ': ' || source || chr(10) || 'Content: ' || content || chr(10) || chr(10), '' ORDER BY rank) AS context FROM m GROUP BY query_id")
def context_string(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("query_id", answers.context(F.col("docs")).alias("context"))


@_query(f"WITH {_DOCS} SELECT query_id, '## Available Context:' || chr(10) || chr(10) || string_agg(rank || '. ' || left(content, 200) || '...' || chr(10), '' ORDER BY rank) AS context FROM m GROUP BY query_id")
def verifier_context(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("query_id", answers.verifier_context(F.col("docs")).alias("context"))


@_query("SELECT item_id, 'ctx' || chr(10) || chr(10) || '## User Question:' || chr(10) || text || chr(10) || chr(10) || '## Answer:' || chr(10) || 'Based on the provided context, here''s my answer:' AS prompt FROM eval_items")
def prompts(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "eval_items").select("item_id", answers.prompt(F.col("text"), F.lit("ctx")).alias("prompt"))


@_query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (json_extract_string(props, '$.k')::INT % 2) = 0 ELSE true END AS is_grounded, CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence, event_id % 2 = 0 AS parse_ok FROM events")
def verify_parse(s: SparkSession, d: str) -> DataFrame:
    """Replies built from the event log: every second one a fenced JSON verdict, the others plain words."""
    k = F.get_json_object("props", "$.k").cast("int")
    good = F.concat(F.lit("Sure.\n```json\n"), F.to_json(F.struct((k % 2 == 0).alias("is_grounded"), F.lit(0.25).alias("confidence"), F.array(F.lit("x")).alias("issues"))), F.lit("\n```\nDone."))
    r = _t(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, good).otherwise(F.lit("looks fine")).alias("reply"))
    return r.select("event_id", answers.verification(F.col("reply")).alias("v")).select("event_id", "v.is_grounded", "v.confidence", "v.parse_ok")


def _answers(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).filter("trim(text) <> ''")
    v = vector.encode(r.select(F.col("row_id").alias("vector_id"), "text"), "text").select("vector_id", "embedding")
    meta = r.select(F.col("row_id").alias("vector_id"), "id", F.col("metadata.source_title").alias("source"), F.col("text").alias("content"))
    q = _t(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return answers.answer(q, v, meta)


@_query()
def answer_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Every held-out item as a question over the encoded records: retrieval, generation, verification."""
    return _answers(s, d).select("query_id", "status", F.size("context").alias("num_sources"), F.length("answer").alias("answer_chars"), "verification.parse_ok")


@_query(f"WITH {_DOCS}, s AS (SELECT query_id, rank, source, 1 / (1 + d2) AS score FROM h JOIN m USING (query_id, rank)) SELECT query_id, rank::INT AS rank, coalesce(nullif(source, ''), 'Document ' || rank) AS title, printf('%.1f', floor(score * 1000 + 0.5) / 10) AS percent FROM s")
def shown_sources(s: SparkSession, d: str) -> DataFrame:
    """What a user sees of the retrieved documents: title and score in percent to one decimal."""
    e = _docs(s, d).select("query_id", F.explode("docs").alias("x")).select("query_id", "x.rank", "x.source", "x.score")
    return e.select("query_id", "rank", F.coalesce(F.nullif("source", F.lit("")), F.concat(F.lit("Document "), F.col("rank").cast("string"))).alias("title"), F.format_string("%.1f", F.floor(F.col("score") * 1000 + 0.5) / 10).alias("percent"))


@_query()
def pipeline_eval(s: SparkSession, d: str) -> DataFrame:
    """Relevance of answers and contexts by the encoder, previews and quality flags."""
    e = evaluate.pipeline_eval(evaluate.relevance(_answers(s, d)).withColumnRenamed("context", "docs"))
    return e.select("query_id", "preview", "answer_words", "num_sources", F.round("answer_relevance", 4).alias("answer_relevance"), F.round("avg_context_relevance", 4).alias("avg_context_relevance"), "has_specific_info")


# --- evaluation, reports, monitoring -------------------------------------------------------------------------------


@_query(f"WITH {_HITS.format(k=5)} SELECT query_id, count(*) AS num_docs, round(max(1 / (1 + d2)), 6) AS top_score, round(avg(1 / (1 + d2)), 6) AS avg_score, round(min(1 / (1 + d2)), 6) AS min_score FROM h GROUP BY query_id")
def retrieval_eval(s: SparkSession, d: str) -> DataFrame:
    r = evaluate.retrieval_eval(vector.with_score(_hits(s, d)))
    return r.select("query_id", "num_docs", *[F.round(c, 6).alias(c) for c in ("top_score", "avg_score", "min_score")])


@_query("""SELECT item_id, CASE WHEN length(coalesce(text, '')) > 200 THEN left(text, 200) || '...' ELSE coalesce(text, '') END AS preview, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::INT AS answer_words,
regexp_matches(coalesce(text, ''), '\\p{Nd}') AS has_numbers, contains(lower(coalesce(text, '')), 'can') OR contains(lower(coalesce(text, '')), 'offer') OR contains(lower(coalesce(text, '')), 'provide') OR contains(lower(coalesce(text, '')), 'include') OR contains(lower(coalesce(text, '')), 'available') AS has_action_words FROM eval_items""")
def answer_indicators(s: SparkSession, d: str) -> DataFrame:
    return evaluate.answer_eval(_t(s, d, "eval_items"), "item_id", "text")


_RESULTS = f"""{_HITS.format(k=5)}, r AS (SELECT query_id, query_id % 7 <> 0 AS success, count(*) AS num_docs, list(1 / (1 + d2) ORDER BY rank) AS scores, avg(1 / (1 + d2)) AS m FROM h GROUP BY query_id),
x AS (SELECT r.*, e.value AS retrieval_ms, e.value * 2 AS pipeline_ms FROM r LEFT JOIN events e ON e.event_id = r.query_id)"""


def _results(s: SparkSession, d: str) -> DataFrame:
    h = vector.with_score(_hits(s, d))
    r = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_docs"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"), F.avg("score").alias("m"))
    ev = _t(s, d, "events").select(F.col("event_id").alias("query_id"), F.col("value").alias("retrieval_ms"))
    return r.join(ev, "query_id", "left").select("query_id", (F.col("query_id") % 7 != 0).alias("success"), "num_docs", "scores", "retrieval_ms", (F.col("retrieval_ms") * 2).alias("pipeline_ms"), F.col("m").alias("answer_relevance"), F.col("m").alias("context_relevance"))


@_query(f"""WITH {_RESULTS} SELECT count(*) AS queries, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failure_count, round(100.0 * count(*) FILTER (success) / count(*), 6) AS success_rate,
round((SELECT avg(s) FROM (SELECT unnest(scores) AS s FROM x WHERE success)), 6) AS avg_document_score, round(avg(scores[1]) FILTER (success), 6) AS avg_first_score, round(avg(m) FILTER (success), 6) AS avg_answer_relevance,
round((SELECT avg(v) FROM (SELECT retrieval_ms AS v FROM x WHERE success UNION ALL SELECT pipeline_ms FROM x WHERE success)), 6) AS avg_latency_ms FROM x""")
def eval_aggregate(s: SparkSession, d: str) -> DataFrame:
    a = evaluate.aggregate_eval(_results(s, d))
    return a.select("queries", "succeeded", "failure_count", *[F.round(c, 6).alias(c) for c in ("success_rate", "avg_document_score", "avg_first_score", "avg_answer_relevance", "avg_latency_ms")])


@_query(f"""WITH {_RESULTS} SELECT query_id, 'Query ' || query_id || ' [unknown] ' || CASE WHEN success THEN 'PASS' ELSE 'FAIL' END || chr(10) || '  Text: Unknown' || chr(10) || '  Relevance: ' || printf('%.3f', 0.0) || chr(10) || '  Latency: ' || printf('%.1f', coalesce(pipeline_ms, 0)) || 'ms' || chr(10) || '  Sources: ' || num_docs AS line FROM x""")
def eval_report_lines(s: SparkSession, d: str) -> DataFrame:
    return evaluate.report_lines(_results(s, d), "query_id", F.col("success"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0.0), F.col("pipeline_ms"), F.col("num_docs"))


_SPREAD = "count({x}) AS n, round(avg({x}), 6) AS mean, round(median({x}), 6) AS median, round({std}({x}), 6) AS std, round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS q1, round(quantile_cont({x}, 0.75), 6) AS q3, round(max({x}), 6) AS max"


@_query(f"SELECT event_type, {_SPREAD.format(x='value', std='stddev_samp')} FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_stats(s: SparkSession, d: str) -> DataFrame:
    v = evaluate.value_stats(_t(s, d, "events"), "value", ["event_type"])
    return v.select("event_type", "n", *[F.round(c, 6).alias(c) for c in v.columns[2:]])


@_query(f"WITH {_HITS.format(k=5)}, s AS (SELECT 1 / (1 + d2) AS score FROM h) SELECT {_SPREAD.format(x='score', std='stddev_pop')} FROM s")
def score_stats(s: SparkSession, d: str) -> DataFrame:
    v = evaluate.value_stats(vector.with_score(_hits(s, d)), "score", sample=False)
    return v.select("n", *[F.round(c, 6).alias(c) for c in v.columns[1:]])


@_query("WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 10)) + 1, 10)::INT AS bin, count(*) AS n FROM events, s WHERE value IS NOT NULL GROUP BY 1")
def latency_histogram(s: SparkSession, d: str) -> DataFrame:
    return evaluate.histogram(_t(s, d, "events"), "value", 10)


@_query(f"WITH {_HITS.format(k=5)}, sc AS (SELECT 1 / (1 + d2) AS score FROM h), s AS (SELECT min(score) AS lo, max(score) AS hi FROM sc) SELECT least(floor((score - lo) / ((hi - lo) / 20)) + 1, 20)::INT AS bin, count(*) AS n FROM sc, s GROUP BY 1")
def score_histogram(s: SparkSession, d: str) -> DataFrame:
    return evaluate.histogram(vector.with_score(_hits(s, d)), "score", 20)


@_query("SELECT event_id, round(avg(value) OVER w, 9) AS rolling, count(value) OVER w AS held FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_latency(s: SparkSession, d: str) -> DataFrame:
    """Mean of the last 100 successful latencies of each service at every request."""
    r = evaluate.rolling_mean(_t(s, d, "events").filter("event_type <> 'error'"), ["event_type"], ["ts", "event_id"], "value")
    return r.select("event_id", F.round("rolling", 9).alias("rolling"), "held")


_HEALTH = """h AS (SELECT {by} count(*) AS total_requests, count(*) FILTER (event_type <> 'error') AS success_count, count(*) FILTER (event_type = 'error') AS error_count,
coalesce(avg(value) FILTER (event_type <> 'error'), 0) AS avg_latency_ms, coalesce(min(value) FILTER (event_type <> 'error'), 0) AS min_latency_ms, coalesce(max(value) FILTER (event_type <> 'error'), 0) AS max_latency_ms FROM events {group})"""


def _requests(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "events").select("ts", "user_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))


@_query(f"WITH {_HEALTH.format(by='', group='')} SELECT total_requests, success_count, error_count, round(100.0 * success_count / total_requests, 6) AS success_rate, round(avg_latency_ms, 6) AS avg_latency_ms, min_latency_ms, max_latency_ms, success_count > 0 AS api_healthy FROM h")
def health_stats(s: SparkSession, d: str) -> DataFrame:
    h = evaluate.health(_requests(s, d))
    return h.select("total_requests", "success_count", "error_count", F.round("success_rate", 6).alias("success_rate"), F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "min_latency_ms", "max_latency_ms", "api_healthy")


@_query(f"""WITH {_HEALTH.format(by='user_id,', group='GROUP BY user_id')} SELECT user_id, array_to_string(list_filter([CASE WHEN success_count = 0 THEN 'api_down' END, CASE WHEN 100.0 * success_count / total_requests < 95 THEN 'low_success_rate' END, CASE WHEN avg_latency_ms > 3000 THEN 'high_latency' END, CASE WHEN error_count > 5 THEN 'many_errors' END, CASE WHEN NOT (success_count = 0 OR 100.0 * success_count / total_requests < 95 OR avg_latency_ms > 3000 OR error_count > 5) THEN 'none' END], lambda x: x IS NOT NULL), ',') AS alerts FROM h""")
def health_alerts(s: SparkSession, d: str) -> DataFrame:
    return evaluate.alerts(evaluate.health(_requests(s, d), ["user_id"])).select("user_id", F.array_join("alerts", ",").alias("alerts"))


@_query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS requests, round(avg(value), 9) AS avg_latency_ms FROM events GROUP BY ALL")
def hourly_requests(s: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of one hour for each service."""
    w = _t(s, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("value"), 9).alias("avg_latency_ms"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "requests", "avg_latency_ms")


@_query("""
WITH a AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS requests FROM b GROUP BY user_id, k""")
def user_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, apart by half an hour without requests."""
    w = _t(s, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "requests")


@_query("SELECT coalesce(event_type, 'all') AS event_type, coalesce((user_id % 10)::VARCHAR, 'all') AS bucket, count(*) AS requests, grouping(event_type)::INT * 2 + grouping(user_id % 10)::INT AS level FROM events GROUP BY CUBE (event_type, user_id % 10)")
def request_cube(s: SparkSession, d: str) -> DataFrame:
    """Counts by service and user bucket with all subtotals."""
    e = _t(s, d, "events").withColumn("bucket", F.col("user_id") % 10)
    c = e.cube("event_type", "bucket").agg(F.count(F.lit(1)).alias("requests"), F.grouping_id().cast("int").alias("level"))
    return c.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce(F.col("bucket").cast("string"), F.lit("all")).alias("bucket"), "requests", "level")


@_query(f"WITH {PAGES} SELECT sum(metadata.word_count)::BIGINT AS words, count(metadata.word_count) AS counted, count(*) - count(metadata.word_count) AS skipped FROM pg")
def word_count_sum(s: SparkSession, d: str) -> DataFrame:
    w = F.col("metadata.word_count")
    return _pages(s, d).agg(F.sum(w).alias("words"), F.count(w).alias("counted"), F.count_if(w.isNull()).alias("skipped"))


@_query(f"WITH {PAGES}, a AS (SELECT count(*) AS files, sum(length(content))::BIGINT AS chars, sum(coalesce(len(chunks), 0))::BIGINT AS chunks, sum(metadata.word_count)::BIGINT AS stated_words, count(*) - count(metadata.word_count) AS without_word_count FROM pg) SELECT *, floor(chars / 5)::BIGINT AS estimated_words, floor(chars / chunks)::BIGINT AS avg_chunk_chars FROM a")
def corpus_report(s: SparkSession, d: str) -> DataFrame:
    return evaluate.corpus_report(_pages(s, d).select("content", "chunks", "metadata.word_count"))


@_query(f"WITH {RECORDS} SELECT count(*) AS records, sum(length(text))::BIGINT AS chars, count(DISTINCT coalesce(metadata.source_url, 'Unknown')) AS sources, round(sum(length(text)) / count(*), 6) AS avg_chars FROM rec")
def records_report(s: SparkSession, d: str) -> DataFrame:
    r = evaluate.records_report(_records(s, d).select("text", "metadata.source_url"))
    return r.withColumn("avg_chars", F.round("avg_chars", 6))


@_query(f"WITH {PAGES} SELECT count(*) AS pages, count(*) FILTER (lower(metadata.status) = 'success') AS succeeded, count(*) - count(*) FILTER (lower(metadata.status) = 'success') AS failed, sum(metadata.word_count) FILTER (lower(metadata.status) = 'success')::BIGINT AS words, sum(length(content)) FILTER (lower(metadata.status) = 'success')::BIGINT AS chars, round(100.0 * count(*) FILTER (lower(metadata.status) = 'success') / count(*), 6) AS success_rate FROM pg")
def scrape_report(s: SparkSession, d: str) -> DataFrame:
    r = evaluate.scrape_report(_pages(s, d).select("metadata.status", "metadata.word_count", "content"))
    return r.withColumn("success_rate", F.round("success_rate", 6))


@_query("WITH r AS (SELECT run_id, coalesce(total_documents, 0) AS n, coalesce(total_characters, 0) AS c, greatest(coalesce(duration_seconds, 0), 1e-8) AS s FROM run_reports) SELECT run_id, n AS documents, c AS characters, round(coalesce(c / nullif(n, 0), 0), 6) AS avg_chars, round(n / s, 6) AS docs_per_sec, round(c / s, 6) AS chars_per_sec FROM r")
def embed_report(s: SparkSession, d: str) -> DataFrame:
    return evaluate.embed_report(_t(s, d, "run_reports"))


# --- general relational operators ----------------------------------------------------------------------------------


@_query(f"WITH {PAGES} SELECT page_id, length(array_to_string(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '')) > 120 AS kept FROM pg")
def content_filter(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", crawl.has_content(F.col("content")).alias("kept"))


@_query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT event_id, l.user_id, l.ts, r.value AS value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def last_error(s: SparkSession, d: str) -> DataFrame:
    """As-of join: the value of each user's latest error at every other event."""
    e = _t(s, d, "events")
    return joins.asof_join(e.filter("event_type <> 'error'").select("event_id", "user_id", "ts"), e.filter("event_type = 'error'").select("user_id", "ts", "value"), "user_id", "ts", "value")


@_query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 10")
def price_spans(s: SparkSession, d: str) -> DataFrame:
    """Interval join: parts whose price lies within 10 above a supplier's balance."""
    spans = _t(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 10).alias("hi"))
    return joins.interval_join(_t(s, d, "part").select("p_partkey", "p_retailprice"), spans, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "s_suppkey")


@_query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS quantity, grouping(l_returnflag)::INT * 2 + grouping(l_linestatus)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def quantity_rollup(s: SparkSession, d: str) -> DataFrame:
    """Roll-up with decimal sums."""
    l = _t(s, d, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return l.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.grouping_id().cast("int").alias("level"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def dearest_orders(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@_query("SELECT l_partkey AS part FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def large_parts_sold(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "lineitem").select(F.col("l_partkey").alias("part")).intersect(_t(s, d, "part").filter("p_size > 25").select("p_partkey"))


@_query("SELECT c_mktsegment AS segment, abs(count(DISTINCT c_custkey) - count(DISTINCT c_custkey)) = 0 AS close FROM customer GROUP BY c_mktsegment")
def approximate_customers(s: SparkSession, d: str) -> DataFrame:
    """Whether the approximate number of customers of a segment is within a tenth of the exact one."""
    by = _t(s, d, "customer").groupBy(F.col("c_mktsegment").alias("segment"))
    both = by.agg(F.approx_count_distinct("c_custkey", 0.02).alias("about"), F.count_distinct("c_custkey").alias("exact"))
    return both.select("segment", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


@_query("SELECT run_id, k AS name, outputs[k] AS value FROM (SELECT run_id, outputs, unnest(map_keys(outputs)) AS k FROM run_reports)")
def run_outputs(s: SparkSession, d: str) -> DataFrame:
    """The entries of a map column."""
    return _t(s, d, "run_reports").select("run_id", F.explode("outputs").alias("name", "value"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
