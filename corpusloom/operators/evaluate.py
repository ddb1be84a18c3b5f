"""Evaluation, reports, latency statistics, health and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import text as T
from corpusloom.operators import vector

# Words that count as action words; limits of the alerts.
ACTION_WORDS = ("can", "offer", "provide", "include", "available")
LEAST_SUCCESS, MOST_LATENCY, MOST_ERRORS = 95.0, 3000.0, 5


def retrieval_eval(hits: DataFrame) -> DataFrame:
    """Per query of (query_id, vector_id, score, rank): documents, first, mean and last score."""
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_docs"), F.min_by("score", "rank").alias("top_score"), F.avg("score").alias("avg_score"), F.max_by("score", "rank").alias("min_score"))


def answer_eval(df: DataFrame, key: str, answer: str) -> DataFrame:
    """Per answer: preview, words, whether it has figures or action words; a null answer counts as empty."""
    a = F.coalesce(F.col(answer), F.lit(""))
    low = F.lower(a)
    return df.select(key, T.preview(a, 200).alias("preview"), T.word_count(a).alias("answer_words"), a.rlike(r"\p{Nd}").alias("has_numbers"), F.exists(F.array(*map(F.lit, ACTION_WORDS)), lambda w: F.contains(low, w)).alias("has_action_words"))


def relevance(answered: DataFrame, encoder: vector.Encoder | None = None, most: int = 500) -> DataFrame:
    """Answers (query_id, query, answer, context) with answer_relevance and context_relevance: cosines of the question with the
    answer and with the first `most` characters of each document, in order; zero vectors give 0."""
    q = vector.encode(vector.encode(answered, "query", encoder, out="_q"), "answer", encoder, out="_a")
    each = q.select("query_id", "_q", F.posexplode("context").alias("_i", "_d")).withColumn("_t", F.left("_d.content", F.lit(most)))
    each = vector.encode(each, "_t", encoder, out="_c").select("query_id", F.struct("_i", S.cosine(F.col("_q"), F.col("_c")).alias("c")).alias("_x"))
    lists = each.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["c"]).alias("context_relevance"))  # at most k a query
    out = q.withColumn("answer_relevance", S.cosine(F.col("_q"), F.col("_a"))).drop("_q", "_a").join(lists, "query_id", "left")
    return out.withColumn("context_relevance", F.coalesce("context_relevance", F.array().cast("array<double>")))


def pipeline_eval(df: DataFrame) -> DataFrame:
    """Answers (query_id, answer, docs, answer_relevance, context_relevance) with preview, sizes and quality flags."""
    r = F.coalesce("answer_relevance", F.lit(0.0))
    mean = F.coalesce(F.try_divide(F.aggregate("context_relevance", F.lit(0.0), lambda a, x: a + x), F.size("context_relevance")), F.lit(0.0))
    return df.select("query_id", T.preview(F.col("answer"), 150).alias("preview"), T.word_count(F.col("answer")).alias("answer_words"), F.size("docs").alias("num_sources"), r.alias("answer_relevance"), mean.alias("avg_context_relevance"), (r > 0.5).alias("has_context"), (F.length("answer") > 100).alias("has_specific_info"), (r > 0.4).alias("is_coherent"))


def aggregate_eval(results: DataFrame) -> DataFrame:
    """One row over (success, num_docs, scores, retrieval_ms, pipeline_ms, answer_relevance, context_relevance); none if nothing succeeded.

    avg_document_score is the mean over all documents, avg_first_score that of the first ones; latencies pool both steps.
    """
    ok = F.coalesce(F.col("success"), F.lit(False))
    of = lambda c: F.when(ok, c)
    scores = F.coalesce(F.col("scores"), F.array().cast("array<double>"))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    r, p = of(F.col("retrieval_ms")), of(F.col("pipeline_ms"))
    one = results.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(ok).alias("succeeded"),
        F.coalesce(F.try_divide(F.sum(of(total)), F.sum(of(F.size(scores)))), F.lit(0.0)).alias("avg_document_score"), F.avg(of(F.get(scores, F.lit(0)))).alias("avg_first_score"),
        F.avg(of(F.col("num_docs"))).alias("avg_documents"), F.avg(of(F.col("answer_relevance"))).alias("avg_answer_relevance"), F.avg(of(F.col("context_relevance"))).alias("avg_context_relevance"),
        F.try_divide(F.coalesce(F.sum(r), F.lit(0.0)) + F.coalesce(F.sum(p), F.lit(0.0)), F.count(r) + F.count(p)).alias("avg_latency_ms"),
        F.least(F.min(r), F.min(p)).alias("min_latency_ms"), F.greatest(F.max(r), F.max(p)).alias("max_latency_ms"),
    )
    return one.filter("succeeded > 0").withColumn("success_rate", 100.0 * F.col("succeeded") / F.col("queries")).withColumn("failure_count", F.col("queries") - F.col("succeeded"))


def value_stats(df: DataFrame, column: str, by: list[str] | None = None, sample: bool = True) -> DataFrame:
    """count, mean, median, std, min, q1, q3, max; nulls are left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(*(by or [])).agg(F.count(column).alias("n"), *S.spread(F.col(column), sample))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n): equal-width bins from the least to the largest value, the last one closed; nulls are left out, one value is one bin."""
    x = F.col(column).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if span.lo is None:
        return df.limit(0).select(F.lit(1).alias("bin"), F.lit(0).cast("bigint").alias("n"))
    b = F.lit(1) if span.lo == span.hi else F.least(F.width_bucket(x, F.lit(span.lo), F.lit(span.hi), F.lit(bins)), F.lit(bins))
    return df.filter(x.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rolling_mean(df: DataFrame, key: list[str], order: list[str], column: str, width: int = 100) -> DataFrame:
    """df with the mean of the last `width` values of each key in order."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(width - 1), 0)
    return df.withColumn("rolling", F.avg(column).over(w)).withColumn("held", F.count(column).over(w))


def health(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(total, success_count, error_count, success_rate, avg/min/max latency, api_healthy) of (ok, latency_ms); the rate is 0 without requests."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    ms = F.when(ok, F.col("latency_ms"))
    h = requests.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("error_count"), F.coalesce(F.avg(ms), F.lit(0.0)).alias("avg_latency_ms"), F.coalesce(F.min(ms), F.lit(0.0)).alias("min_latency_ms"), F.coalesce(F.max(ms), F.lit(0.0)).alias("max_latency_ms"))
    return h.withColumn("success_rate", F.coalesce(F.try_divide(100.0 * F.col("success_count"), F.col("total_requests")), F.lit(0.0))).withColumn("api_healthy", F.col("success_count") > 0)


def alerts(h: DataFrame) -> DataFrame:
    """The health rows with their alerts."""
    say = lambda when, text: F.when(when, F.lit(text))
    found = F.array_compact(F.array(say(~F.col("api_healthy"), "api_down"), say(F.col("success_rate") < LEAST_SUCCESS, "low_success_rate"), say(F.col("avg_latency_ms") > MOST_LATENCY, "high_latency"), say(F.col("error_count") > MOST_ERRORS, "many_errors")))
    return h.withColumn("alerts", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none"))))


def report_lines(df: DataFrame, key: str, success: Column, query: Column, category: Column, relevance: Column, latency: Column, sources: Column) -> DataFrame:
    """(key, line): the text-report entry of each query."""
    c = F.coalesce(category, F.lit("unknown"))
    line = F.concat(F.lit("Query "), F.col(key).cast("string"), F.lit(" ["), c, F.lit("] "), F.when(success, "PASS").otherwise("FAIL"), F.lit("\n  Text: "), F.coalesce(query, F.lit("Unknown")), F.lit("\n  Relevance: "), F.format_string("%.3f", F.coalesce(relevance, F.lit(0.0))), F.lit("\n  Latency: "), F.format_string("%.1f", F.coalesce(latency, F.lit(0.0))), F.lit("ms\n  Sources: "), F.coalesce(sources, F.lit(0)).cast("string"))
    return df.select(key, line.alias("line"))


# --- corpus reports ------------------------------------------------------------------------------------------------


def corpus_report(pages: DataFrame) -> DataFrame:
    """One row over (content, chunks, word_count): files, characters, chunks, estimated and stated words, mean chunk size (null without chunks)."""
    n = F.coalesce(F.size("chunks"), F.lit(0))
    a = pages.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(n > 0, n).otherwise(0)), F.lit(0)).alias("chunks"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("stated_words"), F.count_if(F.col("word_count").isNull()).alias("without_word_count"))
    return a.withColumn("estimated_words", F.floor(F.col("chars") / 5)).withColumn("avg_chunk_chars", F.floor(F.try_divide("chars", "chunks")))


def records_report(records: DataFrame) -> DataFrame:
    """One row over (text, source_url): records, characters, distinct sources (a missing one is one), mean size."""
    a = records.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_distinct(F.coalesce("source_url", F.lit("Unknown"))).alias("sources"))
    return a.withColumn("avg_chars", F.coalesce(F.try_divide("chars", "records"), F.lit(0.0)))


def scrape_report(pages: DataFrame) -> DataFrame:
    """One row over (status, word_count, content): successes and failures, rate, words and characters of the successes."""
    ok = F.lower(F.coalesce("status", F.lit(""))) == "success"
    a = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("word_count"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(ok, F.length("content"))), F.lit(0)).alias("chars"))
    return a.withColumn("success_rate", F.coalesce(F.try_divide(100.0 * F.col("succeeded"), F.col("pages")), F.lit(0.0)))


def embed_report(runs: DataFrame) -> DataFrame:
    """Per run: characters a document, documents and characters a second; the duration is at least 1e-8."""
    d = F.greatest(F.coalesce("duration_seconds", F.lit(0.0)), F.lit(1e-8))
    n = F.coalesce("total_documents", F.lit(0))
    c = F.coalesce("total_characters", F.lit(0))
    return runs.select("run_id", n.alias("documents"), c.alias("characters"), F.round(F.coalesce(F.try_divide(c, n), F.lit(0.0)), 6).alias("avg_chars"), F.round(n / d, 6).alias("docs_per_sec"), F.round(c / d, 6).alias("chars_per_sec"))
