"""Contexts, prompts, pluggable generation and verification, and the whole question pipeline."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import stats as S
from corpusloom.operators import vector

# The wording of contexts, prompts and stand-in answers.
CONTEXT_HEAD = "## Relevant Context\n\n"
AVAILABLE_HEAD = "## Available Context:\n\n"
NO_CONTEXT = "No relevant context found. Unable to generate a response."
GENERATION_ERROR = "Error generating response: "
VERIFICATION_FAILED = "Verification failed. Please try again."
REPLY = "is_grounded boolean, confidence double, issues array<string>, suggestions string"
Generate = Callable[[list[str], list[str], list[list[str]]], list[str]]


def context(docs: Column) -> Column:
    """The generator's context of an ordered array of (source, content)."""
    part = lambda d, i: F.concat(F.lit("### Source "), (i + 1).cast("string"), F.lit(": "), F.coalesce(d["source"], F.lit("Unknown")), F.lit("\nContent: "), F.coalesce(d["content"], F.lit("")), F.lit("\n\n"))
    return F.concat(F.lit(CONTEXT_HEAD), F.array_join(F.transform(docs, part), ""))


def verifier_context(docs: Column) -> Column:
    """The verifier's context: 200 characters of each document, always with an ellipsis."""
    part = lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), F.left(F.coalesce(d["content"], F.lit("")), F.lit(200)), F.lit("...\n"))
    return F.concat(F.lit(AVAILABLE_HEAD), F.array_join(F.transform(docs, part), ""))


def prompt(query: Column, ctx: Column) -> Column:
    return F.concat(ctx, F.lit("\n\n## User Question:\n"), query, F.lit("\n\n## Answer:\nBased on the provided context, here's my answer:"))


def reply_json(text: Column) -> Column:
    """What stands in the first ```json fence, else in the first fence, else all of a reply."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    fenced = lambda mark: strip(F.get(F.split(F.get(F.split(text, mark), F.lit(1)), "```"), F.lit(0)))
    return F.when(text.contains("```json"), fenced("```json")).when(text.contains("```"), fenced("```")).otherwise(text)


def verification(reply: Column) -> Column:
    """The parsed verdict with parse_ok; a reply that is no JSON object counts as grounded at 0.5 with the reply as suggestion. Null stays null."""
    j = reply_json(reply)
    ok = F.coalesce(F.try_parse_json(j).isNotNull() & F.ltrim(j).startswith("{"), F.lit(False))
    v = F.from_json(j, REPLY)
    return F.when(reply.isNull(), F.lit(None)).otherwise(F.struct(
        F.when(ok, v["is_grounded"]).otherwise(F.lit(True)).alias("is_grounded"), F.when(ok, v["confidence"]).otherwise(F.lit(0.5)).alias("confidence"),
        F.when(ok, v["issues"]).otherwise(F.array().cast("array<string>")).alias("issues"), F.when(ok, v["suggestions"]).otherwise(reply).alias("suggestions"), ok.alias("parse_ok"),
    ))


def retrieved(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """(query_id, docs): per query the ordered documents (rank, id, source, content, score); `metadata` is (vector_id, id, source, content)."""
    d = hits.join(metadata, "vector_id").select("query_id", F.struct("rank", F.coalesce("id", F.lit("0")).alias("id"), F.coalesce("source", F.lit("Unknown")).alias("source"), F.coalesce("content", F.lit("")).alias("content"), "score").alias("d"))
    return d.groupBy("query_id").agg(F.array_sort(F.collect_list("d")).alias("docs"))  # at most k a query


def extractive(queries: list[str], prompts: list[str], contents: list[list[str]]) -> list[str]:
    """The offline generator: the three sentences of the context that share most words with the question, in their order."""
    out = []
    for q, docs in zip(queries, contents):
        want = set(re.findall(r"\w+", q.lower()))
        s = [x for d in docs for x in re.split(r"(?<=[.!?])\s+", d) if x.strip()]
        top = sorted(sorted(range(len(s)), key=lambda i: (-len(want & set(re.findall(r"\w+", s[i].lower()))), i))[:3])
        out.append(" ".join(s[i] for i in top))
    return out


def generate(df: DataFrame, model: Generate | None = None) -> DataFrame:
    """df (query, docs, prompt) with `answer`: fixed sentence without documents, an error becomes the answer's text."""
    run_model = model or extractive

    @F.pandas_udf(StringType())
    def run(q: pd.Series, p: pd.Series, c: pd.Series) -> pd.Series:
        try:
            return pd.Series(run_model(q.fillna("").tolist(), p.fillna("").tolist(), [list(x) if x is not None else [] for x in c]))
        except Exception as e:  # a failing model answers with its error
            return pd.Series([GENERATION_ERROR + str(e)] * len(q))

    none = F.coalesce(F.size("docs"), F.lit(0)) <= 0
    return df.withColumn("answer", F.when(none, F.lit(NO_CONTEXT)).otherwise(run("query", "prompt", F.transform("docs", lambda d: d["content"]))))


def lexical_verdict(df: DataFrame) -> DataFrame:
    """df (docs, answer) with `reply`: the offline verifier, the share of the answer's words that the documents hold, as a JSON reply."""
    split = lambda c: F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "")
    have = split(F.array_join(F.transform("docs", lambda d: d["content"]), " "))
    w = F.array_distinct(split(F.col("answer")))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(w, have)), F.size(w)), F.lit(0.0))
    lost = F.slice(F.array_except(w, have), 1, 5)
    return df.withColumn("reply", F.to_json(F.struct((share >= 0.5).alias("is_grounded"), F.round(share, 6).alias("confidence"), lost.alias("issues"), F.lit("").alias("suggestions"))))


def answer(questions: DataFrame, vectors: DataFrame, metadata: DataFrame, top_k: int = 5, correct: bool = True, encoder: vector.Encoder | None = None, model: Generate | None = None) -> DataFrame:
    """(query_id, query, answer, context, verification, status): retrieve, generate and, if asked, verify; one plan for all questions.

    Blank questions are rejected: they come back with status `invalid` and no answer.
    """
    blank = F.coalesce(F.trim("query") == "", F.lit(True))
    good = questions.filter(~blank)
    hits = vector.with_score(vector.knn(vector.encode(good, "query", encoder), vectors, top_k))
    docs = retrieved(hits, metadata)
    q = good.select("query_id", "query").join(docs, "query_id", "left")
    empty = F.array().cast(docs.schema["docs"].dataType)
    q = q.withColumn("docs", F.coalesce("docs", empty)).withColumn("prompt", prompt(F.col("query"), context(F.col("docs"))))
    a = generate(q, model)
    v = verification(F.col("reply")) if correct else None
    a = lexical_verdict(a) if correct else a
    done = a.select("query_id", "query", "answer", F.col("docs").alias("context"), (v if correct else F.lit(None).cast(f"struct<{REPLY.replace(' ', ':').replace(',:', ',')},parse_ok:boolean>")).alias("verification"), F.lit("success").alias("status"))
    bad = questions.filter(blank).select("query_id", "query", *[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in ("answer", "context", "verification")], F.lit("invalid").alias("status"))
    return done.unionByName(bad)
