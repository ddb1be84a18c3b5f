"""Vector search, diagnostics, answers, evaluation and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.operators import answers, evaluate, vector
from corpusloom.streaming import monitor


@pytest.fixture(scope="module")
def stock(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(100, None), (101, [1.0])]
    return spark.createDataFrame(rows, "vector_id bigint, embedding array<float>"), x.astype(float)


def test_knn_equals_brute_force(spark, stock):
    df, x = stock
    q = df.filter("vector_id < 9").withColumnRenamed("vector_id", "query_id")
    got = {}
    for r in vector.knn(q, df, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vector_id, r.d2)
    for i in range(9):
        d2 = ((x - x[i]) ** 2).sum(1)
        want = sorted(range(60), key=lambda j: (d2[j], j))[:4]
        assert [got[i][k + 1][0] for k in range(4)] == want
    assert got[7][1][0] == 3 and got[3][1] == (3, 0.0)
    assert vector.knn(q, df, 1000).filter("query_id = 1").count() == 60
    assert vector.knn(q.limit(0), df, 3).count() == 0 and vector.knn(q, df.limit(0), 3).count() == 0
    s = vector.with_score(vector.knn(q, df, 1)).first()
    assert s.score == 1.0


def test_encoder(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.embedding for r in vector.encode(df, "text").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6) and not any(got[2]) and not any(got[3])


def test_diagnostics(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [float("nan"), 1.0]), (4, None), (5, [0.0, 0.0])], "v bigint, embedding array<float>")
    n = vector.norm_stats(df).first()
    assert (n.vectors, n.min_norm, n.max_norm) == (3, 0.0, 1.0)
    assert {r.dim: r.dead for r in vector.dim_variance(df).collect()} == {0: False, 1: False}
    c = vector.cosine_pairs(df, "v").first()
    assert c.pairs > 0 and c.max_cos == 0.0
    assert vector.cosine_pairs(df.limit(0), "v").first().pairs == 0
    assert df.filter("v = 3").select(S.nonfinite(F.col("embedding"))).first()[0] == 1


@pytest.mark.parametrize("reply,want", [
    ('x ```json\n{"is_grounded": false, "confidence": 0.2, "issues": ["i"], "suggestions": "s"}\n``` y', (False, 0.2, ["i"], "s", True)),
    ('```\n{"is_grounded": true, "confidence": 1.0}\n```', (True, 1.0, None, None, True)),
    ('{"is_grounded": true, "confidence": 0.7, "issues": []}', (True, 0.7, [], None, True)),
    ("nope", (True, 0.5, [], "nope", False)),
    ("", (True, 0.5, [], "", False)),
])
def test_verification(spark, reply, want):
    v = spark.createDataFrame([(reply,)], "r string").select(answers.verification(F.col("r")).alias("v")).first().v
    assert (v.is_grounded, v.confidence, v.issues, v.suggestions, v.parse_ok) == want


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "1", "A", "Cards cost ten units. The branch opens at nine."), (2, "2", None, "Savings accounts pay profit monthly.")], "vector_id bigint, id string, source string, content string")
    v = vector.encode(docs, "content").select("vector_id", "embedding")
    q = spark.createDataFrame([(1, "what do cards cost"), (2, "  "), (3, None)], "query_id bigint, query string")
    got = {r.query_id: r for r in answers.answer(q, v, docs, top_k=5).collect()}
    assert got[1].status == "success" and "Cards cost ten units." in got[1].answer and got[1].verification.is_grounded
    assert [d.source for d in got[1].context if d.id == "2"] == ["Unknown"] and len(got[1].context) == 2
    assert got[2].status == got[3].status == "invalid" and got[2].answer is None
    empty = answers.answer(q, v.limit(0), docs, correct=False).filter("query_id = 1").first()
    assert empty.answer == answers.NO_CONTEXT and empty.verification is None

    def broken(*_):
        raise RuntimeError("boom")

    assert answers.answer(q, v, docs, model=broken).filter("query_id = 1").first().answer == "Error generating response: boom"


def test_evaluation(spark):
    ev = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)] + [(None,)], "value double")
    s = evaluate.value_stats(ev, "value").first()
    assert (s.n, s.mean, s.median, s.q1, s.q3) == (5, 4.0, 3.0, 2.0, 4.0) and s.std == pytest.approx(np.std([1, 2, 3, 4, 10], ddof=1))
    assert {r.bin: r.n for r in evaluate.histogram(ev, "value", 10).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 1}
    assert evaluate.histogram(ev.limit(0), "value").count() == 0
    assert [(r.bin, r.n) for r in evaluate.histogram(ev.filter("value = 1"), "value").collect()] == [(1, 1)]
    rq = spark.createDataFrame([(True, 10.0), (False, 1.0), (None, 2.0)], "ok boolean, latency_ms double")
    h = evaluate.health(rq).first()
    assert (h.total_requests, h.success_count, h.error_count, h.avg_latency_ms) == (3, 1, 2, 10.0)
    assert evaluate.alerts(evaluate.health(rq)).first().alerts == ["low_success_rate"]
    e = evaluate.alerts(evaluate.health(rq.limit(0))).first()
    assert e.success_rate == 0 and e.alerts == ["api_down", "low_success_rate"]
    one = spark.createDataFrame([(1, False, 1, [0.5], 1.0, 2.0, 0.1, 0.1)], "q int, success boolean, num_docs int, scores array<double>, retrieval_ms double, pipeline_ms double, answer_relevance double, context_relevance double")
    assert evaluate.aggregate_eval(one).count() == 0
    good = evaluate.aggregate_eval(one.withColumn("success", F.lit(True))).first()
    assert (good.success_rate, good.avg_document_score, good.avg_latency_ms) == (100.0, 0.5, 1.5)
    p = spark.createDataFrame([(1, "x" * 160, [("a",)], 0.45, [0.2, 0.4])], "query_id int, answer string, docs array<struct<c:string>>, answer_relevance double, context_relevance array<double>")
    r = evaluate.pipeline_eval(p).first()
    assert (len(r.preview), r.has_context, r.has_specific_info, r.is_coherent) == (153, False, True, True) and r.avg_context_relevance == pytest.approx(0.3)


def test_streams(spark, tmp_path):
    src = spark.sql("select timestamp'2025-01-01 00:00:00' + make_dt_interval(0,0,0,id) as ts, id % 3 as user_id, 'svc' as service, id % 5 <> 0 as ok, cast(id as double) as latency_ms from range(200)")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("h", monitor.windowed_health(stream, "1 minute"), "complete"), ("s", monitor.sessions(stream), "complete"), ("r", monitor.rolling(stream), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{name}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select sum(total_requests) from h").first()[0] == 200
    assert spark.sql("select count(*), sum(requests) from s").first()[:] == (3, 200)
    r = spark.sql("select * from r").first()
    good = [float(i) for i in range(200) if i % 5][-100:]
    assert r.n == 100 and r.rolling_ms == pytest.approx(sum(good) / 100)
