"""Exact vector search, encoders and embedding diagnostics."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusloom.functions import stats as S
from corpusloom.session import cut

BLOCK = 4096  #: queries of one broadcast block


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def knn(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vector_id") -> DataFrame:
    """(query_id, vector_id, d2, rank): the k nearest vectors of every query by squared distance, ties to the smaller id.

    Queries go out in bounded blocks; each partition of vectors keeps its own k best in numpy, so only k rows for each query
    and partition are shuffled. Null vectors and lengths other than the query's take no part; fewer than k vectors give as many.
    """
    spark = vectors.sparkSession
    good = queries.filter(F.col(query_id).isNotNull() & F.col("embedding").isNotNull()).select(F.col(query_id).cast("bigint").alias("q"), S.doubles(F.col("embedding")).alias("e"))
    stock = vectors.filter(F.col(vector_id).isNotNull() & F.col("embedding").isNotNull()).select(F.col(vector_id).cast("bigint").alias("v"), "embedding")
    good, stock = cut(good), cut(stock)  # read once for each block
    n = good.count()
    blocks = max(1, -(-n // BLOCK))
    parts = []
    for i in range(blocks):
        mine = good if blocks == 1 else good.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)
        rows = [(r.q, r.e) for r in mine.toLocalIterator()]  # one bounded block
        shared = spark.sparkContext.broadcast(rows)

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for d in {len(e) for _, e in shared.value}:
                some = [(q, e) for q, e in shared.value if len(e) == d]
                by_dim[d] = (np.array([q for q, _ in some], np.int64), np.array([e for _, e in some], np.float64))
            best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for b in batches:
                sizes = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                for d, (qid, q) in by_dim.items():
                    at = np.flatnonzero(sizes == d)
                    for lo in range(0, len(at), 2048):
                        part = pa.array(at[lo : lo + 2048])
                        ids, x = b.column(0).take(part).to_numpy(), _matrix(b.column(1).take(part))
                        for s in range(0, len(q), 256):
                            rough = (q[s : s + 256] ** 2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q[s : s + 256] @ x.T
                            m = min(k, len(ids))
                            edge = np.partition(rough, m - 1, axis=1)[:, m - 1]
                            i, j = np.nonzero(rough <= (edge + 1e-9 * (1 + np.abs(edge)))[:, None])
                            d2 = ((q[s + i] - x[j]) ** 2).sum(1)
                            o = best.get(d, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)))
                            qs, vs, ds = np.r_[o[0], s + i], np.r_[o[1], ids[j]], np.r_[o[2], d2]
                            order = np.lexsort((vs, ds, qs))
                            qs, vs, ds = qs[order], vs[order], ds[order]
                            first = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]])
                            rank = np.arange(len(qs)) - np.repeat(first, np.diff(np.r_[first, len(qs)]))
                            best[d] = (qs[rank < k], vs[rank < k], ds[rank < k])
            for d, (qs, vs, ds) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(by_dim[d][0][qs]), pa.array(vs), pa.array(ds)], ["q", "v", "d2"])

        parts.append(stock.mapInArrow(nearest, "q bigint, v bigint, d2 double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d2", "v"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("v").alias(vector_id), "d2", "rank")


def with_score(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", S.score_of(F.col("d2")))


def rerank(hits: DataFrame, score: Column, least: float = 0.0) -> DataFrame:
    """Hits re-ranked inside their query by another score, those below `least` left out; off unless called."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rescore"), "vector_id")
    return hits.withColumn("rescore", score).filter(F.col("rescore") >= least).withColumn("rank", F.row_number().over(w))


# --- encoders ------------------------------------------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]
_WORD = re.compile(r"\w+")


def hashing_encoder(dim: int = 256) -> Encoder:
    """A deterministic offline encoder: signed hashes of lower-cased words and word pairs, square-root counts."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        cache: dict[str, tuple[int, float]] = {}
        for i, t in enumerate(texts):
            w = _WORD.findall((t or "").lower())
            for g in [*w, *map(" ".join, zip(w, w[1:]))]:
                if g not in cache:
                    h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                    cache[g] = (h % dim, 1.0 if h >> 63 else -1.0)
                slot, sign = cache[g]
                out[i, slot] += sign
        return np.sign(out) * np.sqrt(np.abs(out))

    return encode


def encode(df: DataFrame, text: str, encoder: Encoder | None = None, normalize: bool = True, batch: int = 128, out: str = "embedding") -> DataFrame:
    """df with the vectors of its texts, in batches on the executors; null texts count as empty, empty texts get zeros."""
    model = encoder or hashing_encoder()

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            rows = []
            values = s.fillna("").tolist()
            for lo in range(0, len(values), batch):
                m = np.asarray(model(values[lo : lo + batch]), np.float32)
                if normalize:
                    n = np.linalg.norm(m, axis=1, keepdims=True)
                    m = m / np.where(n > 0, n, 1)
                rows += [x.tolist() for x in m]
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, run(F.col(text)))


# --- diagnostics ---------------------------------------------------------------------------------------------------


def norm_stats(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """min, p01, mean, p99, max of the norms (exact, linear quantiles); non-finite vectors are left out."""
    n = vectors.filter(F.col("embedding").isNotNull() & (S.nonfinite(F.col("embedding")) == 0)).withColumn("norm", S.norm(F.col("embedding")))
    x = F.col("norm")
    return n.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("vectors"), F.min(x).alias("min_norm"), F.percentile(x, F.lit(0.01)).alias("p01_norm"), F.avg(x).alias("mean_norm"), F.percentile(x, F.lit(0.99)).alias("p99_norm"), F.max(x).alias("max_norm"))


def dim_variance(vectors: DataFrame, by: list[str] | None = None, dead: float = 1e-12) -> DataFrame:
    """(dim, variance, dead) of every component: population variance, dead where it is below `dead`. Null, NaN and infinite components are left out."""
    keys = by or []
    each = vectors.filter("embedding is not null").select(*keys, F.posexplode(S.doubles(F.col("embedding"))).alias("dim", "x"))
    each = each.filter("x is not null and not isnan(x)").filter(F.abs("x") != float("inf"))
    return each.groupBy(*keys, "dim").agg(F.var_pop("x").alias("variance")).withColumn("dead", F.col("variance") < dead)


def cosine_pairs(vectors: DataFrame, vector_id: str, samples: int = 2000, near: float = 0.98, seed: int = 42) -> DataFrame:
    """One row of statistics over `samples` drawn pairs of different vectors: (pairs, mean, std, p95, p99, max, near).

    Pair s joins the vectors at two hashed places of the id order; places come from a sorted index, not from a global window.
    Non-finite vectors and lengths other than the partner's give no pair; fewer than two vectors give no pair.
    """
    good = vectors.filter(F.col("embedding").isNotNull() & (S.nonfinite(F.col("embedding")) == 0)).select(F.col(vector_id).alias("v"), "embedding")
    span = good.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    spark = vectors.sparkSession
    width = (span.hi - span.lo + 1) if span.lo is not None else 1
    lo = span.lo or 0
    at = F.pmod(F.col("id") * 7919 + seed, F.lit(width))
    step = F.pmod(F.col("id") * 104729 + 31 * seed, F.lit(max(1, width - 1))) + 1
    s = spark.range(samples).select((at + lo).alias("a"), (F.pmod(at + step, F.lit(width)) + lo).alias("b")).filter("a <> b")
    left, right = good.select(F.col("v").alias("a"), F.col("embedding").alias("x")), good.select(F.col("v").alias("b"), F.col("embedding").alias("y"))
    c = F.broadcast(s).join(left, "a").join(right, "b").filter(F.size("x") == F.size("y")).select(S.cosine(F.col("x"), F.col("y")).alias("c"))
    return c.agg(F.count("c").alias("pairs"), F.avg("c").alias("mean_cos"), F.stddev_pop("c").alias("std_cos"), F.percentile("c", F.lit(0.95)).alias("p95_cos"), F.percentile("c", F.lit(0.99)).alias("p99_cos"), F.max("c").alias("max_cos"), F.count_if(F.col("c") >= near).alias("near_pairs"))


def run_checks(vectors: DataFrame, runs: DataFrame, low: float = 0.95, high: float = 1.05) -> DataFrame:
    """Per run with vectors: counts of what is wrong and a verdict.

    critical: duplicate ids, null vectors, wrong lengths, non-finite components, norms out of [low, high] where the run says it
    normalised; warning: zero vectors; else pass.
    """
    dims = runs.filter("run_id is not null").groupBy("run_id").agg(F.max("embedding_dimension").alias("dim"), F.bool_or("normalize_embeddings").alias("normalized"))
    v = vectors.join(F.broadcast(dims) if dims.count() <= 1_000_000 else dims, "run_id", "left")
    e = F.col("embedding")
    sound = e.isNotNull() & (S.nonfinite(e) == 0)
    n = F.when(sound, S.norm(e))
    per = v.select("run_id", "row_id", "normalized", e.isNull().alias("missing"), (e.isNotNull() & (F.size(e) != F.col("dim"))).alias("wrong"), (e.isNotNull() & (S.nonfinite(e) > 0)).alias("bad"), n.alias("norm"))
    dup = vectors.groupBy("run_id", "row_id").count().groupBy("run_id").agg((F.sum("count") - F.count(F.lit(1))).alias("duplicate_ids"))
    out = per.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("missing").alias("null_vectors"), F.count_if("wrong").alias("wrong_length"), F.count_if("bad").alias("nonfinite"),
        F.count_if(F.col("norm") == 0).alias("zero_vectors"), F.count_if(F.coalesce("normalized", F.lit(False)) & (F.col("norm") > 0) & ~F.col("norm").between(low, high)).alias("norm_outside"),
    ).join(dup, "run_id")
    critical = (F.col("duplicate_ids") + F.col("null_vectors") + F.col("wrong_length") + F.col("nonfinite") + F.col("norm_outside")) > 0
    return out.withColumn("verdict", F.when(critical, "critical").when(F.col("zero_vectors") > 0, "warning").otherwise("pass"))
