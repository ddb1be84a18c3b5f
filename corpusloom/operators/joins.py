"""Joins on order and on intervals, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with `value` of the latest row of right with the same key and no later `at`; null where there is none.

    Both sides go once through one sorted window by key; of right rows at the same time the largest value counts. Null keys
    match nothing, null times come first.
    """
    cols = left.columns
    l = left.select(F.struct(*cols).alias("_l"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(None).alias("_v"), F.lit(1).alias("_side"))
    r = right.filter(F.col(key).isNotNull()).select(F.lit(None).alias("_l"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.struct(F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", F.col("_v.v")).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l.withColumn("_v", F.col("_v").cast(r.schema["_v"].dataType)), allowMissingColumns=True)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select("_l.*", F.col("_v.v").alias(value))


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Each pair of a point and a span with start <= at < end: an equi-join on buckets of `width`, then the exact test.

    A span is sent to the buckets that it touches, a point to its own; rows with null bounds match nothing.
    """
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    p = points.withColumn("_b", bucket(at))
    s = spans.filter(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(s, "_b").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")
