"""Aggregate and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where one of the vectors is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def nonfinite(v: Column) -> Column:
    """How many components are null, NaN or infinite."""
    return F.size(F.filter(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def score_of(d2: Column) -> Column:
    """The score of a squared distance, in (0, 1]."""
    return 1.0 / (1.0 + d2)


def spread(x: Column, sample: bool = True) -> list[Column]:
    """mean, median, std, min, q1, q3, max with linear quantiles; the std of one value is 0."""
    std = F.coalesce(F.stddev_samp(x) if sample else F.stddev_pop(x), F.lit(0.0))
    return [F.avg(x).alias("mean"), F.median(x).alias("median"), std.alias("std"), F.min(x).alias("min"), F.percentile(x, F.lit(0.25)).alias("q1"), F.percentile(x, F.lit(0.75)).alias("q3"), F.max(x).alias("max")]
