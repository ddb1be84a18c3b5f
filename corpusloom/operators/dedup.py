"""Union in order, first of each id, duplicates, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_union(*sources: DataFrame) -> DataFrame:
    """All rows, with src_ord for the place of their source; at least one source is needed."""
    if not sources:
        raise ValueError("no source of documents")
    return reduce(DataFrame.unionByName, [s.withColumn("src_ord", F.lit(i)) for i, s in enumerate(sources)])


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by `order`; a map-side combined minimum, so a key may hold any share of the rows. Null is a key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """(rows, distinct_ids, duplicates): occurrences beyond the first; null is one id."""
    by = df.groupBy(key).count()
    return by.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_ids")).withColumn("duplicates", F.col("rows") - F.col("distinct_ids"))


def difference(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The distinct keys that were not seen."""
    return df.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")
