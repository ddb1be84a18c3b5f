"""Keyed operators that hold under skew: one row per key, joins that broadcast only what was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

BROADCAST_ROWS = 500_000  #: rows of a broadcast side
BROADCAST_BYTES = 32_000_000  #: bytes of a broadcast side as it is written, some 100 MB as a hashed relation


def measured_broadcast(small: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small` with a broadcast hint if its rows and its bytes stay within bounds, without one beyond (a shuffle join follows).

    Pass a table that is already written (see cut): its bytes are those of its files, its rows are counted from the footers.
    """
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(small) if size <= BROADCAST_BYTES and small.count() <= most_rows else small


def one_per_key(df: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """One row per non-null key: the one with the largest `order`, ties by a hash of the whole row; rows with a null key go.

    Only the key columns are shuffled for the whole table. Rows whose key is unique pass through without a shuffle; the
    few re-delivered ones are reduced with a map-side combined max_by, so one key may hold any share of the rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    df = df.dropna(subset=keys)
    again = cut(df.groupBy(*keys).count().filter("count > 1").select(*keys))
    cols = [F.col(f"`{c}`") for c in df.columns]
    hint = measured_broadcast(again)
    rank = [F.col(order)] if order else []
    hashed = F.xxhash64(*[F.to_json(F.struct(c)) for c in cols])
    many = df.join(hint, keys, "left_semi").groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*rank, hashed)).alias("_row"))
    return df.join(hint, keys, "left_anti").select(*cols).unionByName(many.select("_row.*"))
