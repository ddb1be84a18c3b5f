"""Cleaning of extracted text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.text import collapse, drop_adjacent, strip_boilerplate

PHRASE = 4


def _kept(text: str) -> str:
    w = text.split(" ")
    seen: set[str] = set()
    out = []
    for i, x in enumerate(w):
        p = " ".join(w[i : i + PHRASE])
        if p not in seen:
            seen.add(p)
            out.append(x)
    return " ".join(out)


@F.pandas_udf(StringType())
def phrase_dedup(text: pd.Series) -> pd.Series:
    """Keeps a word only where the run of four words that starts with it stands for the first time; collapsed text in and out."""
    return text.map(_kept, na_action="ignore")


def phrase_dedup_native(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): the same by exploding words; slower, kept as the readable form that tests compare with."""
    w = F.split(F.col(text), " ", -1)
    each = df.select(key, F.posexplode(w).alias("i", "w"), w.alias("ws")).select(key, "i", "w", F.array_join(F.slice("ws", F.col("i") + 1, PHRASE), " ").alias("p"))
    first = each.withColumn("first", F.min("i").over(Window.partitionBy(key, "p"))).filter("i = first")
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]), " ").alias(text))


def clean(text: Column) -> Column:
    """White space, repeated phrases, boilerplate, adjacent repeats, white space again."""
    return collapse(drop_adjacent(strip_boilerplate(phrase_dedup(collapse(text)))))
