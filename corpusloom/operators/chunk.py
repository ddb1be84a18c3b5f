"""Chunks of words and of characters: one row per chunk, JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words

WORDS, WORD_OVERLAP = 500, 50
CHARS, CHAR_OVERLAP = 1200, 50


def _starts(n: Column, step: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def word_pieces(text: Column, size: int = WORDS, overlap: int = WORD_OVERLAP) -> Column:
    """Windows of `size` words every size - overlap words (at least one); a last window inside the overlap is kept."""
    w = words(text)
    return F.transform(_starts(F.size(w), max(1, size - overlap)), lambda s: F.array_join(F.slice(w, s + 1, size), " "))


def char_pieces(text: Column, most: int = CHARS, overlap: int = CHAR_OVERLAP) -> Column:
    """Windows of characters, each stripped; blank ones go."""
    step = most - min(overlap, most - 1)
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    cut = F.transform(_starts(F.length(text), step), lambda s: strip(F.substring(text, s + 1, F.lit(most))))
    return F.filter(cut, lambda p: p != "")


def word_chunks(df: DataFrame, key: str, text: str, size: int = WORDS, overlap: int = WORD_OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk); null and blank texts have no chunk."""
    return df.select(key, F.posexplode(word_pieces(F.col(text), size, overlap)).alias("chunk_index", "chunk"))


def char_chunks(df: DataFrame, key: str, text: str, most: int = CHARS, overlap: int = CHAR_OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk); the index counts kept pieces."""
    return df.select(key, F.posexplode(char_pieces(F.col(text), most, overlap)).alias("chunk_index", "chunk"))


def chunk_records(df: DataFrame, most: int = CHARS, overlap: int = CHAR_OVERLAP) -> DataFrame:
    """Records (row_id, id, text, pre_chunked) in final pieces: chunked ones pass, the others are cut and renamed."""
    done = F.coalesce(F.col("pre_chunked"), F.lit(False))
    pieces = F.when(done, F.array("text")).otherwise(char_pieces(F.col("text"), most, overlap))
    each = df.withColumn("_done", done).withColumn("_n", F.size(pieces)).select("row_id", "id", "_done", "_n", F.posexplode(pieces).alias("chunk_index", "chunk"))
    name = F.when(F.col("_done"), F.col("id")).otherwise(F.concat(F.col("id"), F.lit("_chunk_"), F.col("chunk_index").cast("string")))
    return each.select("row_id", name.alias("id"), "chunk_index", F.col("_n").alias("total_chunks"), "chunk")
