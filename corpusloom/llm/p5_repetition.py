"""Problem 5: the share of each page's words that repeat an earlier run of the same page.

The method named for this problem (line frequencies over a host's documents) says nothing of repetition inside one
document, so runs of six words are hashed and compared inside each page instead, exactly and without any shuffle of text.

Defined results: rows with a null page_id go; a repeated page_id counts once (latest delivery, ties: the larger share);
null, empty and shorter texts have the share 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import windows, word_hashes

RUN, MIN_SHARE = 6, 0.25


def repeated_words(texts: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(words, words inside a run that has begun earlier in the same text) of each text."""
    h, n = word_hashes(texts)
    win, doc, at = windows(h, n, run)
    o = np.lexsort((at, win, doc))
    w, d = win[o], doc[o]
    later = np.zeros(len(o), bool)
    later[1:] = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    cover = np.zeros(len(h) + 1, np.int64)
    starts = at[o[later]]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    inside = np.cumsum(cover)[: len(h)] > 0
    return n, np.bincount(np.repeat(np.arange(len(n)), n)[inside], minlength=len(n)) if len(h) else np.zeros(len(n), np.int64)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, again = repeated_words(b.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(again, pa.int64())], ["page_id", "loaded_at", "words", "repeated"])


def shares(pages: DataFrame) -> DataFrame:
    """(page_id, words, repeated, share) of every page."""
    each = pages.filter("page_id is not null").select("page_id", "loaded_at", "content")
    each = each.mapInArrow(_shares, "page_id bigint, loaded_at timestamp, words bigint, repeated bigint")
    once = each.groupBy("page_id").agg(F.max(F.struct("loaded_at", "repeated", "words")).alias("m"))
    share = F.when(F.col("m.words") > 0, F.col("m.repeated") / F.col("m.words")).otherwise(F.lit(0.0))
    return once.select("page_id", "m.words", "m.repeated", share.alias("share"))


def found(pages: DataFrame) -> DataFrame:
    return shares(pages).filter((F.col("words") > 0) & (F.col("repeated") >= MIN_SHARE * F.col("words"))).select("page_id")
