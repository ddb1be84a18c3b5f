"""Problem 8: passages of held-out items inside the corpus.

Method: the hashed 13-word windows of the items (whole items where they are shorter) are a broadcast set, whose size is
bounded by the items and checked; documents are scanned once, hits are verified word by word, no text is shuffled.
Item tables beyond the bound are scanned in blocks of the same size.

Defined results: null ids go; null and empty texts hold nothing and give nothing away; items without words leak nowhere;
repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import WORD, windows, word_hashes

WIDTH = 13
BLOCK_ITEMS = 200_000  #: items of one broadcast set


class ItemWindows:
    """Sorted window hashes of a block of items, by width, with the item and the first word of each."""

    def __init__(self, items: list[tuple[int, str]], width: int) -> None:
        words = [WORD.findall(t.lower()) for _, t in items]
        self.words = words
        self.ids = np.array([i for i, _ in items], np.int64)
        h, n = word_hashes([t for _, t in items])
        self.by_width = {}
        first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        for w in sorted({min(width, int(k)) for k in n if k}):
            win, doc, at = windows(h, n, w)
            ok = (n[doc] >= width) if w == width else (n[doc] == w)
            win, doc, at = win[ok], doc[ok], at[ok]
            o = np.argsort(win, kind="stable")
            self.by_width[w] = (win[o], doc[o], (at - first[doc])[o])

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text index, item index, first word in the text) of every verified hit."""
        h, n = word_hashes(texts)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        cache: dict[int, list[str]] = {}
        for w, (keys, item, where) in self.by_width.items():
            win, doc, at = windows(h, n, w)
            lo = np.searchsorted(keys, win)
            ok = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == win)
            for j in ok:
                d, p = int(doc[j]), int(at[j] - first[doc[j]])
                if d not in cache:
                    cache[d] = WORD.findall(texts[d].lower())
                k = int(lo[j])
                while k < len(keys) and keys[k] == win[j]:
                    i, q = int(item[k]), int(where[k])
                    if cache[d][p : p + w] == self.words[i][q : q + w]:
                        yield d, i, p
                    k += 1


def leaks(documents: DataFrame, items: DataFrame, width: int = WIDTH, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, words): the words of the document inside passages of the item, each counted once."""
    spark = documents.sparkSession
    good = items.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-good.count() // block_items))
    parts = []
    for k in range(blocks):
        mine = good if blocks == 1 else good.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = [(r.item_id, r.text) for r in mine.toLocalIterator()]  # a block has a bounded number of items
        shared = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemWindows(shared.value, width)
            for b in batches:
                seen: dict[tuple[int, int], set[int]] = {}
                for d, i, p in index.hits(b.column(1).to_pylist()):
                    seen.setdefault((d, i), set()).update(range(p, p + min(width, len(index.words[i]))))
                ids = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d, _ in seen], pa.int64()), pa.array([int(index.ids[i]) for _, i in seen], pa.int64()), pa.array([len(x) for x in seen.values()], pa.int64())],
                    ["doc_id", "item_id", "words"],
                )

        parts.append(documents.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(scan, "doc_id bigint, item_id bigint, words bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, documents, most_words) of every item: how far it leaked."""
    by = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("most_words"))
    return items.filter("item_id is not null").select("item_id").distinct().join(by, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_words", F.lit(0)).alias("most_words"))


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item."""
    bad = leaks(documents, items).select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti")
