"""Problem 1: lines repeated over one site's pages.

Method: each partition keeps a mergeable heavy-hitter (Misra-Gries) summary per site; summaries are merged by adding
counters and the recorded under-counts, so the merge is an ordinary hash aggregation and no site is gathered in one task.
A second pass counts the candidates exactly; the confirmed lines are a broadcast set (checked size) for removal.

Defined results: pages with null ids go; a repeated page_id counts once (its latest delivery); null content is a page
without lines; a page whose url has no host belongs to no site and has no repeated lines; lines without letters never count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.keys import measured_broadcast, one_per_key
from corpusloom.session import cut

MIN_PAGES, MIN_SHARE = 8, 0.10
SPARE = 4  #: counters per site are SPARE times what the share threshold needs, so that few false candidates remain
LEAST_COUNTERS = 256


def host(url: Column) -> Column:
    """The host of a url in lower case, without user and port; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1), F.lit(""))


def line_keys(content: Column) -> Column:
    """For every line of content: the hash of its lower-cased letters; null for lines without letters."""
    letters = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]+", "")
    hashed = F.transform(F.split(content, "\n", -1), letters)
    return F.transform(hashed, lambda k: F.when(k != "", F.xxhash64(k)))


def site_pages(pages: DataFrame) -> DataFrame:
    """(page_id, site, keys): one row per page, a hash for each line; a small table that later passes read in place of the texts."""
    few = pages.select("page_id", "loaded_at", F.col("metadata.url").alias("url"), "content")
    once = one_per_key(few, "page_id", "loaded_at")
    return once.select("page_id", host(F.col("url")).alias("site"), line_keys(F.col("content")).alias("keys"))


class Summary:
    """Misra-Gries counters of one site. `missed` bounds by how much any line's count may be too low."""

    __slots__ = ("counts", "missed", "pages", "lines", "share")

    def __init__(self, share: float) -> None:
        self.share = share
        self.counts: dict[int, int] = {}
        self.missed = self.pages = self.lines = 0

    def add(self, keys: list[int]) -> None:
        self.pages += 1
        self.lines += len(keys)
        c = self.counts
        for k in keys:
            c[k] = c.get(k, 0) + 1
        room = self.room()
        if len(c) > 2 * room:  # batch form of the decrement: take off the (room+1)-th largest count
            v = np.fromiter(c.values(), np.int64, len(c))
            off = int(np.partition(v, len(v) - room - 1)[len(v) - room - 1])
            self.missed += off
            self.counts = {k: x - off for k, x in c.items() if x > off}

    def room(self) -> int:
        return max(LEAST_COUNTERS, int(SPARE * self.lines / max(1.0, self.share * self.pages)))


def _summaries(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    sites: dict[str, Summary] = {}
    for b in batches:
        for site, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = sites.get(site)
            if s is None:
                s = sites[site] = Summary(share)
            s.add(keys or [])
    site, key, count = [], [], []
    for name, s in sites.items():
        site += [name] * (len(s.counts) + 1)
        key += [*s.counts, None]
        count += [*s.counts.values(), s.missed]
    yield pa.RecordBatch.from_arrays([pa.array(site, pa.string()), pa.array(key, pa.int64()), pa.array(count, pa.int64())], ["site", "key", "n"])


def repeated_lines(lines: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, key, pages): the lines on at least min_pages pages and min_share of the pages of their site, exactly."""
    per_page = lines.filter("site is not null").select("site", F.array_distinct(F.filter("keys", lambda k: k.isNotNull())).alias("keys"))
    need = per_page.groupBy("site").agg(F.greatest(F.lit(min_pages), F.ceil(F.count(F.lit(1)) * F.lit(min_share) - F.lit(1e-9))).alias("need"))
    merged = per_page.mapInArrow(lambda it: _summaries(it, min_share), "site string, key bigint, n bigint").groupBy("site", "key").agg(F.sum("n").alias("n"))
    merged = cut(merged)
    short = merged.filter("key is null").select("site", F.col("n").alias("missed"))
    bounds = cut(need.join(short, "site"))
    bounds_b = measured_broadcast(bounds)
    likely = cut(merged.filter("key is not null").join(bounds_b, "site").filter("n + missed >= need").select("site", "key"))
    rest = bounds.filter("missed >= need").select("site")  # summaries that say nothing there: every line of the site is counted
    exploded = per_page.select("site", F.explode("keys").alias("key"))
    counted = exploded.join(measured_broadcast(likely), ["site", "key"], "left_semi")
    if rest.count():
        others = exploded.join(measured_broadcast(rest), "site", "left_semi").join(likely, ["site", "key"], "left_anti")
        counted = counted.unionByName(others)
    exact = counted.groupBy("site", "key").agg(F.count(F.lit(1)).alias("pages"))
    return cut(exact.join(bounds_b, "site").filter("pages >= need").select("site", "key", "pages"))


def flagged(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(page_id, line_no) of every line that is a repeated one."""
    each = lines.filter("site is not null").select("page_id", "site", F.posexplode("keys").alias("line_no", "key")).filter("key is not null")
    return each.join(measured_broadcast(repeated.select("site", "key")), ["site", "key"], "left_semi").select("page_id", F.col("line_no").cast("bigint").alias("line_no"))


def found(pages: DataFrame) -> DataFrame:
    lines = cut(site_pages(pages))
    return flagged(lines, repeated_lines(lines))


def clean(pages: DataFrame, size: int = 500, stride: int = 450) -> DataFrame:
    """(page_id, content, chunks, removed): the pages without their repeated lines, re-cut into word windows with line breaks."""
    few = pages.select("page_id", "loaded_at", F.col("metadata.url").alias("url"), "content")
    lines = cut(site_pages(pages))
    drop = flagged(lines, repeated_lines(lines)).groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
    once = one_per_key(few, "page_id", "loaded_at").join(drop, "page_id", "left")
    split = F.split("content", "\n", -1)
    kept = F.filter(split, lambda x, i: ~F.coalesce(F.array_contains("drop", i.cast("bigint")), F.lit(False)))
    once = once.select("page_id", F.array_join(kept, "\n").alias("content"), F.size(F.coalesce("drop", F.array().cast("array<bigint>"))).alias("removed"))
    # a word with the white space before it; the first of a window loses that space
    words = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(\s*\S+)"), 1)
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cutup = F.transform(starts, lambda s: F.ltrim(F.regexp_replace(F.array_join(F.slice("words", s + 1, size), ""), r"^\s+", "")))
    return once.withColumn("words", words).select("page_id", "content", cutup.alias("chunks"), "removed")
