"""Link graphs: breadth-first waves and crawl summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut


# What a crawler accepts.
OK, HTML, LEAST_CHARS = 200, "text/html", 120


def valid_response(status: Column, content_type: Column) -> Column:
    """Whether a response is an HTML page; a missing status or type is not."""
    return F.coalesce((status == OK) & content_type.contains(HTML), F.lit(False))


def has_content(text: Column) -> Column:
    """Whether a page has more than LEAST_CHARS characters besides the white space around its lines; null has none."""
    bare = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), "")
    return F.coalesce(F.length(bare) > LEAST_CHARS, F.lit(False))


def bfs(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, url, depth): urls reached from each seed over (src, dst) edges, in waves until nothing new is found.

    `most` caps the urls of one seed, nearest and then alphabetically first; a seed that has so many goes no further. None
    follows the whole graph. Null urls and self links are ignored. Every wave is a written table of its new urls only.
    """
    e = cut(edges.filter("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    front = cut(seeds.filter("url is not null").select(F.col("url").alias("seed"), "url").distinct().withColumn("depth", F.lit(0)))
    seen = front
    while True:
        nxt = front.select("seed", F.col("url").alias("src"), "depth").join(e, "src").select("seed", F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth")).distinct()
        nxt = nxt.join(seen.select("seed", "url"), ["seed", "url"], "left_anti")
        if most is not None:
            have = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("have"))
            rank = F.row_number().over(Window.partitionBy("seed").orderBy("url"))
            nxt = nxt.withColumn("_n", rank).filter(F.col("_n") <= most).join(have, "seed").filter(F.col("_n") + F.col("have") <= most).select("seed", "url", "depth")
        front = cut(nxt)
        if not front.take(1):
            return seen
        seen = seen.unionByName(front)


def crawl_summary(runs: DataFrame) -> DataFrame:
    """Per crawl: stated and counted pages, distinct links, links found, seconds a page; nulls count as none."""
    links = F.coalesce(F.col("links"), F.array().cast("array<string>"))
    details = F.coalesce(F.col("details"), F.array().cast("array<struct<url:string,links_found:bigint>>"))
    found = F.aggregate(details, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["links_found"], F.lit(0)))
    return runs.select(
        "crawl_id", "total_valid_pages", "skipped_pages", F.size(links).alias("links"), F.size(F.array_distinct(links)).alias("distinct_links"),
        F.size(details).alias("pages_with_details"), found.alias("links_found"),
        F.round(F.try_divide(F.col("crawl_time_sec"), F.coalesce("total_valid_pages", F.lit(0)) + F.coalesce("skipped_pages", F.lit(0))), 6).alias("sec_per_page"),
    )
