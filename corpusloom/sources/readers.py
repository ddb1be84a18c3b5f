"""Readers of scraped pages, prepared JSON lines, manifests and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.keys import measured_broadcast
from corpusloom.session import cut

PAGE_META = "url string, title string, description string, scraped_at string, status string, method string, content_length bigint, word_count bigint, chunk_count bigint, suitable_for_rag boolean"
PAGE = f"metadata struct<{PAGE_META.replace(' string', ':string').replace(' bigint', ':bigint').replace(' boolean', ':boolean')}>, content string, chunks array<string>, text string"
RECORD_META = "struct<source_file:string,source_url:string,source_title:string,chunk_index:int,total_chunks:int,scraped_at:string,pre_chunked:boolean>"


def scraped_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per readable page file, in file-name order by `file_name`; broken files are left out."""
    df = spark.read.schema(f"{PAGE}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return df.withColumn("file_name", name).filter(F.col("_corrupt").isNull()).drop("_corrupt")


def _blank(x: Column) -> Column:
    return F.coalesce(F.regexp_replace(x, r"(?U)\s+", ""), F.lit("")) == ""


def page_records(pages: DataFrame, file_name: str = "file_name") -> DataFrame:
    """(id, text, metadata) of scraped pages: a record for each chunk that is not blank (total_chunks counts all of them);
    pages without chunks give their key `text`, if they have one."""
    title = F.coalesce(F.nullif("metadata.title", F.lit("")), F.col(file_name))
    url, at = F.col("metadata.url"), F.col("metadata.scraped_at")
    meta = lambda i, n, pre: F.struct(F.col(file_name).alias("source_file"), url.alias("source_url"), title.alias("source_title"), i.cast("int").alias("chunk_index"), n.cast("int").alias("total_chunks"), at.alias("scraped_at"), F.lit(pre).alias("pre_chunked"))
    chunked = pages.filter(F.size("chunks") > 0).select("metadata", file_name, F.size("chunks").alias("n"), F.posexplode("chunks").alias("i", "c")).filter(~_blank(F.col("c")))
    a = chunked.select(F.concat(title, F.lit("_chunk_"), F.col("i").cast("string")).alias("id"), F.col("c").alias("text"), meta(F.col("i"), F.col("n"), True).alias("metadata"))
    if "text" not in pages.columns:
        return a
    flat = pages.filter((F.coalesce(F.size("chunks"), F.lit(0)) <= 0) & ~_blank(F.col("text")))
    return a.unionByName(flat.select(title.alias("id"), "text", meta(F.lit(0), F.lit(1), False).alias("metadata")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files of any size, numbered from 1 in each file; files are read in splits.

    A split numbers its own lines; the lines of the splits before it are added from a table of one row for each split.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    splits = rows.groupBy("file", "split").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # the splits of one file
    offsets = cut(splits.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("file", "split", "first", "before"))
    return rows.join(measured_broadcast(offsets), ["file", "split"]).select("file", (F.col("row") - F.col("first") + F.col("before") + 1).alias("line_no"), F.col("value").alias("line"))


def jsonl_records(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, id, text, metadata map) of prepared JSON lines; blank and broken lines and blank texts go, a missing id becomes jsonl_doc_{line_no}."""
    lines = numbered_lines(spark, path).filter(~_blank(F.col("line")))
    r = lines.select("line_no", F.from_json("line", "id string, text string, metadata map<string,string>").alias("r")).filter(F.try_parse_json("line").isNotNull())
    return r.filter(~_blank(F.col("r.text"))).select("line_no", F.coalesce(F.nullif("r.id", F.lit("")), F.concat(F.lit("jsonl_doc_"), F.col("line_no").cast("string"))).alias("id"), F.col("r.text").alias("text"), F.col("r.metadata").alias("metadata"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, id, chars) of a manifest; a broken line or a missing id raises with its line number."""
    lines = numbered_lines(spark, path).filter(~_blank(F.col("line")))
    r = F.from_json("line", f"id string, chars bigint, metadata {RECORD_META}")
    bad = F.try_parse_json("line").isNull() | r["id"].isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad manifest line "), F.col("line_no").cast("string")))).otherwise(r["id"])
    return lines.select("line_no", checked.cast("string").alias("id"), r["chars"].alias("chars"))


def checked_index(vectors: DataFrame, records: DataFrame, key: str = "row_id") -> DataFrame:
    """Vectors with their records by key; raises if the two do not have the same number of rows."""
    a, b = vectors.count(), records.count()
    if a != b:
        raise ValueError(f"vectors and records differ in number: {a} and {b}")
    return vectors.join(records, key)
