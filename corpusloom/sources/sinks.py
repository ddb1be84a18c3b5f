"""Writers of pages, manifests, indexes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import file_key


def page_json(pages: DataFrame) -> DataFrame:
    """(file, json) of every page: its file name and its JSON text."""
    return pages.select(file_key(F.col("metadata.title"), F.col("metadata.url")).alias("file"), F.to_json(F.struct("metadata", "content", "chunks"), {"ignoreNullFields": "false"}).alias("json"))


def write_pages(pages: DataFrame, path: str) -> None:
    page_json(pages).write.mode("overwrite").json(path)


def manifest_line(record_id: Column, text: Column, metadata: Column) -> Column:
    return F.to_json(F.struct(record_id.alias("id"), F.length(F.coalesce(text, F.lit(""))).alias("chars"), metadata.alias("metadata")))


def write_manifest(records: DataFrame, path: str) -> None:
    records.select(manifest_line(F.col("id"), F.col("text"), F.col("metadata")).alias("value")).write.mode("overwrite").text(path)


def served_metadata(records: DataFrame) -> DataFrame:
    """(id, text, chars, metadata) as served beside the vectors."""
    return records.select("id", "text", F.length(F.coalesce("text", F.lit(""))).alias("chars"), "metadata")


def write_index(vectors: DataFrame, records: DataFrame, path: str, key: str = "row_id") -> None:
    """Vectors with their records by key, clustered by key."""
    vectors.join(records, key).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as JSON and, beside it, as `name: value` text."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    lines = F.array_join(F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in report.columns]), "\n")
    report.select(lines.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/txt")
