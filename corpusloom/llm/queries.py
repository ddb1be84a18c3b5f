"""The pN_ queries: every one runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import p10_subjects, p1_site_lines, p2_neighbours, p3_near_copies, p4_main_body, p5_repetition, p6_text_types, p7_residue, p8_leaks, p9_mixing

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    r = _read
    return {
        "p1_found": lambda s, d: p1_site_lines.found(r(s, d, "scraped_pages")),
        "p1_clean": lambda s, d: p1_site_lines.clean(r(s, d, "scraped_pages")),
        "p2_found": lambda s, d: p2_neighbours.found(r(s, d, "doc_vectors"), r(s, d, "run_reports")),
        "p2_recall": lambda s, d: p2_neighbours.recall(r(s, d, "doc_vectors"), r(s, d, "run_reports")),
        "p3_found": lambda s, d: p3_near_copies.found(r(s, d, "scraped_pages"), r(s, d, "doc_records")),
        "p3_groups": lambda s, d: p3_near_copies.groups(r(s, d, "scraped_pages"), r(s, d, "doc_records")),
        "p4_found": lambda s, d: p4_main_body.found(r(s, d, "scraped_pages")),
        "p4_clean": lambda s, d: p4_main_body.clean(r(s, d, "scraped_pages")),
        "p4_wrappers": lambda s, d: p4_main_body.wrappers(r(s, d, "scraped_pages")),
        "p5_found": lambda s, d: p5_repetition.found(r(s, d, "scraped_pages")),
        "p5_shares": lambda s, d: p5_repetition.shares(r(s, d, "scraped_pages")),
        "p6_found": lambda s, d: p6_text_types.found(r(s, d, "scraped_pages")),
        "p6_statistics": lambda s, d: p6_text_types.types(r(s, d, "scraped_pages")),
        "p7_found": lambda s, d: p7_residue.found(r(s, d, "scraped_pages")),
        "p7_report": lambda s, d: p7_residue.report(r(s, d, "scraped_pages")),
        "p8_found": lambda s, d: p8_leaks.found(r(s, d, "documents"), r(s, d, "eval_items")),
        "p8_report": lambda s, d: p8_leaks.report(r(s, d, "documents"), r(s, d, "eval_items")),
        "p8_clean": lambda s, d: p8_leaks.clean(r(s, d, "documents"), r(s, d, "eval_items")),
        "p9_mix": lambda s, d: p9_mixing.mix(r(s, d, "documents"), r(s, d, "source_targets")),
        "p9_shares": lambda s, d: p9_mixing.shares(r(s, d, "documents"), r(s, d, "source_targets")),
        "p10_found": lambda s, d: p10_subjects.found(r(s, d, "documents"), r(s, d, "subjects"), r(s, d, "subject_labels")),
        "p10_composition": lambda s, d: p10_subjects.composition(r(s, d, "documents"), r(s, d, "subjects"), r(s, d, "subject_labels")),
    }


def oracle_sql() -> dict[str, str]:
    from corpusloom.llm import oracles

    return oracles.oracle_sql()
