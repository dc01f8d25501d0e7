"""The engine's public calls. Each takes and returns DataFrames; nothing runs before an action asks for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.operators import documents, remediate, suggest
from lumenpage.plans import report
from lumenpage.sources import archive
from lumenpage.sources.elements import elements, page_table, spread

PAGE = "course_id string, page_id string, identifier string, title string, content_type string, file_path string, canvas_url string, html string"


def analyze_html(spark: SparkSession, html: str, title: str = "", identifier: str = "page", content_type: str = "wiki_page") -> DataFrame:
    """Issues of one fragment."""
    if html is None:
        raise ValueError("html is needed")
    return report.issues(spark.createDataFrame([("", identifier, identifier, title, content_type, "", None, html)], PAGE))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a raw table (page_id, url, html)."""
    return page_table(spread(spark.read.parquet(path)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all archives under a path: the archive is the course. Archives that can't be read have no pages; ``unreadable_archives`` names them."""
    rows = archive.pages(archive.archives(spark, path)).where("error IS NULL")
    return rows.select(F.col("archive").alias("course_id"), F.concat_ws("#", "archive", "file_path").alias("page_id"), "identifier", "title", "content_type", "file_path", F.lit(None).cast("string").alias("canvas_url"), "html")


def unreadable_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, error) of the archives under a path that can't be read."""
    return archive.pages(archive.archives(spark, path)).where("error IS NOT NULL").select("archive", "error").distinct()


def analyze(pages: DataFrame, course_rules: bool = True, config: DataFrame | None = None, rendered: DataFrame | None = None) -> DataFrame:
    """Issues of pages; with a configuration of rules, and with rendered results (course_id, page_id, page_url, violation) beside."""
    found = report.issues(pages, course_rules)
    if rendered is not None:
        found = found.unionByName(documents.rendered_issues(rendered), allowMissingColumns=True)
    return report.configured(found, config) if config is not None else found


def remediate_pages(pages: DataFrame, issues: DataFrame, alts: DataFrame | dict[str, str] | None = None) -> DataFrame:
    return remediate.repaired(pages, issues, alts)


def inventory_documents(pages: DataFrame) -> DataFrame:
    return documents.link_inventory(elements(pages, facts=False))


def export_acr(pages: DataFrame, issues: DataFrame, kind: str = "markdown", before: DataFrame | None = None) -> DataFrame:
    made = {"markdown": report.acr_markdown, "json": report.acr_json, "html": report.acr_html}
    return made[kind](report.acr(pages, issues, before))


def suggestions(issues: DataFrame, model: Callable[[str, str], str | None] | None = None) -> DataFrame:
    found = suggest.contrast_suggestions(issues)
    return found.unionByName(suggest.modelled(issues, model)) if model else found


def apply_suggestions(pages: DataFrame, accepted: DataFrame) -> DataFrame:
    return suggest.apply_all(pages, accepted)
