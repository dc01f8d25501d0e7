"""Streams: pages scanned as they arrive, and trends of scores with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.operators.rules import findings
from lumenpage.plans.report import score, to_issues
from lumenpage.schema import PAGES
from lumenpage.sources.elements import elements


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Pages of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def issue_stream(pages: DataFrame) -> DataFrame:
    """Issues of a stream of pages: rules are local to a page, so no state is kept."""
    return to_issues(findings(elements(pages)))


def write_issues(stream: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Write issues by course; with ``on_batch``, hand every batch on instead."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    if on_batch:
        return writer.foreachBatch(on_batch).start()
    return writer.partitionBy("course_id").format("parquet").option("path", path).outputMode("append").start()


def score_trend(reports: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Scores per course and window of (course_id, analyzed_at, errors, warnings, pages); reports later than ``late`` are left out."""
    by = F.window("analyzed_at", window)
    sums = reports.withWatermark("analyzed_at", late).groupBy("course_id", by.alias("window")).agg(*(F.sum(c).alias(c) for c in ("errors", "warnings", "pages")), F.count("*").alias("reports"))
    return sums.select("course_id", F.col("window.start").alias("start"), "reports", score(F.col("errors"), F.col("warnings"), F.col("pages")).alias("score"))
