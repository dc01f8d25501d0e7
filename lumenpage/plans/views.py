"""Sorted and grouped views that reports and screens show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def criteria_by_category(rollup: DataFrame) -> DataFrame:
    """Per course and category (a criterion's id without its last part): the criteria in order, issues and affected pages."""
    category = F.regexp_replace("criterion_id", r"\.[^.]*$", "")
    criterion = F.struct("criterion_id", "conformance", "issue_count", "pages_affected")
    return rollup.groupBy("course_id", category.alias("category_id")).agg(
        F.array_sort(F.collect_list(criterion)).alias("criteria"), F.sum("issue_count").alias("issue_count"), F.sum("pages_affected").alias("pages_affected")
    )


def by_improvement(page_reports: DataFrame) -> DataFrame:
    """Pages (page_id, issues_before, issues_after) by falling improvement, then by falling count before, then by id."""
    gain = F.col("issues_before") - F.col("issues_after")
    return page_reports.withColumn("improvement", gain).orderBy(F.desc("improvement"), F.desc("issues_before"), "page_id")


def most_improved(page_reports: DataFrame, top: int = 5) -> DataFrame:
    """Of each course the ``top`` pages that lost most issues; pages without a gain aren't shown. Ties stand by id."""
    order = Window.partitionBy("course_id").orderBy(F.desc("improvement"), "page_id")
    gained = page_reports.withColumn("improvement", F.col("issues_before") - F.col("issues_after")).where("improvement > 0")
    return gained.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def suggestion_groups(suggestions: DataFrame) -> DataFrame:
    """Suggestions by rule, the largest groups first, then by rule."""
    return suggestions.groupBy("rule_id").agg(F.count("*").alias("suggestions"), F.count_distinct("page_id").alias("pages")).orderBy(F.desc("suggestions"), "rule_id")
