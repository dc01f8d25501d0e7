"""From pages to issues, and from issues to counts, scores, criteria and reports.

Everything after the parse is DataFrame code. Tables of criteria and rules have
tens of rows and are broadcast; aggregates of issues are per course.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenpage.operators.rules import PAGE_RULES, Rule, findings
from lumenpage.plans import dims
from lumenpage.sources.elements import elements, help_hrefs

#: Weight of a warning, pages' density that divides the score by e, and issues that halve a partial credit.
WARNING_WEIGHT, DENSITY_SCALE, HALF_LIFE = 0.25, 4.0, 20.0
SUPPORTS, PARTIAL, FAILS, NOT_APPLICABLE = "Supports", "Partially Supports", "Does Not Support", "Not Applicable"
HELP_PAGES = 2


def help_findings(linked: DataFrame) -> DataFrame:
    """Pages without a help link that the footers of at least two pages of their course share; from ``help_hrefs`` or whole elements.

    Conventions are few hrefs a course; the join is on (course, href) with an
    aggregate of them, and pages whose course has none drop out.
    """
    if "page" in linked.columns:
        linked = linked.where("nid = 0").withColumn("href", F.col("page.help_href"))
    pages = linked.select("course_id", "page_id", "identifier", "title", "content_type", "canvas_url", F.nullif("href", F.lit("")).alias("href"))
    counts = pages.where("href IS NOT NULL").groupBy("course_id", "href").agg(F.count("*").alias("n")).where(F.col("n") >= HELP_PAGES)
    best = counts.groupBy("course_id").agg(F.min_by("href", F.struct(-F.col("n"), "href")).alias("canonical"), F.max("n").alias("most"))
    flagged = pages.join(counts.select("course_id", "href"), ["course_id", "href"], "left_anti").join(best.select("course_id", "canonical", "most"), "course_id")
    message = F.concat(F.lit("This page is missing the course-wide help link ("), "canonical", F.lit(") that appears in the footer of "), F.col("most").cast("string"), F.lit(" other pages."))
    return flagged.select("course_id", "page_id", "identifier", "title", "content_type", "canvas_url", F.lit("HELP001").alias("rule"), F.lit(0).alias("nid"), F.lit(0).alias("seq"), message.alias("message"), F.lit(None).cast("string").alias("html"))


def to_issues(found: DataFrame, more: tuple[Rule, ...] = ()) -> DataFrame:
    """Findings with what their rules say of them, in the issue schema. Ids are made of course, page, rule and place."""
    rules = F.broadcast(dims.rules(found.sparkSession, more))
    issue_id = F.sha2(F.concat_ws("|", F.coalesce("course_id", F.lit("")), "page_id", "rule_id", "nid", "seq", F.xxhash64("message")), 256)
    return found.withColumnRenamed("rule", "rule_id").join(rules, "rule_id").select(
        issue_id.alias("id"), "course_id", "rule_id", "severity", "category", "wcag_criterion", "message", "page_id", F.col("identifier").alias("page_identifier"), F.col("title").alias("page_title"),
        "content_type", "canvas_url", F.col("html").alias("element_html"), "can_auto_fix", "fix_description", F.lit("course_content").alias("source"),
        F.lit(None).cast("struct<fg_color:string,bg_color:string,contrast_ratio:double,expected_ratio:string,font_size:string,font_weight:string,target:string>").alias("axe_meta"), "rule_ord", "nid", "seq",
    )


def issues(pages: DataFrame, course_rules: bool = False, more_rules: tuple[Rule, ...] = (), more: tuple[Callable[[], list[Column]], ...] = (), only: set[str] | None = None) -> DataFrame:
    """Issues of all page rules; with ``course_rules``, of the rules that compare the pages of a course as well.

    A user's own rules are described by ``more_rules`` and found by ``more``.
    With ``only``, issues of these page rules alone, without working out others.
    """
    found = findings(elements(pages, page_facts=only is None or bool(only & set(PAGE_RULES)) or bool(more)), more, only)
    if course_rules:
        found = found.unionByName(help_findings(help_hrefs(pages)))
    return to_issues(found, more_rules)


def configured(found: DataFrame, config: DataFrame) -> DataFrame:
    """Issues under a configuration (rule_id, enabled, severity_override): rules that are off go, severities are replaced."""
    rows = F.broadcast(config.select("rule_id", "enabled", "severity_override"))
    joined = found.join(rows, "rule_id", "left").where(F.coalesce("enabled", F.lit(True)))
    return joined.withColumn("severity", F.coalesce("severity_override", "severity")).select(found.columns)


def by_category(found: DataFrame, category: str) -> DataFrame:
    return found.where(F.col("category") == category)


def auto_fixable(found: DataFrame) -> DataFrame:
    return found.where("can_auto_fix")


def page_counts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Issues per page, of pages without any as well, and the sorted rules that found them."""
    counts = found.groupBy("course_id", "page_id").agg(
        F.count("*").alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("info"), F.array_sort(F.collect_set("rule_id")).alias("rules"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("issues", "errors", "warnings", "info")]
    return pages.select("course_id", "page_id", "title").join(counts, ["course_id", "page_id"], "left").select("course_id", "page_id", "title", *zero, F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


def course_report(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Totals per course, with its score and band."""
    totals = found.groupBy("course_id").agg(
        F.count("*").alias("total_issues"), *(F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "info"))),
        F.count_if(F.col("rule_id").isin("IMG001", "IMG002") & (F.col("source") == "course_content")).alias("images_needing_alt"),
    )
    out = pages.groupBy("course_id").agg(F.count("*").alias("pages_analyzed")).join(totals, "course_id", "left")
    names = ("total_issues", "errors", "warnings", "info", "images_needing_alt")
    out = out.select("course_id", "pages_analyzed", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    return out.withColumn("score", score(F.col("errors"), F.col("warnings"), F.col("pages_analyzed"))).withColumn("band", band(F.col("score")))


def score(errors: Column, warnings: Column, pages: Column) -> Column:
    return F.when(pages <= 0, 100.0).otherwise(F.bround(100 * F.exp(-((errors + WARNING_WEIGHT * warnings) / pages) / DENSITY_SCALE), 1))


def band(value: Column) -> Column:
    return F.when(value >= 90, "excellent").when(value >= 70, "good").when(value >= 40, "needs_work").otherwise("poor")


def credit(conformance: Column, count: Column) -> Column:
    return F.when(conformance == SUPPORTS, 1.0).when(conformance == PARTIAL, 0.5 * F.pow(F.lit(0.5), count / HALF_LIFE)).otherwise(0.0)


def conformance_from_counts(failing: Column, total: Column) -> Column:
    return F.when(total == 0, NOT_APPLICABLE).when(failing == 0, SUPPORTS).when(failing == total, FAILS).otherwise(PARTIAL)


def criteria_rollup(pages: DataFrame, found: DataFrame, file_entries: DataFrame | None = None) -> DataFrame:
    """Per course and criterion of levels A and AA: conformance, counts, the three commonest rules, and sample pages.

    ``file_entries`` (course_id, file_id, is_pdf, status, ...) adds an issue of 1.3.1 for each PDF that failed its check.
    """
    rows = found.select("course_id", "wcag_criterion", "page_id", "source", "rule_id", "rule_ord")
    if file_entries is not None:
        failed = file_entries.where("is_pdf AND status = 'failed'")
        rows = rows.unionByName(failed.select("course_id", F.lit("1.3.1").alias("wcag_criterion"), F.col("file_id").cast("string").alias("page_id"), F.lit("course_content").alias("source"), F.lit("PDF_CHECK").alias("rule_id"), F.lit(9999).alias("rule_ord")))
    own = F.col("source") == "course_content"
    # by rule first: partial sums before the shuffle, then a few rows per criterion
    by_rule = rows.groupBy("course_id", "wcag_criterion", "rule_id").agg(F.count("*").alias("n"), F.min("rule_ord").alias("ord"), F.count_if(own).alias("own_n"))
    ranked = by_rule.withColumn("k", F.row_number().over(Window.partitionBy("course_id", "wcag_criterion").orderBy(F.desc("n"), "ord", "rule_id")))
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "rule_id", "n")))), lambda t: F.concat(t["rule_id"], F.lit(" ("), t["n"].cast("string"), F.lit(")")))
    tops = ranked.groupBy("course_id", "wcag_criterion").agg(F.array_join(told, ", ").alias("top"), F.sum("n").alias("issue_count"), F.sum("own_n").alias("own_count"))
    touched = rows.groupBy("course_id", "wcag_criterion", "page_id").agg(F.max(own).alias("own")).groupBy("course_id", "wcag_criterion").agg(
        F.count("*").alias("pages_affected"), F.count_if("own").alias("own_pages"), F.slice(F.array_sort(F.collect_set("page_id")), 1, 3).alias("sample_artifacts")
    )
    counts = tops.join(touched, ["course_id", "wcag_criterion"]).withColumnRenamed("wcag_criterion", "criterion_id")
    courses = pages.groupBy("course_id").agg(F.count("*").alias("pages_analyzed"))
    # every course has a row for each of the 48 criteria: an array of them explodes, no join is needed for that
    known = F.array(*(F.struct(F.lit(i).alias("criterion_id"), F.lit(n).alias("name"), F.lit(v).alias("level")) for i, n, v in dims.criteria_rows()))
    grid = courses.select("course_id", "pages_analyzed", F.inline(known))
    out = grid.join(counts, ["course_id", "criterion_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("course_id", "criterion_id", "name", "level", "pages_analyzed", *(zero(c).alias(c) for c in ("issue_count", "own_count", "pages_affected", "own_pages")), F.coalesce("top", F.lit("")).alias("top"), F.coalesce("sample_artifacts", F.array().cast("array<string>")).alias("sample_artifacts"))
    conformance = F.when(F.col("own_count") == 0, SUPPORTS).when((F.col("pages_analyzed") > 0) & (F.col("own_pages") == F.col("pages_analyzed")), FAILS).otherwise(PARTIAL)
    out = out.withColumn("conformance", conformance)
    platform = F.col("issue_count") - F.col("own_count")
    said = (
        F.when(F.col("conformance") == SUPPORTS, F.concat(F.lit("All content meets "), "criterion_id", F.lit(" "), "name", F.lit(". No issues detected.")))
        .when(F.col("conformance") == FAILS, F.concat(F.lit("Content does not meet "), "criterion_id", F.lit(". "), F.col("issue_count").cast("string"), F.lit(" issues found: "), "top", F.lit(".")))
        .otherwise(F.concat(F.lit("Content partially meets "), "criterion_id", F.lit(". "), F.col("issue_count").cast("string"), F.lit(" issues across "), F.col("pages_affected").cast("string"), F.lit(" pages: "), "top", F.lit(".")))
    )
    suffix = F.when(platform > 0, F.concat(F.lit(" ("), F.col("own_count").cast("string"), F.lit(" in course content, "), platform.cast("string"), F.lit(" in platform)"))).otherwise("")
    return out.select("course_id", "criterion_id", "name", "level", "conformance", F.concat(said, suffix).alias("remarks"), "issue_count", "pages_affected", "sample_artifacts", "top")


def conformance_summary(rollup: DataFrame) -> DataFrame:
    """Per course: the share of credit, the overall status, and counts by level and conformance."""
    counted = F.col("conformance") != NOT_APPLICABLE
    is_ = lambda level, c: F.count_if((F.col("level") == level) & (F.col("conformance") == c))
    names = ((SUPPORTS, "supports"), (PARTIAL, "partial"), (FAILS, "not_supported"))
    return rollup.groupBy("course_id").agg(
        F.coalesce(F.bround(F.avg(F.when(counted, credit(F.col("conformance"), F.col("issue_count")))) * 100, 1), F.lit(0.0)).alias("conformance_pct"),
        F.when(F.count("*") == 0, NOT_APPLICABLE).when(F.bool_or(F.col("conformance").isin(FAILS, PARTIAL)), PARTIAL).otherwise(SUPPORTS).alias("overall_status"),
        F.count("*").alias("criteria_count"),
        *(is_(level, c).alias(f"level_{level.lower()}_{n}") for level in ("A", "AA") for c, n in names),
    )


def evidence(found: DataFrame) -> DataFrame:
    """Per page its findings in order; the first gives title and address. ``remediation_applied`` says what could be applied."""
    finding = F.struct("rule_ord", "nid", "seq", "rule_id", "wcag_criterion", "severity", "message", "element_html", F.col("can_auto_fix").alias("remediation_applied"), F.col("fix_description").alias("remediation_notes"))
    first = F.struct("rule_ord", "nid", "seq")
    return found.groupBy("course_id", "page_id").agg(
        F.min_by(F.coalesce("page_identifier", "page_id"), first).alias("title"), F.min_by(F.coalesce("canvas_url", F.lit("")), first).alias("canvas_url"), F.sort_array(F.collect_list(finding)).alias("findings")
    )


def skip_reason(raw: Column) -> Column:
    low = F.lower(raw)
    any_of = lambda *words: low.rlike("|".join(words))
    return F.when(any_of("keyword", "textbook", "catalog", "manual"), "reference-doc keyword").when(low.contains("pages") & low.contains("threshold"), "oversized PDF").when(any_of("conversion failed", "error"), "conversion error").otherwise("other")


def file_outcomes(entries: DataFrame) -> DataFrame:
    """Per course: files by what became of them, and reasons for skipped ones, commonest first."""
    reasons = entries.where("remediation_status = 'skipped' AND skip_reason <> ''").groupBy("course_id", skip_reason(F.col("skip_reason")).alias("reason")).agg(F.count("*").alias("n"))
    listed = reasons.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason", "n"))).alias("reasons"))
    counts = entries.groupBy("course_id").agg(*(F.count_if(F.col("remediation_status") == s).alias(s) for s in ("converted", "pdf_fixed", "audit_passed", "skipped")))
    return counts.join(listed, "course_id", "left").withColumn("reasons", F.transform(F.coalesce("reasons", F.array().cast("array<struct<k:bigint,reason:string,n:bigint>>")), lambda r: F.struct(r["reason"].alias("reason"), r["n"].alias("n"))))


def acr(pages: DataFrame, found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One nested row per course: criteria, totals, and, with issues from before a repair, how many went."""
    rollup = criteria_rollup(pages, found)
    criteria = rollup.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct("criterion_id", "name", "level", "conformance", "remarks", "issue_count", "pages_affected", "sample_artifacts"))).alias("criteria"))
    out = course_report(pages, found).join(conformance_summary(rollup), "course_id").join(criteria, "course_id")
    if before is None:
        return out.withColumn("issues_before", F.lit(0).cast("long")).withColumn("issues_fixed", F.lit(0).cast("long"))
    old = before.groupBy("course_id").agg(F.count("*").alias("issues_before"))
    out = out.join(old, "course_id", "left").withColumn("issues_before", F.coalesce("issues_before", F.lit(0)))
    return out.withColumn("issues_fixed", F.greatest(F.lit(0), F.col("issues_before") - F.col("total_issues")))


def acr_markdown(report: DataFrame) -> DataFrame:
    """(course_id, value): the report as Markdown."""
    line = lambda c: F.concat(F.lit("| "), c["criterion_id"], F.lit(" "), c["name"], F.lit(" | "), c["level"], F.lit(" | "), c["conformance"], F.lit(" | "), c["issue_count"].cast("string"), F.lit(" | "), c["pages_affected"].cast("string"), F.lit(" |"))
    detail = lambda c: F.concat(F.lit("### "), c["criterion_id"], F.lit(" "), c["name"], F.lit("\n\n"), c["remarks"])
    open_ = F.filter("criteria", lambda c: c["conformance"] != SUPPORTS)
    parts = F.array(
        F.lit("# Accessibility Conformance Report\n"), F.concat(F.lit("**Course:** "), "course_id"), F.concat(F.lit("**Status:** "), "overall_status"), F.concat(F.lit("**Conformance:** "), F.col("conformance_pct").cast("string"), F.lit(" %\n")),
        F.lit("| Criterion | Level | Status | Issues | Pages Affected |\n|-----------|-------|--------|--------|----------------|"),
        F.array_join(F.transform("criteria", line), "\n"), F.lit("\n## Detailed Remarks\n"), F.array_join(F.transform(open_, detail), "\n\n"),
    )
    return report.select("course_id", F.array_join(parts, "\n").alias("value"))


def acr_json(report: DataFrame) -> DataFrame:
    return report.select("course_id", F.to_json(F.struct(*report.columns)).alias("value"))


def acr_html(report: DataFrame) -> DataFrame:
    """(course_id, value): the report as a page."""
    cell = lambda c: F.concat(F.lit("<td>"), html_escape(c.cast("string")), F.lit("</td>"))
    row = lambda c: F.concat(F.lit("<tr>"), cell(c["criterion_id"]), cell(c["name"]), cell(c["level"]), cell(c["conformance"]), cell(c["issue_count"]), cell(c["remarks"]), F.lit("</tr>"))
    head = "<table><thead><tr>" + "".join(f'<th scope="col">{h}</th>' for h in ("Criterion", "Name", "Level", "Status", "Issues", "Remarks")) + "</tr></thead><tbody>"
    page = F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Accessibility Conformance Report</title></head><body><h1>Accessibility Conformance Report</h1><p>'),
        html_escape(F.col("course_id")), F.lit("</p>"), F.lit(head), F.array_join(F.transform("criteria", row), ""), F.lit("</tbody></table></body></html>"),
    )
    return report.select("course_id", page.alias("value"))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def dashboard(found: DataFrame, report: DataFrame, top: int = 5) -> DataFrame:
    """One row over all courses: totals, mean score, and the commonest rules."""
    tops = found.groupBy("rule_id", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(top)
    listed = tops.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "rule_id", "n", "severity"))).alias("top_issues"))
    totals = report.agg(F.count("*").alias("courses"), F.sum("pages_analyzed").alias("pages"), F.sum("total_issues").alias("issues"), F.sum("errors").alias("errors"), F.bround(F.avg("score"), 1).alias("mean_score"))
    return totals.crossJoin(F.broadcast(listed))  # one row by one row


def run_summary(page_reports: DataFrame) -> DataFrame:
    """Per course, of pages with counts before and after a repair: totals and the reduction in percent."""
    return page_reports.groupBy("course_id").agg(
        F.count("*").alias("pages"), F.count_if("changed").alias("pages_changed"), F.sum("issues_before").alias("issues_before"), F.sum("issues_after").alias("issues_after")
    ).withColumn("issues_fixed", F.greatest(F.lit(0), F.col("issues_before") - F.col("issues_after"))).withColumn("reduction_pct", F.bround(100.0 * F.col("issues_fixed") / F.greatest(F.col("issues_before"), F.lit(1)), 1))
