"""Reports, scores, help links, rendered results and structures."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenpage.functions import colors
from lumenpage.functions import text as T
from lumenpage.operators import documents as D
from lumenpage.plans import dims, report
from lumenpage.schema import ISSUES
from lumenpage.sources.elements import elements

PAGES = "course_id string, page_id string, identifier string, title string, content_type string, canvas_url string, html string"


def page(i, html, course="c"):
    return (course, str(i), str(i), f"Page {i}", "wiki_page", f"/p/{i}", html)


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [page(1, "<h1>a</h1><a href=1>x</a><a href=2>x</a>"), page(2, "<h1>b</h1>"), page(3, "<p>fine</p>"), page(1, "<h2>ok</h2>", "d")]
    pages = spark.createDataFrame(rows, PAGES).cache()
    return pages, report.issues(pages).cache()


def test_issue_rows_have_the_schema_and_stable_ids(spark, scanned):
    _, issues = scanned
    want = spark.createDataFrame([], ISSUES).schema
    assert [(f.name, f.dataType) for f in issues.schema] == [(f.name, f.dataType) for f in want]
    assert issues.select("id").distinct().count() == issues.count() == 4


def test_course_report_and_pages(scanned):
    pages, issues = scanned
    rows = {r["course_id"]: r for r in report.course_report(pages, issues).collect()}
    assert (rows["c"]["errors"], rows["c"]["warnings"], rows["c"]["pages_analyzed"]) == (2, 2, 3)
    assert rows["c"]["score"] == round(100 * math.exp(-(2.5 / 3) / 4), 1) and rows["c"]["band"] == "good"
    assert (rows["d"]["score"], rows["d"]["band"]) == (100.0, "excellent")
    counts = {(r["course_id"], r["page_id"]): (r["issues"], r["rules"]) for r in report.page_counts(pages, issues).collect()}
    assert counts[("c", "1")] == (3, ["HDG001", "LNK010"]) and counts[("c", "3")] == (0, [])


def test_scores_bands_and_credit(spark):
    rows = spark.createDataFrame([(0, 0, 10), (0, 0, 0), (5, 4, 3)], "e long, w long, p long")
    assert [r[0] for r in rows.select(report.score(F.col("e"), F.col("w"), F.col("p"))).collect()] == [100.0, 100.0, round(100 * math.exp(-(6 / 3) / 4), 1)]
    bands = spark.createDataFrame([(90.0,), (70.0,), (40.0,), (39.9,)], "s double").select(report.band(F.col("s"))).collect()
    assert [b[0] for b in bands] == ["excellent", "good", "needs_work", "poor"]
    credit = spark.range(1).select(*(report.credit(F.lit("Partially Supports"), F.lit(n)) for n in (0, 20))).first()
    assert tuple(credit) == (0.5, 0.25)
    counts = spark.createDataFrame([(0, 0), (0, 3), (3, 3), (1, 3)], "f int, t int").select(report.conformance_from_counts(F.col("f"), F.col("t"))).collect()
    assert [c[0] for c in counts] == ["Not Applicable", "Supports", "Does Not Support", "Partially Supports"]


def test_rollup_conformance_and_exports(spark, scanned):
    pages, issues = scanned
    rollup = report.criteria_rollup(pages, issues)
    assert rollup.count() == 2 * 48 == 2 * dims.criteria(spark).count()
    row = rollup.where("course_id = 'c' AND criterion_id = '1.3.1'").first()
    assert (row["conformance"], row["issue_count"], row["pages_affected"], row["sample_artifacts"]) == ("Partially Supports", 2, 2, ["1", "2"])
    assert row["remarks"] == "Content partially meets 1.3.1. 2 issues across 2 pages: HDG001 (2)."
    assert report.conformance_summary(rollup).where("course_id = 'd'").first()["conformance_pct"] == 100.0
    acr = report.acr(pages, issues, before=issues.union(issues))
    first = acr.where("course_id = 'c'").first()
    assert (first["issues_before"], first["issues_fixed"], len(first["criteria"]), first["overall_status"]) == (8, 4, 48, "Partially Supports")
    assert "| 1.3.1 Info and Relationships | A | Partially Supports | 2 | 2 |" in report.acr_markdown(acr).where("course_id = 'c'").first()["value"]
    assert json.loads(report.acr_json(acr).first()["value"])["criteria"]
    assert "<td>1.3.1</td>" in report.acr_html(acr).first()["value"]
    assert report.dashboard(issues, report.course_report(pages, issues)).first()["top_issues"][0]["rule_id"] in ("HDG001", "LNK010")
    assert len(report.evidence(issues).where("page_id = '1'").first()["findings"]) == 3


def test_files_and_configuration(spark, scanned):
    pages, issues = scanned
    entries = spark.createDataFrame(
        [("c", 7, True, "failed", "skipped", "Matched keyword textbook"), ("c", 8, True, "ok", "converted", None), ("c", 9, False, "failed", "skipped", "over 50 pages threshold"), ("c", 10, True, "ok", "skipped", "odd")],
        "course_id string, file_id int, is_pdf boolean, status string, remediation_status string, skip_reason string",
    )
    row = report.criteria_rollup(pages, issues, entries).where("course_id = 'c' AND criterion_id = '1.3.1'").first()
    assert row["issue_count"] == 3 and "PDF_CHECK (1)" in row["remarks"]
    out = report.file_outcomes(entries).first()
    assert (out["converted"], out["skipped"], [r["reason"] for r in out["reasons"]]) == (1, 3, ["other", "oversized PDF", "reference-doc keyword"])
    config = spark.createDataFrame([("HDG001", False, None), ("LNK010", True, "error")], "rule_id string, enabled boolean, severity_override string")
    assert [(r["rule_id"], r["severity"]) for r in report.configured(issues, config).collect()] == [("LNK010", "error")] * 2
    assert report.auto_fixable(issues).count() == 4 and report.by_category(issues, "links").count() == 2
    assert dims.rule_mapping()["LNK007"] == "1.3.1" and "DID001" not in dims.rule_mapping() and dims.guides(spark).count() == 66


def test_help_links(spark):
    footer = "<footer><a href='/help'>Help</a></footer>"
    pages = spark.createDataFrame([page(1, footer), page(2, footer), page(3, "<footer><a href='/faq'>FAQ</a></footer>"), page(4, "<p>x</p>"), page(5, None), page(1, "<p>x</p>", "d")], PAGES)
    rows = report.help_findings(elements(pages)).collect()
    assert sorted(r["page_id"] for r in rows) == ["3", "4", "5"] and all("(/help)" in r["message"] and "2 other pages" in r["message"] for r in rows)


def test_rendered_results(spark):
    node = lambda target, data=None: {"target": [target], "html": "<i>", "any": [{"data": data}] if data else []}
    colors_ = {"fgColor": "#777777", "bgColor": "#888888", "contrastRatio": 1.2, "expectedContrastRatio": "4.5:1", "fontSize": "12.0pt (16px)", "fontWeight": "normal"}
    violations = [{"id": "color-contrast", "impact": "serious", "help": "h", "tags": ["cat.color", "wcag2aa", "wcag143"], "nodes": [node("#content .x", colors_), node("#header")]}, {"id": "new-rule", "impact": "odd", "help": "", "description": "d", "tags": [], "nodes": [node(".zzz")]}]
    df = spark.createDataFrame([("c", "p", "/u", json.dumps(v)) for v in violations], "course_id string, page_id string, page_url string, violation string")
    rows = sorted(D.rendered_issues(df).collect(), key=lambda r: r["id"])
    assert [(r["rule_id"], r["severity"], r["category"], r["wcag_criterion"], r["source"], r["can_auto_fix"]) for r in rows] == [
        ("AXE_NEW_RULE", "warning", "structure", "", "canvas_platform", False), ("CLR001", "error", "contrast", "1.4.3", "course_content", True), ("CLR001", "error", "contrast", "1.4.3", "canvas_platform", False),
    ]
    assert rows[1]["axe_meta"]["fg_color"] == "#777777" and rows[2]["axe_meta"] is None and rows[0]["message"] == "d"


def test_documents_chapters_and_structures(spark):
    html = "<a href='$IMS-CC-FILEBASE$/My%20Doc.pdf'>a</a><a href='https://x.org/a%2Bb.PDF?x=1'>long text</a><a href='https://x.org/a+b.PDF'>t</a><a href='rel.pdf'>r</a><a href='x.txt'>n</a>"
    parsed = elements(spark.createDataFrame([page(1, html), page(2, "<a href='$IMS-CC-FILEBASE$/My%20Doc.pdf' title='Longer title'>a</a>")], PAGES))
    rows = {r["key"]: r for r in D.link_inventory(parsed).collect()}
    assert rows["web_resources/My Doc.pdf"]["source_page_ids"] == ["1", "2"] and rows["web_resources/My Doc.pdf"]["display_text"] == "Longer title"
    assert rows["https://x.org/a+b.PDF"]["original_hrefs"] == ["https://x.org/a%2Bb.PDF?x=1", "https://x.org/a+b.PDF"] and len(rows) == 2
    assert {(r["filename"], r["is_external"]) for r in D.document_links(parsed, "x.org").collect()} == {("my%20doc.pdf", False), ("a%2bb.pdf", False), ("a+b.pdf", False), ("rel.pdf", False)}
    items = spark.createDataFrame([("d", 1, "Title", 0.0, 0.0, 18.0), ("d", 1, "body text that is long", 0.0, 20.0, 10.0), ("d", 1, "left", 5.0, 1.0, 12.1)], "doc string, page_num int, text string, x double, y double, font_size double")
    sizes = D.heading_map(items)
    assert {(r["size"], r["level"]) for r in sizes.collect()} == {(18.0, 2), (12.0, 3)}
    assert D.reading_order(items, sizes).first()["text"] == "[H2] Title\n[H3] left\nbody text that is long"
    pages = spark.createDataFrame([("d", k, k in (3, 6)) for k in range(1, 9)] + [("e", k, False) for k in range(1, 23)], "doc string, page_num int, starts boolean")
    got = {(r["doc"], r["page_num"]): r["chapter"] for r in D.chapters(pages).collect()}
    assert [got["d", k] for k in range(1, 9)] == [0, 0, 1, 1, 1, 2, 2, 2] and (got["e", 20], got["e", 21]) == (1, 2)
    chunks = spark.createDataFrame([("a b\nc d e\nf",), ("",)], "t string").select(D.word_chunks(F.col("t"), 3)).collect()
    assert [c[0] for c in chunks] == [["a b", "c d e", "f"], [""]]
    garbage = spark.createDataFrame([("ab",), ("1 - 2.3",), ("Chapter one",), ("xqzt words",), ("HTML",)], "t string").select(D.garbage_heading(F.col("t"))).collect()
    assert [g[0] for g in garbage] == [True, True, False, True, False]
    modules = spark.createDataFrame([("m1", []), ("m2", [("a", 2), (" ", 1)])], "name string, items array<struct<title:string,position:int>>")
    rubrics = spark.createDataFrame([("r", [("",), ("x",)])], "title string, data array<struct<description:string>>")
    found = D.structure_issues(modules, rubrics)
    assert sorted(r["category"] for r in found.collect()) == ["modules", "modules", "navigation", "rubrics"]
    assert D.structure_score(found).first()["score"] == 81.0


@settings(max_examples=150, deadline=None)
@given(st.tuples(*[st.integers(0, 255)] * 3), st.tuples(*[st.integers(0, 255)] * 3), st.sampled_from([3.2, 4.5, 4.7]))
def test_adjusted_colours_reach_the_target_or_the_end(fg, bg, target):
    new = colors.adjusted(fg, bg, target)
    assert colors.contrast(new, bg) >= target or new in ((0, 0, 0), (255, 255, 255))


def test_colour_columns_equal_single_values(spark):
    import random

    rng = random.Random(1)
    rows = [tuple(rng.randrange(256) for _ in range(6)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f int").select(F.struct(*(F.col(x).alias(y) for x, y in zip("abc", "rgb"))).alias("fg"), F.struct(*(F.col(x).alias(y) for x, y in zip("def", "rgb"))).alias("bg"))
    got = df.select(T.contrast(F.col("fg"), F.col("bg")), T.adjusted(F.col("fg"), F.col("bg"), 4.5), T.adjusted(F.col("bg"), F.col("fg"), 4.5, foreground=False)).collect()
    for row, (ratio, front, back) in zip(rows, got):
        assert abs(ratio - colors.contrast(row[:3], row[3:])) < 1e-9
        assert tuple(front) == colors.adjusted(row[:3], row[3:], 4.5) and tuple(back) == colors.adjusted(row[3:], row[:3], 4.5, foreground=False)


def test_the_search_for_a_colour_looks_light_up(spark):
    df = spark.createDataFrame([(1, 2, 3)], "r int, g int, b int").select(F.struct("r", "g", "b").alias("fg"), F.struct("b", "g", "r").alias("bg"))
    plan = df.select(T.adjusted(F.col("fg"), F.col("bg"), 4.5).alias("new"))._jdf.queryExecution().optimizedPlan().toString()
    assert "POWER" in plan and "POWER" not in plan[plan.index("aggregate(") :]


def test_streams_scan_pages_and_trends(spark, tmp_path):
    from lumenpage.streaming.monitor import issue_stream, page_stream, score_trend, write_issues

    rows = [("c", "1", "1", "T", "wiki_page", "f", None, "<h1>x</h1>"), ("c", "2", "2", "T", "wiki_page", "f", None, "<h2>x</h2>")]
    spark.createDataFrame(rows, "course_id string, page_id string, identifier string, title string, content_type string, file_path string, canvas_url string, html string").write.parquet(f"{tmp_path}/in")
    query = write_issues(issue_stream(page_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert [r["rule_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["HDG001"]
    reports = spark.createDataFrame([("c", "2024-01-01 01:00:00", 1, 0, 2), ("c", "2024-01-01 05:00:00", 0, 4, 2)], "course_id string, at string, errors long, warnings long, pages long").withColumn("analyzed_at", F.to_timestamp("at"))
    assert score_trend(reports).first()["score"] == round(100 * math.exp(-(2 / 4) / 4), 1)
