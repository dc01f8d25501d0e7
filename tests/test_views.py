"""Views, prompts, slugs, scrubbed documents, suggestions by path, and the one-walk parse."""

import json
import time

from pyspark.sql import functions as F

from lumenpage.functions import text as T
from lumenpage.operators import convert, prompts, suggest
from lumenpage.plans import cases, views
from lumenpage.sources.elements import element_rows, list_runs
from lumenpage.sources.dom import parse


def test_slugs_do_not_collide(spark):
    rows = [("x", "a", "1"), ("x", "a", "2"), ("x", "a 2", "3"), ("x", "!!", "4"), ("x", "b", "5"), ("y", "A", "1")]
    titles = spark.createDataFrame(rows, "archive string, title string, resolved_path string")
    taken = spark.createDataFrame([("x", "wiki_content/b.html"), ("z", "wiki_content/a.html")], "archive string, file string")
    got = {(r["archive"], r["resolved_path"]): r["slug"] for r in convert.unique_slugs(titles, taken=taken).collect()}
    assert got == {("x", "1"): "a", ("x", "2"): "a-2", ("x", "3"): "a-2-2", ("x", "4"): "converted-document", ("x", "5"): "b-2", ("y", "1"): "a"}
    assert convert.unique_slugs(titles.limit(0)).count() == 0
    assert len({r["slug"] for r in convert.unique_slugs(titles.where("archive = 'x'")).collect()}) == 5


def test_documents_are_scrubbed_at_any_depth(spark):
    inside = {"a": ["me@x.org", {"b": "/Users/ann/file", "c": 3}], "me@x.org": None}
    rows = spark.createDataFrame([(json.dumps(inside),), ("no json me@x.org",), (None,)], "d string")
    got = [r[0] for r in rows.select(T.scrubbed_json(F.col("d"))).collect()]
    assert json.loads(got[0]) == {"a": ["<email>", {"b": "<home>/file", "c": 3}], "me@x.org": None}
    assert got[1:] == ["no json <email>", None]


def test_addresses_of_criteria(spark):
    got = spark.createDataFrame([("1.4.3",), ("",), (None,)], "c string").select(T.wcag_url(F.col("c")), T.criterion_url(F.col("c"))).collect()
    assert got[0][0].endswith("#:~:text=1.4.3") and got[0][1].endswith("/143") and got[1][0] == got[2][0] == ""


def test_views_are_in_order(spark):
    pages = spark.createDataFrame([("c", "a", 5, 1), ("c", "b", 9, 5), ("c", "d", 3, 3), ("c", "e", 9, 4)], "course_id string, page_id string, issues_before int, issues_after int")
    assert [r["page_id"] for r in views.by_improvement(pages).collect()] == ["e", "b", "a", "d"]
    assert [(r["page_id"], r["rank"]) for r in views.most_improved(pages, 2).orderBy("rank").collect()] == [("e", 1), ("a", 2)]
    found = spark.createDataFrame([("LNK004", "p"), ("IMG001", "p"), ("LNK004", "q"), ("CLR001", "p")], "rule_id string, page_id string")
    assert [r["rule_id"] for r in views.suggestion_groups(found).collect()] == ["LNK004", "CLR001", "IMG001"]


def test_prompts_are_one_for_each_row(spark):
    rows = spark.createDataFrame([("t" * 900, "here", "/x", ""), ("u", "link", None, "a page")], "text string, link string, href string, context string")
    got = rows.select(
        prompts.for_heading(F.col("text")).alias("h"), prompts.for_link(F.col("link"), F.col("href"), F.col("text")).alias("l"), prompts.for_alt_text(F.col("context")).alias("a"),
        prompts.for_choice(F.array(F.struct("link")), F.col("context")).alias("c"), prompts.for_document(F.col("text"), F.lit("12: H2"), F.lit(0), F.lit(3)).alias("d"),
    ).collect()
    assert got[0]["h"].count("t" * 500) == 1 and "t" * 501 not in got[0]["h"] and "t" * 301 not in got[0]["l"]
    assert "a page" in got[1]["a"] and "stands in" not in got[0]["a"] and '{"link":"here"}' in got[0]["c"] and got[0]["d"].startswith("Page 1 of 3.")


def test_suggestions_find_their_page_by_path_then_identifier(spark):
    pages = spark.createDataFrame([("p1", "i1", "f1.html", '<img src="a">'), ("p2", "i2", None, '<img src="a">'), ("p3", "i3", "f3.html", '<img src="a">')], "page_id string, identifier string, file_path string, html string")
    rows = [("1", "i9", "f1.html", "one"), ("2", "i2", "", "two"), ("3", "", None, "none"), ("4", "i3", None, "four")]
    found = spark.createDataFrame(
        [(i, "IMG001", t, '<img src="a">', {}, p, f) for i, p, f, t in rows], "id string, rule_id string, proposed_text string, original_html string, metadata map<string,string>, page_id string, page_file_path string"
    )
    got = {r["page_id"]: (r["applied"], r["html"]) for r in suggest.apply_all(pages, found).collect()}
    assert {p: n for p, (n, _) in got.items()} == {"p1": 1, "p2": 1, "p3": 1} and 'alt="four"' in got["p3"][1]


def test_deep_pages_take_time_in_proportion():
    began = time.perf_counter()
    rows = element_rows("<div>" * 3000 + "x" + "</div>" * 3000)
    assert len(rows) == 3001 and time.perf_counter() - began < 5
    assert rows[1]["below"] == [("div", 2999)] and rows[-1]["above"] == ["div"] and rows[1]["text"] == "x"


def test_runs_of_list_paragraphs_stop_where_the_list_does():
    def sizes(html):
        return [len(lines) if lines else len(run) for run, lines in list_runs(parse(html))]

    assert sizes("<p>1. a</p><br><p>2. b</p><p></p><p>3. c</p>x<p>4. d</p>") == [3]
    assert sizes("<p>1. a</p><p></p><br><p>2. b</p>") == []
    assert sizes("<p>- a</p><div>x</div><p>- b</p><p>- c</p>") == [2]
    assert sizes("<p>- a<br>- b</p><p>1. a</p><p>2. b</p>") == [2, 2]


def test_texts_of_templates_are_sql_of_both_dialects():
    assert cases.expression("a'b\\c@{x + 1}@") == "'a''b' || chr(92) || 'c' || CAST((x + 1) AS STRING)"
