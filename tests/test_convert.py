"""Conversions, other formats, image texts, and the public calls."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenpage import api
from lumenpage.operators import convert
from lumenpage.plans import report


def test_documents_become_pages_and_links_follow(spark):
    docs = spark.createDataFrame([("a", "x/One.pdf", "My Doc", bytearray(b"1")), ("a", "x/Two.pdf", "my doc!", bytearray(b"2")), ("a", "x/Gone.pdf", "Gone", None), ("a", "x/Bad.pdf", "Bad", bytearray(b"3"))], "archive string, resolved_path string, title string, content binary")
    rows = {r["resolved_path"]: r for r in convert.converted(docs, lambda path, content: "```html\n<h2>Title here</h2><h2>xqzt bcd</h2><img src='' alt='A cat'><p>t</p>\n```" if content != b"3" else 1 / 0).collect()}
    assert rows["x/One.pdf"]["file_path"] == "wiki_content/my-doc.html" and rows["x/Two.pdf"]["file_path"] == "wiki_content/my-doc-2.html"
    assert "<h2>Title here</h2><p><em>A cat</em></p><p>t</p>" in rows["x/One.pdf"]["html"] and rows["x/One.pdf"]["identifier"].startswith("clu_doc_")
    assert rows["x/Gone.pdf"]["skip_reason"] == "not in the archive" and rows["x/Bad.pdf"]["skip_reason"] == "conversion failed: ZeroDivisionError"
    pages = spark.createDataFrame([("a", """<a href="f?a&amp;b">x</a><a href='f?a&b'>y</a><a href="g">z</a>"""), ("b", '<a href="g">z</a>')], "archive string, html string")
    links = spark.createDataFrame([("a", "f?a&b", "T")], "archive string, href string, target string")
    assert [r["html"] for r in convert.relinked(pages, links).orderBy("archive").collect()] == ["""<a href="T">x</a><a href='T'>y</a><a href="g">z</a>""", '<a href="g">z</a>']
    assert convert.plain_fallback("a\n\n b ", "T") == "<h2>T</h2>\n<p>a</p>\n<p>b</p>" and convert.plain_fallback(" ") == ""


def test_formats(spark):
    pages = spark.createDataFrame([("1", "A & b", "<body><h1>x</h1><p>y</p></body>"), ("2", None, None)], "page_id string, title string, html string")
    rows = {r["page_id"]: r for r in convert.exported(pages, "text").collect()}
    assert bytes(rows["1"]["content"]).decode() == "A & b\n=====\n\nx\n\ny" and rows["1"]["filename"] == "A_b.txt" and rows["2"]["filename"] == "document.txt"
    assert b"<title>A &amp; b</title>" in bytes(convert.exported(pages, "html").where("page_id = '1'").first()["content"])
    with zipfile.ZipFile(io.BytesIO(bytes(convert.exported(pages, "epub").first()["content"]))) as z:
        assert z.namelist()[0] == "mimetype" and b"<h1>x</h1>" in z.read("OEBPS/chapter.xhtml")
    with pytest.raises(ValueError):
        convert.exported(pages, "pdf")


def test_images_that_need_texts(spark):
    issues = api.analyze_html(spark, "<img src='b.png'><img src='a.png?x=1&amp;y'><img src='b.png'>")
    assert [(r["src"], r["place"]) for r in convert.image_sources(issues).orderBy("place").collect()] == [("b.png", 1), ("a.png?x=1&y", 2)]
    images = spark.createDataFrame([("b.png", bytearray(b"1")), ("b.png", bytearray(b"1")), ("c.png", bytearray(b"2"))], "src string, content binary")
    assert [tuple(r) for r in convert.alt_texts(images, lambda src, content: "A boat" if src == "b.png" else 1 / 0).collect()] == [("b.png", "A boat")]
    kinds = spark.createDataFrame([("quiz",), ("wiki_page",)], "k string").select(convert.writable(F.col("k")).alias("w")).collect()
    assert [k["w"]["writable"] for k in kinds] == [False, True]


def test_public_calls(spark, tmp_path):
    with pytest.raises(ValueError):
        api.analyze_html(spark, None)
    raw = spark.createDataFrame([(1, "http://a.org/x", "<title>T</title><h1>a</h1><a href='http://b.org/f.pdf'>f</a>"), (2, "http://a.org/y", "<p>b</p>")], "page_id long, url string, html string")
    raw.write.parquet(f"{tmp_path}/pages")
    pages = api.read_pages(spark, f"{tmp_path}/pages")
    issues = api.analyze(pages)
    assert {r["rule_id"] for r in issues.collect()} == {"HDG001", "LNK007", "PDF001"}
    assert api.inventory_documents(pages).first()["extension"] == "pdf"
    assert all(api.export_acr(pages, issues, kind).count() == 1 for kind in ("markdown", "json", "html"))
    fixed = api.remediate_pages(pages, issues)
    assert report.issues(fixed).where("rule_id = 'HDG001'").count() == 0
    violation = '{"id": "image-alt", "impact": "minor", "help": "h", "tags": ["wcag111"], "nodes": [{"target": ["#content"], "html": "<img>", "any": []}]}'
    rendered = spark.createDataFrame([("a.org", "1", "/x", violation)], "course_id string, page_id string, page_url string, violation string")
    off = spark.createDataFrame([("LNK007", False, None)], "rule_id string, enabled boolean, severity_override string")
    assert {r["rule_id"] for r in api.analyze(pages, config=off, rendered=rendered).collect()} == {"HDG001", "PDF001", "IMG001"}
    assert api.suggestions(issues).count() == 0


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
