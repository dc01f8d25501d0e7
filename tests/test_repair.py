"""Repairs, sanitizer, suggestions and archives."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenpage.functions import latex
from lumenpage.functions.text import MAX_ALT
from lumenpage.operators import remediate, suggest
from lumenpage.operators.rules import RULES
from lumenpage.plans import report
from lumenpage.sources import archive
from lumenpage.sources.dom import parse

EVERY = {r.rule_id for r in RULES}


def fix(html, *rules, **kw):
    return remediate.repair(html, set(rules), **kw)[0]


@pytest.mark.parametrize(
    ("rule", "before", "after"),
    [
        ("HDG001", "<h1>a</h1>", "<h2>a</h2>"),
        ("HDG002", "<h3>a</h3><h2>b</h2><h5>c</h5>", "<h2>a</h2><h2>b</h2><h3>c</h3>"),
        ("TBL001", "<table><tr><td>a</td><td></td></tr></table>", '<table><tr><th scope="col">a</th><td></td></tr></table>'),
        ("TBL004", "<table><tr><th scope=col></th></tr></table>", "<table><tr><td></td></tr></table>"),
        ("TBL005", "<table><tr><td>a</td></tr></table>", '<table role="presentation"><tr><td>a</td></tr></table>'),
        ("LIST001", "<p>1. a</p><p>2. <b>b</b></p>", "<ol><li>a</li><li><b>b</b></li></ol>"),
        ("LIST001", "<p>To do:<br>- a<br>- b</p>", "<p>To do:</p><ul><li>a</li><li>b</li></ul>"),
        ("LNK002", "<a title='A b' href=x>a B</a>", '<a href="x">a B</a>'),
        ("STR002", "<font color=red size=2>a</font><strike>b</strike>", '<span style="color: red">a</span><del>b</del>'),
        ("STR003", "<p style='font-size: 9px; color: red'>a</p>", '<p style="color: red">a</p>'),
        ("LNK006", "<a href=x>a</a><a href=x>b</a>", '<a href="x">a b</a>'),
        ("LNK001", "<a href='#'>here</a><a href='/a/my-plan.html'>click here</a><a href=x>Read more about bees</a>", 'here<a href="/a/my-plan.html">My plan</a><a href="x">about bees</a>'),
        ("LNK008", "<a href='a b'>x</a>", '<a href="a%20b">x</a>'),
        ("HDG004", "<h2>t</h2><p><b>Bold</b></p>", "<h2>t</h2><h3>Bold</h3>"),
        ("HDG003", "<h2> </h2><p>x</p>", "<p>x</p>"),
        ("STR001", "<p></p><p></p><p>x</p>", "<p></p><p>x</p>"),
        ("MDA002", "<video autoplay></video>", "<video></video>"),
        ("TGT001", "<button style='width: 5px'>x</button>", '<button style="width: 24px">x</button>'),
        ("IMG009", "<img alt='image of a dog'>", '<img alt="A dog"/>'),
        ("IMG005", "<a href='my_file.pdf'><img></a>", '<a href="my_file.pdf"><img alt="My File"/></a>'),
        ("LNK009", "<a href='#x'>a</a><p id=y></p><a href='#y'>b</a>", 'a<p id="y"></p><a href="#y">b</a>'),
        ("ARIA001", "<i aria-owns='a b' id=a></i><i aria-controls=c></i>", '<i aria-owns="a" id="a"></i><i></i>'),
        ("DID001", "<i id=x></i><i id=x></i><i id=x-2></i>", '<i id="x"></i><i id="x-3"></i><i id="x-2"></i>'),
        ("TBL006", "<table><tr><td></td><td>a</td></tr></table>", "<table><tr><td>\xa0</td><td>a</td></tr></table>"),
        ("LNK010", "<a href='/a'>x</a><a href='/b/c.html'>x</a>", '<a href="/a">x</a><a href="/b/c.html">x (c)</a>'),
        ("LNK011", "<a href=q></a><a href=q>t</a>", '<a href="q">t</a>'),
        ("LNK012", "<a href=x><img alt=''></a><a href=x>t</a>", '<a href="x"><img alt="t"/></a>'),
        ("LNK005", "<a href='http://www.my-site.org/faq'>http://www.my-site.org/faq</a>", '<a href="http://www.my-site.org/faq">My Site FAQ</a>'),
        ("MDA001", "<iframe src='https://vimeo.com/1'></iframe>", '<iframe src="https://vimeo.com/1" title="Embedded video from Vimeo"></iframe>'),
        ("FOC001", "<div style='position: fixed'></div><a href=x>y</a>", '<div style="position: fixed"></div><a href="x" style="scroll-margin-top: 80px;">y</a>'),
        ("AUTH001", "<input type=password>", '<input type="password" autocomplete="current-password"/>'),
        ("BTN001", "<button></button><input type=submit>", '<button aria-label="Button"></button><input type="submit" value="Submit"/>'),
        ("STR004", "<u>a</u><p style='text-decoration: underline; color: red'>b</p>", '<em>a</em><p style="color: red">b</p>'),
        ("STR005", "<p style='text-align: justify'>b</p>", '<p style="text-align: left">b</p>'),
        ("MATH001", "<p>$x^2$</p>", '<p><span role="math" aria-label="x^2">x<sup>2</sup></span></p>'),
        ("none", "<a href='http://a.org/http://b.org/x'>l</a>", '<a href="http://b.org/x">l</a>'),
        ("none", "<img src='a/my-cat.png'><img src='x' width=1>", '<img src="a/my-cat.png" alt="My Cat"/><img src="x" width="1" alt="" role="presentation"/>'),
        ("none", "<img alt=a><img alt=a>", '<img alt="a"/><img alt="a (2)"/>'),
    ],
)
def test_each_repair(rule, before, after):
    assert fix(before, rule) == after


def test_repairs_with_choices():
    table = "<h3>Scores</h3><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert ">Table: Scores</caption>" in fix(table, "TBL003")
    assert '<th scope="row">x' in fix("<table><tr><th>a</th><td>b</td></tr><tr><th>x</th><td>2</td></tr></table>", "TBL002")
    assert "position: absolute" in fix("<a href='/d/my-doc.pdf'></a>", "LNK003") and "My Doc" in fix("<a href='/d/my-doc.pdf'></a>", "LNK003")
    assert fix(f"<p>{'x' * 60}</p>", "HDG005", title="T").startswith("<h2>T</h2>") and "<h2>" not in fix(f"<p>{'x' * 60}</p>", "HDG005")
    long = fix(f"<h2>{'word ' * 40}</h2>", "HDG006")
    assert len(parse(long).first("h2").text()) <= 120 and parse(long).text(" ").split() == ["word"] * 40
    assert "#" in fix("<p style='color: #cccccc'>x</p>", "CLR001") and "#cccccc" not in fix("<p style='color: #cccccc'>x</p>", "CLR001")
    assert fix("<img src='a/b.png'>", alts={"b.png": "A boat"}) == '<img src="a/b.png" alt="A boat"/>'
    seen = [{"fg_color": "#999999", "bg_color": "#ffffff", "element_html": "<p id=k>x</p>", "font_size": "12px"}]
    assert "color: #" in fix("<p id=k>x</p>", "CLR001", rendered=seen)
    assert remediate.apply_color_scheme("<p style='background-color: #112233'>x</p>", "#000001", "#000002") == '<p style="background-color: #000001">x</p>'


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12))
def test_repaired_levels_never_skip(levels):
    got = [int(h.tag[1]) for h in parse(fix("".join(f"<h{n}>x</h{n}>" for n in levels), "HDG002")).elements("h1", "h2", "h3", "h4", "h5", "h6")]
    assert all(b <= a + 1 for a, b in zip([1, *got], got))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_alts_are_short_and_sanitizing_twice_changes_nothing(text):
    assert len(remediate.truncated(text)) <= MAX_ALT
    once = remediate.sanitize(text)[0]
    assert remediate.sanitize(once)[0] == once


def test_sanitizer_keeps_the_allow_list():
    html, counts = remediate.sanitize("<h1 onclick=x>a</h1><script>s</script><figure><img src=x alt=y foo=z></figure><p style='color: red; filter: x; bad' data-k=1 role=bogus>t</p>")
    assert html == '<h2>a</h2><img src="x" alt="y"/><p style="color: red" data-k="1">t</p>'
    assert counts == {"elements": 3, "attributes": 3, "declarations": 1}


def test_latex():
    assert latex.to_html(r"\frac{a}{b} \leq \alpha_{i}") == "(a)/(b) ≤ α<sub>i</sub>"
    assert latex.to_html(r"\sqrt[3]{x} \neq \varepsilon") == "3√x ≠ ε"
    assert latex.convert_text("no math") is None
    assert latex.remaining("costs $5$ and $x$ \\alpha") == ["$5$", "$x$", "\\alpha"]


def test_second_scan_of_repaired_pages_is_clean(spark):
    html = "<h1>A</h1><h4>B</h4><p>1. x</p><p>2. y</p><a href='#'>here</a><table><caption>c</caption><tr><th>N</th><td></td></tr></table><font>f</font><button></button>"
    schema = "course_id string, page_id string, identifier string, title string, content_type string, canvas_url string, html string"
    pages = spark.createDataFrame([("c", "1", "1", "T", "wiki_page", None, html), ("c", "2", "2", "T", "quiz", None, html), ("c", "3", "3", "T", "wiki_page", None, "<p>ok</p>")], schema)
    before = report.issues(pages)
    new = remediate.repaired(pages, before).cache()
    assert {r["page_id"]: r["changed"] for r in new.collect()} == {"1": True, "2": False, "3": False}
    left = {r["rule_id"] for r in report.issues(new).where("page_id = '1'").collect()}
    assert not left & {"HDG001", "HDG002", "LIST001", "LNK009", "TBL002", "TBL006", "STR002"}
    summary = report.run_summary(spark.createDataFrame([("c", True, 10, 2), ("c", False, 0, 0)], "course_id string, changed boolean, issues_before long, issues_after long")).first()
    assert (summary["issues_fixed"], summary["reduction_pct"], summary["pages_changed"]) == (8, 80.0, 1)


def test_suggestions(spark):
    from lumenpage.schema import ISSUES

    kind = spark.createDataFrame([], ISSUES).schema
    blank = dict.fromkeys(kind.names)
    meta = {"fg_color": "rgb(200, 200, 200)", "bg_color": "#fff", "font_size": "16px", "font_weight": "normal", "target": "p.k"}
    rows = [blank | {"id": "i1", "page_id": "1", "rule_id": "CLR001", "axe_meta": meta}, blank | {"id": "i2", "page_id": "1", "rule_id": "CLR001"}, blank | {"id": "i3", "page_id": "1", "rule_id": "LNK004", "element_html": "<a href='x'>here</a>"}, blank | {"id": "i4", "page_id": "1", "rule_id": "IMG001", "element_html": "<img src='gone'>"}]
    issues = spark.createDataFrame([tuple(r[n] for n in kind.names) for r in rows], kind)
    assert suggest.targets(issues).count() == 3
    contrast = suggest.contrast_suggestions(issues)
    assert contrast.first()["proposed_text"] not in (None, "#c8c8c8")
    answers = suggest.modelled(issues, lambda rule, html: "text " + suggest.answer_json("The plan", 7) if rule == "LNK004" else 1 / 0)
    assert [(r["proposed_text"], r["confidence"]) for r in answers.collect()] == [("The plan", 1.0)]
    pages = spark.createDataFrame([("1", "<p class=k>low</p><a href='x'>Here</a>"), ("2", "<p>other</p>")], "page_id string, html string")
    out = {r["page_id"]: r for r in suggest.apply_all(pages, contrast.unionByName(answers)).collect()}
    assert (out["1"]["applied"], out["1"]["not_applied"], out["2"]["applied"]) == (2, 0, 0)
    assert "The plan" in out["1"]["html"] and "color: #" in out["1"]["html"]
    for rule, html, want in (("FORM003", "<label for=a></label>", "New"), ("TBL003", "<table><tr><td>q</td></tr></table>", "<caption>New</caption>"), ("IMG001", "<img src=s>", 'alt="New"')):
        assert want in suggest.apply(html, {"rule_id": rule, "proposed_text": "New", "original_html": html})[0]
    assert suggest.apply("<p>", {"rule_id": "IMG001", "proposed_text": "x", "original_html": "<img src=s>"})[1] is False


MANIFEST = """<manifest xmlns="http://x"><metadata><schemaversion>1.1.0</schemaversion><lom:lom xmlns:lom="http://l"><lom:general><lom:title><lom:string>Smoke Course</lom:string></lom:title></lom:general></lom:lom></metadata>
<resources><resource identifier="r1" type="webcontent" href="wiki_content/page.html"><file href="wiki_content/page.html"/></resource>
<resource identifier="r2" type="imsdt_xmlv1p1"><file href="d.xml"/></resource><resource identifier="r3" type="imsqti_xmlv1p2"><file href="q.xml"/></resource>
<resource identifier="r4" type="associatedcontent" href="a/x.html"><file href="a/x.html"/><file href="a/assignment_settings.xml"/></resource></resources></manifest>"""


def packed():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("imsmanifest.xml", MANIFEST), ("wiki_content/page.html", "<html><title>Intro &amp; more</title><body><h1>x</h1></body></html>"), ("d.xml", "<topic><text texttype='text/html'>&lt;p&gt;talk&lt;/p&gt;</text></topic>"),
                           ("q.xml", "<q><mattext>one</mattext><mattext> </mattext><mattext>two</mattext></q>"), ("a/x.html", "<p>do</p>"), ("a/assignment_settings.xml", "<a/>"), ("course_settings/syllabus.html", "<p>plan</p>")):
            z.writestr(name, text)
    return out.getvalue()


def test_archives_are_read_and_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.imscc").write_bytes(packed())
    (tmp_path / "in" / "b.imscc").write_bytes(b"not a zip")
    source = archive.archives(spark, f"{tmp_path}/in")
    rows = archive.pages(source).collect()
    assert [(r["identifier"], r["content_type"], r["title"]) for r in rows if not r["error"]] == [("syllabus", "syllabus", "syllabus"), ("r1", "wiki_page", "Intro & more"), ("r2", "discussion", "d"), ("r3", "quiz", "q"), ("r4", "assignment", "x")]
    assert [r["error"] for r in rows if r["error"]] and rows[-1]["error"] or rows[0]["error"]
    good = source.where("archive LIKE '%a.imscc'")
    assert tuple(archive.courses(good).select("title", "version").first()) == ("Smoke Course", "1.1.0")
    assert archive.resources(good).count() == 4 and archive.members(good).count() == 7 and archive.unsafe(archive.members(good)).count() == 0
    changed = archive.pages(good).selectExpr("archive", "file_path", "content_type", "replace(html, 'talk', 'new talk') AS html")
    new = archive.rewritten(good, changed).first()["content"]
    course = archive.parse(bytes(new))
    assert next(p for p in course.pages if p["content_type"] == "discussion")["html"] == "<p>new talk</p>"


def test_archive_limits_and_collisions():
    with pytest.raises(archive.UnsafeArchive):
        archive.check_limits([("a", 10_000, 10)])
    with pytest.raises(archive.UnsafeArchive):
        archive.check_limits([("a", 1, 1)] * 50_001)
    archive.check_limits([("a", 10_000, 0)])
    with pytest.raises(KeyError):
        archive.rebuild(packed(), {"gone.html": b""})
    with pytest.raises(KeyError):
        archive.rebuild(packed(), {}, {"q.xml": b""})
    with zipfile.ZipFile(io.BytesIO(archive.rebuild(packed(), {"q.xml": b"<q/>"}, {"new.html": b"n"}))) as z:
        assert z.read("q.xml") == b"<q/>" and z.read("new.html") == b"n" and z.read("a/x.html") == b"<p>do</p>"
    assert archive.register("<resources></resources>", [("i", "p.html")]).count("<resource ") == 1


def test_image_members(spark):
    rows = spark.createDataFrame([("$IMS-CC-FILEBASE$/a%20b.png?x=1",), ("http://x/y.png",), ("data:image/png;base64,x",), ("../img/c+d.png",), ("",)], "src string")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(archive.image_member(F.col("src"))).collect()] == ["web_resources/a b.png", None, None, "img/c+d.png", None]


def test_texts_of_images_meet_by_equal_stretches_as_by_comparing_all(spark):
    import random

    from lumenpage.operators.remediate import alts_of_pages

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab/") for _ in range(rng.randrange(1, 9)))
    long = "data:" + "ab" * 200
    srcs = [word() for _ in range(60)] + [long + "/x", "z" + long, "é😀/b"]
    alts = [("c", k, f"alt {i}", i % 7) for i, k in enumerate(sorted({word() for _ in range(40)} | {long, "😀", long + "/x/y"}))]
    pages = spark.createDataFrame([("c", str(i), "1", "T", "wiki_page", "f", None, f'<img src="{x}">') for i, x in enumerate(srcs)], "course_id string, page_id string, identifier string, title string, content_type string, file_path string, canvas_url string, html string")
    made = alts_of_pages(pages, spark.createDataFrame(alts, "course_id string, src string, alt string, place int"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert all(" _id#" in line or "(_id#" in line for line in plan.splitlines() if "Join" in line and "Contains(" in line)
    got = {r["page_id"]: r["_alts"][0]["alt"] for r in made.collect()}
    for i, x in enumerate(srcs):
        near = [((x != k), place, k, alt) for _, k, alt, place in alts if k in x or x in k]
        assert got.get(str(i)) == (min(near)[3] if near else None)
