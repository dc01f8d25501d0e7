"""Each rule on fixtures with a positive, a negative and a trap case; counts are of findings per rule."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenpage.operators.rules import RULES, findings
from lumenpage.sources.dom import parse
from lumenpage.sources.elements import elements

PAGES = "course_id string, page_id string, identifier string, title string, content_type string, canvas_url string, html string"

# html, and the findings it must give of the rules named (0: none)
CASES = {
    "img_missing": ("<img src=a><img alt='' src=b><img alt=' ' role=presentation><img class='equation_image'><img usemap=#m>", {"IMG001": 4}),
    "img_area": ("<map><area><area alt=x></map>", {"IMG001": 1}),
    "img_alt": ("<img alt='Photo of x'><img alt='fig1.2a'><img alt='x.PNG'><img alt='a cat on a mat'><img alt='logo'>", {"IMG002": 4, "IMG001": 0}),
    "img_code_length": (f"<img alt='a{'1' * 40}'><img alt='a{'1' * 39}'>", {"IMG002": 1}),
    "img_near": ("<img alt=Sun><img alt=' sun '><img alt=moon><img alt=x><img alt=moon><img alt=far><img alt=b><img alt=c><img alt=far>", {"IMG003": 2}),
    "img_long": (f"<img alt='{'x ' * 51}'><img alt='{'y' * 100}'>", {"IMG004": 1}),
    "img_linked": ("<a href=x><img><img alt=''></a><a href=y>text<img></a><a href=z><img alt=ok></a>", {"IMG005": 2}),
    "img_title": ("<img title=t><img title=t alt=a><img title=' '>", {"IMG006": 1}),
    "img_longdesc": ("<img longdesc='desc'><img longdesc='http://x'><img longdesc='#d'><img longdesc=''>", {"IMG008": 1}),
    "img_noise": ("<img alt='Sunset (opens in new window)'><img alt='An image of a dog'><img alt='Sunset. Image'><img alt='image'><img alt='an imagery of x'>", {"IMG009": 3}),
    "headings": ("<h1>a</h1><h3>b</h3><h4>c</h4><h2>d</h2><h5>e</h5>", {"HDG001": 1, "HDG002": 2}),
    "heading_order": ("<h3>a</h3><h3>b</h3>", {"HDG002": 1}),
    "heading_empty": ("<h2>&nbsp;</h2><h3><img alt=x></h3><h4><img></h4>", {"HDG003": 2}),
    "heading_fake": (f"<p><b>Bold</b></p><p><b>B</b> more</p><li><p><b>in list</b></p></li><p style='font-size: 20px'>big</p><p><strong>{'x' * 81}</strong></p>", {"HDG004": 2}),
    "structure_short": ("<p>short</p>", {"HDG005": 0}),
    "structure_text": (f"<p>{'x' * 51}</p>", {"HDG005": 1}),
    "structure_frame": ("<iframe src=x title=y></iframe>", {"HDG005": 1}),
    "heading_long": (f"<h2>{'x' * 121}</h2><h2>{'x' * 120}</h2>", {"HDG006": 1}),
    "table_plain": ("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", {"TBL001": 1, "TBL005": 0, "TBL006": 0}),
    "table_layout": ("<table role=none><tr><td>a</td></tr></table><table role=presentation><tr><td></td></tr></table>", {"TBL001": 0, "TBL005": 1, "TBL006": 0}),
    "table_nested": ("<table><tr><td><table><tr><th>h</th><td>x</td></tr></table></td></tr></table>", {"TBL002": 2, "TBL001": 0}),
    "table_caption": ("<p>Scores</p><table><tr><th scope=col>a</th><th scope=col>b</th></tr></table>", {"TBL003": 1, "TBL002": 0}),
    "table_colspan": ("<table><tr><td colspan=x>t</td></tr><tr><th>a</th></tr></table>", {"TBL003": 1}),
    "table_empty_head": ("<table><caption>c</caption><tr><th>&nbsp;</th><th><img alt=x></th><th>y</th></tr></table>", {"TBL004": 1}),
    "table_sparse": ("<table><caption>c</caption><tr><td> </td><td>&nbsp;</td><td><input></td></tr></table>", {"TBL006": 1}),
    "list_runs": ("<p>1. a</p><br><p>2. b</p><p></p><p>3. c</p><p>x</p><p>- a<br>- b</p><p>i. a</p><p>ii. b</p>", {"LIST001": 2}),
    "empties": ("<p></p><p> </p><p>x</p><p></p><p id=k></p><div><br></div><div></div><div role=x></div>", {"STR001": 2}),
    "deprecated": ("<font>a</font><center>b</center><tt>c</tt>", {"STR002": 3}),
    "small": ("<p style='font-size:10px'>a</p><p style='font-size: 9.9pt'>b</p><p style='font-size:0.8em'>c</p><p style='font-size:9px'></p>", {"STR003": 2}),
    "underline": ("<u>a</u><u style='text-decoration: underline'>b</u><a href=x style='text-decoration:underline'>c</a>", {"STR004": 3}),
    "justify": ("<p style='text-align: justify'>a</p>", {"STR005": 1}),
    "aria_refs": ("<i aria-labelledby='a b c' aria-owns=a></i><b id=a></b>", {"ARIA001": 1}),
    "ids": ("<i id=x></i><i id=x></i><i id=x></i><i id=y></i>", {"DID001": 1}),
    "hidden_focus": ("<button aria-hidden=true>x</button><div aria-hidden=true><a href=y>z</a></div><div aria-hidden=true tabindex=-1><a>n</a></div>", {"ARIA002": 2}),
    "roles": ("<i role=SLIDER></i><i role=scrollbar></i><i role=bogus></i><i role=' '></i>", {"ARIA003": 3, "ARIA004": 1}),
    "target": ("<a href=x><img alt='' width=10></a><button style='width: 30px; height: 5px'>x</button><p>text around <a href=z style='width:3px'>a</a></p>", {"TGT001": 2}),
    "fixed": ("<div style='Position: FIXED'>x</div>", {"FOC001": 1}),
    "buttons": ("<button></button><button aria-label=x></button><input type=submit><input type=SUBMIT><input type=reset value=x>", {"BTN001": 2}),
    "events": ("<a href=x onmouseover=f() onmouseout=g()>y</a><select onchange='window.open(x)'></select><select onchange='f()'></select>", {"EVT001": 1, "EVT002": 1}),
    "vague": ("<a href=x>Click HERE</a><a href=y>read more about it</a><a href=z>http://here</a><a href=w>Course plan</a>", {"LNK001": 2, "LNK004": 1, "LNK005": 1}),
    "titles": ("<a href=x title='Report.pdf'>report</a><a href=y title='Other'>thing</a>", {"LNK002": 1}),
    "empty_links": ("<a name=k></a><a href=x><img><img alt=y></a><a href=z aria-label=l></a>", {"LNK003": 2}),
    "adjacent": ("<a href=x>a</a> <a href=x>b</a><!-- c --><a href=x>d</a>", {"LNK006": 1}),
    "documents": ("<a href='f.pdf#page=2'>a</a><a href='f.docx?x=1'>b</a><a href='https://docs.google.com/forms/1'>c</a>", {"LNK007": 2, "PDF001": 1, "DOC001": 1}),
    "assets": ("<a href='/files/12'>the pdf</a><a href='/pages/files/12'>x</a>", {"DOC002": 1, "PDF001": 1}),
    "spaces": ("<a href='a b'>x</a><a href='#a b'>y</a><a href='mailto:a b'>z</a>", {"LNK008": 1}),
    "fragments": ("<a href='#'>a</a><a href='#gone'>b</a><a href='#here'>c</a><p id=here>", {"LNK009": 2}),
    "same_text": ("<a href=1>More info</a><a href=2>more info</a><a href=''>MORE INFO</a><a href=3>x</a>", {"LNK010": 3}),
    "redundant": ("<a href=q></a><a href=q>text</a><a href=w></a><a href=w> </a><a href='#k'></a>", {"LNK011": 2}),
    "pair": ("<a href=x><img alt=''></a> <a href=' x'>text</a>", {"LNK012": 1}),
    "media": ("<video></video><video><track kind=captions></video><audio></audio><p>Transcript</p><iframe src='https://youtu.be/x'></iframe><iframe src='https://vimeo.com/1' title=t></iframe>", {"MDA001": 2}),
    "autoplay": ("<video autoplay aria-label=x></video>", {"MDA002": 1}),
    "videos": ("<iframe src='https://youtube.com/embed/1' title=t></iframe><a href='https://youtube.com/embed/1'>x</a><a href='https://arc.instructure.com/2'>y</a>", {"MDA003": 1, "MDA004": 1, "MDA005": 1, "MDA006": 1}),
    "math": ("<p>$a$ and $$b$$ and \\(c\\) and \\frac{1}{2}</p>", {"MATH001": 1}),
    "no_math": ("<p>it costs 5 dollars</p>", {"MATH001": 0}),
    "forms": ("<form><label for=i>Name</label><input id=i><input aria-label='name!'><input type=hidden name=name><textarea placeholder=other></textarea></form>", {"FORM001": 1}),
    "password": ("<input type=PASSWORD><input type=password autocomplete=new-password>", {"AUTH001": 1}),
    "labels": ("<label>&nbsp;</label><label for=gone>x</label><label for=k>y</label><i id=k></i>", {"FORM003": 1, "FORM007": 1}),
    "choices": ("<input type=radio name=a><input type=radio name=a><input type=checkbox><fieldset><input type=radio name=b></fieldset>", {"FORM005": 2}),
    "personal": ("<input name=userEmail><input type=tel><input name=zip autocomplete=postal-code><input type=checkbox name=city>", {"FORM009": 2}),
    "contrast": ("<p style='color:#da3c2b'>a</p><p style='color:#999; background-color: white'>b</p><p style='background-color: black; color: white'>c</p><p style='color:rgb(200,200,200)'></p>", {"CLR001": 2}),
    "contrast_large": ("<p style='color:#909090; font-size: 24px'>a</p><p style='color:#808080; font-size: 24px'>a</p>", {"CLR001": 1}),
    "contrast_inherited": ("<div style='color:#777; background-color:#666'><p>x</p></div>", {"CLR001": 2}),
    "unclosed": ("<p><b>A<br><p>B</p>", {"HDG004": 1}),
    "script_text": ("<script>var t='</p>$x$';</script><p>y</p>", {"MATH001": 0}),
    "null": (None, {}),
    "blank": ("", {"HDG005": 0}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [("c", name, name, "T", "wiki_page", None, html) for name, (html, _) in CASES.items()]
    got = findings(elements(spark.createDataFrame(rows, PAGES))).collect()
    return {name: Counter(r["rule"] for r in got if r["page_id"] == name) for name in CASES}, got


@pytest.mark.parametrize("name", CASES)
def test_findings(found, name):
    want = CASES[name][1]
    assert {r: found[0][name].get(r, 0) for r in want} == want


def test_every_page_rule_is_covered(found):
    covered = {r for _, want in CASES.values() for r, n in want.items() if n}
    assert covered == {r.rule_id for r in RULES} - {"HELP001"}
    assert len(RULES) == 66


def test_findings_say_where_and_what(found):
    got = found[1]
    assert all(len(r["html"] or "") <= 200 and r["message"] for r in got)
    row = next(r for r in got if r["page_id"] == "ids")
    assert row["message"] == 'Duplicate id="x" found 3 times — IDs must be unique'
    row = next(r for r in got if r["page_id"] == "heading_order")
    assert row["message"] == 'Heading level skipped from H1 to H3: "a..."'


def test_rules_need_no_shuffle(spark):
    pages = spark.createDataFrame([("c", "p", "p", "T", "wiki_page", None, "<p>x")], PAGES)
    plan = findings(elements(pages))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_trees():
    assert parse("Hello <b>World</b>").text() == "HelloWorld"
    assert parse("<p><b>A<br><p>B</p>").html() == "<p><b>A<br/><p>B</p></b></p>"
    assert parse("<a href='x?a=1&amp;b'>t</i></a>").html() == '<a href="x?a=1&amp;b">t</a>'
    assert parse("<script>if (a < b) '</p>'</script>").text() == ""
    assert parse("<input disabled>").first("input").attrs == {"disabled": ""}
    assert parse("<!-- c --><!DOCTYPE html><p>x").text() == "x"
    deep = "<div>" * 3000 + "x"
    assert parse(deep).text() == "x" and parse(deep).html().endswith("</div>")


def test_smoke_fixture(spark):
    pages = spark.createDataFrame([("c", "p", None, None, None, None, "<h2>Overview</h2><p><img src='hero.png'></p>")], PAGES)
    assert findings(elements(pages)).where(F.col("rule") == "IMG001").count() == 1


def test_own_rules_run_beside_the_others(spark):
    from lumenpage.operators.rules import Rule, msg, tag, when
    from lumenpage.plans import report

    pages = spark.createDataFrame([("c", "p", "p", "T", "wiki_page", None, "<h2>a</h2><hr><hr>")], PAGES)
    own = report.issues(pages, more_rules=(Rule("OWN001", "info", "structure", "1.3.1", False),), more=(lambda: [when("OWN001", tag("hr"), msg("A line"))],))
    assert [(r["rule_id"], r["severity"], r["message"]) for r in own.collect()] == [("OWN001", "info", "A line")] * 2


def test_wanted_rules_alone_are_worked_out_with_the_same_findings(spark):
    from lumenpage.sources.elements import TASK_ROWS, spread

    html = '<h1>T</h1><img src="a.png"><a href="#">here</a><p style="color: #ccc">pale</p><table><tr><td>1</td></tr></table>'
    pages = spark.createDataFrame([("c", "1", "1", "T", "wiki_page", None, html)], PAGES)
    every = findings(elements(pages)).collect()
    for only in ({"HDG001"}, {"IMG001", "LNK009"}):
        assert sorted(findings(elements(pages), only=only).collect()) == sorted(r for r in every if r["rule"] in only)
    assert spread(spark.range(10 * TASK_ROWS).coalesce(1)).rdd.getNumPartitions() == 10
