"""Constructed pages for every rule and repair, with DuckDB SQL that states what must come out.

A page is a template over a row of ``supplier``: ``@{expression}`` is SQL that
Spark and DuckDB read alike. The rules' queries give (case_name, k, rule,
issues); their SQL counts issues from the row's values, by the rule's
definition. The repairs' queries give (case_name, k, html); their SQL writes the
repaired page. Nothing of either SQL is made from the operators.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.operators import documents
from lumenpage.operators.remediate import HIDDEN, repaired
from lumenpage.operators.rules import findings
from lumenpage.plans import dims, report, views
from lumenpage.sources.elements import elements, spread

K = "s_suppkey"


def literal(text: str) -> str:
    """A string as SQL of both dialects; a backslash is an escape in one of them only."""
    return " || chr(92) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\\"))


def expression(template: str) -> str:
    parts = re.split(r"@\{(.*?)\}@", template, flags=re.DOTALL)
    return " || ".join(f"CAST(({p}) AS STRING)" if k % 2 else literal(p) for k, p in enumerate(parts) if p) or "''"


def pick(*values: str, by: int | None = None) -> str:
    """A choice among texts by the row's key."""
    n = by or len(values)
    return "@{CASE " + " ".join(f"WHEN {K} % {n} = {i} THEN {expression(v)}" for i, v in enumerate(values)) + " END}@"


def is_(*remainders: int, of: int) -> str:
    """1 if the key has one of these remainders, else 0."""
    return f"CAST({K} % {of} IN ({', '.join(map(str, remainders))}) AS INT)"


KEY, NAME = "@{s_suppkey}@", "@{s_name}@"


def times(text: str, n: str) -> str:
    return "@{repeat(" + expression(text) + f", CAST({n} AS INT))" + "}@"


# (case, page, issues by rule); rules that aren't named must not fire.
IMAGES = [
    ("missing", f'<h2>t</h2><img src="a{KEY}.png"><img src="b.png" alt=""><img src="c.png" alt="" role="presentation">', {"IMG001": "2"}),
    ("map", f'<img src="m.png" usemap="#m"><map><area href="x"><area href="y" alt="{NAME}"></map>', {"IMG001": "3"}),
    ("equation", f'<img class="equation_image" src="q.png"><img src="/equation_images/{KEY}"><img src="z.png" data-equation-content="x">', {}),
    (
        "near",
        f'<img src="1.png" alt="Elm tree {NAME}">' + "".join(f'<img src="{i}.png" alt="' + pick(*("ELM TREE @{upper(s_name)}@" if r == i else f"view of a {c} barn" for r in range(4))) + '">' for i, c in ((1, "red"), (2, "blue"), (3, "green"))),
        {"IMG003": is_(1, 2, of=4)},
    ),
    ("long", f'<img src="l.png" alt="{times("wood ", f"{K} % 40")}">', {"IMG004": f"CAST(5 * ({K} % 40) > 100 AS INT)", "IMG002": f"CAST(5 * ({K} % 40) - 1 > 100 AS INT)", "IMG001": is_(0, of=40)}),
    ("linked", '<a href="p">' + pick('<img src="x.png" alt="">', f'<img src="x.png" alt="{NAME}">', '<img src="x.png" alt=""><img src="y.png" alt="">') + "</a>", {"IMG005": f"CASE {K} % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END", "IMG001": f"CASE {K} % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END"}),
    ("titled", '<img src="t.png" title="' + pick("", NAME) + '" alt="">', {"IMG006": is_(1, of=2), "IMG001": "1"}),
    ("longdesc", '<img src="l.png" alt="A mill pond" longdesc="' + pick("notes.txt", "http://x/y", "/d", "#d", "") + '">', {"IMG008": is_(0, of=5)}),
    ("noise", '<img src="n.png" alt="' + pick("Image of a mill", "A mill, photo", "A mill pond (opens in new window)", "A mill pond") + '">', {"IMG009": is_(0, 1, 2, of=4), "IMG002": is_(0, of=4)}),
    ("reasons", '<img src="n.png" alt="' + pick("IMAGE", "scan.PNG", "fig1.2a", "A mill, fig 1.2a") + '">', {"IMG002": is_(0, 1, 2, of=4)}),
]
HEADINGS = [
    ("levels", "<h2>A</h2>" + "".join(f"<h{s}>" for s in ()) + "@{'<h' || (2 + s_suppkey % 5) || '>B</h' || (2 + s_suppkey % 5) || '>'}@", {"HDG002": is_(2, 3, 4, of=5)}),
    ("first", "@{'<h' || (2 + s_suppkey % 3) || '>B</h' || (2 + s_suppkey % 3) || '>'}@", {"HDG002": is_(1, 2, of=3)}),
    ("empty", pick("<h2></h2>", "<h2>&nbsp;</h2>", '<h2><img src="x.png" alt="A mill"></h2>', f"<h2>{NAME}</h2>"), {"HDG003": is_(0, 1, of=4)}),
    ("bold", f"<h2>A</h2><p><strong>{times('ab ', f'{K} % 40')}x</strong></p>", {"HDG004": f"CAST(3 * ({K} % 40) + 1 <= 80 AS INT)"}),
    ("bold_in_list", f"<h2>A</h2><ul><li><p><strong>{NAME}</strong></p></li></ul><p><b>{NAME}</b> and more</p>", {}),
    ("large", "<h2>A</h2><p style=\"font-size: @{10 + s_suppkey % 20}@px\">Some words</p>", {"HDG004": f"CAST({K} % 20 >= 10 AS INT)"}),
    ("none", f"<p>{times('word ', f'{K} % 20')}end</p>", {"HDG005": f"CAST(5 * ({K} % 20) + 3 > 50 AS INT)"}),
    ("embedded", "<p>x</p>" + pick('<iframe src="f" title="t"></iframe>', '<a class="instructure_file_link" href="f">Leaflet</a>', "<p>y</p>"), {"HDG005": is_(0, 1, of=3)}),
    ("long", f"<h2>{times('abcde', f'{K} % 30')}.</h2>", {"HDG006": f"CAST(5 * ({K} % 30) + 1 > 120 AS INT)"} | {"HDG003": "0"}),
    ("h1", times("<h1>T</h1>", f"{K} % 3") + "<h2>x</h2>", {"HDG001": f"{K} % 3"}),
]
TABLES = [
    ("headless", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>" + pick("", "d") + "</td></tr></table>", {"TBL001": "1", "TBL006": is_(0, of=2)}),
    ("scopes", f'<table><caption>c</caption><tr><th>a</th><th scope="col">b</th>{times("<th>x</th>", f"{K} % 3")}</tr><tr><td>1</td><td>2</td></tr></table>', {"TBL002": f"1 + {K} % 3"}),
    ("caption", f'<p>{times("long ", f"{K} % 15")}title</p><table><tr><th scope="col">a</th><th scope="col">b</th></tr><tr><td>1</td><td>2</td></tr></table>', {"TBL003": "1"}),
    ("empty_head", "<table" + pick("", ' role="presentation"') + '><caption>c</caption><tr><th scope="col"></th><th scope="col">b</th></tr><tr><td>1</td><td>2</td></tr></table>', {"TBL004": is_(0, of=2)}),
    ("single", pick("<table><tr><td>1</td><td>2</td></tr></table>", "<table><tr><td>1</td></tr><tr><td>2</td></tr></table>", '<table role="presentation"><tr><td>1</td><td>2</td></tr></table>'), {"TBL005": is_(0, 1, of=3), "TBL001": is_(0, 1, of=3)}),
    ("blank_cells", f'<table><tr><th scope="col">h</th></tr>{times("<tr><td> </td></tr>", f"{K} % 4")}<tr><td>&nbsp;</td></tr></table>', {"TBL006": is_(1, 2, 3, of=4), "TBL003": "1"}),
    ("nested", f"<table><tr><td><table><tr><td>1</td></tr><tr><td>{KEY}</td></tr></table></td><td>x</td></tr></table>", {"TBL005": "1"}),
]
STRUCTURE = [
    ("dashes", times("<p>- item</p>", f"{K} % 4") + "<p>end</p>", {"LIST001": is_(2, 3, of=4)}),
    ("numbers", "<p>1. a</p><p>2) b</p>" + pick("<p>3. c</p>", "<p>plain</p>"), {"LIST001": "1"}),
    ("breaks", "<p>-a<br>-b<br>" + pick("-c", "c") + "</p>", {"LIST001": "1"}),
    ("unlike", f"<p>1. a</p><p>- {KEY}</p>", {}),
    ("empties", times("<p></p>", f"{K} % 4") + "<p>x</p>", {"STR001": is_(2, 3, of=4)}),
    ("small_px", '<p style="font-size: @{5 + s_suppkey % 10}@px">tiny</p>', {"STR003": f"CAST({K} % 10 <= 5 AS INT)"}),
    ("small_pt", '<p style="font-size: @{7 + s_suppkey % 6}@pt">tiny</p>', {"STR003": f"CAST({K} % 6 < 3 AS INT)"}),
    ("underlined", "<u>" + pick("", "x") + '</u><span style="text-decoration: underline">y</span><a href="/p" style="text-decoration: underline">z</a>', {"STR004": f"1 + {is_(1, of=2)}"}),
    ("justified", '<p style="text-align: ' + pick("justify", "left") + '">x</p>', {"STR005": is_(0, of=2)}),
    ("fixed", '<div style="position: ' + pick("fixed", "sticky", "absolute") + '">x</div>', {"FOC001": is_(0, 1, of=3)}),
    ("target", '<button style="width: @{14 + s_suppkey % 20}@px">go</button>', {"TGT001": f"CAST({K} % 20 < 10 AS INT)"}),
    ("target_image", '<a href="/x"><img src="i.png" alt="A mill" width="@{14 + s_suppkey % 20}@"></a>', {"TGT001": f"CAST({K} % 20 < 10 AS INT)"}),
    ("target_inline", f'<p>Some long text here {KEY} <a href="/x" style="width: 10px">go on</a></p>', {}),
    ("mouse", "<div " + pick("onmouseover", "onclick") + '="x()">a</div><select onchange="' + pick("location.href=this.value", "total()", "window.open(this.value)") + '"><option>a</option></select>', {"EVT001": is_(0, of=2), "EVT002": is_(0, 2, of=3)}),
    ("buttons", "<button>" + pick("", "&nbsp;", "Go", '<img src="x.png" alt="Go">') + '</button><input type="submit"><input type="button" value="v">', {"BTN001": f"1 + {is_(0, 1, of=4)}"}),
    ("deprecated", f"<font>a</font><tt>{KEY}</tt><big>c</big><del>d</del>", {"STR002": "3"}),
]
ARIA = [
    ("references", '<div id="a">x</div><span aria-labelledby="a ' + pick("b", "", "b c") + '">y</span>', {"ARIA001": is_(0, 2, of=3)}),
    ("hidden", '<div aria-hidden="true">' + pick('<a href="/x">y</a>', "<a>y</a>", '<span tabindex="-1">y</span>') + '</div><button aria-hidden="true">z</button>', {"ARIA002": f"1 + {is_(0, of=3)}"}),
    ("properties", '<div role="slider"' + pick("", ' aria-valuenow="1"') + '>a</div><div role="scrollbar">b</div>', {"ARIA003": f"2 + {is_(0, of=2)}"}),
    ("roles", '<div role="' + pick("wizard", "BUTTON", "alert") + '">a</div>', {"ARIA004": is_(0, of=3)}),
    ("ids", times('<p id="i">x</p>', f"{K} % 4") + f'<p id="j{KEY}">y</p>', {"DID001": is_(2, 3, of=4)}),
]
LINKS = [
    ("vague", '<a href="/r">' + pick("click here", "Read more about it", "Annual report", "https://example.org") + "</a>", {"LNK001": is_(0, 1, of=4), "LNK004": is_(0, of=4), "LNK005": is_(3, of=4)}),
    ("titles", '<a href="/r" title="' + pick("Annual report", "Annual report for all", "Other") + '">Annual report</a>', {"LNK002": is_(0, 1, of=3)}),
    ("empty", f'<a href="/r{KEY}">' + pick("", "&nbsp;", '<img src="i.png" alt="A mill">', "Old mill") + "</a>", {"LNK003": is_(0, 1, of=4)}),
    ("adjacent", '<a href="/a">One</a> <a href="' + pick("/a", "/b") + '">Two</a>', {"LNK006": is_(0, of=2)}),
    ("spaces", '<a href="' + pick("/a b", "#a b", "/ab") + '">Some place</a>', {"LNK008": is_(0, of=3), "LNK009": is_(1, of=3)}),
    ("redundant", '<a href="/v">Seen</a>' + times('<p>t</p><a href="/v"></a>', f"{K} % 3"), {"LNK011": f"{K} % 3", "LNK003": f"{K} % 3"}),
    ("empty_twice", f'<a href="/w{KEY}"></a><p>t</p><a href="/w{KEY}"></a>', {"LNK011": "1", "LNK003": "2"}),
    ("pair", '<a href="/p"><img src="i.png" alt="A mill"></a> <a href="' + pick("/p", "/q") + '">The mill</a>', {"LNK012": is_(0, of=2), "LNK006": is_(0, of=2)}),
    ("anchors", '<a href="#">Empty place</a><a href="#sec">Section one</a>' + pick('<p id="sec">x</p>', "<p>x</p>"), {"LNK009": f"1 + {is_(1, of=2)}"}),
    ("ambiguous", '<a href="/a">Plan</a><p>x</p><a href="' + pick("/a", "/b") + '">plan</a>', {"LNK010": f"2 * {is_(1, of=2)}"}),
]
DOCUMENTS = [
    ("files", '<a href="/f/x' + pick(".pdf", ".docx", ".html", ".PDF?v=1") + '">Plan of it</a>', {"LNK007": is_(0, 1, 3, of=4), "PDF001": is_(0, 3, of=4)}),
    ("page_of_pdf", f'<a href="/f/x{KEY}.pdf#page=2">Plan of it</a>', {"PDF001": "1"}),
    ("google", '<a href="https://docs.google.com/' + pick("document/d/1", "forms/d/1", "x") + '">Sheet of it</a>', {"LNK007": is_(0, 1, of=3), "DOC001": is_(0, 1, of=3)}),
    ("assets", '<a href="' + pick("/files/12/y", "/pages/files/12", "/media_objects/7") + '">Thing</a>', {"DOC002": is_(0, 2, of=3)}),
]
MEDIA = [
    ("video", '<video src="v.mp4"' + pick(" autoplay", "") + "></video><p>" + pick("Transcript of it", "Other", "Words") + "</p>", {"MDA001": is_(1, 2, of=3), "MDA002": is_(0, of=2)}),
    ("frame", f'<iframe src="https://www.youtube.com/embed/{KEY}"' + pick(' title="A film"', "") + "></iframe>", {"MDA001": is_(1, of=2), "MDA003": "1", "MDA004": "1"}),
    ("twice", f'<a href="https://youtu.be/{KEY}">Film one</a><iframe src="https://youtu.be/{KEY}" title="t"></iframe>', {"MDA003": "1", "MDA004": "1"}),
    ("studio", '<iframe src="https://x.' + pick("instructuremedia.com", "vimeo.com") + '/e/1" title="t"></iframe>', {"MDA005": is_(0, of=2), "MDA006": is_(0, of=2)}),
    ("math", "<p>" + pick("so $a+b$ is", "$$a+b$$", "\\frac{a}{b}", "for $5 only", "plain") + "</p>", {"MATH001": is_(0, 1, 2, of=5)}),
]
FORMS = [
    ("alike", '<form><input name="email" autocomplete="email"><input name="' + pick("E-mail!", "city") + '" autocomplete="on"></form>', {"FORM001": is_(0, of=2)}),
    ("password", '<input type="password" autocomplete="' + pick("off", "current-password", "") + '">', {"AUTH001": is_(0, 2, of=3)}),
    ("labels", '<label for="a">' + pick("", "&nbsp;", "Name") + '</label><input id="a" type="text" name="x">', {"FORM003": is_(0, 1, of=3)}),
    ("choices", '<input type="radio" name="r"><input type="radio" name="' + pick("r", "s") + '"><fieldset><input type="checkbox" name="c"></fieldset>', {"FORM005": f"1 + {is_(1, of=2)}"}),
    ("orphans", '<label for="' + pick("a", "zz") + '">N</label><input id="a">', {"FORM007": is_(1, of=2)}),
    ("personal", '<input type="' + pick("email", "text", "hidden") + '" name="' + pick("zip_code", "q") + '">', {"FORM009": f"CASE WHEN {K} % 3 = 0 THEN 1 WHEN {K} % 3 = 1 AND {K} % 2 = 0 THEN 1 ELSE 0 END"}),
]
_GREY = f"(({K} * 5) % 256)"
_LINEAR = f"(CASE WHEN {_GREY} / 255.0 <= 0.03928 THEN {_GREY} / 255.0 / 12.92 ELSE pow(({_GREY} / 255.0 + 0.055) / 1.055, 2.4) END)"
_RGB = f"rgb(@{{{_GREY}}}@, @{{{_GREY}}}@, @{{{_GREY}}}@)"
CONTRAST = [
    ("on_white", f'<p style="color: {_RGB}; background-color: #ffffff">x</p>', {"CLR001": f"CAST(1.05 / ({_LINEAR} + 0.05) < 4.7 AS INT)"}),
    ("assumed", f'<p style="color: {_RGB}">x</p>', {"CLR001": f"CAST(1.05 / ({_LINEAR} + 0.05) < 4.7 AS INT)"}),
    ("on_black", f'<p style="color: {_RGB}; background-color: black">x</p>', {"CLR001": f"CAST(({_LINEAR} + 0.05) / 0.05 < 4.7 AS INT)"}),
    ("large", f'<p style="font-size: 24px; color: {_RGB}; background-color: #fff">x</p>', {"CLR001": f"CAST(1.05 / ({_LINEAR} + 0.05) < 3.2 AS INT)"}),
    ("inherited", f'<div style="color: {_RGB}; background-color: #ffffff"><span>x</span></div>', {"CLR001": f"2 * CAST(1.05 / ({_LINEAR} + 0.05) < 4.7 AS INT)"}),
]
RULE_CASES = {"images": IMAGES, "headings": HEADINGS, "tables": TABLES, "structure": STRUCTURE, "aria": ARIA, "links": LINKS, "documents": DOCUMENTS, "media": MEDIA, "forms": FORMS, "contrast": CONTRAST}
# Rules that a query looks at: prefixes of their ids.
LOOKED_AT = {
    "images": ("IMG",), "headings": ("HDG",), "tables": ("TBL",), "structure": ("LIST", "STR", "FOC", "TGT", "EVT", "BTN"), "aria": ("ARIA", "DID"), "links": ("LNK",),
    "documents": ("DOC", "PDF", "LNK007"), "media": ("MDA", "MATH"), "forms": ("FORM", "AUTH"), "contrast": ("CLR",),
}

_LABEL = f'<span style="{HIDDEN}">'
# (case, page, repaired page).
REPAIRS = {
    "headings": [
        ("HDG001", f"<h1>{NAME}</h1><p>x</p>", f"<h2>{NAME}</h2><p>x</p>"),
        ("HDG002", "<h2>A</h2>@{'<h' || (3 + s_suppkey % 4) || '>B</h' || (3 + s_suppkey % 4) || '>'}@<h6>C</h6>", "<h2>A</h2><h3>B</h3><h4>C</h4>"),
        ("HDG003", "<h2>A</h2><h3>" + pick("", NAME, "&nbsp;") + "</h3>", "<h2>A</h2>" + pick("", f"<h3>{NAME}</h3>", "")),
        ("HDG004", f"<h2>A</h2><p><strong>Bold {KEY}</strong></p>", f"<h2>A</h2><h3>Bold {KEY}</h3>"),
        ("HDG006", f"<h2>{times('abcd ', f'20 + {K} % 10')}end</h2>", "@{CASE WHEN s_suppkey % 10 < 4 THEN '<h2>' || repeat('abcd ', CAST(20 + s_suppkey % 10 AS INT)) || 'end</h2>' ELSE '<h2>' || rtrim(repeat('abcd ', 24)) || '</h2><p>' || repeat('abcd ', CAST(s_suppkey % 10 - 4 AS INT)) || 'end</p>' END}@"),
    ],
    "tables": [
        ("TBL001", f"<table><tr><td>a</td><td>b{KEY}</td></tr><tr><td>c</td><td>d</td></tr></table>", f'<table><tr><th scope="col">a</th><th scope="col">b{KEY}</th></tr><tr><td>c</td><td>d</td></tr></table>'),
        ("TBL002", f"<table><caption>c</caption><tr><th>a</th><th>b</th></tr><tr><th>r</th><td>{KEY}</td></tr></table>", f'<table><caption>c</caption><tr><th scope="col">a</th><th scope="col">b</th></tr><tr><th scope="row">r</th><td>{KEY}</td></tr></table>'),
        ("TBL003", f'<h2>Plan {KEY}</h2><table><tr><th scope="col">a</th><th scope="col">b</th></tr><tr><td>1</td><td>2</td></tr></table>', f'<h2>Plan {KEY}</h2><table><caption style="text-align: center; font-weight: bold; padding: 8px;">Table: Plan {KEY}</caption><tr><th scope="col">a</th><th scope="col">b</th></tr><tr><td>1</td><td>2</td></tr></table>'),
        ("TBL004", f'<table><caption>c</caption><tr><th scope="col"></th><th scope="col">b</th></tr><tr><td>1</td><td>{KEY}</td></tr></table>', f'<table><caption>c</caption><tr><td></td><th scope="col">b</th></tr><tr><td>1</td><td>{KEY}</td></tr></table>'),
        ("TBL005", f"<table><tr><td><table><tr><td>1</td></tr><tr><td>{KEY}</td></tr></table></td><td>x</td></tr></table>", f'<table><tr><td><table role="presentation"><tr><td>1</td></tr><tr><td>{KEY}</td></tr></table></td><td>x</td></tr></table>'),
        ("TBL006", f'<table><caption>c</caption><tr><th scope="col">h</th><th scope="col">i</th></tr><tr><td></td><td>{KEY}</td></tr></table>', f'<table><caption>c</caption><tr><th scope="col">h</th><th scope="col">i</th></tr><tr><td>@{{chr(160)}}@</td><td>{KEY}</td></tr></table>'),
    ],
    "structure": [
        ("LIST001", f"<p>1. a{KEY}</p><p>2. b</p>", f"<ol><li>a{KEY}</li><li>b</li></ol>"),
        ("LIST001_dashes", f"<p>- a{KEY}</p><p>- b</p><p>c</p>", f"<ul><li>a{KEY}</li><li>b</li></ul><p>c</p>"),
        ("STR001", f"<p></p><p></p><p>x{KEY}</p>", f"<p></p><p>x{KEY}</p>"),
        ("STR002", f'<center>{NAME}</center><tt>c</tt><strike>d</strike><font color="#112233" face="Arial">e</font>', f'<div style="text-align: center;">{NAME}</div><code>c</code><del>d</del><span style="color: #112233; font-family: Arial">e</span>'),
        ("STR003", '<p style="font-size: @{5 + s_suppkey % 5}@px; margin: 0">x</p>', '<p style="margin: 0">x</p>'),
        ("STR004", f'<p><u>a{KEY}</u> and <span style="text-decoration: underline; margin: 0">b</span></p>', f'<p><em>a{KEY}</em> and <span style="margin: 0">b</span></p>'),
        ("STR005", f'<p style="text-align: justify">x{KEY}</p>', f'<p style="text-align: left">x{KEY}</p>'),
        ("ARIA001", f'<div id="a">x</div><span aria-labelledby="a b{KEY}">y</span><em aria-controls="c">z</em>', '<div id="a">x</div><span aria-labelledby="a">y</span><em>z</em>'),
        ("DID001", f'<p id="i">a</p><p id="i">b{KEY}</p><p id="i-2">c</p>', f'<p id="i">a</p><p id="i-3">b{KEY}</p><p id="i-2">c</p>'),
        ("TGT001", '<div><button style="width: @{10 + s_suppkey % 10}@px">go</button></div>', '<div><button style="width: 24px">go</button></div>'),
        ("FOC001", f'<div style="position: fixed"><a href="/x{KEY}">Some place</a></div>', f'<div style="position: fixed"><a href="/x{KEY}" style="scroll-margin-top: 80px;">Some place</a></div>'),
        ("symbols", f"<h1>T{KEY}</h1><span>►</span>", f'<h2>T{KEY}</h2><span aria-hidden="true">►</span>'),
    ],
    "images": [
        ("IMG001", f'<img src="/f/old_mill-{KEY}.png">', f'<img src="/f/old_mill-{KEY}.png" alt="Old Mill {KEY}"/>'),
        ("IMG004", f'<img src="a{KEY}.png" alt="{"wood " * 30}">', f'<img src="a{KEY}.png" alt="{("wood " * 20).strip()}"/>'),
        ("IMG005", f'<a href="/m" aria-label="The mill {KEY}"><img src="x.png" alt=""></a>', f'<a href="/m" aria-label="The mill {KEY}"><img src="x.png" alt="The mill {KEY}"/></a>'),
        ("IMG009", f'<img src="a{KEY}.png" alt="Image of a mill">', f'<img src="a{KEY}.png" alt="A mill"/>'),
        ("equal", f'<h1>T</h1><img src="1.png" alt="A mill {NAME}"><p>a</p><img src="2.png" alt="A mill {NAME}">', f'<h2>T</h2><img src="1.png" alt="A mill {NAME}"/><p>a</p><img src="2.png" alt="A mill {NAME} (2)"/>'),
        ("spacer", '<img src="' + pick("dot", "a.gif") + '" width="1" alt="">', '<img src="' + pick("dot", "a.gif") + '" width="1" alt="" role="presentation"/>'),
    ],
    "links": [
        ("LNK001", f'<a href="/big-plan{KEY}.html">click here</a>', f'<a href="/big-plan{KEY}.html">Big plan{KEY}</a>'),
        ("LNK002", f'<a href="/r" title="Annual report">Annual report {KEY}</a>', f'<a href="/r">Annual report {KEY}</a>'),
        ("LNK003", f'<a href="/docs/my_file-{KEY}.html"></a>', f'<a href="/docs/my_file-{KEY}.html">{_LABEL}My File {KEY}</span></a>'),
        ("LNK005", f'<a href="https://www.example.com/{KEY}/big-plan">https://www.example.com/{KEY}/big-plan</a>', f'<a href="https://www.example.com/{KEY}/big-plan">Example Big Plan</a>'),
        ("LNK006", f'<a href="/a{KEY}">One</a><a href="/a{KEY}">Two</a>', f'<a href="/a{KEY}">One Two</a>'),
        ("LNK008", f'<a href="/a b{KEY}">Some place</a>', f'<a href="/a%20b{KEY}">Some place</a>'),
        ("LNK009", f'<p><a href="#nope">Place {KEY}</a></p>', f"<p>Place {KEY}</p>"),
        ("LNK010", f'<a href="/a/one.html">Plan</a><p>x</p><a href="/b/two{KEY}.html">plan</a>', f'<a href="/a/one.html">Plan</a><p>x</p><a href="/b/two{KEY}.html">plan (two{KEY})</a>'),
        ("LNK011", f'<a href="/v{KEY}">Seen</a><p>t</p><a href="/v{KEY}" aria-label="x"></a>', f'<a href="/v{KEY}">Seen</a><p>t</p>'),
        ("LNK012", f'<a href="/p{KEY}@{{chr(10)}}@"><img src="i.png" alt="A mill"></a><a href="/p{KEY}">The mill</a>', f'<a href="/p{KEY}@{{chr(10)}}@"><img src="i.png" alt="The mill"/></a>'),
        ("doubled", f'<h1>T</h1><a href="https://old.example/https://new.example/{KEY}">The mill</a>', f'<h2>T</h2><a href="https://new.example/{KEY}">The mill</a>'),
    ],
    "media": [
        ("MDA001", f'<iframe src="https://www.youtube.com/embed/{KEY}"></iframe>', f'<iframe src="https://www.youtube.com/embed/{KEY}" title="Embedded video from YouTube"></iframe>'),
        ("MDA002", f'<video src="v.mp4" autoplay aria-label="f{KEY}"></video>', f'<video src="v.mp4" aria-label="f{KEY}"></video>'),
        ("MATH001", f"<p>So $x^2$ is {KEY}.</p>", f'<p>So <span role="math" aria-label="x^2">x<sup>2</sup></span> is {KEY}.</p>'),
        ("AUTH001", f'<input type="password" name="p{KEY}">', f'<input type="password" name="p{KEY}" autocomplete="current-password"/>'),
        ("BTN001", f'<p>a{KEY}</p><button type="submit"></button><input type="reset">', f'<p>a{KEY}</p><button type="submit" aria-label="Submit"></button><input type="reset" value="Reset"/>'),
        ("CLR001", f'<p style="color: #cccccc; background-color: #ffffff">pale {KEY}</p>', f'<p style="color: #737373; background-color: #ffffff">pale {KEY}</p>'),
    ],
}


def _pages(spark: SparkSession, sf_dir: str, cases: list[tuple[str, str]]) -> DataFrame:
    """A page for each case and row."""
    rows = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name"))
    made = rows.select("s_suppkey", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.expr(expression(html)).alias("html")) for name, html in cases))).alias("case"))
    null = F.lit(None).cast("string")
    return made.select(
        F.col("case.name").alias("course_id"), F.col("s_suppkey").cast("string").alias("page_id"), null.alias("identifier"), F.lit("A page").alias("title"),
        F.lit("wiki_page").alias("content_type"), null.alias("file_path"), null.alias("canvas_url"), F.col("case.html").alias("html"),
    )


def _rules_query(group: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _pages(spark, sf_dir, [(name, html) for name, html, _ in RULE_CASES[group]])
        looked_at = reduce(lambda a, b: a | b, (F.col("rule").startswith(p) for p in LOOKED_AT[group]))
        found = findings(elements(own)).where(looked_at)
        return found.groupBy(F.col("course_id").alias("case_name"), F.col("page_id").cast("long").alias("k"), "rule").agg(F.count("*").alias("issues"))

    run.__name__, run.__doc__ = f"rules_{group}", f"Rules of {group} over constructed pages."
    return run


def _rules_sql(group: str) -> str:
    parts = [f"SELECT '{name}' AS case_name, {K} AS k, '{rule}' AS rule, CAST({count} AS BIGINT) AS issues FROM supplier" for name, _, wants in RULE_CASES[group] for rule, count in wants.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE issues > 0"


def _repairs_query(group: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _pages(spark, sf_dir, [(name, html) for name, html, _ in REPAIRS[group]])
        new = repaired(own, report.issues(own), sanitized=False)
        return new.select(F.col("course_id").alias("case_name"), F.col("page_id").cast("long").alias("k"), "html")

    run.__name__, run.__doc__ = f"repairs_{group}", f"Repairs of {group}: the pages as they are written back."
    return run


def _repairs_sql(group: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS case_name, {K} AS k, {expression(html)} AS html FROM supplier" for name, _, html in REPAIRS[group])


# (case, page, what the editor keeps of it after repair, elements dropped).
SANITIZED = [
    ("scripts", f"<h1>T</h1><script>x</script><style>y</style><p>a{KEY}</p>", f"<h2>T</h2><p>a{KEY}</p>", "2"),
    ("figures", f'<h1>T</h1><figure><img src="a.png" alt="A mill"><figcaption>c{KEY}</figcaption></figure>', f'<h2>T</h2><img src="a.png" alt="A mill"/>c{KEY}', "2"),
    ("attributes", f'<h1>T</h1><div role="wizard" onclick="x()" data-x="1" style="display: grid; filter: x; color: black">a{KEY}</div>', f'<h2>T</h2><div data-x="1" style="display: grid; color: black">a{KEY}</div>', "0"),
    ("forms", f'<h1>T</h1><form><input name="q"></form><p role="Alert" lang="en" align="left">b{KEY}</p>', f'<h2>T</h2><p role="Alert" lang="en">b{KEY}</p>', "2"),
]


def sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired pages after the editor's allow-list."""
    own = _pages(spark, sf_dir, [(name, html) for name, html, _, _ in SANITIZED])
    new = repaired(own, report.issues(own))
    return new.select(F.col("course_id").alias("case_name"), F.col("page_id").cast("long").alias("k"), "html", "elements_dropped")


SANITIZED_SQL = " UNION ALL ".join(f"SELECT '{name}' AS case_name, {K} AS k, {expression(html)} AS html, CAST({n} AS INTEGER) AS elements_dropped FROM supplier" for name, _, html, n in SANITIZED)


def titled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without headings get their title as one, if they hold more than 50 characters."""
    own = _pages(spark, sf_dir, [("titled", f"<p>{times('word ', f'{K} % 20')}end</p>")])
    new = repaired(own, report.issues(own), with_title=True, sanitized=False)
    return new.select(F.col("page_id").cast("long").alias("k"), "html")


TITLED_SQL = f"SELECT {K} AS k, CASE WHEN 5 * ({K} % 20) + 3 > 50 THEN '<h2>A page</h2>' ELSE '' END || '<p>' || repeat('word ', CAST({K} % 20 AS INT)) || 'end</p>' AS html FROM supplier"


def help_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the help link that other pages of their course share."""
    own = _pages(spark, sf_dir, [("help", "<h2>A</h2>" + pick('<footer><a href="/help">Help</a></footer>', '<div role="contentinfo"><a href="/desk/@{s_suppkey % 2}@">Support</a></div>', "<footer>none</footer>"))])
    own = own.withColumn("course_id", (F.col("page_id").cast("long") % 10).cast("string"))
    found = report.issues(own, course_rules=True).where("rule_id = 'HELP001'")
    return found.select(F.col("course_id").cast("long").alias("course_id"), F.col("page_id").cast("long").alias("k"))


HELP_SQL = f"""
    WITH p AS (SELECT {K} AS k, {K} % 10 AS course_id, CASE {K} % 3 WHEN 0 THEN '/help' WHEN 1 THEN '/desk/' || ({K} % 2) END AS href FROM supplier),
    c AS (SELECT course_id, href, count(*) AS n FROM p WHERE href IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT course_id, k FROM p WHERE course_id IN (SELECT course_id FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.course_id = p.course_id AND c.href = p.href)
"""


def document_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pages link to, in the package or outside."""
    html = f'<a href="$IMS-CC-FILEBASE$/docs/f%20@{{s_suppkey % 3}}@.pdf">Text</a><a href="https://h.example/d/@{{s_suppkey % 2}}@.DOCX?v={KEY}">Other</a><a href="/x.html">no</a>'
    own = _pages(spark, sf_dir, [("links", html)]).withColumn("course_id", (F.col("page_id").cast("long") % 4).cast("string"))
    found = documents.link_inventory(elements(own, facts=False))
    return found.select(F.col("course_id").cast("long").alias("course_id"), "key", "is_external", "extension", F.size("original_hrefs").cast("long").alias("hrefs"), F.size("source_page_ids").cast("long").alias("pages"))


DOCUMENT_SQL = f"""
    SELECT {K} % 4 AS course_id, 'web_resources/docs/f ' || ({K} % 3) || '.pdf' AS key, false AS is_external, 'pdf' AS extension, CAST(1 AS BIGINT) AS hrefs, count(*) AS pages FROM supplier GROUP BY {K} % 4, {K} % 3
    UNION ALL SELECT {K} % 4, 'https://h.example/d/' || ({K} % 2) || '.DOCX', true, 'docx', count(DISTINCT {K}), count(*) FROM supplier GROUP BY {K} % 4, {K} % 2
"""


def improved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of customers as courses and their orders as pages, the five pages that lost most issues."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select((F.col("o_custkey") % 50).alias("course_id"), F.col("o_orderkey").alias("page_id"), (F.col("o_orderkey") % 23).alias("issues_before"), (F.col("o_orderkey") % 7).alias("issues_after"))
    return views.most_improved(rows).select("course_id", "page_id", "improvement", "rank")


IMPROVED_SQL = """
    SELECT o_custkey % 50 AS course_id, o_orderkey AS page_id, o_orderkey % 23 - o_orderkey % 7 AS improvement, CAST(row_number() OVER w AS INTEGER) AS rank FROM orders WHERE o_orderkey % 23 > o_orderkey % 7
    WINDOW w AS (PARTITION BY o_custkey % 50 ORDER BY o_orderkey % 23 - o_orderkey % 7 DESC, o_orderkey) QUALIFY rank <= 5
"""


def criteria_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of constructed pages by category of criteria."""
    own = _pages(spark, sf_dir, [("criteria", "<h1>T</h1><p>x</p>" + pick('<a href="/r">click here</a>', '<img src="a.png">', "<p>y</p>"))])
    rolled = report.criteria_rollup(own, report.issues(own).where("rule_id IN ('HDG001', 'LNK001', 'IMG001')"))
    return views.criteria_by_category(rolled).select("category_id", F.size("criteria").cast("long").alias("criteria"), F.col("issue_count").cast("long").alias("issue_count"), F.col("pages_affected").cast("long").alias("pages_affected"))


CATEGORIES_SQL = f"""
    WITH d AS (SELECT unnest(['{"', '".join(r[0] for r in dims.criteria_rows() if r[2] in ("A", "AA"))}']) AS id),
    n AS (SELECT count(*) AS h, count(*) FILTER ({K} % 3 = 0) AS l, count(*) FILTER ({K} % 3 = 1) AS i FROM supplier)
    SELECT regexp_replace(id, '\.[^.]*$', '') AS category_id, count(*) AS criteria, CAST(sum(CASE id WHEN '1.3.1' THEN h WHEN '2.4.4' THEN l WHEN '1.1.1' THEN i ELSE 0 END) AS BIGINT) AS issue_count,
      CAST(sum(CASE id WHEN '1.3.1' THEN h WHEN '2.4.4' THEN l WHEN '1.1.1' THEN i ELSE 0 END) AS BIGINT) AS pages_affected FROM d, n GROUP BY 1
"""


def alt_texts_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts, joined to the images of their course: exact addresses, else parts of them."""
    own = _pages(spark, sf_dir, [("alts", f'<img src="/f/a{KEY}.png"><img src="/f/shared.png?v={KEY}"><img src="/f/none-{KEY}.png" alt="A mill">')])
    alts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("alts").alias("course_id"), F.concat(F.lit("/f/a"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("src"), F.concat(F.lit("Text of "), "s_name").alias("alt"))
    alts = alts.union(spark.range(1).select(F.lit("alts"), F.lit("/f/shared.png"), F.lit("A shared pond")))
    new = repaired(own, report.issues(own), alts=alts, sanitized=False)
    return new.select(F.col("page_id").cast("long").alias("k"), "html")


ALTS_SQL = f"""SELECT {K} AS k, '<img src="/f/a' || {K} || '.png" alt="Text of ' || s_name || '"/><img src="/f/shared.png?v=' || {K} || '" alt="A shared pond"/><img src="/f/none-' || {K} || '.png" alt="A mill"/>' AS html FROM supplier"""


def rendered_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as a browser saw them, repaired in the page that names its element."""
    own = _pages(spark, sf_dir, [("rendered", f'<p class="c">pale {KEY}</p><p>dark</p>')])
    meta = F.struct(F.lit("#cccccc").alias("fg_color"), F.lit("#ffffff").alias("bg_color"), F.lit(1.6).alias("contrast_ratio"), F.lit("4.5:1").alias("expected_ratio"), F.lit("12.0pt (16px)").alias("font_size"), F.lit("normal").alias("font_weight"), F.lit("p").alias("target"))
    issues = own.select("course_id", "page_id", F.lit("CLR001").alias("rule_id"), F.lit(True).alias("can_auto_fix"), meta.alias("axe_meta"), F.lit('<p class="c">').alias("element_html"))
    new = repaired(own, issues, sanitized=False)
    return new.select(F.col("page_id").cast("long").alias("k"), "html")


RENDERED_SQL = f"""SELECT {K} AS k, '<p class="c" style="color: #737373">pale ' || {K} || '</p><p>dark</p>' AS html FROM supplier"""


QUERIES = {f"rules_{g}": _rules_query(g) for g in RULE_CASES} | {f"repairs_{g}": _repairs_query(g) for g in REPAIRS}
ORACLE_SQL = {f"rules_{g}": _rules_sql(g) for g in RULE_CASES} | {f"repairs_{g}": _repairs_sql(g) for g in REPAIRS}
for _query, _sql in ((sanitized_pages, SANITIZED_SQL), (titled_pages, TITLED_SQL), (help_links, HELP_SQL), (document_inventory, DOCUMENT_SQL),
    (improved_pages, IMPROVED_SQL), (criteria_categories, CATEGORIES_SQL), (alt_texts_applied, ALTS_SQL), (rendered_contrast, RENDERED_SQL)):
    QUERIES[_query.__name__], ORACLE_SQL[_query.__name__] = _query, _sql
