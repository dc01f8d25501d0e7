"""Pages to elements: one parse of each page, which states the facts of its tree that the rules ask for.

Facts are counts, neighbours, and texts; every judgement over them is a column
expression elsewhere. A page is parsed within its own row, so nothing is
shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lumenpage.schema import ELEMENTS
from lumenpage.sources.dom import HIDDEN_TEXT, Element, Text, blank, body_of, parse, same

#: Characters of an element's HTML that a finding shows; rows that share a batch; rows of a table that share a task.
HTML_CHARS, BATCH_ROWS, TASK_ROWS = 200, 2000, 4000
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_CONTROLS = frozenset(("button", "input", "select", "textarea"))

# Classes of embedded files, words and addresses of help links, list markers in their order.
FILE_CLASSES = {"instructure_scribd_file", "instructure_file_link", "preview_in_overlay", "inline_disabled"}
HELP_WORDS = ("help", "support", "contact", "faq", "assistance")
HELP_PATHS = ("help", "support", "contact", "faq")
MARKERS = (
    ("numeric", re.compile(r"\d+[.)]\s")),
    ("letter", re.compile(r"[a-z][.)]\s")),
    ("upper_letter", re.compile(r"[A-Z][.)]\s")),
    ("roman", re.compile(r"(i{1,3}|iv|vi{0,3})[.)]\s")),
    ("unordered", re.compile(r"[-*•]+\s?")),
)


def marker(text: str) -> str | None:
    """The kind of list marker that a line begins with."""
    return next((name for name, pattern in MARKERS if pattern.match(text)), None)


def cut(node: Element, n: int = HTML_CHARS) -> str:
    return node.head(n)


def focusable(node: Element) -> bool:
    return node.tag in _CONTROLS or (node.tag == "a" and bool(node.get("href"))) or ("tabindex" in node.attrs and node.get("tabindex").strip() != "-1")


def lines_of(paragraph: Element) -> list[str]:
    """The stripped text between line breaks; comments count as text."""
    lines, own = [], ""
    for node in paragraph.walk():
        if isinstance(node, Element):
            if node.tag == "br":
                lines.append(own.strip())
                own = ""
        else:
            own += node.value
    return [*lines, own.strip()]


def _plain(paragraph: Element) -> bool:
    return paragraph.first("table", "div", "section", "article", "figure", "ol", "ul") is None


def _lead(paragraph: Element, chars: int = 64) -> str:
    """The first characters of a paragraph's text; enough to tell its marker, however much it holds."""
    out = ""
    for x in paragraph.strings():
        if x := x.strip():
            out += f" {x}" if out else x
            if len(out) >= chars:
                break
    return out


def _is_break(node: Element | Text) -> bool:
    return isinstance(node, Element) and node.tag == "br"


def _is_paragraph(node: Element | Text) -> bool:
    return isinstance(node, Element) and node.tag == "p"


def list_runs(body: Element) -> list[tuple[list[Element], list[str] | None]]:
    """Paragraphs that read as lists: runs of marked siblings, then single ones with marked lines (and these lines).

    Each group of siblings is read once, from the left. A run goes on over line
    breaks, and over an empty paragraph that the next one of its kind directly
    follows.
    """
    paragraphs = body.elements("p")
    place = {id(p): k for k, p in enumerate(paragraphs)}
    leads = {id(p): _lead(p) for p in paragraphs}
    plain = {id(p): _plain(p) for p in paragraphs if marker(leads[id(p)])}
    kind = lambda n: marker(leads[id(n)]) if _is_paragraph(n) and id(n) in leads else None
    runs: list[list[Element]] = []
    for parent in {id(p.parent): p.parent for p in paragraphs}.values():
        row = [n for n in parent.children if not blank(n)]
        start = 0
        while start < len(row):
            own = kind(row[start])
            if not own or not plain[id(row[start])]:
                start += 1
                continue
            run, at = [row[start]], start + 1
            while at < len(row):
                node = row[at]
                if _is_paragraph(node) and leads[id(node)]:
                    if kind(node) != own or not plain[id(node)]:
                        break
                    run.append(node)
                elif not _is_break(node) and not (_is_paragraph(node) and at + 1 < len(row) and kind(row[at + 1]) == own):
                    break
                at += 1
            if len(run) >= 2:
                runs.append(run)
            start = max(start + 1, at if len(run) >= 2 else 0)
    runs.sort(key=lambda run: place[id(run[0])])
    used = {id(p) for run in runs for p in run}
    found: list[tuple[list[Element], list[str] | None]] = [(run, None) for run in runs]
    for p in paragraphs:
        if id(p) not in used and p.first("br") is not None and _plain(p):
            lines = [line for line in lines_of(p) if line]
            kinds = [m for m in map(marker, lines) if m]
            if len(kinds) >= 2 and len(set(kinds)) == 1:
                found.append(([p], lines))
    return found


def is_empty(node: Element) -> bool:
    """Nothing in it but blanks and line breaks, and no id, role or aria attribute."""
    if not all(blank(c) or _is_break(c) for c in node.children):
        return False
    return not (node.get("id") or node.get("role") or any(a.startswith("aria-") for a in node.attrs))


def empty_runs(body: Element) -> list[tuple[Element, int]]:
    """Runs of empty paragraphs, then divisions; each one must equal what stands next to the first."""
    found = []
    for tag in ("p", "div"):
        own = body.elements(tag)
        k = 0
        while k < len(own) - 1:
            if not is_empty(own[k]):
                k += 1
                continue
            beside, last = own[k].next_significant(), k + 1
            while last < len(own) and is_empty(own[last]) and same(beside, own[last]):
                last += 1
            if last - k >= 2:
                found.append((own[k], last - k))
            k = last
    return found


def help_href(root: Element) -> str | None:
    """The first help link of a footer, else of a contentinfo region, else of the last element of the body."""
    body = body_of(root)

    def first(region: Element) -> str | None:
        for a in region.elements("a"):
            if "href" in a.attrs:
                text, href = a.text().lower(), a.get("href").lower()
                if any(w in text for w in HELP_WORDS) or any(f"/{w}" in href or href.startswith((f"{w}:", f"mailto:{w}")) for w in HELP_PATHS):
                    return a.get("href")
        return None

    regions = [*body.elements("footer"), *(e for e in body.elements() if e.get("role") == "contentinfo")]
    found = next((h for h in map(first, regions) if h), None)
    top = [c for c in body.children if isinstance(c, Element)]
    return found or (first(top[-1]) if top else None)


def is_blank_cell(cell: Element) -> bool:
    """ASCII white space alone counts as blank here, so that a no-break space fills a cell."""
    return not cell.raw().strip(" \t\n\r\x0b\x0c") and cell.first("img", "input", "select", "textarea") is None


def _grid(table: Element) -> dict:
    row = table.first("tr")
    cells = row.elements("td", "th") if row else []
    caption = table.first("caption")
    data = table.elements("td")
    return {
        "rows": [len(r.elements("td", "th")) for r in table.elements("tr")],
        "first_cells": [c.text()[:15] for c in cells[:3]],
        "colspan": cells[0].attrs.get("colspan", "1") if cells else None,
        "first_cell": cells[0].text() if cells else None,
        "heads": [h.text() for h in table.elements("th")],
        "cells": len(data),
        "empty": sum(map(is_blank_cell, data)),
        "caption": caption.text() if caption else None,
    }


def _inputs(form: Element) -> list[dict]:
    out = []
    labels = form.elements("label")
    for node in form.elements("input", "textarea", "select"):
        label = next((x for x in labels if node.get("id") and x.attrs.get("for") == node.get("id")), None)
        out.append({"kind": node.attrs.get("type", "text").lower(), "label": label.text() if label else "", "aria": node.get("aria-label"), "placeholder": node.get("placeholder"), "name": node.get("name"), "html": cut(node)})
    return out


class Tree:
    """A parsed page with what its elements are asked for, worked out in one walk.

    Elements have their number in document order, and the number of the last
    element below them. Their texts, images, focusable elements and the like are
    ranges of lists that the walk fills, so no subtree is read again.
    """

    def __init__(self, source: str | None):
        self.root = parse(source)
        self.body = body_of(self.root)
        self.every: list[Element] = []
        self.number: dict[int, int] = {id(self.root): 0}
        self.pieces: list[str] = []
        self.images: list[Element] = []
        self.shown: list[int] = [0]  # images with an alternative text, up to each image
        self.focus: list[int] = [0]
        self.captions: list[int] = [0]
        self.span: list[tuple[int, int]] = [(0, 0)]  # characters of the text
        self.pictures: list[tuple[int, int]] = [(0, 0)]
        self.last: list[int] = [0]
        self.below: list[dict[str, int]] = [{}]
        self.above: list[list[str]] = [[]]
        self.styles: list[list[str]] = [[]]
        self.place: dict[int, int] = {}  # among its siblings
        self._walk()
        self.text = "".join(self.pieces)

    def _walk(self) -> None:
        chars = 0
        stack: list[tuple[Element, int]] = [(self.root, 0)]
        while stack:
            node, at = stack.pop()
            own = self.number[id(node)]
            hidden = node.tag in HIDDEN_TEXT
            while at < len(node.children):
                child = node.children[at]
                at += 1
                if isinstance(child, Element):
                    self.place[id(child)] = at - 1
                    stack.append((node, at))
                    self._enter(child, own, chars)
                    stack.append((child, 0))
                    break
                if not hidden and child.kind == "text" and (value := child.value.strip()):
                    self.pieces.append(value)
                    chars += len(value)
            else:
                self.span[own] = (self.span[own][0], chars)
                self.pictures[own] = (self.pictures[own][0], len(self.images))
                self.last[own] = len(self.every)
                if node is not self.root:
                    up = self.below[self.number[id(node.parent)]]
                    for tag, n in self.below[own].items():
                        up[tag] = up.get(tag, 0) + n
                    up[node.tag] = up.get(node.tag, 0) + 1

    def _enter(self, node: Element, up: int, chars: int) -> None:
        self.every.append(node)
        self.number[id(node)] = len(self.every)
        self.focus.append(self.focus[-1] + focusable(node))
        self.captions.append(self.captions[-1] + (node.tag == "track" and node.get("kind") in ("captions", "subtitles")))
        if node.tag == "img":
            self.images.append(node)
            self.shown.append(self.shown[-1] + bool(node.get("alt").strip()))
        self.span.append((chars, chars))
        self.pictures.append((len(self.images), len(self.images)))
        self.last.append(len(self.every))
        self.below.append({})
        parent = node.parent
        known = self.above[up]
        self.above.append(known if parent.tag in known or parent is self.root else [parent.tag, *known])
        self.styles.append([node.get("style"), *self.styles[up]] if node.get("style") else self.styles[up])

    def text_of(self, node: Element) -> str:
        if node.tag in HIDDEN_TEXT:
            return node.text()
        a, z = self.span[self.number[id(node)]]
        return self.text[a:z]

    def chars_of(self, node: Element) -> int:
        a, z = self.span[self.number[id(node)]]
        return z - a

    def alts_of(self, node: Element) -> list[Element]:
        """The images below."""
        a, z = self.pictures[self.number[id(node)]]
        return self.images[a:z]

    def has_alt(self, node: Element) -> bool:
        a, z = self.pictures[self.number[id(node)]]
        return self.shown[z] > self.shown[a]

    def beside(self, node: Element) -> Element | Text | None:
        """The next sibling that isn't blank."""
        own = node.parent.children
        return next((own[k] for k in range(self.place[id(node)] + 1, len(own)) if not blank(own[k])), None)

    def element_after(self, node: Element) -> Element | None:
        own = node.parent.children
        return next((own[k] for k in range(self.place[id(node)] + 1, len(own)) if isinstance(own[k], Element)), None)

    def element_before(self, node: Element) -> Element | None:
        own = node.parent.children
        return next((own[k] for k in range(self.place[id(node)] - 1, -1, -1) if isinstance(own[k], Element)), None)


def _first(rows, key) -> list[dict]:
    """The first row of each key."""
    out: dict = {}
    for r in rows:
        out.setdefault(key(r), r)
    return list(out.values())


def _links(tree: Tree, links: list[Element], ids: set[str]) -> list[dict]:
    """The links of a page; what they have in common with others is counted once for all.

    ``destinations``: different addresses of named links with this text, in any
    case. ``covered``: a visible link has the same address. ``again``: an earlier
    link without content has it. ``broken``: a fragment that names nothing.
    """
    rows = [{"nid": tree.number[id(a)], "text": tree.text_of(a), "href": a.get("href"), "html": cut(a), "visible": bool(tree.chars_of(a)) or tree.has_alt(a)} for a in links]
    addresses: dict[str, set[str]] = {}
    shown, empty = set(), set()
    for r in rows:
        if r["text"] and r["href"]:
            addresses.setdefault(r["text"].lower(), set()).add(r["href"])
        if r["visible"]:
            shown.add(r["href"].strip())
    for r in rows:
        to = r["href"].strip()
        r |= {"to": to, "destinations": len(addresses.get(r["text"].lower(), ())), "covered": to in shown, "again": not r["visible"] and to in empty, "broken": r["href"].startswith("#") and (r["href"] == "#" or r["href"][1:] not in ids)}
        if not r["visible"]:
            empty.add(to)
    return rows


def _page(tree: Tree, links: list[Element]) -> dict:
    root, body, every, number = tree.root, tree.body, tree.every, tree.number
    refs = ("aria-labelledby", "aria-describedby", "aria-controls", "aria-owns")
    ids = {e.get("id") for e in every if "id" in e.attrs}
    times = Counter(own for e in every if (own := e.get("id").strip()))
    tagged: dict[str, list[Element]] = {}
    for e in every:
        tagged.setdefault(e.tag, []).append(e)
    inside = range(number[id(body)] + 1, tree.last[number[id(body)]] + 1)
    of_body = lambda *tags: [e for t in tags for e in tagged.get(t, ()) if number[id(e)] in inside]
    runs = []
    for run, lines in list_runs(body):
        items = [x[:40] for x in (lines or [tree.text_of(p) for p in run[:3]])[:3]]
        size = sum(marker(x) is not None for x in lines) if lines else len(run)
        runs.append({"nid": number[id(run[0])], "size": size, "preview": "; ".join(items), "html": cut(run[0]), "single": lines is not None})
    return {
        "repeated_ids": [{"id": own, "times": n} for own, n in times.items() if n > 1],
        "raw": root.raw(),
        "has_body": body is not root,
        "body_chars": tree.chars_of(body),
        "body_html": cut(body),
        "sub_headings": len(of_body(*_HEADINGS[1:])),
        "embeds": len(of_body("iframe", "embed", "object", "video")),
        "files": sum(1 for a in of_body("a") if FILE_CLASSES & set(a.get("class").split())),
        "links": _links(tree, links, ids),
        "list_runs": runs,
        "empty_runs": [{"nid": number[id(e)], "size": n, "tag": e.tag, "html": cut(e)} for e, n in empty_runs(body)],
        "refs": [{"nid": number[id(e)], "attr": r, "missing": [x for x in e.get(r).split() if x not in ids], "html": cut(e)} for r in refs for e in every if r in e.attrs],
        "labels": [{"nid": number[id(e)], "target": own, "known": own in ids, "html": cut(e)} for e in tagged.get("label", ()) for own in [e.get("for").strip()]],
        "videos": _first(
            ({"nid": number[id(e)], "frame": e.tag == "iframe", "url": e.get("src" if e.tag == "iframe" else "href"), "html": cut(e)} for tag in ("iframe", "a") for e in tagged.get(tag, ())), lambda v: v["url"]
        ),
        "choices": _first(
            (
                {"nid": number[id(e)], "kind": e.get("type").lower(), "name": e.get("name"), "html": cut(e)}
                for e in tagged.get("input", ()) if e.get("type").lower() in ("radio", "checkbox") and "fieldset" not in tree.above[number[id(e)]]
            ),
            lambda c: (c["kind"], c["name"]) if c["name"] else c["nid"],
        ),
        "code": [tree.text_of(c) for c in tagged.get("code", ())],
        "scripts": [{"src": s.get("src"), "text": s.raw()} for s in tagged.get("script", ())],
        "help_href": help_href(root),
    }


def element_rows(source: str | None, facts: bool = True, page_facts: bool = True) -> list[dict]:
    """The rows of a page: that of the page itself, then its elements in document order; without ``facts`` those of attributes alone, without ``page_facts`` none of the page."""
    tree = Tree(source)
    number = tree.number
    if not facts:
        return [{"nid": 0, "tag": "#document"}, *({"nid": k, "tag": e.tag, "attrs": list(e.attrs.items()), "text": tree.text_of(e)} for k, e in enumerate(tree.every, 1))]
    first, end = number[id(tree.body)], tree.last[number[id(tree.body)]]
    links = [e for e in tree.every if e.tag == "a"]
    after_link = dict(zip(map(id, links), links[1:], strict=False))
    images = [e for e in tree.every if e.tag == "img" or (e.tag == "input" and e.attrs.get("type") == "image")]
    place = {id(e): k for k, e in enumerate(images)}
    rows = [{"nid": 0, "tag": "#document", "page": _page(tree, links) if page_facts else None, "text": tree.text}]
    level = 1
    for own, node in enumerate(tree.every, 1):
        up, last, inside = node.parent, tree.last[own], first < own <= end
        pictures = tree.alts_of(node)
        row = {
            "nid": own, "tag": node.tag, "attrs": list(node.attrs.items()), "text": tree.text_of(node), "html": cut(node),
            "parent_tag": up.tag, "parent_chars": tree.chars_of(up) if node.tag in ("a", "button") else None,
            "above": tree.above[own], "in_body": inside, "styles": tree.styles[own],
            "below": list(tree.below[own].items()), "alts": [e.attrs.get("alt") for e in pictures],
            "img_width": pictures[0].attrs.get("width") if pictures else None, "img_height": pictures[0].attrs.get("height") if pictures else None,
            "kids": [c.tag if isinstance(c, Element) else "#text" for c in node.children if not blank(c)],
            "focusable": focusable(node), "focusable_below": tree.focus[last] > tree.focus[own], "captioned": tree.captions[last] > tree.captions[own],
        }
        if node.tag == "a":
            beside, following = tree.beside(node), after_link.get(id(node))
            if isinstance(beside, Element):
                row["beside"] = {"tag": beside.tag, "href": beside.get("href"), "text": tree.text_of(beside), "image": beside.first("img") is not None}
            if following is not None:
                row |= {"next_href": following.get("href"), "next_adjacent": same(beside, following)}
        elif node.tag in _HEADINGS and inside:
            row["prev_level"], level = level, int(node.tag[1])
        elif node.tag == "table":
            heads = node.elements("th")
            row["grid"] = _grid(node)
            row["heads_without_scope"] = [{"text": tree.text_of(h)[:30], "html": cut(h)} for h in heads if "scope" not in h.attrs]
            row["empty_heads"] = [cut(h) for h in heads if not tree.chars_of(h) and not tree.has_alt(h)]
            before = tree.element_before(node)
            if before is not None:
                row["prev"] = {"tag": before.tag, "text": tree.text_of(before), "style": before.get("style"), "class": before.get("class"), "bold": before.first("b", "strong") is not None}
        elif node.tag in ("video", "audio"):
            following = tree.element_after(node)
            if following is not None:
                row |= {"next_tag": following.tag, "next_text": tree.text_of(following)}
        elif node.tag == "form":
            row["inputs"] = _inputs(node)
        if id(node) in place:
            k = place[id(node)]
            row["near"] = [{"alt": e.get("alt").strip().lower(), "html": cut(e)} for e in images[k + 1 : k + 3]]
        rows.append(row)
    return rows


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of rows; what none of them has is not looked up in each."""
    seen = set().union(*rows)
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) if f.name in seen else pa.nulls(len(rows), f.type) for f in schema], schema=schema)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table dealt out over all cores, and over more tasks the more rows there are.

    Parsing is bound by CPU, and a compressed file holds more rows than one task
    should parse; so a task has ``TASK_ROWS`` rows or the rows of one of many
    splits, whatever the size of the table. Rows are counted by the file's footer.
    """
    if rows.isStreaming:
        return rows
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def elements(pages: DataFrame, facts: bool = True, page_facts: bool = True) -> DataFrame:
    """The elements of pages (course_id, page_id, identifier, title, content_type, canvas_url, html); a null page has its root row alone.

    Without ``facts`` rows have tag, attributes and text only, which is all that
    inventories ask for; without ``page_facts`` the facts of whole pages are null.
    Rows of many small pages share a batch.
    """
    schema: StructType = _parse_datatype_string(ELEMENTS)
    names = ["course_id", "page_id", "identifier", "title", "content_type", "canvas_url"]
    if not facts:
        schema = StructType([schema[c] for c in (*names, "nid", "tag", "attrs", "text")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for page in batch.to_pylist():
                own = {n: page[n] for n in names}
                held += [own | r for r in element_rows(page["html"], facts, page_facts)]
                if len(held) >= BATCH_ROWS:
                    yield batch_of(held, arrow)
                    held = []
        if held:
            yield batch_of(held, arrow)

    return pages.select(*names, "html").mapInArrow(run, schema)


def help_hrefs(pages: DataFrame) -> DataFrame:
    """The pages' columns, without html, and the help link of each: a parse that states nothing else."""
    names = ["course_id", "page_id", "identifier", "title", "content_type", "canvas_url"]
    schema: StructType = _parse_datatype_string(", ".join(f"{n} string" for n in (*names, "href")))
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            hrefs = pa.array([help_href(parse(h)) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).cast(pa.string()) for n in names), hrefs], schema=arrow)

    return pages.select(*names, "html").mapInArrow(run, schema)


def page_table(table: DataFrame) -> DataFrame:
    """Pages from the raw table (page_id, url, html): the host is the course, the path the file."""
    from pyspark.sql import functions as F

    title = F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    return table.select(
        F.expr("try_parse_url(url, 'HOST')").alias("course_id"),
        F.col("page_id").cast("string").alias("page_id"),
        F.col("page_id").cast("string").alias("identifier"),
        title.alias("title"),
        F.lit("wiki_page").alias("content_type"),
        F.expr("try_parse_url(url, 'PATH')").alias("file_path"),
        F.col("url").alias("canvas_url"),
        "html",
    )
