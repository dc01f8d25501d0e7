"""Repairs: ordered rewrites of a page's tree, each under the rule that asks for it, and the sanitizer.

A page is rewritten within its own row. Later rewrites see what earlier ones did.
Which run is decided by the fixable rules found before; those without a rule
always run.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpage.functions import colors, latex
from lumenpage.functions.text import GENERIC_ALT_PREFIXES, MAX_ALT, NAVIGATION_NOISE, NOISE_WORDS, SOFT_ALT
from lumenpage.operators.rules import LARGE_CONTRAST, NORMAL_CONTRAST, VAGUE, VAGUE_PREFIXES, VIDEO_HOSTS
from lumenpage.sources.dom import Element, Text, blank, body_of, parse, same, set_style
from lumenpage.sources.elements import FILE_CLASSES, elements, is_blank_cell, is_empty, list_runs, marker

HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
# The platform's text colour, symbols without meaning, parts of host names, and words in capitals.
DEFAULT_TEXT = (45, 59, 69)
SYMBOLS = set("▼►▶◀▲●○■□★☆→←↑↓•")
SUFFIXES = {"ac", "ai", "app", "ca", "co", "com", "edu", "gov", "info", "io", "ly", "mil", "net", "org", "tv", "uk", "us"}
CAPITALS = {"api", "faq", "hr", "id", "it", "la", "lms", "lti", "tv", "ui", "url", "ux"}
PLATFORMS = (("instructuremedia", "Studio"), ("arc.instructure", "Studio"), ("media.instructure", "Studio"), ("canvastudio", "Studio"), ("youtube", "YouTube"), ("youtu.be", "YouTube"),
             ("vimeo", "Vimeo"), ("kaltura", "Kaltura"), ("panopto", "Panopto"), ("wistia", "Wistia"), ("echo360", "Echo360"), ("mediasite", "Mediasite"))
HIDDEN = "position: absolute; width: 1px; height: 1px; padding: 0; margin: -1px; overflow: hidden; clip: rect(0, 0, 0, 0); white-space: nowrap; border: 0;"
URL_ATTRIBUTES = ("href", "src", "action", "data", "poster", "cite")


@dataclass
class Work:
    """A page under repair."""

    root: Element
    title: str = ""
    alts: dict[str, str] = field(default_factory=dict)
    rendered: list[dict] = field(default_factory=list)
    done: list[str] = field(default_factory=list)

    @property
    def body(self) -> Element:
        return body_of(self.root)

    def all(self, *tags: str) -> list[Element]:
        return self.root.elements(*tags)

    def styled(self) -> list[Element]:
        return [e for e in self.root.elements() if e.get("style")]


FIXERS: list[tuple[str | None, Callable[[Work], int]]] = []


def fixer(rule: str | None):
    """Register a rewrite, in the order of execution; it returns how many places it changed."""

    def add(f: Callable[[Work], int]) -> Callable[[Work], int]:
        FIXERS.append((rule, f))
        return f

    return add


def repair(source: str | None, rules: set[str], title: str = "", alts: dict[str, str] | None = None, rendered: list[dict] | None = None) -> tuple[str, list[str]]:
    """The repaired page, and a line for each rewrite that changed something."""
    work = Work(parse(source), title or "", alts or {}, rendered or [])
    for rule, f in FIXERS:
        if (rule is None or rule in rules) and (n := f(work)):
            work.done.append(f"{rule or 'always'}: {f.__name__} ({n})")
    return work.root.html(), work.done


def seen_text(node: Element) -> str:
    return node.text().replace("\xa0", "").strip()


def has_alt(node: Element) -> bool:
    return any(i.get("alt").strip() for i in node.elements("img"))


def truncated(alt: str) -> str:
    alt = " ".join(alt.split())
    if len(alt) <= MAX_ALT:
        return alt
    head = alt[:MAX_ALT]
    space = head.rfind(" ")
    return head[: space if space > SOFT_ALT else MAX_ALT].rstrip()


def words_of(name: str) -> str:
    return name.rsplit(".", 1)[0].replace("-", " ").replace("_", " ").strip()


def last_segment(url: str) -> str:
    return url.split("/")[-1].split("?")[0].split("#")[0]


def is_layout(table: Element) -> bool:
    if table.get("role") in ("presentation", "none"):
        return True
    if table.first("caption", "thead", "tfoot") or table.get("summary") or any(h.text() for h in table.elements("th")):
        return False
    return table.first("table") is not None or any(a.tag == "table" for a in table.ancestors())


def _drop_size(node: Element) -> None:
    rest = re.sub(r"font-size\s*:[^;]+;?\s*", "", node.get("style")).strip()
    node.attrs.pop("style", None)
    if rest:
        node.attrs["style"] = rest


@fixer(None)
def heal_doubled_schemes(w: Work) -> int:
    n = 0
    for e in w.all():
        for name in URL_ATTRIBUTES:
            if m := re.search(r"://.*?(https?://.*)$", e.get(name), re.IGNORECASE | re.DOTALL):
                e.attrs[name], n = m[1], n + 1
    return n


@fixer("HDG001")
def demote_h1(w: Work) -> int:
    found = w.body.elements("h1")
    for h in found:
        h.tag = "h2"
    return len(found)


@fixer("HDG002")
def repair_levels(w: Work) -> int:
    level, n = 1, 0
    for h in w.body.elements(*HEADS):
        level = min(int(h.tag[1]), level + 1)
        n += h.tag != f"h{level}"
        h.tag = f"h{level}"
    return n


@fixer("TBL001")
def head_first_rows(w: Work) -> int:
    n = 0
    for table in w.all("table"):
        row = table.first("tr")
        if is_layout(table) or table.first("th") or row is None:
            continue
        for cell in row.elements("td"):
            if cell.text() or has_alt(cell):
                cell.tag, n = "th", n + 1
                cell.attrs.setdefault("scope", "col")
    return n


@fixer("TBL002")
def add_scopes(w: Work) -> int:
    n = 0
    for table in w.all("table"):
        first = table.first("tr")
        for head in [h for h in table.elements("th") if "scope" not in h.attrs]:
            row = next((a for a in head.ancestors() if a.tag == "tr"), None)
            if row is not None:
                cells = row.elements("th", "td")
                head.attrs["scope"] = "row" if not same(row, first) and cells and same(cells[0], head) else "col"
                n += 1
    return n


@fixer("TBL003")
def add_captions(w: Work) -> int:
    n = 0
    for table in w.all("table"):
        if table.first("caption") or is_layout(table) or not table.first("th"):
            continue
        text, source, row = "", None, table.first("tr")
        cells = row.elements("td", "th") if row else []
        if cells and re.fullmatch(r"\s*\d+\s*", span := cells[0].attrs.get("colspan", "1")) and int(span) >= 3:
            text, source = cells[0].text(), row
        before = [e for e in reversed(table.siblings_before()) if isinstance(e, Element)]
        if not text and before and before[0].tag == "p":
            p = before[0]
            strong = p.first("b", "strong") or "font-weight" in p.get("style") or "center" in p.get("style") + p.get("class")
            if 0 < len(p.text()) < (100 if strong else 50):
                text, source = p.text(), p
        if not text:
            heading = next((e for e in before if e.tag in HEADS[1:]), None)
            if heading is not None and heading.text():
                text = f"Table: {heading.text()}"
            elif len(names := [c.text()[:20] for c in cells[:3] if c.text()]) >= 2:
                text = f"Table with columns: {', '.join(names)}"
        if text:
            caption = Element("caption", {"style": "text-align: center; font-weight: bold; padding: 8px;"})
            caption.set_text(text)
            table.insert(0, caption)
            if source is not None:
                source.remove()
            n += 1
    return n


@fixer("TBL004")
def unhead_empty(w: Work) -> int:
    n = 0
    for table in w.all("table"):
        for head in table.elements("th") if table.get("role") != "presentation" else ():
            if not head.text() and not has_alt(head):
                head.tag, n = "td", n + 1
                head.attrs.pop("scope", None)
    return n


@fixer("TBL005")
def mark_layout(w: Work) -> int:
    n = 0
    for table in w.all("table"):
        rows = table.elements("tr")
        if table.get("role") != "presentation" and not table.first("caption", "th") and (len(rows) <= 1 or all(len(r.elements("td", "th")) <= 1 for r in rows)):
            table.attrs["role"], n = "presentation", n + 1
            for cell in table.elements("td"):
                cell.attrs.pop("scope", None)
    return n


def _without_marker(p: Element) -> None:
    """Remove the marker at the start of the first text."""
    for node in p.walk():
        if isinstance(node, Text) and node.value.strip():
            node.value = re.sub(r"^\s*(?:\d+[.)]|[A-Za-z][.)]|(?:i{1,3}|iv|vi{0,3})[.)]|[-*•]+)\s*", "", node.value)
            return


@fixer("LIST001")
def make_lists(w: Work) -> int:
    kinds = {"letter": "a", "upper_letter": "A", "roman": "i"}
    n = 0
    for run, lines in list_runs(w.body):
        if run[0].parent is None:
            continue
        kind = marker(next(x for x in lines if marker(x)) if lines else run[0].text(" "))
        made = Element("ul") if kind == "unordered" else Element("ol", {"type": kinds[kind]} if kind in kinds else {})
        if lines:
            kept = [x for x in lines if not marker(x)]
            for x in lines:
                if marker(x):
                    made.append(Element("li")).set_text(re.sub(r"^(?:\d+[.)]|[A-Za-z]+[.)]|[-*•]+)\s*", "", x))
            if kept:
                intro = Element("p")
                intro.set_text(" ".join(kept))
                run[0].replace(intro, made)
            else:
                run[0].replace(made)
        else:
            run[0].add_before(made)
            for p in run:
                p.remove()
                _without_marker(p)
                item = made.append(Element("li"))
                for c in p.children:
                    item.append(c)
        n += 1
    return n


@fixer("IMG002")
def shorten_alts(w: Work) -> int:
    found = [i for i in w.all("img") if len(i.get("alt")) > MAX_ALT]
    for i in found:
        i.attrs["alt"] = truncated(i.get("alt"))
    return len(found)


@fixer("LNK002")
def drop_titles(w: Work) -> int:
    n = 0
    for a in w.all("a"):
        title, text = a.get("title").strip().lower(), a.text().lower()
        if title and text and (title.startswith(text) or text.startswith(title)):
            del a.attrs["title"]
            n += 1
    return n


def _inherited(node: Element, name: str) -> str | None:
    return next((c for e in (node, *node.ancestors()) if e.get("style") and (c := colors.of_style(e.get("style"), name))), None)


def _needed(node: Element) -> float:
    bold = any(a.tag in ("strong", "b") for a in node.ancestors()) or node.first("strong", "b") is not None
    return LARGE_CONTRAST if colors.large(node.get("style"), bold) else NORMAL_CONTRAST


def _recolor(style: str, name: str, value: str) -> str:
    edge = r"(?<![a-zA-Z-])" if name == "color" else ""
    return re.sub(rf"{edge}{name}\s*:\s*[^;]+", f"{name}: {value}", style, count=1)


@fixer("CLR001")
def raise_contrast(w: Work) -> int:
    n = 0
    for e in w.styled():
        style, target = e.get("style"), _needed(e)
        fg, bg = (colors.rgb(colors.of_style(style, p)) for p in ("color", "background-color"))
        if fg and bg and colors.contrast(fg, bg) < target:
            new = colors.adjusted(fg, bg, target)
            if new != fg and colors.contrast(new, bg) >= target:
                e.attrs["style"], n = _recolor(style, "color", colors.hexed(new)), n + 1
            elif (ground := colors.adjusted(bg, fg, target, foreground=False)) != bg:
                e.attrs["style"], n = _recolor(style, "background-color", colors.hexed(ground)), n + 1
        elif fg and not bg and not colors.of_style(style, "background-color"):
            ground = colors.rgb(_inherited(e, "background-color")) or (255, 255, 255)
            if colors.contrast(fg, ground) < target:
                e.attrs["style"], n = _recolor(style, "color", colors.hexed(colors.adjusted(fg, ground, target))), n + 1
        elif bg and not colors.of_style(style, "color") and colors.contrast(DEFAULT_TEXT, bg) < target:
            e.attrs["style"], n = f"{style.rstrip('; ')}; color: {colors.hexed(colors.adjusted(DEFAULT_TEXT, bg, target))};", n + 1
    for e in w.all():
        if re.search(r"(?:^|;)\s*color\s*:", e.get("style")) or not e.text() or e.elements():
            continue
        fg, bg = (colors.rgb(_inherited(e, p)) for p in ("color", "background-color"))
        if fg and bg and colors.contrast(fg, bg) < (target := _needed(e)):
            e.attrs["style"] = f"color: {colors.hexed(colors.adjusted(fg, bg, target))}" + (f"; {e.get('style')}" if e.get("style") else "")
            n += 1
    return n


@fixer("CLR001")
def rendered_contrast(w: Work) -> int:
    """Colours as a browser saw them; each finding names its element by HTML."""
    n = 0
    for meta in w.rendered:
        fg, bg = colors.rgb(meta.get("fg_color")), colors.rgb(meta.get("bg_color"))
        wanted = parse(meta.get("element_html")).elements()
        if not fg or not bg or not wanted:
            continue
        own = wanted[0]
        same_tag = w.all(own.tag)
        tests = (lambda e: own.get("id") and e.get("id") == own.get("id"), lambda e: own.get("class") and e.get("class") == own.get("class"), lambda e: own.text() and e.text() == own.text())
        found = next((e for t in tests for e in same_tag if t(e)), None)
        if found is not None:
            size = float(re.sub(r"[^\d.]", "", (meta.get("font_size") or "").partition("px")[0].split("(")[-1]) or 0)
            big = size >= 24 or (size >= 18.67 and str(meta.get("font_weight")) in ("bold", "700", "800", "900"))
            set_style(found, color=colors.hexed(colors.adjusted(fg, bg, LARGE_CONTRAST if big else NORMAL_CONTRAST)))
            n += 1
    return n


@fixer("MATH001")
def convert_math(w: Work) -> int:
    n = 0
    for s in w.all("script"):
        if re.search("mathjax|katex|math-renderer", s.get("src") + s.raw(), re.IGNORECASE):
            s.remove()
            n += 1
    for code in w.all("code"):
        if re.search(r"\\(?:frac|sqrt|alpha|beta|gamma|sum|int|lim)", code.raw()):
            code.replace(*parse(latex.to_html(code.raw())).children)
            n += 1
    for node in [x for x in w.root.walk() if isinstance(x, Text) and x.kind == "text" and x.parent.tag not in ("script", "style", "pre")]:
        if new := latex.convert_text(node.value):
            at = next(k for k, c in enumerate(node.parent.children) if c is node)
            parent = node.parent
            del parent.children[at]
            for k, c in enumerate(parse(new).children):
                parent.insert(at + k, c)
            n += 1
    return n


@fixer("LNK003")
def name_empty_links(w: Work) -> int:
    n = 0
    for a in w.all("a"):
        if "href" not in a.attrs or seen_text(a) or a.get("aria-label") or has_alt(a):
            continue
        name = last_segment(a.get("href"))
        label = (words_of(name).title() if name and name != a.get("href") and not name.startswith("http") else "") or "Link"
        for icon in a.elements("i", "span"):
            if not icon.text():
                icon.attrs["aria-hidden"] = "true"
        a.append(Element("span", {"style": HIDDEN})).set_text(label)
        n += 1
    return n


@fixer("HDG003")
def drop_empty_headings(w: Work) -> int:
    found = [h for h in w.body.elements(*HEADS) if not seen_text(h) and not has_alt(h)]
    for h in found:
        h.remove()
    return len(found)


@fixer("STR001")
def drop_empties(w: Work) -> int:
    """Of neighbours in document order that are both without text, the first goes."""
    n = 0
    for tag in ("p", "div"):
        own = w.body.elements(tag)
        bare = [not (e.get("id") or e.get("role") or any(a.startswith("aria-") for a in e.attrs) or seen_text(e)) for e in own]
        for e, this, following in zip(own, bare, bare[1:], strict=False):
            if this and following and e.parent is not None:
                e.remove()
                n += 1
    return n


@fixer("STR002")
def modern_tags(w: Work) -> int:
    plain = {"center": ("div", "text-align: center;"), "blink": ("span", None), "marquee": ("span", None), "big": ("span", "font-size: larger;"), "strike": ("del", None), "tt": ("code", None)}
    n = 0
    for e in w.all("font", *plain):
        if e.tag == "font":
            parts = [f"{css}: {e.attrs[a]}" for a, css in (("color", "color"), ("face", "font-family")) if e.get(a)]
            for a in ("color", "face", "size"):
                e.attrs.pop(a, None)
            e.tag = "span"
            if parts:
                e.attrs["style"] = "; ".join([*parts, *([e.get("style")] if e.get("style") else [])])
        else:
            e.tag, style = plain[e.tag]
            if style:
                e.attrs["style"] = style
        n += 1
    return n


@fixer("STR003")
def drop_small_sizes(w: Work) -> int:
    n = 0
    for e in w.styled():
        m = next((x for u, x in ((u, re.search(rf"font-size\s*:\s*([\d.]+)\s*(?:{u})", e.get("style"))) for u in ("px", "pt", "em|rem", "%")) if x), None)
        if m and e.text():
            unit = re.search(r"(px|pt|em|%)\)?$", m[0])[1]
            size = float(m[1])
            if (unit == "px" and size <= 10) or size < {"pt": 10, "em": 0.75, "%": 75}.get(unit, 0):
                _drop_size(e)
                n += 1
    return n


@fixer("LNK006")
def merge_adjacent(w: Work) -> int:
    links, gone, n = w.all("a"), set(), 0
    for a, b in zip(links, links[1:], strict=False):
        if id(a) not in gone and a.get("href") and a.get("href") == b.get("href"):
            if b.text() and a.text() != b.text():
                a.set_text(f"{a.text()} {b.text()}".strip())
            gone.add(id(b))
            n += 1
    for a in links:
        if id(a) in gone:
            a.remove()
    return n


@fixer("LNK001")
def describe_links(w: Work) -> int:
    n = 0
    for a in w.all("a"):
        said, href = a.text(), a.get("href")
        low = said.lower()
        prefix = next((p for p in VAGUE_PREFIXES if low.startswith(p)), None)
        if low not in VAGUE and prefix is None:
            continue
        n += 1
        if not href or href == "#":
            a.unwrap()
            continue
        rest = said[len(prefix) :].strip().strip("!.,;:") if prefix and low not in VAGUE else ""
        if len(rest) > 3:
            a.set_text(rest)
            continue
        url = urlparse(href)
        name = words_of(unquote(url.path).rstrip("/").split("/")[-1])
        if len(name) > 2:
            a.set_text(name[0].upper() + name[1:])
        else:
            a.attrs["aria-label"] = f"Link to {url.netloc or href[:40]}"
    return n


@fixer("LNK008")
def encode_spaces(w: Work) -> int:
    found = [a for a in w.all("a") if " " in a.get("href") and not a.get("href").startswith(("#", "mailto:"))]
    for a in found:
        a.attrs["href"] = a.get("href").replace(" ", "%20")
    return len(found)


@fixer("HDG004")
def promote_paragraphs(w: Work) -> int:
    n = 0
    for p in w.body.elements("p"):
        text, style = p.text(), p.get("style")
        if p.parent is None or not 0 < len(text) <= 80 or any(a.tag in ("li", "td", "th", "ul", "ol", "table") for a in p.ancestors()):
            continue
        kids = [c for c in p.children if not blank(c)]
        bold = len(kids) == 1 and isinstance(kids[0], Element) and kids[0].tag in ("strong", "b")
        limits = (("px", 20), (r"(?:em|rem)", 1.3), ("pt", 14), ("%", 130))
        large = any((m := re.search(rf"font-size\s*:\s*([\d.]+)\s*{u}", style)) and float(m[1]) >= least for u, least in limits)
        if not bold and not large:
            continue
        n += 1
        if text in SYMBOLS:
            p.attrs["aria-hidden"] = "true"
            continue
        order = w.body.elements("p", *HEADS)
        before = [h for h in order[: next(k for k, e in enumerate(order) if e is p)] if h.tag in HEADS[1:5]]
        p.tag = f"h{min(int(before[-1].tag[1]) + 1, 6) if before else 2}"
        if large:
            _drop_size(p)
        if bold:
            kids[0].unwrap()
    return n


@fixer("HDG005")
def add_title(w: Work) -> int:
    body = w.body
    if not w.title or body.first(*HEADS[1:]):
        return 0
    if len(body.text()) <= 50 and not body.first("iframe", "embed", "object", "video") and not any(FILE_CLASSES & set(a.get("class").split()) for a in body.elements("a")):
        return 0
    heading = Element("h2")
    heading.set_text(w.title)
    body.insert(0, heading)
    return 1


@fixer("HDG006")
def split_headings(w: Work) -> int:
    n = 0
    for h in w.body.elements(*HEADS):
        text = h.text()
        if len(text) > 120:
            head = text[:120]
            space = head.rfind(" ")
            head = head[:space].rstrip() if space > 60 else head
            h.set_text(head)
            if rest := text[len(head) :].strip():
                p = Element("p")
                p.set_text(rest)
                h.parent.insert(next(k for k, c in enumerate(h.parent.children) if c is h) + 1, p)
            n += 1
    return n


@fixer("MDA002")
def stop_autoplay(w: Work) -> int:
    found = [e for e in w.all("video", "audio", "embed") if "autoplay" in e.attrs]
    for e in found:
        del e.attrs["autoplay"]
    return len(found)


@fixer("TGT001")
def enlarge_targets(w: Work) -> int:
    n = 0
    for e in w.all("a", "button"):
        if e.parent.tag in ("p", "span", "em", "strong", "b", "i", "li", "td", "th") and len(e.parent.text()) - len(e.text()) > 5:
            continue
        before = e.html()
        image = e.first("img")
        for side in ("width", "height"):
            if image is not None and not e.text() and re.fullmatch(r"\s*\d+(\.\d+)?\s*(px)?\s*", image.get(side)) and float(image.get(side).replace("px", "")) < 24:
                image.attrs[side] = "24"
            m = re.search(rf"(?:^|;|\s){side}\s*:\s*([\d.]+)\s*px", e.get("style"))
            if m and float(m[1]) < 24:
                e.attrs["style"] = re.sub(rf"((?:^|;|\s){side}\s*:\s*)[\d.]+(\s*px)", r"\g<1>24\2", e.get("style"))
        n += e.html() != before
    return n


@fixer("IMG004")
def shorten_alts_again(w: Work) -> int:
    return shorten_alts(w)


def _clean_alt(alt: str) -> str | None:
    """An alternative text without noise, or null if it has none."""
    alt = alt.strip()
    ends, words = " .,;:-!?()", "|".join(NOISE_WORDS)
    if m := re.search(NAVIGATION_NOISE, alt):
        return f"{alt[: m.start()].rstrip(ends)} {alt[m.end() :].lstrip(ends)}".strip()
    if len(alt.split()) > 1:
        if (m := re.match(rf"(?:an?\s+)?(?:{words})\s+of\s+", alt, re.IGNORECASE)) and (rest := alt[m.end() :].strip()):
            return rest[0].upper() + rest[1:]
        if (m := re.search(rf"[.,;:\-!?\s]*\b(?:{words})\.?\s*$", alt, re.IGNORECASE)) and (rest := alt[: m.start()].rstrip(" ,;:.-!?")):
            return rest
    return None


@fixer("IMG009")
def strip_noise(w: Work) -> int:
    n = 0
    for i in w.all("img"):
        new = _clean_alt(i.get("alt")) if i.get("alt") else None
        if new is not None:
            i.attrs["alt"], n = new, n + 1
            if not new:
                i.attrs["role"] = "presentation"
    return n


@fixer("IMG005")
def name_linked_images(w: Work) -> int:
    n = 0
    for a in w.all("a"):
        if "href" not in a.attrs or seen_text(a):
            continue
        for i in a.elements("img"):
            if not i.get("alt").strip():
                i.attrs["alt"] = a.get("title") or a.get("aria-label") or words_of(last_segment(a.get("href"))).title() or "Link"
                n += 1
    return n


def _ids(w: Work) -> set[str]:
    return {e.attrs["id"] for e in w.all() if "id" in e.attrs}


@fixer("LNK009")
def unwrap_broken_anchors(w: Work) -> int:
    ids = _ids(w)
    found = [a for a in w.all("a") if a.get("href").startswith("#") and a.get("href")[1:] not in (ids - {""})]
    for a in found:
        a.unwrap()
    return len(found)


@fixer("ARIA001")
def drop_broken_references(w: Work) -> int:
    ids, n = _ids(w), 0
    for e in w.all():
        for name in ("aria-labelledby", "aria-describedby", "aria-controls", "aria-owns"):
            own = e.get(name).split()
            good = [x for x in own if x in ids]
            if len(good) < len(own):
                e.attrs[name] = " ".join(good)
                if not good:
                    del e.attrs[name]
                n += 1
    return n


@fixer("DID001")
def rename_ids(w: Work) -> int:
    taken, seen, n = _ids(w), set(), 0
    for e in w.all():
        own = e.get("id")
        if own in seen:
            k = 2
            while f"{own}-{k}" in taken:
                k += 1
            e.attrs["id"], n = f"{own}-{k}", n + 1
        if e.get("id"):
            taken.add(e.get("id"))
            seen.add(e.get("id"))
    return n


@fixer("TBL006")
def fill_cells(w: Work) -> int:
    n = 0
    for table in w.all("table"):
        cells = table.elements("td")
        empty = [c for c in cells if not seen_text(c) and not c.first("img", "input", "select", "textarea")] if table.get("role") != "presentation" else []
        fresh = [c for c in empty if is_blank_cell(c)]
        for c in empty:
            c.set_text("\xa0")
        if fresh and len(empty) > 0.6 * len(cells) and not table.get("aria-label"):
            table.attrs["aria-label"] = "Worksheet table"
        n += len(fresh)
    return n


@fixer("LNK010")
def disambiguate(w: Work) -> int:
    groups: dict[str, list[Element]] = {}
    for a in w.all("a"):
        if a.text() and a.get("href"):
            groups.setdefault(a.text().lower(), []).append(a)
    n = 0
    for own in groups.values():
        if len({a.get("href") for a in own}) > 1:
            for k, a in enumerate(own[1:], 2):
                url = urlparse(a.get("href"))
                name = unquote(url.path).rstrip("/").split("/")[-1]
                said = url.fragment or (name.rsplit(".", 1)[0] if name else "") or url.hostname or str(k)
                a.set_text(f"{a.text()} ({said})")
                n += 1
    return n


@fixer("LNK011")
def drop_redundant_links(w: Work) -> int:
    links = [(a, a.get("href").strip(), bool(a.text() or has_alt(a))) for a in w.all("a")]
    links = [x for x in links if x[1] and not x[1].startswith("#")]
    kept, n = {href for _, href, shown in links if shown}, 0
    for a, href, shown in links:
        if not shown:
            if href in kept:
                a.remove()
                n += 1
            kept.add(href)
    return n


@fixer("LNK012")
def merge_image_links(w: Work) -> int:
    n = 0
    for a in w.all("a"):
        b = a.next_significant() if a.parent is not None else None
        image = a.first("img")
        if a.get("href").strip() and not a.text() and image is not None and isinstance(b, Element) and b.tag == "a" and b.get("href").strip() == a.get("href").strip() and b.text() and not b.first("img"):
            image.attrs["alt"] = b.text()
            b.remove()
            n += 1
    return n


def url_label(url: str) -> str:
    """Words for an address: its host without common parts, and its last segment."""
    url = re.sub(r"(?i)\s*\(opens in new window\)\s*$", "", (url or "").strip())
    if not url:
        return ""
    parsed = urlparse(f"https:{url}" if url.startswith("//") else url if "://" in url else f"https://{url}")
    host = (parsed.hostname or "").removeprefix("www.")
    if not host:
        return ""
    parts = [p for p in host.split(".") if p]
    while len(parts) > 1 and parts[-1] in SUFFIXES:
        parts.pop()

    def words(names: list[str]) -> list[str]:
        tokens = [t for x in names for t in re.split("[-_]+", x) if t]
        return [p.upper() if p.lower() in CAPITALS else p.title() for t in tokens for p in (re.findall(r"[a-zA-Z]+|\d+", t) or [t])]

    segments = [s for s in unquote(parsed.path).split("/") if s]
    tail = words([segments[-1].rsplit(".", 1)[0]]) if segments else []
    return " ".join(words(parts) + tail).strip() or host


@fixer("LNK005")
def name_raw_urls(w: Work) -> int:
    n = 0
    for a in w.all("a"):
        said = a.text(" ")
        if re.search(r"(?i)https?://|www\.", said):
            new = url_label(said) or url_label(a.get("href"))
            if new and new.lower() != said.lower():
                a.set_text(new)
                n += 1
    return n


def video_platform(src: str) -> str:
    return next((name for token, name in PLATFORMS if token in src.lower()), "video platform")


@fixer("MDA001")
def title_videos(w: Work) -> int:
    found = [f for f in w.all("iframe") if re.search(VIDEO_HOSTS, f.get("src")) and not f.get("title") and not f.get("aria-label")]
    for f in found:
        f.attrs["title"] = f"Embedded video from {video_platform(f.get('src'))}"
    return len(found)


@fixer("FOC001")
def add_scroll_margin(w: Work) -> int:
    if not any("position" in s and ("fixed" in s or "sticky" in s) for s in (e.get("style").lower() for e in w.styled())):
        return 0
    found = [e for e in w.body.elements("a", "button", "input", "select", "textarea", "details", "summary") if "scroll-margin-top" not in e.get("style")]
    for e in found:
        e.attrs["style"] = f"{e.get('style').rstrip('; ')}; scroll-margin-top: 80px;".removeprefix("; ")
    return len(found)


@fixer("AUTH001")
def complete_passwords(w: Work) -> int:
    found = [i for i in w.all("input") if i.get("type").lower() == "password" and i.get("autocomplete").strip().lower() not in ("current-password", "new-password")]
    for i in found:
        i.attrs["autocomplete"] = "current-password"
    return len(found)


@fixer("BTN001")
def name_buttons(w: Work) -> int:
    n = 0
    for b in w.all("button"):
        if not (seen_text(b) or b.get("aria-label").strip() or b.get("aria-labelledby").strip() or has_alt(b)):
            name, image = (b.get("type") or "button").title(), b.first("img")
            (image if image is not None else b).attrs["alt" if image is not None else "aria-label"] = name
            n += 1
    for i in w.all("input"):
        if i.get("type") in ("submit", "button", "reset") and not i.get("value").strip() and not i.get("aria-label").strip():
            i.attrs["value"], n = i.get("type").title(), n + 1
    return n


@fixer("STR004")
def drop_underlines(w: Work) -> int:
    n = 0
    for u in w.all("u"):
        u.tag, n = "em", n + 1
    for e in w.styled():
        new = re.sub(r"(?i)\s*text-decoration\s*:\s*[^;]*\bunderline\b[^;]*;?", "", e.get("style")).strip("; ")
        if e.tag != "a" and "underline" in e.get("style").lower() and new != e.get("style").strip("; "):
            e.attrs.pop("style")
            if new:
                e.attrs["style"] = new
            n += 1
    return n


@fixer("STR005")
def align_left(w: Work) -> int:
    n = 0
    for e in w.styled():
        new = re.sub(r"text-align\s*:\s*justify", "text-align: left", e.get("style"))
        n += new != e.get("style")
        e.attrs["style"] = new
    return n


@fixer(None)
def apply_alts(w: Work) -> int:
    n = 0
    for i in w.all("img") if w.alts else ():
        src = i.get("src")
        key = src if src in w.alts else next((k for k in w.alts if src and (k in src or src in k)), None)
        if src and key is not None:
            i.attrs["alt"], n = w.alts[key], n + 1
    return n


@fixer(None)
def fallback_alts(w: Work) -> int:
    n = 0
    for i in w.all("img"):
        if i.get("alt").strip() or ("alt" in i.attrs and i.get("role") == "presentation"):
            continue
        name = i.get("src").split("/")[-1].split("?")[0]
        if "/equation_images/" in i.get("src"):
            i.attrs["alt"] = "Mathematical equation"
        elif i.get("width") in ("0", "1") or i.get("height") in ("0", "1"):
            i.attrs |= {"alt": "", "role": "presentation"}
        elif any(a.tag == "a" for a in i.ancestors()):
            continue
        elif "." in name:
            i.attrs["alt"] = words_of(name).title() or "Image"
        else:
            i.attrs |= {"alt": "", "role": "presentation"}
        n += 1
    for area in w.all("area"):
        if "alt" not in area.attrs:
            area.attrs["alt"], n = area.get("href").split("/")[-1] if area.get("href") else "Map area", n + 1
    return n


@fixer(None)
def shorten_alts_at_last(w: Work) -> int:
    return shorten_alts(w)


@fixer(None)
def number_equal_alts(w: Work) -> int:
    seen: dict[str, int] = {}
    n = 0
    for i in w.all("img"):
        alt = i.get("alt")
        if alt:
            seen[alt] = seen.get(alt, 0) + 1
            if seen[alt] > 1:
                i.attrs["alt"], n = f"{alt} ({seen[alt]})", n + 1
    return n


@fixer(None)
def clean_up(w: Work) -> int:
    before = w.root.html()
    for i in w.all("img"):
        prefix = next((p for p in GENERIC_ALT_PREFIXES if i.get("alt").lower().startswith(p)), None)
        rest = i.get("alt")[len(prefix) :].lstrip(" ,:-") if prefix else ""
        if rest:
            i.attrs["alt"] = rest[0].upper() + rest[1:]
        if i.attrs.get("alt") == "" and not i.get("role") and any(x in i.get("src").lower() for x in ("spacer", "divider", "separator", "blank")):
            i.attrs["role"] = "presentation"
    for e in w.styled():
        fg, bg = (colors.of_style(e.get("style"), p) for p in ("color", "background-color"))
        white = colors.rgb(fg) is not None and min(colors.rgb(fg)) > 230
        if white and bg:
            for c in e.elements("p", "em", "strong", "span", *HEADS[1:], "li", "a"):
                if c.text() and not colors.of_style(c.get("style"), "background-color"):
                    c.attrs["style"] = f"{c.get('style').rstrip('; ')}; background-color: {bg}; color: {fg};".removeprefix("; ")
        elif white and not any(colors.of_style(a.get("style"), "background-color") for a in e.ancestors()):
            rest = re.sub(r"(?<![a-zA-Z-])color\s*:[^;]*;?\s*", "", e.get("style")).strip("; ")
            e.attrs.pop("style")
            if rest:
                e.attrs["style"] = rest
    for e in w.all("span", "p", "div"):
        if e.text() in SYMBOLS:
            e.attrs["aria-hidden"] = "true"
            if re.search(r"font-size\s*:", e.get("style")):
                _drop_size(e)
    return int(w.root.html() != before)


def apply_color_scheme(source: str, primary: str, secondary: str) -> str:
    """Hex backgrounds and borders of inline styles in two given colours."""
    root = parse(source)
    for e in root.elements():
        if e.get("style"):
            style = re.sub(r"background-color:\s*#[0-9A-Fa-f]{6}", f"background-color: {primary}", e.get("style"))
            e.attrs["style"] = re.sub(r"border-color:\s*#[0-9A-Fa-f]{6}", f"border-color: {secondary}", style)
    return root.html()


# What an editor's allow-list keeps.
DROPPED = {"script", "style", "form", "input", "select", "textarea", "button", "object", "embed", "applet", "link", "meta"}
UNWRAPPED = {"figure", "figcaption", "font", "center", "blink", "marquee", "big"}
ROLES_KEPT = {
    "banner", "complementary", "contentinfo", "main", "navigation", "region", "search", "alert", "dialog", "group", "img", "list", "listitem", "presentation", "none",
    "tab", "tablist", "tabpanel", "cell", "columnheader", "row", "rowgroup", "rowheader", "table", "heading", "separator", "toolbar",
}
ATTRIBUTES_KEPT = {
    "id", "class", "style", "title", "lang", "dir", "tabindex", "aria-describedby", "aria-hidden", "aria-label", "aria-labelledby", "aria-live", "aria-relevant",
    "aria-atomic", "role",
}
OWN_ATTRIBUTES = {
    "a": ("href", "target", "name", "rel",),
    "img": ("src", "alt", "width", "height",),
    "iframe": ("src", "width", "height", "title", "allow", "allowfullscreen", "frameborder", "sandbox",),
    "video": ("src", "controls", "width", "height", "poster", "preload",),
    "audio": ("src", "controls", "preload",),
    "source": ("src", "type",),
    "td": ("colspan", "rowspan", "headers",),
    "th": ("scope", "colspan", "rowspan", "headers",),
    "col": ("span",),
    "colgroup": ("span",),
    "ol": ("type", "start", "reversed",),
    "li": ("value",),
    "table": ("border", "cellpadding", "cellspacing", "summary",),
    "blockquote": ("cite",),
    "q": ("cite",),
    "del": ("cite", "datetime",),
    "ins": ("cite", "datetime",),
    "time": ("datetime",),
    "details": ("open",),
    "track": ("src", "kind", "srclang", "label",),
}
CSS_KEPT = {
    "background", "background-color", "background-image", "background-position", "background-repeat", "background-size", "border", "border-bottom", "border-collapse",
    "border-color", "border-left", "border-radius", "border-right", "border-spacing", "border-style", "border-top", "border-width", "box-shadow", "clear", "clip",
    "color", "cursor", "direction", "display", "flex", "flex-basis", "flex-direction", "flex-flow", "flex-grow", "flex-shrink", "flex-wrap", "float", "font",
    "font-family", "font-size", "font-style", "font-variant", "font-weight", "gap", "grid", "grid-area", "grid-column", "grid-gap", "grid-row", "grid-template",
    "grid-template-areas", "grid-template-columns", "grid-template-rows", "height", "justify-content", "left", "letter-spacing", "line-height", "list-style",
    "list-style-type", "margin", "margin-bottom", "margin-left", "margin-right", "margin-top", "max-height", "max-width", "min-height", "min-width", "opacity", "outline",
    "overflow", "padding", "padding-bottom", "padding-left", "padding-right", "padding-top", "position", "right", "table-layout", "text-align", "text-decoration",
    "text-indent", "text-overflow", "text-shadow", "text-transform", "top", "vertical-align", "visibility", "white-space", "width", "word-break", "word-spacing",
    "word-wrap", "z-index",
}


def allowed_style(style: str) -> tuple[str, int]:
    """The allowed declarations of an inline style, and how many others it had; what isn't a declaration vanishes uncounted."""
    parts = [(k.strip(), v.strip()) for k, colon, v in (d.partition(":") for d in style.split(";")) if colon]
    kept = [f"{k}: {v}" for k, v in parts if k.lower() in CSS_KEPT]
    return "; ".join(kept), len(parts) - len(kept)


def sanitize(source: str | None) -> tuple[str, dict[str, int]]:
    """What the allow-list keeps, and counts of what went: elements, attributes, declarations."""
    root = parse(source)
    counts = {"elements": 0, "attributes": 0, "declarations": 0}
    for e in root.elements():
        if e.tag in DROPPED:
            counts["elements"] += 1
            if e.parent is not None:
                e.remove()
    for e in root.elements("h1"):
        e.tag, counts["elements"] = "h2", counts["elements"] + 1
    for e in root.elements():
        if e.tag in UNWRAPPED:
            counts["elements"] += 1
            e.unwrap()
    for e in root.elements():
        if "role" in e.attrs and e.get("role").strip().lower() not in ROLES_KEPT:
            del e.attrs["role"]
            counts["attributes"] += 1
        if "style" in e.attrs:
            e.attrs["style"], gone = allowed_style(e.get("style"))
            counts["declarations"] += gone
            if not e.attrs["style"]:
                del e.attrs["style"]
        own = ATTRIBUTES_KEPT | set(OWN_ATTRIBUTES.get(e.tag, ()))
        for name in [a for a in e.attrs if a not in own and not a.startswith("data-")]:
            del e.attrs[name]
            counts["attributes"] += 1
    return root.html(), counts


def violations(elements: DataFrame) -> DataFrame:
    """What the sanitizer would change, as rows (page_id, nid, severity, element): a check without a rewrite."""
    forbidden = sorted(DROPPED | UNWRAPPED | {"h1"})
    css = F.filter(F.split(F.coalesce(F.try_element_at("attrs", F.lit("style")), F.lit("")), ";"), lambda d: d.contains(":") & ~F.lower(F.trim(F.split(d, ":")[0])).isin(*sorted(CSS_KEPT)))
    rows = elements.where("nid > 0").select("course_id", "page_id", "nid", "tag", F.col("tag").isin(*forbidden).alias("bad"), F.size(css).alias("declarations"))
    return rows.where("bad OR declarations > 0").select("course_id", "page_id", "nid", F.col("tag").alias("element"), F.when(F.col("bad"), "error").otherwise("warning").alias("severity"), "declarations")


#: Kinds of pages that may be written back.
WRITABLE = ("wiki_page", "assignment", "discussion", "announcement", "syllabus")
RENDERED = "array<struct<fg_color:string,bg_color:string,font_size:string,font_weight:string,element_html:string>>"
CHANGED = "html string, changed boolean, fixes array<string>, elements_dropped int, attributes_dropped int, declarations_dropped int"


def alts_of_pages(pages: DataFrame, alts: DataFrame) -> DataFrame:
    """Per page: the generated texts (course_id, src, alt[, place]) of its images, as an array of (src, alt).

    A text is for the image of its address; else the first text, by place, whose
    address is part of the image's or the reverse. Only texts and images of one
    course meet. Addresses meet by joins of equal values (``parts_of``), so the
    work grows with the addresses and not with their pairs.
    """
    names = ["course_id", "page_id"]
    images = elements(pages, facts=False).where("tag = 'img'").select(*names, F.try_element_at("attrs", F.lit("src")).alias("own")).where("own <> ''").distinct()
    place = F.col("place") if "place" in alts.columns else F.lit(0)
    known = alts.select("course_id", F.col("src").alias("key"), "alt", place.alias("place")).where("key <> ''")
    known = known.groupBy("course_id", "key").agg(F.min(F.struct("place", "key", "alt")).alias("text"))
    own = images.select("course_id", "own").distinct()
    same_ = own.join(known, (own["own"] == known["key"]) & (own["course_id"] == known["course_id"])).select(own["course_id"], "own", "text")
    rest = own.join(same_.select("course_id", "own"), ["course_id", "own"], "left_anti")
    keys = known.select("course_id", "key")
    met = parts_of(rest, "own", keys, "key").unionByName(parts_of(keys, "key", rest, "own"))
    other = met.join(known, ["course_id", "key"]).groupBy("course_id", "own").agg(F.min("text").alias("text"))
    found = same_.unionByName(other).select("course_id", "own", F.col("text.alt").alias("alt"))
    best = images.join(found, ["course_id", "own"])
    return best.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct(F.col("own").alias("src"), "alt"))).alias("_alts"))


#: Characters of a part that are looked up; longer parts are looked up by their beginning and then compared.
PART_CHARS = 256


def parts_of(wholes: DataFrame, whole: str, parts: DataFrame, part: str) -> DataFrame:
    """(course_id, whole, part): which texts of ``parts`` stand inside longer texts of ``wholes``, course by course.

    Each whole gives its stretches of those lengths that the parts of its course
    have, once each; they are joined to the parts as equal values. A whole has at
    most (its length x different lengths of parts) of them, however many parts
    there are. Long wholes go by a digest, so that stretches stay small.
    """
    head = parts.select("course_id", F.col(part), F.left(F.col(part), F.lit(PART_CHARS)).alias("_stretch"))
    sizes = head.select("course_id", F.char_length("_stretch").alias("_size")).distinct()
    named = wholes.select("course_id", F.col(whole), F.when(F.char_length(whole) <= PART_CHARS, F.col(whole)).otherwise(F.sha2(whole, 256)).alias("_id"))
    sized = named.join(sizes, "course_id").where(F.col("_size") <= F.char_length(whole))
    at = sized.select("course_id", whole, "_id", "_size", F.explode(F.sequence(F.lit(1), F.char_length(whole) - F.col("_size") + 1)).alias("_at"))
    stretches = at.select("course_id", "_id", F.substring(F.col(whole), F.col("_at"), F.col("_size")).alias("_stretch")).distinct()
    pairs = stretches.join(head, ["course_id", "_stretch"]).select("course_id", "_id", part).join(named, ["course_id", "_id"])
    return pairs.where(F.col(whole).contains(F.col(part)) & (F.col(whole) != F.col(part))).select("course_id", whole, part)


def repaired(pages: DataFrame, issues: DataFrame, alts: DataFrame | dict[str, str] | None = None, with_title: bool = False, sanitized: bool = True) -> DataFrame:
    """Pages with their repaired (and sanitized) html, and what was done. Only writable pages with issues are rewritten.

    Rules found are gathered per page (a few dozen at most) and joined to the
    pages by their key; so are the colours that a browser saw, from contrast
    issues with axe_meta, and generated texts of images, from a table
    (course_id, src, alt[, place]) or, if few, a dict.
    """
    rendered = F.array().cast(RENDERED)
    if "axe_meta" in issues.columns and issues.schema["axe_meta"].dataType.typeName() == "struct":
        seen = F.col("axe_meta").isNotNull() & (F.col("rule_id") == "CLR001")
        rendered = F.collect_list(F.when(seen, F.struct(*(F.col(f"axe_meta.{c}").cast("string").alias(c) for c in ("fg_color", "bg_color", "font_size", "font_weight")), F.col("element_html")))).cast(RENDERED)
    else:
        rendered = F.first(rendered)
    found = issues.groupBy("course_id", "page_id").agg(F.collect_set(F.when(F.col("can_auto_fix"), F.col("rule_id"))).alias("_rules"), rendered.alias("_rendered"))
    joined = pages.join(found, ["course_id", "page_id"], "left")
    if isinstance(alts, DataFrame):
        joined = joined.join(alts_of_pages(pages, alts), ["course_id", "page_id"], "left")
    few = alts if isinstance(alts, dict) else {}
    names = pages.columns

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                html, fixes, gone = r["html"], [], {"elements": 0, "attributes": 0, "declarations": 0}
                if r["_rules"] is not None and r["content_type"] in WRITABLE:
                    own = {a["src"]: a["alt"] for a in r.get("_alts") or ()} or few
                    html, fixes = repair(r["html"], set(r["_rules"]), r["title"] if with_title else "", own, r["_rendered"])
                    if sanitized:
                        html, gone = sanitize(html)
                out.append({n: r[n] for n in names} | {"html": html, "changed": html != r["html"], "fixes": fixes} | {f"{k}_dropped": v for k, v in gone.items()})
            yield pa.RecordBatch.from_pylist(out, schema)

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(f"{base}, {CHANGED}")
    schema = to_arrow_schema(kind)
    return joined.mapInArrow(run, kind)


__all__ = ["FIXERS", "is_empty", "repair", "repaired", "sanitize", "violations"]
