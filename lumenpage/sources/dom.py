"""HTML trees over the standard library's tokenizer.

No element is closed by the start of another; an end tag closes up to the
nearest open element of its name, or nothing. Void elements close at once.
Text of script, style and template elements belongs to them alone.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
HIDDEN_TEXT = frozenset(("script", "style", "template"))


class Text:
    """A text node; ``kind`` is text, comment, or declaration."""

    __slots__ = ("kind", "parent", "value")

    def __init__(self, value: str, kind: str = "text"):
        self.value, self.kind, self.parent = value, kind, None

    def html(self) -> str:
        if self.kind == "comment":
            return f"<!--{self.value}-->"
        if self.kind == "declaration":
            return f"<!{self.value}>"
        if self.parent is not None and self.parent.tag in ("script", "style"):
            return self.value
        return html_lib.escape(self.value, quote=False)


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    # reading

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def walk(self) -> Iterator[Element | Text]:
        """All nodes below, in document order; safe only while the tree stands still."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Element):
                stack.extend(reversed(node.children))

    def elements(self, *tags: str) -> list[Element]:
        return [n for n in self.walk() if isinstance(n, Element) and (not tags or n.tag in tags)]

    def first(self, *tags: str) -> Element | None:
        return next((n for n in self.walk() if isinstance(n, Element) and n.tag in tags), None)

    def ancestors(self) -> Iterator[Element]:
        node = self.parent
        while node is not None and node.tag != "#document":
            yield node
            node = node.parent

    def strings(self) -> Iterator[str]:
        own = self.tag in HIDDEN_TEXT
        for node in self.walk():
            if isinstance(node, Text) and node.kind == "text" and (own or not (node.parent is not None and node.parent.tag in HIDDEN_TEXT)):
                yield node.value

    def raw(self) -> str:
        return "".join(self.strings())

    def text(self, separator: str = "") -> str:
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)

    def siblings_after(self) -> list[Element | Text]:
        own = self.parent.children if self.parent is not None else [self]
        return own[_index(own, self) + 1 :]

    def siblings_before(self) -> list[Element | Text]:
        own = self.parent.children if self.parent is not None else [self]
        return own[: _index(own, self)]

    def next_significant(self) -> Element | Text | None:
        """The next sibling that isn't blank; comments count as strings."""
        return next((n for n in self.siblings_after() if not blank(n)), None)

    def html(self) -> str:
        return "".join(self._written())

    def head(self, chars: int) -> str:
        """The first characters of the HTML; no more of the tree is written than that."""
        out, size = [], 0
        for part in self._written():
            out.append(part)
            size += len(part)
            if size >= chars:
                break
        return "".join(out)[:chars]

    def _written(self) -> Iterator[str]:
        stack: list[Element | Text | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif isinstance(node, Text):
                yield node.html()
            elif node.tag == "#document":
                stack.extend(reversed(node.children))
            elif node.tag in VOID and not node.children:
                yield f"<{node.tag}{_attributes(node.attrs)}/>"
            else:
                yield f"<{node.tag}{_attributes(node.attrs)}>"
                stack.append(f"</{node.tag}>")
                stack.extend(reversed(node.children))

    # writing

    def append(self, node: Element | Text | str) -> Element | Text:
        return self.insert(len(self.children), node)

    def insert(self, at: int, node: Element | Text | str) -> Element | Text:
        if isinstance(node, str):
            node = Text(node)
        node.parent = self
        self.children.insert(at, node)
        return node

    def remove(self) -> None:
        if self.parent is not None:
            del self.parent.children[_index(self.parent.children, self)]
            self.parent = None

    def replace(self, *nodes: Element | Text) -> None:
        parent, at = self.parent, _index(self.parent.children, self)
        del parent.children[at]
        self.parent = None
        for k, node in enumerate(nodes):
            parent.insert(at + k, node)

    def unwrap(self) -> None:
        own, self.children = self.children, []
        self.replace(*own)

    def set_text(self, text: str) -> None:
        self.children = []
        self.append(text)

    def add_before(self, node: Element | Text) -> None:
        self.parent.insert(_index(self.parent.children, self), node)


def _index(nodes: list, node) -> int:
    return next(k for k, n in enumerate(nodes) if n is node)


def _attributes(attrs: dict[str, str]) -> str:
    out = []
    for name, value in attrs.items():
        value = value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        quote = "'" if '"' in value and "'" not in value else '"'
        out.append(f" {name}={quote}{value if quote == chr(39) else value.replace(chr(34), '&quot;')}{quote}")
    return "".join(out)


def blank(node: Element | Text) -> bool:
    return isinstance(node, Text) and not node.value.strip()


def same(a: Element | Text | None, b: Element | Text | None) -> bool:
    """Structural equality: name, attributes and contents."""
    if a is b:
        return True
    if isinstance(a, Element) and isinstance(b, Element):
        return a.tag == b.tag and a.attrs == b.attrs and len(a.children) == len(b.children) and all(map(same, a.children, b.children))
    return isinstance(a, Text) and isinstance(b, Text) and a.value == b.value


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#document")
        self.stack = [self.root]
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for name, value in attrs:
            own[name] = value or ""
        node = self.stack[-1].append(Element(tag, own))
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.open.get(tag):
            top = self.stack.pop()
            self.open[top.tag] -= 1
            if top.tag == tag:
                break

    def handle_data(self, data):
        last = self.stack[-1].children[-1:]
        if last and isinstance(last[0], Text) and last[0].kind == "text":
            last[0].value += data
        else:
            self.stack[-1].append(data)

    def handle_comment(self, data):
        self.stack[-1].append(Text(data, "comment"))

    def handle_decl(self, decl):
        self.stack[-1].append(Text(decl, "declaration"))

    def unknown_decl(self, data):
        self.stack[-1].append(Text(data.removeprefix("CDATA["), "text" if data.startswith("CDATA[") else "declaration"))

    def handle_pi(self, data):
        self.stack[-1].append(Text(f"?{data}", "declaration"))


def parse(source: str | None) -> Element:
    """The tree of a page or fragment; its root is #document."""
    builder = _Builder()
    builder.feed(source or "")
    builder.close()
    return builder.root


def body_of(root: Element) -> Element:
    return root.first("body") or root


def style_of(node: Element, name: str) -> str | None:
    """A declaration of an inline style."""
    found = re.search(rf"(?:^|;)\s*{re.escape(name)}\s*:\s*([^;]*)", node.get("style"), re.IGNORECASE)
    return found[1].strip() if found else None


def set_style(node: Element, **declarations: str | None) -> None:
    """Set (or with None drop) declarations of an inline style; names have _ for -."""
    parts = [(k.strip(), v.strip()) for k, _, v in (d.partition(":") for d in node.get("style").split(";")) if k.strip()]
    for name, value in declarations.items():
        name = name.replace("_", "-")
        kept = [(k, v) for k, v in parts if k.lower() != name]
        parts = kept if value is None else [*kept, (name, value)]
    if parts:
        node.attrs["style"] = "; ".join(f"{k}: {v}" for k, v in parts)
    else:
        node.attrs.pop("style", None)
