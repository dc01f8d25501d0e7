"""The page rules, as expressions over element rows.

A finding is a struct (rule, nid, seq, message, html). Each rule yields an array
of them from one row: element rules from the facts of an element, page rules
from the page facts on the root's row. All rules are evaluated in one pass over
the elements, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpage.functions import text as T
from lumenpage.sources.elements import FILE_CLASSES, HTML_CHARS

C = F.col
FINDING = "array<struct<rule:string,nid:int,seq:int,message:string,html:string>>"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    category: str
    wcag: str
    auto_fix: bool
    fix: str | None = None


# The rules in order (id, severity, category, criterion, fixable, fix).
RULES = [
    Rule("IMG001", "error", "images", "1.1.1", True, "Generate alt text using AI vision model"),
    Rule("IMG002", "warning", "images", "1.1.1", True, "Generate descriptive alt text using AI"),
    Rule("IMG003", "warning", "images", "1.1.1", True, "Differentiate alt text for nearby images"),
    Rule("IMG004", "warning", "images", "1.1.1", True, "Truncate alt text to a concise description"),
    Rule("IMG005", "error", "images", "1.1.1", True, "Add alt text from link context"),
    Rule("IMG006", "warning", "images", "1.1.1", True, "Copy title to alt or generate alt text using AI"),
    Rule("IMG008", "error", "images", "1.1.1", False),
    Rule("IMG009", "warning", "images", "1.1.1", True, "Strip leading 'Image of …' or trailing '… Image' noise"),
    Rule("HDG001", "error", "headings", "1.3.1", True, "Convert H1 to H2 and shift all other headings"),
    Rule("HDG002", "warning", "headings", "1.3.1", True, "Adjust heading levels to maintain proper hierarchy"),
    Rule("HDG003", "error", "headings", "1.3.1", True, "Remove empty heading elements"),
    Rule("HDG004", "warning", "headings", "1.3.1", True, "Convert bold paragraph to proper heading element"),
    Rule("HDG005", "warning", "headings", "1.3.1", True, "Add page title as H2 heading at top of content"),
    Rule("HDG006", "warning", "headings", "1.3.1", True, "Truncate heading at word boundary and move remainder to paragraph"),
    Rule("TBL001", "error", "tables", "1.3.1", True, "Convert first row cells to <th> elements"),
    Rule("TBL002", "warning", "tables", "1.3.1", True, "Add scope='col' or scope='row' to header cells"),
    Rule("TBL003", "warning", "tables", "1.3.1", True, "Add a descriptive caption to the table"),
    Rule("TBL004", "error", "tables", "1.3.1", True, "Convert empty header to data cell or add descriptive text"),
    Rule("TBL005", "warning", "tables", "1.3.1", True, "Add role='presentation' to layout tables"),
    Rule("TBL006", "warning", "tables", "1.3.1", True, "Fill empty cells with non-breaking space for screen reader compatibility"),
    Rule("LIST001", "warning", "structure", "1.3.1", True, "Convert numbered paragraphs to ordered list elements"),
    Rule("STR001", "warning", "structure", "1.3.1", True, "Remove consecutive empty paragraphs and divs"),
    Rule("STR002", "error", "structure", "4.1.2", True, "Convert deprecated tags to modern equivalents"),
    Rule("STR003", "warning", "structure", "1.4.4", True, "Remove small font-size or normalize to readable size"),
    Rule("ARIA001", "error", "structure", "4.1.2", True, "Remove broken ARIA references"),
    Rule("DID001", "error", "structure", "4.1.1", True, "Rename duplicate IDs to be unique"),
    Rule("ARIA002", "error", "structure", "4.1.2", False, "Remove aria-hidden or remove focusable children"),
    Rule("ARIA003", "error", "structure", "4.1.2", False, "Add the required ARIA property for this role"),
    Rule("ARIA004", "error", "structure", "4.1.2", True, "Remove invalid role attribute"),
    Rule("STR004", "warning", "structure", "1.3.1", True, "Replace <u> with <em>; strip text-decoration: underline from non-link elements"),
    Rule("STR005", "warning", "structure", "1.4.8", True, "Change text-align: justify to text-align: left"),
    Rule("MDA001", "error", "media", "1.2.2", True, "Add title attribute to video iframe with video title or platform name"),
    Rule("MDA002", "error", "media", "1.4.2", True, "Remove autoplay attribute"),
    Rule("MDA003", "warning", "media", "1.2.2", False),
    Rule("MDA004", "warning", "media", "1.2.2", False),
    Rule("MDA005", "warning", "media", "1.2.2", False),
    Rule("MDA006", "warning", "media", "1.2.2", False),
    Rule("MATH001", "warning", "math", "1.3.1", True, "Convert LaTeX expressions to accessible HTML using Math SEL"),
    Rule("LNK001", "warning", "links", "2.4.4", True, "Fix non-descriptive link text or unwrap broken placeholder links"),
    Rule("LNK002", "warning", "links", "2.4.4", True, "Remove title attribute that duplicates link text"),
    Rule("LNK003", "error", "links", "2.4.4", True, "Add aria-label derived from link href"),
    Rule("LNK004", "warning", "links", "2.4.4", False, "Rewrite link text to describe the destination"),
    Rule("LNK005", "warning", "links", "2.4.4", True, "Replace URL text with descriptive link text derived from domain"),
    Rule("LNK006", "warning", "links", "2.4.4", True, "Merge adjacent duplicate links into one"),
    Rule("LNK007", "info", "links", "2.4.4", False, "Consider converting the document to an accessible HTML page"),
    Rule("LNK008", "warning", "links", "2.4.4", True, "URL-encode spaces as %20"),
    Rule("LNK009", "error", "links", "2.1.1", True, "Unwrap broken anchor links, keeping inner text"),
    Rule("LNK010", "warning", "links", "2.4.4", True, "Disambiguate duplicate link text with contextual suffix"),
    Rule("LNK011", "warning", "links", "2.4.4", True, "Remove the empty link; the visible-content link already covers the destination"),
    Rule("LNK012", "warning", "links", "2.4.4", True, "Merge adjacent image-only and text-only links to the same destination into a single image link with the text as alt"),
    Rule("CLR001", "error", "contrast", "1.4.3", True, "Adjust foreground color to meet 4.5:1 contrast ratio"),
    Rule("TGT001", "warning", "structure", "2.5.8", True, "Ensure minimum 24x24px target size for interactive elements"),
    Rule("FOC001", "warning", "focus", "2.4.11", True, "Add scroll-margin to prevent focus from being obscured by fixed elements"),
    Rule("FORM001", "warning", "forms", "3.3.7", False),
    Rule("AUTH001", "warning", "forms", "3.3.8", True, "Add autocomplete attribute to password fields"),
    Rule("FORM003", "error", "forms", "1.3.1", True, "Add descriptive text to empty form label"),
    Rule("FORM005", "error", "forms", "1.3.1", False, "Wrap related radio/checkbox groups in a <fieldset> with a <legend>"),
    Rule("FORM007", "error", "forms", "1.3.1", True, "Associate label with a matching form control or remove orphaned for attribute"),
    Rule("FORM009", "warning", "forms", "1.3.5", True, "Add autocomplete attribute for personal data inputs"),
    Rule("BTN001", "error", "structure", "1.1.1", True, "Add accessible label to empty button"),
    Rule("DOC001", "warning", "documents", "1.1.1", False, "Verify the linked Google document meets accessibility standards"),
    Rule("DOC002", "info", "documents", "1.1.1", False, "Consider converting the linked asset to an accessible HTML page"),
    Rule("PDF001", "warning", "documents", "1.1.1", False, "Verify the linked PDF meets accessibility standards (tagged, readable, proper structure)"),
    Rule("EVT001", "warning", "events", "2.1.1", False),
    Rule("EVT002", "warning", "events", "2.1.1", False),
    Rule("HELP001", "info", "structure", "3.2.6", False),
]
BY_ID = {r.rule_id: r for r in RULES}

# Words and patterns of the rules.
DEPRECATED = ("font", "center", "blink", "marquee", "big", "strike", "tt")
REQUIRED_PROPS = {"combobox": ("aria-expanded",), "meter": ("aria-valuenow",), "scrollbar": ("aria-controls", "aria-valuenow"), "slider": ("aria-valuenow",), "spinbutton": ("aria-valuenow",)}
ROLES = (
    "alert", "alertdialog", "application", "article", "banner", "blockquote", "button", "caption", "cell", "checkbox", "code", "columnheader", "combobox", "command",
    "comment", "complementary", "composite", "contentinfo", "definition", "deletion", "dialog", "directory", "document", "emphasis", "feed", "figure", "form", "generic",
    "grid", "gridcell", "group", "heading", "img", "input", "insertion", "link", "list", "listbox", "listitem", "log", "main", "marquee", "math", "menu", "menubar",
    "menuitem", "menuitemcheckbox", "menuitemradio", "meter", "navigation", "none", "note", "option", "paragraph", "presentation", "progressbar", "radio", "radiogroup",
    "range", "region", "roletype", "row", "rowgroup", "rowheader", "scrollbar", "search", "searchbox", "section", "sectionhead", "select", "separator", "slider",
    "spinbutton", "status", "strong", "structure", "subscript", "superscript", "switch", "tab", "table", "tablist", "tabpanel", "term", "textbox", "time", "timer",
    "toolbar", "tooltip", "tree", "treegrid", "treeitem", "widget", "window",
)
INLINE_PARENTS = ("p", "span", "em", "strong", "b", "i", "li", "td", "th", "label")
MOUSE_EVENTS = ("ondblclick", "onmousedown", "onmouseout", "onmouseover", "onmouseup")
JUMP = r"(?iU)(location\b|navigate\b|\.href\b|window\.open\b)"
VAGUE = (
    "click here", "click", "here", "link", "read more", "more", "learn more", "this", "this link", "this page", "continue", "go", "see more", "view",
    "view more", "details", "info", "information", "download",
)
VAGUE_PREFIXES = (
    "click here", "click this", "click on", "click to", "click for", "tap here", "tap to", "go here", "read more", "learn more", "see more", "view more",
    "find out more", "more info",
)
FAKE = ("click here", "click", "here", "read more", "more", "learn more", "link", "this", "this link", "this page", "see more", "view", "view more")
URL_SIGNS = ("http://", "https://", "www.")
DOCUMENTS = {
    ".doc": "Word document", ".docx": "Word document", ".ppt": "PowerPoint presentation", ".pptx": "PowerPoint presentation", ".pps": "PowerPoint slideshow",
    ".ppsx": "PowerPoint slideshow", ".xls": "Excel spreadsheet", ".xlsx": "Excel spreadsheet", ".odt": "OpenDocument text", ".ods": "OpenDocument spreadsheet",
    ".odp": "OpenDocument presentation", ".rtf": "RTF document", ".wpd": "WordPerfect document", ".pdf": "PDF document", ".sxw": "StarOffice document",
    ".sxc": "StarOffice spreadsheet", ".sxd": "StarOffice drawing", ".sxi": "StarOffice presentation", ".pages": "Apple Pages document",
    ".key": "Apple Keynote presentation", ".numbers": "Apple Numbers spreadsheet",
}
GOOGLE = {
    "docs.google.com/document": ("Google Document", "Google Document"), "docs.google.com/spreadsheets": ("Google Sheet", "Google Sheet"),
    "docs.google.com/presentation": ("Google Presentation", "Google Slides"), "docs.google.com/forms": ("Google Form", "Google Form"),
    "drive.google.com/file": ("Google File", "Google Drive file"), "docs.google.com/file": ("Google File", "Google Drive file"),
}
VIDEO_HOSTS = r"(?i)youtube|youtu\.be|vimeo|kaltura|panopto|wistia|instructuremedia|arc\.instructure|canvastudio|echo360|mediasite|media\.instructure"
YOUTUBE, STUDIO = r"(?i)youtube\.com/(?:watch|embed)|youtu\.be/", r"(?i)instructuremedia\.com|arc\.instructure\.com"
LATEX = (
    r"\\(?:frac|sqrt|sum|prod|int|lim|infty|partial|nabla|alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|"
    r"chi|psi|omega|Alpha|Beta|Gamma|Delta|Epsilon|Zeta|Eta|Theta|Iota|Kappa|Lambda|Mu|Nu|Xi|Pi|Rho|Sigma|Tau|Upsilon|Phi|Chi|Psi|Omega|pm|mp|times|div|cdot|ne|"
    r"le|ge|leq|geq|approx|equiv|sim|forall|exists|in|notin|subset|supset|cup|cap|leftarrow|rightarrow|Leftarrow|Rightarrow|begin|end|text|mathrm|mathbf|mathit|"
    r"overline|underline|hat|vec)(?:\{|[^a-zA-Z]|$)"
)
MATH_PATTERNS = (r"(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)", r"(?s)\$\$(.+?)\$\$", r"\\\((.+?)\\\)", r"(?s)\\\[(.+?)\\\]")
MATH_SCRIPTS = r"(?i)mathjax|katex|math-renderer"
SKIP_LABELLED = ("hidden", "submit", "reset", "button", "image")
SKIP_PERSONAL = (*SKIP_LABELLED, "checkbox", "radio", "file")
PERSONAL_NAMES = (
    ("email", "email"), ("phone", "tel"), ("tel", "tel"), ("fname", "given-name"), ("first.name", "given-name"), ("first_name", "given-name"), ("given", "given-name"),
    ("lname", "family-name"), ("last.name", "family-name"), ("last_name", "family-name"), ("family", "family-name"), ("address", "street-address"),
    ("street", "street-address"), ("zip", "postal-code"), ("postal", "postal-code"), ("city", "address-level2"), ("state", "address-level1"),
    ("province", "address-level1"), ("country", "country-name"),
)
NORMAL_CONTRAST, LARGE_CONTRAST, MIN_TARGET, MAX_HEADING, MAX_FAKE_HEADING, MIN_STRUCTURED = 4.7, 3.2, 24, 120, 80, 50
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


#: Attributes that many rules look at; each becomes a column first.
OWN = ("alt", "href", "src", "style", "role", "title", "type", "name", "class", "aria-label")


def _attribute(name: str) -> Column:
    return F.coalesce(F.try_element_at(C("attrs"), F.lit(name)), F.lit(""))


def attr(name: str) -> Column:
    return C(f"`@{name}`") if name in OWN else _attribute(name)


def has(name: str) -> Column:
    return F.coalesce(F.map_contains_key(C("attrs"), F.lit(name)), F.lit(False))


def below(*tags: str) -> Column:
    """How many elements with any of these tags are below."""
    total = F.lit(0)
    for t in tags:
        total = total + F.coalesce(F.try_element_at(C("below"), F.lit(t)), F.lit(0))
    return total


def tag(*names: str) -> Column:
    return C("tag").isin(*names)


def bare(c: Column) -> Column:
    return T.strip(c)


def visible(c: Column) -> Column:
    """Text without no-break spaces and outer white space."""
    return bare(F.replace(c, F.lit("\xa0"), F.lit("")))


def left(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def msg(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def hit(rule: str, message: Column, html: Column | None = None, nid: Column | None = None, seq: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), (C("nid") if nid is None else nid).cast("int").alias("nid"), (F.lit(0) if seq is None else seq).cast("int").alias("seq"),
        message.alias("message"), (C("html") if html is None else html).alias("html"),
    )


def when(rule: str, test: Column, message: Column, seq: int = 0) -> Column:
    """A finding of one element, or null."""
    return F.when(test, hit(rule, message, seq=F.lit(seq)))


def _with_alt() -> Column:
    return F.exists("alts", lambda a: a.isNotNull() & (T.strip(a) != ""))


def prepared(elements: DataFrame) -> DataFrame:
    """Elements with what several rules share, in steps, so that each is worked out once and expressions stay short."""
    text = C("text")
    inherited = lambda name: F.try_element_at(F.filter(F.transform("styles", lambda s: T.color_of(s, name)), lambda c: c.isNotNull()), F.lit(1))
    label = lambda i: F.coalesce(*(F.when(T.strip(F.coalesce(c, F.lit(""))) != "", T.strip(c)) for c in (i["label"], i["aria"], i["placeholder"], i["name"])), F.lit(""))
    stripped = lambda c: F.when(c == "", c).otherwise(bare(c))
    key = lambda c: T.strip(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))
    bold = F.arrays_overlap("above", F.array(F.lit("strong"), F.lit("b"))) | (below("strong", "b") > 0)
    white = F.struct(F.lit(255).alias("r"), F.lit(255).alias("g"), F.lit(255).alias("b"))
    columns = {f"@{name}": _attribute(name) for name in OWN}
    first = elements.withColumns(columns)
    style = attr("style")
    second = first.withColumns({
        "_low": F.when(tag("a"), F.lower(text)), "_fg": F.when(style != "", T.color_of(style, "color")), "_bg": F.when(style != "", T.color_of(style, "background-color")),
        "_over_fg": F.when(F.size("styles") > 0, inherited("color")), "_over_bg": F.when(F.size("styles") > 0, inherited("background-color")),
        "_role": F.lower(stripped(attr("role"))), "_alt": stripped(attr("alt")), "_href": stripped(attr("href")),
        "_reason": F.when(tag("img"), T.inadequate_alt(attr("alt"))), "_noise": F.when(tag("img"), T.alt_noise(attr("alt"))),
        "_title": F.when(tag("a"), _normal(attr("title"))), "_named": F.when(tag("a"), _normal(text)),
        "_keyed": F.filter(F.transform(F.filter("inputs", lambda i: ~i["kind"].isin(*SKIP_LABELLED)), lambda i: F.struct(key(label(i)).alias("key"), i["html"].alias("html"))), lambda i: i["key"] != ""),
        "_large": F.when(style != "", T.large_text(style, bold)),
    })
    third = second.withColumns({
        "_rgb": T.rgb_of(C("_fg")), "_rgb_bg": T.rgb_of(C("_bg")), "_rgb_over_fg": T.rgb_of(C("_over_fg")), "_rgb_over_bg": T.rgb_of(C("_over_bg")),
        "_needed": F.when(C("_large"), LARGE_CONTRAST).otherwise(NORMAL_CONTRAST), 
        "_keys": F.array_distinct(F.transform("_keyed", lambda i: i["key"])),
    })
    light = lambda c: F.when(c.isNotNull(), T.luminance(c))
    fourth = third.withColumns({
        "_l_fg": light(C("_rgb")), "_l_bg": light(C("_rgb_bg")), "_l_over": light(F.coalesce("_rgb_over_bg", white)), "_l_over_fg": light(C("_rgb_over_fg")), "_l_over_bg": light(C("_rgb_over_bg")),
    })
    ratio = lambda a, b: (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)
    # greatest and least pass over nulls, so both colours are asked for
    both = lambda a, b: F.when(C(a).isNotNull() & C(b).isNotNull(), ratio(C(a), C(b)))
    return fourth.withColumns({"_own_ratio": both("_l_fg", "_l_bg"), "_over_ratio": both("_l_fg", "_l_over"), "_both_ratio": both("_l_over_fg", "_l_over_bg")})


def _images() -> list[Column]:
    img, alt = tag("img"), attr("alt")
    equation = F.array_contains(F.split(F.lower(attr("class")), r"(?U)\s+"), "equation_image") | F.lower(attr("src")).contains("/equation_images/") | (attr("data-equation-content") != "")
    plain = img & ~equation
    src = F.when(has("src"), attr("src")).otherwise("unknown")
    reason = C("_reason")
    told = (
        F.when(reason == "generic_placeholder", msg('Alt text "', alt, '" is not descriptive'))
        .when(reason == "filename", msg('Alt text appears to be a filename: "', alt, '"'))
        .when(reason == "reference_code", msg('Alt text "', alt, '" looks like an internal reference code'))
        .when(reason == "too_long", msg("Alt text must stay under 100 characters (", F.char_length(alt), " chars)"))
        .otherwise(msg('Alt text "', alt, '" needs improvement'))
    )
    own = F.lower("_alt")
    near = F.try_element_at(F.filter("near", lambda n: n["alt"] == F.lower("_alt")), F.lit(1))
    noise = C("_noise")
    longdesc = bare(attr("longdesc"))
    return [
        when("IMG001", plain & ~has("alt"), msg("Image missing alt text: ", src)),
        when("IMG001", plain & has("alt") & (C("_alt") == "") & (attr("role") != "presentation"), msg("Image has empty alt text: ", src)),
        when("IMG001", img & has("usemap") & ~has("alt"), msg("Image map missing alternative text"), 1),
        when("IMG001", tag("area") & (C("_alt") == ""), msg("Image map area missing alternative text"), 2),
        when("IMG002", plain & (alt != "") & reason.isNotNull(), told),
        F.when((own != "") & near.isNotNull(), hit("IMG003", msg("A nearby image has the same alternative text: '", left(own, 50), "'"), near["html"])),
        when("IMG004", img & (F.char_length(alt) > T.MAX_ALT), msg("Alt text is ", F.char_length(alt), ' characters (max 100): "', left(alt, 40), '..."')),
        when("IMG006", img & (bare(attr("title")) != "") & (C("_alt") == ""), msg("Image has title but no alt text — title is not a substitute for alt: ", left(src, 80))),
        when("IMG008", img & (longdesc != "") & ~(longdesc.startswith("http") | longdesc.startswith("/") | longdesc.startswith("#")), msg("Invalid longdesc — '", left(longdesc, 60), "' is not a valid URL")),
        when("IMG009", img & (alt != "") & noise.isNotNull(), msg("Alt text has redundant ", noise["position"], ' noise: "', left(alt, 60), '"')),
    ]


def _headings() -> list[Column]:
    heading, own = tag(*HEADINGS) & C("in_body"), C("text")
    level = F.substring(C("tag"), 2, 1).try_cast("int")
    style = attr("style")
    large = (T.size_of(style, "px") >= 20) | (T.size_of(style, "em|rem") >= 1.3) | (T.size_of(style, "pt") >= 14) | (T.size_of(style, "%") >= 130)
    paragraph = tag("p") & C("in_body") & ~F.arrays_overlap("above", F.array(*map(F.lit, ("li", "td", "th", "ul", "ol", "table")))) & (own != "") & (F.char_length(own) <= MAX_FAKE_HEADING)
    bold = (F.size("kids") == 1) & F.coalesce(F.try_element_at("kids", F.lit(1)).isin("strong", "b"), F.lit(False))
    return [
        when("HDG001", tag("h1") & C("in_body"), msg('H1 tag found: "', left(own, 50), '..." - the page title takes H1')),
        when("HDG002", heading & (level > C("prev_level") + 1), msg("Heading level skipped from H", C("prev_level"), " to H", level, ': "', left(own, 30), '..."')),
        when("HDG003", heading & (visible(own) == "") & ~_with_alt(), msg("Empty <", C("tag"), "> element")),
        when("HDG004", paragraph & bold, msg('Paragraph styled as heading: "', left(own, 50), '"')),
        when("HDG004", paragraph & ~bold & F.coalesce(large, F.lit(False)), msg('Large-text paragraph may be a heading: "', left(own, 50), '"')),
        when("HDG006", heading & (F.char_length(own) > MAX_HEADING), msg("Heading is ", F.char_length(own), ' characters (max 120): "', left(own, 50), '..."')),
    ]


def _layout() -> Column:
    return (
        F.when(attr("role").isin("presentation", "none"), True)
        .when((below("caption", "thead", "tfoot") > 0) | (attr("summary") != "") | F.exists("grid.heads", lambda h: h != ""), False)
        .otherwise((below("table") > 0) | F.array_contains("above", "table"))
    )


def _tables() -> list[Column]:
    table, shown = tag("table"), attr("role") != "presentation"
    cells = F.array_join("grid.first_cells", ", ")
    prev, said = C("prev"), C("prev.text")
    wide = C("grid.colspan").try_cast("int") >= 3
    centred = prev["style"].contains("center") | prev["class"].contains("center")
    heavy = prev["bold"] | prev["style"].contains("font-weight")
    beside = (prev["tag"] == "p") & (said != "") & ((F.char_length(said) < 50) | ((F.char_length(said) < 100) & (heavy | centred)))
    possible = F.when(F.coalesce(wide, F.lit(False)), C("grid.first_cell")).when(F.coalesce(beside, F.lit(False)), said)
    headed = table & ~_layout() & (below("caption") == 0) & (below("th") > 0)
    loose = table & shown & (below("caption") == 0) & (below("th") == 0)
    return [
        when("TBL001", table & ~_layout() & (below("th") == 0), msg('Table missing header cells. First row: "', cells, '..."')),
        when("TBL003", headed & (F.coalesce(possible, F.lit("")) != ""), msg('Table has possible caption that should be a <caption>: "', left(F.coalesce(possible, F.lit("")), 50), '"')),
        when("TBL003", headed & (F.coalesce(possible, F.lit("")) == ""), msg('Table missing caption. Content preview: "', cells, '..."')),
        when("TBL005", loose & (F.size("grid.rows") <= 1), msg("Single-row table may be used for layout")),
        when("TBL005", loose & (F.size("grid.rows") > 1) & F.forall("grid.rows", lambda n: n <= 1), msg("Single-column table may be used for layout")),
        when("TBL006", table & shown & (C("grid.empty") > 0), msg('Table "', left(F.coalesce("grid.caption", F.lit("unnamed")), 30), '" has ', C("grid.empty"), "/", C("grid.cells"), " empty cells")),
    ]


def _styles() -> list[Column]:
    style, own, styled = attr("style"), C("text"), has("style")
    small = (T.size_of(style, "px") <= 10) | (T.size_of(style, "pt") < 10) | (T.size_of(style, "em|rem") < 0.75) | (T.size_of(style, "%") < 75)
    underlined = "Underlined text — may be confused with links. Use bold or italic instead."
    low = F.lower(style)
    return [
        when("STR002", tag(*DEPRECATED), msg("Deprecated <", C("tag"), "> tag found")),
        when("STR003", styled & (own != "") & F.coalesce(small, F.lit(False)), msg('Very small text: "', left(own, 40), '"')),
        when("STR004", tag("u") & (own != ""), msg(underlined)),
        when("STR004", ~tag("a") & (own != "") & style.rlike(r"(?iU)text-decoration\s*:\s*[^;]*\bunderline\b"), msg(underlined), 1),
        when("STR005", style.contains("text-align") & style.contains("justify"), msg("Justified text — can create uneven spacing. Use left-aligned text.")),
        when("FOC001", low.contains("position") & (low.contains("fixed") | low.contains("sticky")), msg("Element with position:fixed/sticky may obscure focused content: <", C("tag"), ">")),
    ]


def _roles() -> list[Column]:
    role = C("_role")
    hidden = attr("aria-hidden") == "true"
    events = F.array_intersect(F.array(*map(F.lit, MOUSE_EVENTS)), F.transform(F.map_keys("attrs"), lambda k: F.lower(k)))
    width = F.replace(F.coalesce("img_width", F.lit("")), F.lit("px"), F.lit(""))
    height = F.replace(F.coalesce("img_height", F.lit("")), F.lit("px"), F.lit(""))
    sized = lambda name: F.regexp_extract(attr("style"), rf"(?:^|;|\s){name}\s*:\s*([\d.]+)\s*px", 1).try_cast("double")
    picture = (below("img") > 0) & (C("text") == "")
    target = (
        F.when(picture & (bare(width).try_cast("double") < MIN_TARGET), msg("Image link target is ", bare(width).try_cast("double"), "px wide (minimum 24px)"))
        .when(picture & (bare(height).try_cast("double") < MIN_TARGET), msg("Image link target is ", bare(height).try_cast("double"), "px tall (minimum 24px)"))
        .when(sized("width") < MIN_TARGET, msg("Interactive element width is ", F.bround(sized("width")).cast("int"), "px (minimum 24px)"))
        .when(sized("height") < MIN_TARGET, msg("Interactive element height is ", F.bround(sized("height")).cast("int"), "px (minimum 24px)"))
    )
    inline = C("parent_tag").isin(*INLINE_PARENTS) & (C("parent_chars") - F.char_length("text") > 5)
    out = [
        when("ARIA002", hidden & C("focusable"), msg('aria-hidden="true" set on a focusable element — keyboard users can reach it but screen readers cannot')),
        when("ARIA002", hidden & ~C("focusable") & C("focusable_below"), msg('aria-hidden="true" on element containing focusable children — keyboard users can reach content that screen readers cannot see')),
        when("ARIA004", (role != "") & ~role.isin(*ROLES), msg('Invalid ARIA role "', role, '" — use a valid WAI-ARIA role or a native HTML element')),
        when("TGT001", tag("a", "button") & ~F.coalesce(inline, F.lit(False)) & target.isNotNull(), target),
        when("EVT001", F.size(events) > 0, msg("Device-dependent event handler (", F.array_join(F.array_sort(events), ", "), ") on <", C("tag"), "> — may not be keyboard accessible")),
        when("EVT002", tag("select") & attr("onchange").rlike(JUMP), msg("JavaScript jump menu — select element navigates on change")),
    ]
    for name, props in REQUIRED_PROPS.items():
        out += [when("ARIA003", (role == name) & (attr(p) == ""), msg(f'Role "{name}" requires {p} attribute'), k) for k, p in enumerate(props)]
    return out


def _buttons_and_forms() -> list[Column]:
    kind = F.lower(attr("type"))
    typed = F.when(has("type"), kind).otherwise("text")
    name = F.lower(attr("name"))
    personal = F.coalesce(F.when(typed == "email", "email").when(typed == "tel", "tel"), *(F.when(name.contains(p), v) for p, v in PERSONAL_NAMES))
    label = (attr("aria-label") != "") & (bare(attr("aria-label")) != "")
    return [
        when("BTN001", tag("button") & (visible(C("text")) == "") & ~label & (bare(attr("aria-labelledby")) == "") & ~_with_alt(), msg("Empty button — button contains no text or alternative text")),
        when("BTN001", tag("input") & attr("type").isin("submit", "button", "reset") & (bare(attr("value")) == "") & ~label, msg("Empty ", attr("type"), " input — missing value attribute"), 1),
        when("AUTH001", tag("input") & (kind == "password") & ~F.lower(bare(attr("autocomplete"))).isin("current-password", "new-password"),
             msg('Password input is missing autocomplete="current-password" or "new-password" — required for accessible authentication (WCAG 3.3.8)')),
        when("FORM003", tag("label") & (visible(C("text")) == "") & ~_with_alt(), msg("A form label is present but contains no content")),
        when("FORM009", tag("input") & (attr("autocomplete") == "") & ~typed.isin(*SKIP_PERSONAL) & personal.isNotNull(), msg('Input appears to collect "', personal, '" data but has no autocomplete attribute')),
    ]


def _normal(c: Column) -> Column:
    c = F.regexp_replace(bare(F.lower(c)), r"\.(pdf|docx?|txt|xlsx?|pptx?)$", "")
    return T.squeeze(F.regexp_replace(c, r"(?U)[^\w\s]", ""))


def _links() -> list[Column]:
    a, own, href = tag("a"), C("text"), attr("href")
    low = C("_low")
    url = T.contains_any(low, URL_SIGNS)
    title, named = C("_title"), C("_named")
    first_alt = F.try_element_at("alts", F.lit(1))
    pattern = "(?i)(" + "|".join(e.replace(".", r"\.") for e in sorted(DOCUMENTS, key=len, reverse=True)) + r")(\?.*)?$"
    extension = F.lower(F.regexp_extract(href, pattern, 1))
    labels = F.create_map(*(F.lit(x) for pair in DOCUMENTS.items() for x in pair))
    google = lambda k: F.coalesce(*(F.when(F.lower(href).contains(p), v[k]) for p, v in GOOGLE.items()))
    shown = F.when(own == "", "(no text)").otherwise(left(own, 40))
    is_pdf = href.rlike(r"(?i)\.pdf(\?.*)?(#.*)?$") | (href.contains("/files/") & own.rlike(r"(?iU)\bpdf\b"))
    beside = C("beside")
    pair = (C("_href") != "") & (own == "") & (below("img") > 0) & (beside["tag"] == "a") & (T.strip(beside["href"]) == C("_href")) & (beside["text"] != "") & ~beside["image"]
    return [
        when("IMG005", F.lit(False), msg("")),
        when("LNK001", a & (own != "") & ~url & low.isin(*VAGUE), msg('Link text "', low, '" is not descriptive (href: ', left(href, 50), ")")),
        when("LNK001", a & (own != "") & ~url & ~low.isin(*VAGUE) & T.starts_with_any(low, VAGUE_PREFIXES), msg('Link text "', left(low, 40), '" starts with non-descriptive phrase (href: ', left(href, 50), ")")),
        when("LNK002", a & (title != "") & (named != "") & (title.startswith(named) | named.startswith(title)), msg('Link title "', left(bare(attr("title")), 50), '" duplicates link text')),
        when("LNK003", a & (own == "") & (attr("aria-label") == "") & T.is_blank(first_alt), msg("Link has no accessible text: ", left(href, 60))),
        when("LNK004", a & low.isin(*FAKE), msg('Link uses generic text "', low, '" (href: ', left(href, 50), ")")),
        when("LNK005", a & (own != "") & url, msg("Link text is a raw URL: ", left(low, 60))),
        when("LNK006", a & (href != "") & (href == C("next_href")) & C("next_adjacent"), msg("Adjacent links share the same href: ", left(href, 60))),
        when("LNK007", a & (extension != ""), msg("Link to ", F.try_element_at(labels, extension), ': "', left(own, 40), '" (', left(href, 60), ")")),
        when("LNK007", a & (extension == "") & google(0).isNotNull(), msg("Link to ", google(0), ': "', left(own, 40), '" (', left(href, 60), ")")),
        when("LNK008", a & href.contains(" ") & ~(href.startswith("#") | href.startswith("mailto:")), msg('Link URL contains spaces: "', left(own, 40), '" (', left(href, 60), ")")),
        when("LNK012", a & F.coalesce(pair, F.lit(False)), msg("Adjacent image and text links share the same destination")),
        when("DOC001", a & google(1).isNotNull(), msg("Link to ", google(1), ' — verify document is accessible: "', left(own, 40), '" (', left(href, 60), ")")),
        when("DOC002", a & ~href.rlike(r"(?i)/(pages|assignments|discussion_topics|quizzes|modules|announcements)/") & href.rlike(r"(?i)/files/\d+|/media_objects/"),
             msg('Link to a stored asset — consider converting to accessible HTML page: "', left(own, 40), '" (', left(href, 60), ")")),
        when("PDF001", a & is_pdf, msg('Link to PDF document — verify PDF is accessible: "', shown, '" (', left(href, 60), ")")),
    ]


def _media_and_contrast() -> list[Column]:
    src = attr("src")
    told = C("captioned") | (attr("aria-label") != "") | (attr("aria-describedby") != "") | F.coalesce((C("next_tag") == "p") & F.lower(C("next_text")).contains("transcript"), F.lit(False))
    style, own = attr("style"), C("text")
    fg, bg, over, needed = C("_fg"), C("_bg"), C("_over_bg"), C("_needed")
    own_ratio, over_ratio, both_ratio = C("_own_ratio"), C("_over_ratio"), C("_both_ratio")
    leaf = (own != "") & (F.size("below") == 0) & ~style.rlike(r"(?:^|;)\s*color\s*:")
    return [
        when("MDA001", tag("video", "audio") & ~told, msg("<", C("tag"), "> element has no captions or text alternative")),
        when("MDA001", tag("iframe") & src.rlike(VIDEO_HOSTS) & (attr("title") == "") & (attr("aria-label") == ""), msg("Video iframe missing title or aria-label: ", left(src, 80)), 1),
        when("MDA002", tag("video", "audio", "embed") & has("autoplay"), msg("<", C("tag"), "> has autoplay enabled")),
        when("CLR001", fg.isNotNull() & bg.isNotNull() & (own_ratio < needed), msg("Low contrast ratio (", F.format_number(own_ratio, 1), ":1, needs ", needed, ':1) for text: "', left(own, 30), '..."')),
        when("CLR001", fg.isNotNull() & bg.isNull() & (own != "") & (over_ratio < needed),
             msg("Low contrast ratio (", F.format_number(over_ratio, 2), ":1, needs ", needed, ":1) — ", fg, " on ", F.coalesce(over, F.lit("#ffffff (assumed)")), ' for text: "', left(own, 30), '..."')),
        when("CLR001", leaf & (both_ratio < needed), msg("Very low contrast (", F.format_number(both_ratio, 2), ":1, needs ", needed, ":1) — inherited colors ", C("_over_fg"), " on ", over), 1),
    ]


def _arrays() -> list[Column]:
    """Rules that give several findings for one element."""
    a_images = F.filter("alts", lambda a: T.is_blank(a))
    linked = F.when(tag("a") & (C("text") == ""), F.transform(a_images, lambda _, k: hit("IMG005", msg("Linked image has no alt text and link has no text: ", left(attr("href"), 60)), seq=k)))
    scope = F.when(tag("table"), F.transform("heads_without_scope", lambda h, k: hit("TBL002", msg('Table header "', h["text"], '" missing scope attribute'), h["html"], seq=k)))
    empty = F.when(tag("table") & (attr("role") != "presentation"), F.transform("empty_heads", lambda h, k: hit("TBL004", msg("Table header cell is empty"), h, seq=k)))
    groups = F.filter(F.transform("_keys", lambda k: F.struct(k.alias("key"), F.filter("_keyed", lambda i: i["key"] == k).alias("of"))), lambda g: F.size(g["of"]) >= 2)
    entry = F.when(
        tag("form"),
        F.transform(groups, lambda g, k: hit("FORM001", msg("Form contains ", F.size(g["of"]), ' inputs with similar label "', g["key"], '" — may require redundant data entry'), g["of"][0]["html"], seq=k)),
    )
    return [linked, scope, empty, entry]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _page_rules() -> list[Column]:
    """Rules over the facts of a whole page."""
    page = C("page")
    long, media, files = page["body_chars"] > MIN_STRUCTURED, page["embeds"] > 0, page["files"] > 0
    detail = (
        F.when(files & ~long & ~media, msg("Page has ", page["files"], " embedded file link(s) but no headings"))
        .when(media & ~long, msg("Page has ", page["embeds"], " embedded media element(s) but no headings"))
        .otherwise(msg("Page has ", page["body_chars"], " characters of text but no headings"))
    )
    structure = F.when((page["sub_headings"] == 0) & (long | media | files), F.array(hit("HDG005", detail, page["body_html"])))
    lists = F.transform(
        "page.list_runs",
        lambda r: hit("LIST001", F.when(r["single"], msg(r["size"], ' <br>-separated lines inside a single <p> look like a list: "', r["preview"], '..."')).otherwise(msg(r["size"], ' consecutive paragraphs look like a list: "', r["preview"], '..."')), r["html"], r["nid"]),
    )
    empties = F.transform("page.empty_runs", lambda r: hit("STR001", msg(r["size"], " consecutive empty <", r["tag"], "> elements"), r["html"], r["nid"]))
    broken = F.transform(
        F.filter("page.refs", lambda r: F.size(r["missing"]) > 0),
        lambda r, k: hit("ARIA001", msg(r["attr"], " references missing ID(s): ", F.array_join(F.slice(r["missing"], 1, 3), ", ")), r["html"], r["nid"], k),
    )
    twice = F.transform("page.repeated_ids", lambda i, k: hit("DID001", msg('Duplicate id="', i["id"], '" found ', i["times"], " times — IDs must be unique"), msg('id="', i["id"], '"'), seq=k))
    fragment = lambda a: F.substring(a["href"], F.lit(2), F.char_length(a["href"]))
    anchors = F.transform(
        F.filter("page.links", lambda a: a["broken"]),
        lambda a: hit("LNK009", F.when(a["href"] == "#", msg('Link "', left(a["text"], 40), '" has empty fragment href="#"')).otherwise(msg('Link "', left(a["text"], 40), '" references nonexistent id="#', fragment(a), '"')), a["html"], a["nid"]),
    )
    same_text = F.transform(
        F.filter("page.links", lambda a: a["destinations"] > 1),
        lambda a: hit("LNK010", msg('Multiple links with text "', left(a["text"], 40), '" point to different destinations (', left(a["href"], 60), ")"), a["html"], a["nid"]),
    )
    redundant = F.transform(
        F.filter("page.links", lambda a: ~a["visible"] & (a["to"] != "") & ~a["to"].startswith("#") & (a["covered"] | a["again"])),
        lambda a: hit("LNK011", F.when(a["covered"], msg("Empty link redundant with visible link to ", left(a["to"], 60))).otherwise(msg("Duplicate empty link to ", left(a["to"], 60), "; keeping first occurrence")), a["html"], a["nid"]),
    )

    def videos(rule: str, pattern: str, frame: str, link: str) -> Column:
        own = F.filter("page.videos", lambda v: v["url"].rlike(pattern))
        return F.transform(own, lambda v: hit(rule, F.concat(F.when(v["frame"], frame).otherwise(link), left(v["url"], 80)), v["html"], v["nid"]))

    raw = page["raw"]
    formulas = _count(raw, LATEX) + F.size(F.filter("page.code", lambda c: c.rlike(LATEX))) + F.size(F.filter("page.scripts", lambda s: s["src"].rlike(MATH_SCRIPTS) | s["text"].rlike(MATH_SCRIPTS)))
    for p in MATH_PATTERNS:
        formulas = formulas + _count(raw, p)
    math = F.when(formulas > 0, F.array(hit("MATH001", msg("Found ", formulas, " LaTeX math expression(s) that need conversion to accessible HTML"), F.lit(None).cast("string"))))
    fieldset = F.transform("page.choices", lambda c: hit("FORM005", msg(F.initcap(c["kind"]), " input", F.when(c["name"] == "", "").otherwise(msg(' (name="', c["name"], '")')), " is not enclosed in a <fieldset> — related controls should be grouped"), c["html"], c["nid"]))
    orphans = F.transform(
        F.filter("page.labels", lambda x: (x["target"] != "") & ~x["known"]),
        lambda x: hit("FORM007", msg('Label references for="', x["target"], '" but no element with id="', x["target"], '" exists — label is not associated with a control'), x["html"], x["nid"]),
    )
    return [
        structure, lists, empties, broken, twice, anchors, same_text, redundant,
        videos("MDA003", YOUTUBE, "YouTube video — verify captions are human-generated, not auto-generated: ", "YouTube video link — verify captions are human-generated, not auto-generated: "),
        videos("MDA004", YOUTUBE, "YouTube video detected — verify video is still available: ", "YouTube video link detected — verify video is still available: "),
        videos("MDA005", STUDIO, "Studio video — verify captions are human-generated: ", "Studio video link — verify captions are human-generated: "),
        videos("MDA006", STUDIO, "Studio video detected — verify video is still available: ", "Studio video link detected — verify video is still available: "),
        math, fieldset, orphans,
    ]


def _named() -> Column:
    return tag("a", "button", "select") | (F.size("attrs") > 0)


def _seen() -> Column:
    return tag("video", "audio", "iframe", "embed") | (F.size("styles") > 0)


#: Rules by the part of the row that they look at: their ids, the elements that any of them can find, and the rules; parts keep generated methods small.
GROUPS: dict[str, tuple[tuple[str, ...], Callable[[], Column], Callable[[], list[Column]]]] = {
    "images": (("IMG001", "IMG002", "IMG003", "IMG004", "IMG006", "IMG008", "IMG009"), lambda: tag("img", "area", "input"), _images),
    "headings": (("HDG001", "HDG002", "HDG003", "HDG004", "HDG006"), lambda: tag(*HEADINGS, "p"), _headings),
    "tables": (("TBL001", "TBL003", "TBL005", "TBL006"), lambda: tag("table"), _tables),
    "styles": (("STR002", "STR003", "STR004", "STR005", "FOC001"), lambda: tag(*DEPRECATED, "u") | (attr("style") != ""), _styles),
    "roles": (("ARIA002", "ARIA003", "ARIA004", "TGT001", "EVT001", "EVT002"), _named, _roles),
    "forms": (("BTN001", "AUTH001", "FORM003", "FORM009"), lambda: tag("button", "input", "label"), _buttons_and_forms),
    "links": (("LNK001", "LNK002", "LNK003", "LNK004", "LNK005", "LNK006", "LNK007", "LNK008", "LNK012", "DOC001", "DOC002", "PDF001"), lambda: tag("a"), _links),
    "media": (("MDA001", "MDA002", "CLR001"), _seen, _media_and_contrast),
}
#: The rules of ``_arrays`` and ``_page_rules``, in their order.
ARRAY_RULES = ("IMG005", "TBL002", "TBL004", "FORM001")
PAGE_RULES = ("HDG005", "LIST001", "STR001", "ARIA001", "DID001", "LNK009", "LNK010", "LNK011", "MDA003", "MDA004", "MDA005", "MDA006", "MATH001", "FORM005", "FORM007")


def findings(elements: DataFrame, more: tuple[Callable[[], list[Column]], ...] = (), only: set[str] | None = None) -> DataFrame:
    """Rows of findings of all page rules: the page columns, rule, nid, seq, message, html.

    ``more`` adds rules of a user's own: functions that give columns of findings
    or nulls, made with ``when`` or ``hit`` over the facts of an element. With
    ``only``, findings of these rules alone; others are not worked out. The rules
    of a group run over the elements that they can find.
    """
    none = F.array().cast(FINDING)
    wanted = lambda rule: only is None or rule in only
    made = lambda columns: F.filter(F.array(*columns), lambda f: f.isNotNull()).cast(FINDING)
    parts = [F.when(gate(), made(rules())).otherwise(none) for ids, gate, rules in GROUPS.values() if any(map(wanted, ids))]
    parts += [made(rules()) for rules in more]
    several = [F.coalesce(a.cast(FINDING), none) for rule, a in zip(ARRAY_RULES, _arrays(), strict=True) if wanted(rule)]
    of_pages = [F.coalesce(p.cast(FINDING), none) for rule, p in zip(PAGE_RULES, _page_rules(), strict=True) if wanted(rule)] if any(map(wanted, PAGE_RULES)) else []
    of_element = F.when(C("nid") > 0, F.concat(none, *parts, *several))
    of_page = F.when(C("nid") == 0, F.concat(none, *of_pages))
    page = [C(c) for c in ("course_id", "page_id", "identifier", "title", "content_type", "canvas_url")]
    found = prepared(elements).select(*page, F.explode(F.coalesce(of_element, of_page, none)).alias("f"))
    if only is not None and not more:
        found = found.where(C("f.rule").isin(*sorted(only)))
    return found.select(*page, C("f.rule").alias("rule"), C("f.nid").alias("nid"), C("f.seq").alias("seq"), C("f.message").alias("message"), left(C("f.html"), HTML_CHARS).alias("html"))


__all__ = ["BY_ID", "FILE_CLASSES", "RULES", "Rule", "findings"]
