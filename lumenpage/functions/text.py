"""Text, alternative-text, style and colour expressions. White space is Unicode's throughout."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that make an alternative text inadequate.
GENERIC_ALTS = (
    "image", "photo", "picture", "pic", "img", "graphic", "icon", "logo", "banner", "screenshot", "screen shot", "untitled", "null", "undefined",
    "placeholder", "test", "temp", "temporary", "related image",
)
GENERIC_ALT_PREFIXES = (
    "image result for", "image of", "an image of", "photo of", "a photo of", "picture of", "a picture of", "graphic of", "diagram of", "a diagram of",
    "illustration of", "chart of", "graph of", "figure of",
)
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".svg", ".ico")
MAX_ALT, SOFT_ALT, MAX_CODE = 100, 70, 40
NOISE_WORDS = ("image", "images", "picture", "pictures", "photo", "photos", "photograph", "photographs", "graphic", "graphics", "icon", "icons", "img", "pic")
NAVIGATION_NOISE = r"(?i)\(?(?:link\s+)?opens?\s+in\s+(?:a\s+)?new\s+(?:window|tab|page)\)?"
# Colour names.
COLORS = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "orange": "#ffa500", "purple": "#800080",
    "gray": "#808080", "grey": "#808080", "navy": "#000080", "teal": "#008080", "maroon": "#800000", "olive": "#808000", "lime": "#00ff00", "aqua": "#00ffff",
    "fuchsia": "#ff00ff", "silver": "#c0c0c0", "brown": "#a52a2a", "darkgray": "#a9a9a9",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    hits = [c.startswith(p) for p in prefixes]
    return _any(hits)


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    return _any([c.contains(p) for p in parts])


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def inadequate_alt(alt: Column) -> Column:
    """Why an alternative text is inadequate, or null; the first reason counts."""
    own = strip(F.coalesce(alt, F.lit("")))
    low, compact = F.lower(own), F.regexp_replace(own, r"(?U)\s+", "")
    code = (F.char_length(compact) <= MAX_CODE) & compact.rlike(r"(?U)\d") & compact.rlike(r"(?iU)^(?:[a-z]?\d+(?:[._-]\d+)*[a-z]*|[a-z]+\d+[a-z0-9._-]*)$")
    return (
        F.when(own == "", "missing_alt")
        .when(low.isin(*GENERIC_ALTS) | starts_with_any(low, GENERIC_ALT_PREFIXES), "generic_placeholder")
        .when(_any([low.endswith(e) for e in IMAGE_EXTENSIONS]), "filename")
        .when(code, "reference_code")
        .when(F.char_length(own) > MAX_ALT, "too_long")
    )


def truncated_alt(alt: Column) -> Column:
    """At most 100 characters, cut at the last space if that keeps over 70."""
    own = squeeze(F.coalesce(alt, F.lit("")))
    head = F.substring(own, 1, MAX_ALT)
    space = F.lit(MAX_ALT) - F.locate(" ", F.reverse(head))
    at_space = F.substring(head, F.lit(1), space)
    return F.when(F.char_length(own) <= MAX_ALT, own).otherwise(strip(F.when((F.locate(" ", F.reverse(head)) > 0) & (space > SOFT_ALT), at_space).otherwise(head)))


def alt_noise(alt: Column) -> Column:
    """(position, cleaned) of words in an alternative text that say nothing, or null."""
    own = strip(F.coalesce(alt, F.lit("")))
    words = "|".join(NOISE_WORDS)
    lead, trail = rf"(?iU)^(?:an?\s+)?(?:{words})\s+of\s+", rf"(?iU)[.,;:\-!?\s]*\b(?:{words})\.?\s*$"
    nav_at = F.regexp_instr(own, F.lit(NAVIGATION_NOISE))
    nav_len = F.char_length(F.regexp_substr(own, F.lit(NAVIGATION_NOISE)))
    ends = r"[\s.,;:\-!?()]+"
    before = F.regexp_replace(F.substring(own, F.lit(1), nav_at - 1), ends + "$", "")
    after = F.regexp_replace(F.substring(own, nav_at + nav_len, F.char_length(own)), "^" + ends, "")
    rest = strip(F.regexp_replace(own, lead, ""))
    head = F.regexp_replace(F.regexp_replace(own, trail, ""), r"[ ,;:.\-!?]+$", "")
    many = own.rlike(r"(?U)\S\s+\S")
    made = lambda position, cleaned: F.struct(F.lit(position).alias("position"), cleaned.alias("cleaned"))
    return (
        F.when(own == "", None)
        .when(nav_at > 0, made("navigation", strip(F.concat(before, F.lit(" "), after))))
        .when(~many, None)
        .when(own.rlike(lead) & (rest != ""), made("leading", F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.char_length(rest)))))
        .when(own.rlike(trail) & (head != ""), made("trailing", head))
    )


def size_of(style: Column, unit: str) -> Column:
    """The first font size with this unit (a pattern) of an inline style."""
    return F.regexp_extract(style, rf"font-size\s*:\s*([\d.]+)\s*(?:{unit})", 1).try_cast("double")


def color_of(style: Column, name: str) -> Column:
    """A colour of an inline style as #hex: the first hex form, else the first rgb(), else the first name that is known."""
    edge = r"(?<![a-zA-Z-])" if name == "color" else ""
    hexed = F.regexp_extract(style, rf"{edge}{name}\s*:\s*(#[0-9A-Fa-f]{{3,6}})", 1)
    rgb = rf"{edge}{name}\s*:\s*rgb\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)"
    part = lambda k: F.lpad(F.lower(F.hex(F.regexp_extract(style, rgb, k).try_cast("int"))), 2, "0")
    named = F.lower(F.regexp_extract(style, rf"{edge}{name}\s*:\s*([a-zA-Z]+)", 1))
    table = F.create_map(*(F.lit(x) for pair in COLORS.items() for x in pair))
    return F.when(hexed != "", hexed).when(style.rlike(rgb), F.concat(F.lit("#"), part(1), part(2), part(3))).when(named != "", F.try_element_at(table, named))


def rgb_of(color: Column) -> Column:
    """(r, g, b) of a #hex colour of three or six digits, else null."""
    digits = F.regexp_replace(color, "^#+", "")
    digits = F.when(F.char_length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("int")
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


#: The linear light of each value of a channel, and the widths of 30 halvings, as SQL: both are folded to one literal each.
_LINEAR = "array(" + ", ".join(f"{v / 255 / 12.92 if v / 255 <= 0.03928 else ((v / 255 + 0.055) / 1.055) ** 2.4!r}D" for v in range(256)) + ")"
_WIDTHS = "array(" + ", ".join(f"{0.5**k!r}D" for k in range(1, 31)) + ")"


def luminance(rgb: Column) -> Column:
    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(rgb["r"]) + 0.7152 * linear(rgb["g"]) + 0.0722 * linear(rgb["b"])


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def adjusted(moved: Column, fixed: Column, target: float | Column, foreground: bool = True) -> Column:
    """``moved`` shifted toward black or white, by 30 halvings, just so far that the contrast is reached; else wholly."""

    def light_of(part: Callable[[str], Column]) -> Column:
        return reduce(add, (weight * F.get(F.expr(_LINEAR), part(c)) for c, weight in zip("rgb", (0.2126, 0.7152, 0.0722))))

    own = light_of(lambda c: fixed[c])
    light = own > 0.18 if foreground else ~(own < 0.18)
    end = F.when(light, 0).otherwise(255)

    def moved_part(c: str, share: Column) -> Column:
        return (moved[c] + (end - moved[c]) * share).cast("int")

    # the search's upper end alone: its lower end lies one width below; both are exact in binary, so a step tries upper end less width
    def halve(hi: Column, width: Column) -> Column:
        new = light_of(lambda c: moved_part(c, hi - width))
        return F.when((F.greatest(new, own) + 0.05) / (F.least(new, own) + 0.05) >= target, hi - width).otherwise(hi)

    share = F.aggregate(F.expr(_WIDTHS), F.lit(1.0), halve)
    at = F.transform(F.array(share), lambda x: F.struct(*(moved_part(c, x).alias(c) for c in "rgb")))
    return F.when(contrast(moved, fixed) >= target, moved).otherwise(at[0])


def large_text(style: Column, bold: Column) -> Column:
    """24 px and more, or 18.67 px and more in bold; px, pt, em or rem, % are tried in this order."""
    px = F.coalesce(size_of(style, "px"), size_of(style, "pt") * 1.333, size_of(style, "em|rem") * 16, size_of(style, "%") / 100 * 16)
    heavy = bold | style.rlike(r"font-weight\s*:\s*(bold|[7-9]\d{2})")
    return F.coalesce((px >= 24) | ((px >= 18.67) & heavy), F.lit(False))


def marker(text: Column) -> Column:
    """The kind of list marker that a line begins with, or null."""
    return (
        F.when(text.rlike(r"(?U)^\d+[.)]\s"), "numeric")
        .when(text.rlike(r"(?U)^[a-z][.)]\s"), "letter")
        .when(text.rlike(r"(?U)^[A-Z][.)]\s"), "upper_letter")
        .when(text.rlike(r"(?U)^(i{1,3}|iv|vi{0,3})[.)]\s"), "roman")
        .when(text.rlike(r"^[-*•]+"), "unordered")
    )


def wcag_url(criterion: Column) -> Column:
    """Where an issue's criterion is explained; empty without one."""
    own = F.coalesce(criterion, F.lit(""))
    return F.when(own == "", "").otherwise(F.concat(F.lit("https://www.w3.org/WAI/WCAG22/Understanding/#:~:text="), own))


def criterion_url(criterion: Column) -> Column:
    """The page of a criterion, as reports link to it."""
    return F.concat(F.lit("https://www.w3.org/WAI/WCAG22/Understanding/"), F.replace(criterion, F.lit("."), F.lit("")))


def scrubbed(text: Column) -> Column:
    """Folders before archive names, e-mail addresses, and home folders replaced by markers, in this order.

    Each pattern runs only over texts that hold what it can't do without.
    """
    low = F.lower(text)
    text = F.when(low.contains(".imscc"), F.regexp_replace(text, r"(?iU)(\S*/)?([^/\s\"']+\.imscc)", "<imscc-dir>/$2")).otherwise(text)
    text = F.when(low.contains("@"), F.regexp_replace(text, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "<email>")).otherwise(text)
    return F.when(low.contains("/users/") | low.contains("/home/"), F.regexp_replace(text, r"(?iU)/Users/[^/\s]+|/home/[^/\s]+", "<home>")).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_name(text: Column) -> Column:
    """Word characters and hyphens, spaces as underscores, at most 100."""
    return F.substring(F.regexp_replace(strip(F.regexp_replace(text, r"(?U)[^\w\s-]", "")), r"(?U)\s+", "_"), 1, 100)


def alt_confidence(alt: Column) -> Column:
    """How far a generated text is to be trusted, by its length and hedging words."""
    own = strip(F.coalesce(alt, F.lit("")))
    n = F.char_length(own)
    base = F.when(n < 8, 0.25).when(n > 250, 0.45).when(n.between(15, 120), 0.80).otherwise(0.75)
    hedged = contains_any(F.lower(own), ("unclear", "cannot determine", "i cannot", "unable to", "no image", "no visible", "decorative"))
    return F.when(hedged, F.least(base, F.lit(0.35))).otherwise(base)


#: The patterns of ``scrubbed`` and what takes their place, in order, for values inside documents.
_SCRUBS = (
    (re.compile(r"(\S*/)?([^/\s\"']+\.imscc)", re.IGNORECASE), r"<imscc-dir>/\2"),
    (re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), "<email>"),
    (re.compile(r"/Users/[^/\s]+|/home/[^/\s]+", re.IGNORECASE), "<home>"),
)


def _scrub_inside(value):
    if isinstance(value, str):
        for pattern, marker_ in _SCRUBS:
            value = pattern.sub(marker_, value)
        return value
    if isinstance(value, dict):
        return {k: _scrub_inside(v) for k, v in value.items()}
    return [_scrub_inside(v) for v in value] if isinstance(value, list) else value


def scrubbed_json(document: Column) -> Column:
    """A JSON document with every string value in it scrubbed, at any depth; names stay. What isn't JSON is scrubbed as a text."""

    @F.arrow_udf("string")
    def scrub(documents: pa.Array) -> pa.Array:
        out = []
        for d in documents.to_pylist():
            try:
                out.append(d if d is None else json.dumps(_scrub_inside(json.loads(d)), ensure_ascii=False))
            except ValueError:
                out.append(_scrub_inside(d))
        return pa.array(out, pa.string())

    return scrub(document)
