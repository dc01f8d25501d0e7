"""Colours of single values, for rewriting trees; the column forms are in ``text``."""

from __future__ import annotations

import re

from lumenpage.functions.text import COLORS

RGB = tuple[int, int, int]


def of_style(style: str, name: str) -> str | None:
    edge = r"(?<![a-zA-Z-])" if name == "color" else ""
    if m := re.search(rf"{edge}{name}\s*:\s*(#[0-9A-Fa-f]{{3,6}})", style):
        return m[1]
    if m := re.search(rf"{edge}{name}\s*:\s*rgb\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", style):
        return "#" + "".join(f"{int(x):02x}" for x in m.groups())
    m = re.search(rf"{edge}{name}\s*:\s*([a-zA-Z]+)", style)
    return COLORS.get(m[1].lower()) if m else None


def rgb(color: str | None) -> RGB | None:
    digits = (color or "").lstrip("#")
    digits = "".join(c * 2 for c in digits) if len(digits) == 3 else digits
    return tuple(bytes.fromhex(digits)) if re.fullmatch("[0-9A-Fa-f]{6}", digits) else None


def hexed(color: RGB) -> str:
    return "#" + bytes(color).hex()


def luminance(color: RGB) -> float:
    linear = [c / 255 / 12.92 if c / 255 <= 0.03928 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in color]
    return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]


def contrast(a: RGB, b: RGB) -> float:
    x, y = sorted((luminance(a), luminance(b)))
    return (y + 0.05) / (x + 0.05)


def adjusted(moved: RGB, fixed: RGB, target: float, foreground: bool = True) -> RGB:
    """``moved`` shifted toward black or white, just so far that the contrast is reached; else wholly."""
    if contrast(moved, fixed) >= target:
        return moved
    dark = luminance(fixed) > 0.18 if foreground else luminance(fixed) >= 0.18
    end = 0 if dark else 255
    at = lambda share: tuple(int(c + (end - c) * share) for c in moved)
    low, high = 0.0, 1.0
    for _ in range(30):
        mid = (low + high) / 2
        low, high = (low, mid) if contrast(at(mid), fixed) >= target else (mid, high)
    return at(high)


def large(style: str, bold: bool) -> bool:
    for unit, factor in (("px", 1), ("pt", 1.333), ("(?:em|rem)", 16), ("%", 0.16)):
        if m := re.search(rf"font-size\s*:\s*([\d.]+)\s*{unit}", style):
            size = float(m[1]) * factor
            return size >= 24 or (size >= 18.67 and (bold or bool(re.search(r"font-weight\s*:\s*(bold|[7-9]\d{2})", style))))
    return False
