"""What models are asked, as columns: one prompt for each row, made where the row is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of surrounding text that a prompt quotes, for headings and for links.
HEADING_CHARS, LINK_CHARS = 500, 300


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _head(text: Column, chars: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, chars)


def for_alt_text(context: Column) -> Column:
    """Asks for an alternative text of an image; a context is named if there is one."""
    where = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("The image stands in "), context, F.lit("; use that only where it makes the image clearer.")))
    return _lines(
        "Say what can be seen in this image, in fewer than 100 characters.", "Name the visible things, and the subject taught if it can be seen; leave the page's own words out.",
        "Don't begin with words like image, photo or picture. Give the text alone, without quotes.", where,
    )


def for_choice(candidates: Column, context: Column) -> Column:
    """Asks which of some alternative texts (an array of structs) is best, as JSON."""
    return _lines(
        "Choose the best alternative text: short, plain and exact. Leave out any that are vague or look like file names.", "Answer with JSON alone; its keys are text, model and confidence (0.0 to 1.0).",
        F.concat(F.lit("Context: "), F.coalesce(F.nullif(context, F.lit("")), F.lit("none"))), F.concat(F.lit("Candidates: "), F.to_json(candidates)),
    )


def for_heading(text: Column, level: int = 2) -> Column:
    """Asks for a heading of the section that a text begins."""
    return _lines(f"Write a heading (H{level}) for this section: at most 60 characters, in plain words, on what it is about. Give the heading alone, without quotes.", F.concat(F.lit("Section: "), _head(text, HEADING_CHARS)))


def for_link(link_text: Column, href: Column, around: Column) -> Column:
    """Asks for a link's text that says where it leads."""
    return _lines(
        "Rewrite this link's text so that it says where the link leads: at most 60 characters, no phrases like click here or read more. Give the text alone.",
        F.concat(F.lit("Text: "), link_text), F.concat(F.lit("Address: "), F.coalesce(href, F.lit(""))), F.concat(F.lit("Around it: "), _head(around, LINK_CHARS)),
    )


def for_document(structured: Column, heading_map: Column, page: Column, pages: Column) -> Column:
    """Asks for accessible HTML of a page of a document, whose lines may begin with a heading level in brackets; pages count from 0."""
    place = F.when(pages > 1, F.concat(F.lit("Page "), (page + 1).cast("string"), F.lit(" of "), pages.cast("string"), F.lit("."))).otherwise("A document of one page.")
    sizes = F.when(F.coalesce(heading_map, F.lit("")) != "", F.concat(F.lit("Font sizes and heading levels:\n"), heading_map))
    return _lines(place, sizes, "Turn the text below into accessible HTML. [H2] to [H6] before a line is its heading level; other lines are body text. Keep the order, add no styles, and give the fragment alone.", structured)
