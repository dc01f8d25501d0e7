"""Links to documents, layouts of converted documents, structure of modules, and rendered-scan results, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenpage.functions.text import is_blank, strip

# Extensions of the inventory and of the flat scan, and the marker of packaged files.
INVENTORY_EXTENSIONS = ("pdf", "docx", "doc", "pptx", "ppt")
SCAN_EXTENSIONS = (".pdf", ".docx", ".pptx", ".xlsx", ".doc", ".ppt", ".xls")
FILEBASE = "$IMS-CC-FILEBASE$"


def unquoted(c: Column) -> Column:
    """Percent escapes decoded; a plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _path(href: Column) -> Column:
    """The path of an address, absolute or relative."""
    bare = F.regexp_replace(href, r"[?#].*$", "")
    return F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?", "")


def scheme(href: Column) -> Column:
    return F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(href: Column) -> Column:
    return F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def extension(href: Column) -> Column:
    path = unquoted(_path(href))
    return F.when(path.contains("."), strip(F.lower(F.element_at(F.split(path, r"\."), -1)))).otherwise("")


def is_external(href: Column) -> Column:
    return scheme(href).isin("http", "https", "ftp", "mailto")


def link_inventory(elements: DataFrame, extensions: tuple[str, ...] = INVENTORY_EXTENSIONS) -> DataFrame:
    """Documents that pages link to: packaged files by path first, then external addresses; hrefs and pages in order, the longest text."""
    href = F.col("attrs")["href"]
    title = strip(F.coalesce(F.try_element_at("attrs", F.lit("title")), F.lit("")))
    links = elements.where("tag = 'a'").select("course_id", "page_id", "nid", href.alias("href"), F.when(title != "", title).otherwise(F.col("text")).alias("shown")).where("href <> ''")
    links = links.withColumn("extension", extension(F.col("href"))).where(F.col("extension").isin(*extensions)).withColumn("is_external", is_external(F.col("href")))
    after = F.regexp_replace(F.element_at(F.split("href", F.lit(r"\$IMS-CC-FILEBASE\$"), 2), -1), "^/", "")
    resolved = F.when(~F.col("is_external") & F.col("href").contains(FILEBASE), F.concat(F.lit("web_resources/"), unquoted(_path(after))))
    outer = F.concat(scheme(F.col("href")), F.lit("://"), host(F.col("href")), unquoted(_path(F.col("href"))))
    keyed = links.withColumn("resolved_path", resolved).withColumn("key", F.when(F.col("is_external"), outer).otherwise(resolved)).where("key IS NOT NULL")
    first = F.struct("page_id", "nid")
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "nid", c))), lambda x: x[c]))
    return keyed.groupBy("course_id", "is_external", "key").agg(
        F.min("resolved_path").alias("resolved_path"), F.min_by("extension", first).alias("extension"), ordered("href").alias("original_hrefs"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["page_id"])).alias("source_page_ids"), F.max_by("shown", F.struct(F.char_length("shown"), -F.col("nid"))).alias("display_text"),
    )


def document_links(elements: DataFrame, domain: str = "") -> DataFrame:
    """The flat scan: one row per link to a document."""
    href = F.col("attrs")["href"]
    links = elements.where("tag = 'a'").select("course_id", "page_id", "title", href.alias("url")).where("url IS NOT NULL")
    path = F.lower(_path(F.col("url")))
    ext = F.when(path.contains("."), F.concat(F.lit("."), F.element_at(F.split(path, r"\."), -1))).otherwise("")
    outside = host(F.col("url")) != ""
    if domain:
        outside = outside & ~host(F.col("url")).contains(domain)
    return links.select("course_id", "page_id", "title", "url", F.element_at(F.split(path, "/"), -1).alias("filename"), ext.alias("extension"), outside.alias("is_external")).where(F.col("extension").isin(*SCAN_EXTENSIONS))


def heading_map(items: DataFrame, key: str = "doc") -> DataFrame:
    """Per document: the body size (most text) and heading levels of the five next larger sizes. ``items`` has font_size and text."""
    sized = items.where("font_size IS NOT NULL").groupBy(key, (F.bround(F.col("font_size") * 2) / 2).alias("size")).agg(F.sum(F.char_length("text")).alias("weight"))
    body = sized.groupBy(key).agg(F.max_by("size", F.struct("weight", -F.col("size"))).alias("body_size"))
    larger = sized.join(body, key).where("size > body_size")
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("size")))
    return larger.select(key, "body_size", "size", (rank + 1).alias("level")).where("level <= 6")


def reading_order(items: DataFrame, headings: DataFrame, key: str = "doc", tolerance: float = 1.0) -> DataFrame:
    """Text of each page in reading order, with [Hn] before items in a heading's size."""
    levels = headings.groupBy(key).agg(F.collect_list(F.struct("size", "level")).alias("levels"))
    joined = items.join(levels, key, "left")
    near = F.try_element_at(F.array_sort(F.transform(F.filter("levels", lambda h: F.abs(h["size"] - F.col("font_size")) <= tolerance), lambda h: F.struct(F.abs(h["size"] - F.col("font_size")).alias("d"), h["level"].alias("level")))), F.lit(1))["level"]
    said = F.concat(F.coalesce(F.concat(F.lit("[H"), near.cast("string"), F.lit("] ")), F.lit("")), "text")
    row = F.struct((F.bround(F.col("y") / 5) * 5).alias("line"), "x", said.alias("said"))
    return joined.groupBy(key, "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["said"]), "\n").alias("text"))


def chapters(pages: DataFrame, key: str = "doc", least: int = 2, most: int = 30, fixed: int = 20) -> DataFrame:
    """Chapter of each page (doc, page_num, starts): runs from one start to the next; with too few or too many starts, every ``fixed`` pages.

    Pages before the first start are chapter 0.
    """
    order = Window.partitionBy(key).orderBy("page_num")
    counted = pages.withColumn("starts_total", F.sum(F.col("starts").cast("int")).over(Window.partitionBy(key))).withColumn("n", F.row_number().over(order) - 1)
    running = F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    even = F.floor(F.col("n") / fixed) + 1
    return counted.withColumn("chapter", F.when(F.col("starts_total").between(least, most), running).otherwise(even)).select(key, "page_num", F.col("chapter").cast("int").alias("chapter"))


def word_chunks(text: Column, limit: int = 3000) -> Column:
    """Chunks of whole lines with at most ``limit`` words (a longer line is a chunk of its own)."""
    words = lambda line: F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("own"), F.lit(0).alias("n"))

    def add(state: Column, line: Column) -> Column:
        over = (state["n"] > 0) & (state["n"] + words(line) > limit)
        return F.struct(
            F.when(over, F.concat(state["done"], F.array(state["own"]))).otherwise(state["done"]).alias("done"),
            F.when(over, F.array(line)).otherwise(F.concat(state["own"], F.array(line))).alias("own"),
            F.when(over, words(line)).otherwise(state["n"] + words(line)).alias("n"),
        )

    end = lambda s: F.transform(F.filter(F.concat(s["done"], F.array(s["own"])), lambda c: F.size(c) > 0), lambda c: F.array_join(c, "\n"))
    return F.aggregate(F.split(text, "\n"), start, add, end)


def garbage_heading(text: Column) -> Column:
    """Under four characters, without letters, or with a word of four letters and more, not in capitals, that has no vowel."""
    own = strip(text)
    words = F.filter(F.split(own, r"(?U)\s+"), lambda w: (F.char_length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 4) & (F.upper(w) != w) & ~w.rlike("(?i)[aeiouy]"))
    return (F.char_length(own) < 4) | ~own.rlike(r"(?U)\p{L}") | (F.size(words) > 0)


def repaired_levels(headings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Heading levels that never skip: each at most one below the one before, starting below 1.

    With places i = 1, 2, ... the repaired level is i + min(1, least of level - i so far), so a running minimum does.
    """
    by = Window.partitionBy(*key).orderBy(*order)
    placed = headings.withColumn("_i", F.row_number().over(by))
    low = F.min(F.col("level") - F.col("_i")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("repaired", (F.col("_i") + F.least(F.lit(1), low)).cast("int")).drop("_i")


def structure_issues(modules: DataFrame, rubrics: DataFrame | None = None) -> DataFrame:
    """Quality of modules (name, items of title and position) and rubrics (title, data of description)."""
    name, items = F.col("name"), F.col("items")
    row = lambda category, severity, message, location: F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), message.alias("message"), location.alias("location"))
    at = F.concat(F.lit("Module: "), name)
    empty = F.when(F.size(F.coalesce(items, F.array().cast(modules.schema["items"].dataType))) <= 0, F.array(row("modules", "warning", F.concat(F.lit("Module '"), name, F.lit("' has no items")), at)))
    untitled = F.transform(F.filter(items, lambda i: is_blank(i["title"])), lambda i: row("modules", "error", F.lit("Module item has no title"), F.concat(at, F.lit(", Position: "), F.coalesce(i["position"].cast("string"), F.lit("?")))))
    places = F.transform(items, lambda i: F.coalesce(i["position"], F.lit(0)))
    unordered = F.when(places != F.array_sort(places), F.array(row("navigation", "warning", F.concat(F.lit("Module '"), name, F.lit("' has non-sequential item positions")), at)))
    kind = "array<struct<category:string,severity:string,message:string,location:string>>"
    parts = F.concat(*(F.coalesce(p.cast(kind), F.array().cast(kind)) for p in (empty, untitled, unordered)))
    out = modules.select(F.inline(parts))
    if rubrics is not None:
        said = lambda _: row("rubrics", "warning", F.concat(F.lit("Rubric criterion has no description in '"), F.col("title"), F.lit("'")), F.concat(F.lit("Rubric: "), F.col("title")))
        out = out.union(rubrics.select(F.inline(F.transform(F.filter("data", lambda d: is_blank(d["description"])), said).cast(kind))))
    return out


def structure_score(found: DataFrame) -> DataFrame:
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return found.agg(errors.alias("errors"), warnings.alias("warnings"), F.greatest(F.lit(0.0), 100.0 - 10 * errors - 3 * warnings).alias("score"))


# Rules, severities and places of a rendered scan's results.
RENDERED_RULES = {
    "image-alt": "IMG001", "input-image-alt": "IMG001", "area-alt": "IMG001", "image-redundant-alt": "IMG003", "role-img-alt": "IMG001", "empty-heading": "HDG003",
    "heading-order": "HDG002", "page-has-heading-one": "HDG005", "td-headers-attr": "TBL001", "th-has-data-cells": "TBL004", "empty-table-header": "TBL004",
    "table-fake-caption": "TBL003", "scope-attr-valid": "TBL002", "link-name": "LNK003", "link-in-text-block": "LNK001", "color-contrast": "CLR001",
    "color-contrast-enhanced": "CLR001", "button-name": "BTN001", "label": "FORM002", "select-name": "FORM008", "input-button-name": "BTN001",
    "form-field-multiple-labels": "FORM004", "label-title-only": "FORM009", "fieldset": "FORM006", "marquee": "STR002", "blink": "STR002", "html-has-lang": "LANG001",
    "html-lang-valid": "LANG001", "document-title": "PAGE001", "bypass": "NAV001", "meta-refresh": "NAV002", "aria-valid-attr": "ARIA001",
    "aria-valid-attr-value": "ARIA001", "aria-allowed-attr": "ARIA001", "aria-required-attr": "ARIA001", "aria-roles": "ARIA001", "autocomplete-valid": "AUTH001",
    "video-caption": "MDA001", "audio-caption": "MDA001", "frame-title": "MDA002", "tabindex": "FOC001", "focus-order-semantics": "FOC001",
}
IMPACTS = {"critical": "error", "serious": "error", "moderate": "warning", "minor": "info"}
PREFIXES = {
    "IMG": "images", "HDG": "headings", "TBL": "tables", "LNK": "links", "CLR": "contrast", "BTN": "structure", "FORM": "forms", "STR": "structure", "LANG": "structure",
    "PAGE": "structure", "NAV": "structure", "ARIA": "structure", "MDA": "media", "FOC": "focus",
}
PLATFORM = (
    "#header", "#nav", ".ic-app-header", ".ic-app-nav-toggle-and-crumbs", "#breadcrumbs", "#footer", ".navigation-tray", "#left-side", ".course-menu",
    "#right-side-wrapper", "#flash_message_holder", "#global_nav_tray_container", ".ic-Layout-watermark", "#skip_navigation_link",
)
CONTENT = ("#content", ".user_content", ".ic-Layout-contentMain", ".show-content")
VIOLATION = (
    "struct<id:string,impact:string,help:string,description:string,tags:array<string>,nodes:array<struct<target:array<string>,html:string,"
    "any:array<struct<data:struct<fgColor:string,bgColor:string,contrastRatio:double,expectedContrastRatio:string,fontSize:string,fontWeight:string>>>>>>"
)


def rendered_issues(violations: DataFrame) -> DataFrame:
    """Issues from (course_id, page_id, page_url, violation as JSON): one for each node."""
    v = F.col("v")
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    parsed = violations.withColumn("v", F.from_json("violation", VIOLATION))
    rule = F.coalesce(F.try_element_at(table(RENDERED_RULES), v["id"]), F.concat(F.lit("AXE_"), F.upper(F.replace(v["id"], F.lit("-"), F.lit("_")))))
    parsed = parsed.withColumn("rule_id", rule)
    category = F.coalesce(*(F.when(F.col("rule_id").startswith(p), c) for p, c in PREFIXES.items()), F.lit("structure"))
    digits = F.try_element_at(F.filter(F.transform(v["tags"], lambda t: F.replace(t, F.lit("wcag"), F.lit(""))), lambda t: t.rlike(r"^\d{3,}$")), F.lit(1))
    criterion = F.coalesce(F.concat_ws(".", F.substring(digits, 1, 1), F.substring(digits, 2, 1), F.substring(digits, F.lit(3), F.char_length(digits))), F.lit(""))
    node = F.col("node")
    verdict = lambda t: F.when(_holds(t, CONTENT), F.lit("course_content")).when(_holds(t, PLATFORM), F.lit("canvas_platform"))
    source = F.coalesce(F.try_element_at(F.filter(F.transform(node["target"], verdict), lambda s: s.isNotNull()), F.lit(1)), F.lit("canvas_platform"))
    data = F.try_element_at(F.filter(F.transform(node["any"], lambda a: a["data"]), lambda d: d["fgColor"].isNotNull() & d["bgColor"].isNotNull()), F.lit(1))
    meta = F.when(v["id"].isin("color-contrast", "color-contrast-enhanced") & data.isNotNull(), F.struct(
        data["fgColor"].alias("fg_color"), data["bgColor"].alias("bg_color"), data["contrastRatio"].alias("contrast_ratio"), data["expectedContrastRatio"].alias("expected_ratio"),
        data["fontSize"].alias("font_size"), data["fontWeight"].alias("font_weight"), F.try_element_at(node["target"], F.lit(1)).alias("target")))
    rows = parsed.select("*", F.posexplode(v["nodes"]).alias("n", "node"))
    return rows.select(
        F.concat_ws("_", "rule_id", "page_id", F.col("n").cast("string")).alias("id"), "course_id", "rule_id", F.coalesce(F.try_element_at(table(IMPACTS), F.coalesce(v["impact"], F.lit("moderate"))), F.lit("warning")).alias("severity"),
        category.alias("category"), F.when(digits.isNull(), "").otherwise(criterion).alias("wcag_criterion"), F.coalesce(F.nullif(v["help"], F.lit("")), v["description"], F.lit("")).alias("message"), "page_id",
        F.col("page_url").alias("canvas_url"), F.substring(node["html"], 1, 200).alias("element_html"), (source == "course_content").alias("can_auto_fix"), source.alias("source"), meta.alias("axe_meta"),
    )


def _holds(c: Column, parts: tuple[str, ...]) -> Column:
    out = c.contains(parts[0])
    for p in parts[1:]:
        out = out | c.contains(p)
    return out
