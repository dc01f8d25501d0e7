"""Documents that become pages, other formats of pages, and images that need texts.

Converters and image models are callables that the caller gives. They run in
the task that has the row; what fails becomes a skipped row, never a failed job.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import io
import re
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenpage.functions.text import file_name, slug
from lumenpage.operators.remediate import WRITABLE
from lumenpage.plans.report import html_escape
from lumenpage.sources.dom import Element, parse

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def writable(content_type: Column) -> Column:
    """(writable, reason): which kinds of pages may be written back."""
    ok = content_type.isin(*WRITABLE)
    return F.struct(ok.alias("writable"), F.when(~ok, F.concat(F.lit("pages of type "), content_type, F.lit(" are never written"))).alias("reason"))


# images


def image_sources(issues: DataFrame) -> DataFrame:
    """Images without texts, (page_id, src) once each, in the order of their first issue."""
    src = F.regexp_extract("element_html", r"""<img\b[^>]*?\bsrc=(?:"([^"]*)"|'([^']*)')""", 1)
    rows = issues.where("rule_id = 'IMG001'").select("page_id", "nid", html_unescape(src).alias("src")).where("src <> ''")
    return rows.groupBy("page_id", "src").agg(F.min("nid").alias("first")).select("page_id", "src", F.row_number().over(Window.partitionBy("page_id").orderBy("first", "src")).alias("place"))


def html_unescape(c: Column) -> Column:
    """The entities that an attribute of a serialized tree can have."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def alt_texts(images: DataFrame, model: Callable[[str, bytes], str | None]) -> DataFrame:
    """(src, alt) of ``model(src, content)`` for distinct images (src, content); those that fail have no row."""

    def run(batches):
        for batch in batches:
            made = []
            for src, content in zip(batch["src"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    alt = model(src, content)
                except Exception:
                    alt = None
                if alt:
                    made.append((src, alt))
            yield pa.RecordBatch.from_pydict({"src": pa.array([m[0] for m in made], pa.string()), "alt": pa.array([m[1] for m in made], pa.string())})

    return images.dropDuplicates(["src"]).select("src", "content").mapInArrow(run, "src string, alt string")


# converted documents


def unique_slugs(titles: DataFrame, key: str = "archive", taken: DataFrame | None = None) -> DataFrame:
    """A slug for each title, in order of resolved_path: with -2, -3 ... up to the first that no earlier title, and no file in ``taken`` (key, file name), has.

    An archive holds a bounded number of files, so its titles are one group.
    """
    base = F.coalesce(F.nullif(slug(F.col("title")), F.lit("")), F.lit("converted-document"))
    rows = titles.withColumn("_base", base)
    kind = StructType([*titles.schema.fields, StructField("slug", StringType())])

    def run(group: pa.Table, files: pa.Table) -> pa.Table:
        used = set(files["_file"].to_pylist())
        rank = sorted(range(group.num_rows), key=lambda k: (group["resolved_path"][k].as_py() is not None, group["resolved_path"][k].as_py()))
        slugs = [""] * group.num_rows
        for k in rank:
            own = group["_base"][k].as_py()
            n = 2
            found = own
            while f"wiki_content/{found}.html" in used:
                found, n = f"{own}-{n}", n + 1
            slugs[k] = found
            used.add(f"wiki_content/{found}.html")
        return group.drop_columns(["_base"]).append_column("slug", pa.array(slugs, pa.string()))

    files = titles.select(F.col(key).alias("_key"), F.lit(None).cast("string").alias("_file")).limit(0) if taken is None else taken.select(F.col(taken.columns[0]).alias("_key"), F.col(taken.columns[1]).alias("_file"))
    return rows.groupBy(key).cogroup(files.groupBy("_key")).applyInArrow(run, kind)


def stable_id(path: Column) -> Column:
    return F.concat(F.lit("clu_doc_"), F.substring(F.sha1(path.cast("binary")), 1, 24))


def wrapped(title: Column, body: Column, identifier: Column) -> Column:
    """A converted document as a page."""
    return F.concat(
        F.lit('<html>\n<head>\n<meta http-equiv="Content-Type" content="text/html; charset=utf-8"/>\n<title>'), html_escape(title), F.lit('</title>\n<meta name="identifier" content="'), identifier,
        F.lit('"/>\n<meta name="editing_roles" content="teachers"/>\n<meta name="workflow_state" content="active"/>\n</head>\n<body>\n'), body, F.lit("\n</body>\n</html>"),
    )


def converted(documents: DataFrame, converter: Callable[[str, bytes], str | None]) -> DataFrame:
    """Pages of documents (archive, resolved_path, title, content): html, or the reason why there is none."""

    def run(batches):
        for batch in batches:
            body, reason = [], []
            for path, content in zip(batch["resolved_path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                made = why = None
                if content is None:
                    why = "not in the archive"
                else:
                    try:
                        made = clean_converted(converter(path, content) or "")
                        why = None if made else "conversion failed: no text"
                    except Exception as e:
                        why = f"conversion failed: {type(e).__name__}"
                body.append(made or None)
                reason.append(why)
            yield pa.RecordBatch.from_arrays([batch["archive"], batch["resolved_path"], batch["title"], pa.array(body, pa.string()), pa.array(reason, pa.string())], ["archive", "resolved_path", "title", "body", "skip_reason"])

    rows = documents.select("archive", "resolved_path", "title", "content").mapInArrow(run, "archive string, resolved_path string, title string, body string, skip_reason string")
    rows = unique_slugs(rows).withColumn("identifier", stable_id(F.col("resolved_path")))
    path = F.when(F.col("body").isNotNull(), F.concat(F.lit("wiki_content/"), "slug", F.lit(".html")))
    return rows.select("archive", "resolved_path", "title", "identifier", path.alias("file_path"), F.when(F.col("body").isNotNull(), wrapped(F.col("title"), F.col("body"), F.col("identifier"))).alias("html"), "skip_reason")


def href_variants(href: Column) -> Column:
    """An address as it may stand in HTML."""
    return F.array_distinct(F.array(href, *(F.replace(href, F.lit("&"), F.lit(e)) for e in ("&amp;", "&#38;", "&#x26;"))))


def relinked(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages of an archive (archive, html, ...) with addresses (archive, href, target) replaced in href attributes.

    An archive's links are few and join its pages by key.
    """
    variant = links.select("archive", F.explode(href_variants(F.col("href"))).alias("old"), "target").groupBy("archive").agg(F.array_sort(F.collect_set(F.struct("old", "target"))).alias("_links"))
    joined = pages.join(variant, "archive", "left")

    def step(html: Column, link: Column) -> Column:
        for quote in ('"', "'"):
            html = F.replace(html, F.concat(F.lit(f"href={quote}"), link["old"], F.lit(quote)), F.concat(F.lit(f"href={quote}"), link["target"], F.lit(quote)))
        return html

    new = F.when(F.col("_links").isNull(), F.col("html")).otherwise(F.aggregate("_links", F.col("html"), step))
    return joined.withColumn("html", new).select(pages.columns)


def clean_converted(source: str) -> str:
    """A converter's output without fences, images without address, and headings that say nothing."""
    text = re.sub(r"^```(?:html)?\s*\n?|\n?```\s*$", "", source.strip()).strip("`").strip()
    if "<img" not in text and "<h" not in text:
        return text
    root = parse(text)
    for image in root.elements("img"):
        if not image.get("src").strip():
            if image.get("alt").strip():
                caption = Element("p")
                caption.append(Element("em")).set_text(image.get("alt").strip())
                image.replace(caption)
            else:
                image.remove()
    for heading in root.elements(*HEADINGS):
        if is_garbage(heading.text(" ")) and not any(i.get("alt").strip() for i in heading.elements("img")):
            heading.remove()
    return root.html()


def is_garbage(text: str) -> bool:
    """Under four characters, no letters, or a word of four letters and more, not in capitals, without vowels."""
    text = text.strip()
    if len(text) < 4 or not any(c.isalpha() for c in text):
        return True
    return any(len(re.sub("[^A-Za-z]", "", w)) >= 4 and w != w.upper() and not re.search("(?i)[aeiouy]", w) for w in text.split())


def plain_fallback(text: str, title: str = "") -> str:
    lines = [f"<p>{x.strip()}</p>" for x in text.split("\n") if x.strip()]
    return "\n".join(([f"<h2>{title}</h2>"] if title and lines else []) + lines)


# other formats


def in_shell(source: str | None, title: str = "") -> str:
    """The body of a page within a whole page, as a browser would show it."""
    body = re.search(r"(?is)<body[^>]*>(.*?)</body>", source or "")
    head = f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>{html_lib.escape(title or "Document")}</title>\n</head>\n'
    return f"{head}<body>\n{body[1] if body else source or ''}\n</body>\n</html>"


def plain_text(source: str | None, title: str = "") -> str:
    text = parse(source).text("\n\n")
    return f"{title}\n{'=' * len(title)}\n\n{text}" if title else text


def epub(source: str | None, title: str = "") -> bytes:
    """A page as a book of one chapter."""
    name = html_lib.escape(title or "Document")
    own = uuid.UUID(hashlib.md5((title + (source or "")).encode()).hexdigest())
    chapter = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="en"><head><title>{name}</title></head><body>{parse(source).html()}</body></html>'
    package = (
        f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">urn:uuid:{own}</dc:identifier><dc:title>{name}</dc:title><dc:language>en</dc:language></metadata><manifest><item id="c" href="chapter.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="c"/></spine></package>'
    )
    nav = f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{name}</title></head><body><nav epub:type="toc"><ol><li><a href="chapter.xhtml">{name}</a></li></ol></nav></body></html>'
    container = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        for path, text in (("META-INF/container.xml", container), ("OEBPS/content.opf", package), ("OEBPS/nav.xhtml", nav), ("OEBPS/chapter.xhtml", chapter)):
            z.writestr(path, text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


FORMATS = {"html": ("html", "text/html; charset=utf-8", lambda s, t: in_shell(s, t).encode()), "text": ("txt", "text/plain; charset=utf-8", lambda s, t: plain_text(s, t).encode()), "epub": ("epub", "application/epub+zip", epub)}


def exported(pages: DataFrame, kind: str) -> DataFrame:
    """(page_id, filename, content_type, content) of pages in another format."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; there are {', '.join(FORMATS)}")
    ending, media, make = FORMATS[kind]

    def run(batches):
        for batch in batches:
            made = [make(s, t or "") for s, t in zip(batch["html"].to_pylist(), batch["title"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["filename"], pa.array(made, pa.binary())], ["page_id", "filename", "content"])

    named = F.concat(F.coalesce(F.nullif(file_name(F.coalesce("title", F.lit(""))), F.lit("")), F.lit("document")), F.lit(f".{ending}"))
    rows = pages.select("page_id", "title", "html", named.alias("filename")).mapInArrow(run, "page_id string, filename string, content binary")
    return rows.select("page_id", "filename", F.lit(media).alias("content_type"), "content")
