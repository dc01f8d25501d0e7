"""Packaged courses: a zip archive with a manifest, pages and other members.

Archives are read as binary files, one row each, and opened within the task
that has the row; pages and members leave it as rows. Limits are checked before
anything is unpacked, and an archive that breaks one becomes an error row.
"""

from __future__ import annotations

import html as html_lib
import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Limits of archives, and the fixed place of the syllabus.
MAX_TOTAL, MAX_MEMBERS, MAX_MEMBER, MAX_RATIO, CHUNK = 5 << 30, 50_000, 1 << 30, 300, 1 << 20
SYLLABUS = "course_settings/syllabus.html"
PAGES = "archive string, identifier string, title string, content_type string, file_path string, html string, error string"
RESOURCES = "archive string, identifier string, type string, href string, files array<string>"
MEMBERS = "archive string, path string, size long, compressed long"


class UnsafeArchive(ValueError):
    """An archive breaks a limit."""


def check_limits(members: list[tuple[str, int, int]]) -> None:
    """Members (path, size, compressed size) must be few and small, and may not be packed too tightly."""
    if len(members) > MAX_MEMBERS:
        raise UnsafeArchive(f"{len(members)} members")
    if (total := sum(m[1] for m in members)) > MAX_TOTAL:
        raise UnsafeArchive(f"{total} bytes in all")
    for path, size, packed in members:
        if size > MAX_MEMBER or (packed > 0 and size / packed > MAX_RATIO):
            raise UnsafeArchive(f"{path}: {size} bytes from {packed}")


def read_member(archive: zipfile.ZipFile, path: str, limit: int = MAX_MEMBER) -> bytes:
    """A member, read in chunks; a header that understates its size doesn't help it past the limit."""
    out = bytearray()
    with archive.open(path) as source:
        while chunk := source.read(CHUNK):
            out += chunk
            if len(out) > limit:
                raise UnsafeArchive(f"{path}: more than {limit} bytes")
    return bytes(out)


@dataclass
class Course:
    title: str = "Untitled Course"
    version: str = "1.1.0"
    resources: list[dict] = field(default_factory=list)
    pages: list[dict] = field(default_factory=list)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _find(node, *path: str):
    for name in path:
        node = next((c for c in (node if node is not None else ()) if _local(c.tag) == name), None)
    return node


def title_of(source: str, fallback: str) -> str:
    found = re.search(r"<title>(.*?)</title>", source, re.DOTALL)
    return (html_lib.unescape(found[1]).strip() if found else "") or fallback


def content_type(href: str, files: list[str]) -> str:
    if href == SYLLABUS:
        return "syllabus"
    if href.startswith("wiki_content/"):
        return "wiki_page"
    return "assignment" if any(f.endswith("assignment_settings.xml") for f in files) else "wiki_page"


def discussion_html(source: bytes) -> str:
    node = next((e for e in ElementTree.fromstring(source).iter() if _local(e.tag) == "text"), None)
    return (node.text or "") if node is not None else ""


def quiz_html(source: bytes) -> str:
    texts = [e.text for e in ElementTree.fromstring(source).iter() if _local(e.tag) == "mattext" and (e.text or "").strip()]
    return "\n".join(f'<div data-quiz-mattext-index="{k}">{t}</div>' for k, t in enumerate(texts))


def parse(content: bytes) -> Course:
    """A course of an archive's bytes: its syllabus first, then pages by resource; each file once."""
    course = Course()
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        check_limits([(i.filename, i.file_size, i.compress_size) for i in archive.infolist()])
        names = set(archive.namelist())
        root = ElementTree.fromstring(read_member(archive, "imsmanifest.xml"))
        metadata = _find(root, "metadata")
        version = _find(metadata, "schemaversion")
        course.version = (version.text or "").strip() or course.version if version is not None else course.version
        title = _find(metadata, "lom", "general", "title", "string")
        course.title = (title.text or "").strip() or course.title if title is not None else course.title
        for r in (e for e in root.iter() if _local(e.tag) == "resource"):
            files = [f.get("href") for f in r if _local(f.tag) == "file" and f.get("href")]
            course.resources.append({"identifier": r.get("identifier") or "", "type": r.get("type") or "", "href": r.get("href") or (files[0] if files else ""), "files": files})
        seen: set[str] = set()

        def add(path: str, identifier: str, kind: str, made: str) -> None:
            if path not in seen:
                seen.add(path)
                course.pages.append({"identifier": identifier, "title": title_of(made, path.rpartition("/")[2].rpartition(".")[0] or path), "content_type": kind, "file_path": path, "html": made})

        if SYLLABUS in names:
            add(SYLLABUS, "syllabus", "syllabus", read_member(archive, SYLLABUS).decode("utf-8", "replace"))
        for r in course.resources:
            kind = r["type"]
            path = next((p for p in (r["href"], *r["files"]) if p in names), None)
            if path is None:
                continue
            if "imsdt" in kind:
                xml = next((p for p in (r["href"], *r["files"]) if p in names and p.endswith(".xml")), path)
                add(xml, r["identifier"], "discussion", discussion_html(read_member(archive, xml)))
            elif "imsqti" in kind:
                xml = next((p for p in (r["href"], *r["files"]) if p in names and p.endswith(".xml")), path)
                add(xml, r["identifier"], "quiz", quiz_html(read_member(archive, xml)))
            else:
                page = next((p for p in (r["href"], *r["files"]) if p in names and p.endswith((".html", ".htm"))), None)
                if page:
                    add(page, r["identifier"], content_type(page, r["files"]), read_member(archive, page).decode("utf-8", "replace"))
    return course


def archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows (archive, content) of all archives under a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def _opened(rows, columns: list[str]):
    """Run per archive: rows of ``columns`` that a function makes of a course, or one with the error."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["archive"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    made = [{"archive": name, "error": None} | r for r in rows(parse(content))]
                except (UnsafeArchive, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    made = [{"archive": name, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pydict({c: [r.get(c) for r in made] for c in columns})

    return run


def pages(source: DataFrame) -> DataFrame:
    """Pages of archives; an archive that can't be read is one row with its error."""
    columns = [c.split()[0] for c in PAGES.split(", ")]
    return source.mapInArrow(_typed(_opened(lambda c: c.pages, columns), columns), PAGES)


def courses(source: DataFrame) -> DataFrame:
    columns = ["archive", "title", "version", "error"]
    return source.mapInArrow(_typed(_opened(lambda c: [{"title": c.title, "version": c.version}], columns), columns), "archive string, title string, version string, error string")


def resources(source: DataFrame) -> DataFrame:
    columns = ["archive", "identifier", "type", "href", "files"]

    def run(batches):
        for batch in _opened(lambda c: c.resources, columns)(batches):
            table = pa.Table.from_batches([batch])
            files = table["files"].cast(pa.list_(pa.string())) if table.num_rows else table["files"]
            yield from table.set_column(4, "files", files).to_batches()

    return source.mapInArrow(run, RESOURCES)


def _typed(run, columns: list[str]):
    """Columns of nulls alone become strings."""

    def typed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([batch[c].cast(pa.string()) for c in columns], columns)

    return typed


def members(source: DataFrame) -> DataFrame:
    """The central directory: (archive, path, size, compressed)."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["archive"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    own = z.infolist()
                yield pa.RecordBatch.from_pydict({"archive": pa.array([name] * len(own), pa.string()), "path": pa.array([i.filename for i in own], pa.string()), "size": pa.array([i.file_size for i in own], pa.int64()), "compressed": pa.array([i.compress_size for i in own], pa.int64())})

    return source.mapInArrow(run, MEMBERS)


def unsafe(rows: DataFrame) -> DataFrame:
    """Archives that break a limit, by their members alone."""
    tight = (F.col("compressed") > 0) & (F.col("size") / F.col("compressed") > MAX_RATIO)
    counts = rows.groupBy("archive").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.max(tight).alias("tight"))
    return counts.where((F.col("members") > MAX_MEMBERS) | (F.col("bytes") > MAX_TOTAL) | (F.col("largest") > MAX_MEMBER) | F.col("tight"))


def first_of_each(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Pages once per file path, the first by ``order``."""
    by = Window.partitionBy("archive", "file_path").orderBy(order)
    return rows.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def image_member(src: Column) -> Column:
    """The member that an image's address means, or null for other schemes."""
    outer = F.lower(src).rlike(r"^(https?|ftp|mailto|data):") | src.startswith("//")
    bare = F.regexp_replace(src, r"[?#].*$", "")
    inner = F.when(bare.contains("$IMS-CC-FILEBASE$"), F.concat(F.lit("web_resources/"), F.regexp_replace(F.element_at(F.split(bare, r"\$IMS-CC-FILEBASE\$"), -1), "^/", "")))
    decoded = F.coalesce(F.try_url_decode(F.replace(F.coalesce(inner, F.regexp_replace(bare, r"^(\.\./|/)+", "")), F.lit("+"), F.lit("%2B"))), bare)
    return F.when(~outer & (bare != ""), decoded)


def splice_discussion(xml: str, new_html: str) -> str:
    """Discussion XML with its text element replaced."""
    return re.sub(r"(<text[^>]*>)(.*?)(</text>)", lambda m: m[1] + html_lib.escape(new_html, quote=False) + m[3], xml, count=1, flags=re.DOTALL)


def rebuild(content: bytes, overrides: dict[str, bytes], added: dict[str, bytes] | None = None) -> bytes:
    """An archive with some members replaced and others added; the rest is copied as it is.

    A replacement of what isn't there, and an addition of what is, are refused.
    """
    out = io.BytesIO()
    added = added or {}
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        names = set(old.namelist())
        if missing := sorted(set(overrides) - names):
            raise KeyError(f"not in the archive: {missing}")
        if twice := sorted(set(added) & names):
            raise KeyError(f"already in the archive: {twice}")
        for info in old.infolist():
            new.writestr(info, overrides.get(info.filename, read_member(old, info.filename)))
        for path, data in added.items():
            new.writestr(path, data)
    return out.getvalue()


def register(manifest: str, documents: list[tuple[str, str]]) -> str:
    """A manifest with a resource for each converted document (identifier, path)."""
    lines = "".join(f'<resource identifier="{html_lib.escape(i)}" type="webcontent" href="{html_lib.escape(p)}"><file href="{html_lib.escape(p)}"/></resource>' for i, p in documents)
    return manifest.replace("</resources>", f"{lines}</resources>", 1)


def rewritten(source: DataFrame, changed: DataFrame) -> DataFrame:
    """Archives (archive, content) with the pages of ``changed`` (archive, file_path, content_type, html) written back, and the file paths that were refused.

    Pages join their archive by its key; quizzes can't be written back and are refused, discussions are spliced into their XML.
    """
    rows = changed.groupBy("archive").agg(F.collect_list(F.struct("file_path", "content_type", "html")).alias("pages"))
    joined = source.join(rows, "archive", "left")

    def run(batches):
        for batch in batches:
            out, refused = [], []
            for r in batch.to_pylist():
                overrides = {}
                refused.append(sorted(p["file_path"] for p in r["pages"] or () if p["content_type"] == "quiz"))
                for p in r["pages"] or ():
                    if p["content_type"] == "discussion":
                        with zipfile.ZipFile(io.BytesIO(r["content"])) as z:
                            overrides[p["file_path"]] = splice_discussion(z.read(p["file_path"]).decode("utf-8", "replace"), p["html"]).encode()
                    elif p["content_type"] != "quiz":
                        overrides[p["file_path"]] = p["html"].encode()
                out.append(rebuild(r["content"], overrides))
            yield pa.RecordBatch.from_arrays([batch["archive"], pa.array(out, pa.binary()), pa.array(refused, pa.list_(pa.string()))], ["archive", "content", "refused"])

    return joined.mapInArrow(run, "archive string, content binary, refused array<string>")
