"""Suggestions: proposed changes that a person may accept. Models are callables that the caller gives; none is ever called over a network."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpage.functions import text as T
from lumenpage.sources.dom import Element, parse, set_style
from lumenpage.sources.elements import cut

#: Rules that have suggestions, and contrast that they aim at.
TARGETS = ("CLR001", "LNK004", "IMG001", "FORM003", "TBL003")
NORMAL, LARGE = 4.5, 3.0


def targets(issues: DataFrame) -> DataFrame:
    """Residual issues that suggestions are made for; contrast only where rendered colours are known."""
    return issues.where(F.col("rule_id").isin(*TARGETS) & ((F.col("rule_id") != "CLR001") | F.col("axe_meta").isNotNull()))


def normal_color(c: Column) -> Column:
    """#rrggbb of #rgb, #rrggbb, rgb() or rgba(), else null."""
    rgb = r"(?i)^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    part = lambda k: F.lpad(F.lower(F.hex(F.regexp_extract(c, rgb, k).try_cast("int"))), 2, "0")
    return (
        F.when(c.rlike("(?i)^#[0-9a-f]{6}$"), F.lower(c))
        .when(c.rlike("(?i)^#[0-9a-f]{3}$"), F.lower(F.regexp_replace(c, "([0-9A-Fa-f])", "$1$1")))
        .when(c.rlike(rgb), F.concat(F.lit("#"), part(1), part(2), part(3)))
    )


def contrast_suggestions(issues: DataFrame) -> DataFrame:
    """New text colours for issues with rendered colours, by arithmetic alone."""
    meta = F.col("axe_meta")
    rows = targets(issues).where("rule_id = 'CLR001'").withColumns({"fg": normal_color(meta["fg_color"]), "bg": normal_color(meta["bg_color"])}).where("fg IS NOT NULL AND bg IS NOT NULL")
    rows = rows.withColumns({"fg_rgb": T.rgb_of(F.col("fg")), "bg_rgb": T.rgb_of(F.col("bg"))})
    size = F.regexp_extract(F.coalesce(meta["font_size"], F.lit("")), r"([\d.]+)px", 1).try_cast("double")
    large = F.coalesce((size >= 24) | ((size >= 18.67) & meta["font_weight"].isin("bold", "700", "800", "900")), F.lit(False))
    new = T.adjusted(F.col("fg_rgb"), F.col("bg_rgb"), F.when(large, LARGE).otherwise(NORMAL))
    rows = rows.withColumn("new", new)
    hexed = F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(F.col("new")[c])), 2, "0") for c in "rgb"))
    return rows.select(
        F.sha2(F.concat_ws("|", "id", F.lit("suggestion")), 256).alias("id"), F.col("id").alias("issue_id"), "page_id", "rule_id", "category", F.col("element_html").alias("original_html"),
        F.col("fg").alias("original_text"), hexed.alias("proposed_text"), F.lit(0.9).alias("confidence"), F.create_map(F.lit("selector"), meta["target"], F.lit("background"), F.col("bg")).alias("metadata"),
    )


def parse_answer(answer: Column) -> Column:
    """(text, confidence) of a model's answer: the widest braces as JSON; confidence within 0 and 1."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "text string, confidence double")
    return F.when(found["text"].isNotNull(), F.struct(found["text"].alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(found["confidence"], F.lit(0.5)))).alias("confidence")))


def modelled(issues: DataFrame, model: Callable[[str, str], str | None]) -> DataFrame:
    """Answers of ``model(rule_id, element_html)`` for other rules; failures give no row."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    answer = model(r["rule_id"], r["element_html"])
                except Exception:
                    answer = None
                if answer:
                    rows.append(r | {"answer": answer})
            names = ["id", "page_id", "rule_id", "category", "element_html", "answer"]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], pa.string()) for n in names})

    kept = targets(issues).where("rule_id <> 'CLR001'").select("id", "page_id", "rule_id", "category", "element_html")
    made = kept.mapInArrow(run, "id string, page_id string, rule_id string, category string, element_html string, answer string").withColumn("said", parse_answer(F.col("answer")))
    said = F.coalesce(F.col("said.text"), F.col("answer"))
    return made.select(
        F.sha2(F.concat_ws("|", "id", F.lit("suggestion")), 256).alias("id"), F.col("id").alias("issue_id"), "page_id", "rule_id", "category", F.col("element_html").alias("original_html"),
        F.lit(None).cast("string").alias("original_text"), said.alias("proposed_text"), F.coalesce(F.col("said.confidence"), T.alt_confidence(said)).alias("confidence"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def _select(root: Element, selector: str) -> Element | None:
    """The first element of a plain selector: its last part, by id, class or name."""
    m = re.fullmatch(r"([a-zA-Z][\w-]*)?(?:#([\w-]+))?((?:\.[\w-]+)*)(?::.*)?", (selector or "").split(">")[-1].strip().split(" ")[-1])
    if not m:
        return None
    classes = set(filter(None, m[3].split(".")))
    return next((e for e in root.elements() if (not m[1] or e.tag == m[1].lower()) and (not m[2] or e.get("id") == m[2]) and classes <= set(e.get("class").split())), None)


def apply(source: str, suggestion: dict) -> tuple[str, bool]:
    """A page with one suggestion applied, and whether its place was found."""
    root, rule, new = parse(source), suggestion["rule_id"], suggestion["proposed_text"]
    wanted = (parse(suggestion.get("original_html") or "").elements() or [None])[0]
    place = None
    if rule == "CLR001":
        place = _select(root, dict(suggestion.get("metadata") or {}).get("selector", ""))
        if place is not None:
            set_style(place, color=new)
    elif wanted is not None and rule == "LNK004":
        place = next((a for a in root.elements("a") if a.get("href") == wanted.get("href") and a.text().lower() == wanted.text().lower()), None)
        if place is not None:
            place.set_text(new)
    elif wanted is not None and rule == "IMG001":
        place = next((i for i in root.elements("img") if i.get("src") == wanted.get("src")), None)
        if place is not None:
            place.attrs["alt"] = new
    elif wanted is not None and rule == "FORM003":
        labels = root.elements("label")
        place = next((x for x in labels if wanted.get("for") and x.get("for") == wanted.get("for")), None) or next((x for x in labels if not x.text()), None)
        if place is not None:
            place.set_text(new)
    elif wanted is not None and rule == "TBL003":
        row = lambda t: [c.text() for c in (t.first("tr").elements("td", "th") if t.first("tr") else [])]
        place = next((t for t in root.elements("table") if not t.first("caption") and cut(t) == (suggestion.get("original_html") or "")), None) or next((t for t in root.elements("table") if not t.first("caption") and row(t) and row(t)[: len(row(wanted))] == row(wanted)), None)
        if place is not None:
            caption = Element("caption")
            caption.set_text(new)
            place.insert(0, caption)
    return (root.html() if place is not None else source), place is not None


def apply_all(pages: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Pages with their suggestions applied in order of id, and how many found their place.

    A suggestion is for the page whose file path (else identifier) equals its
    page_file_path, else its page_id; then for the page of that identifier, or
    page_id. Suggestions with neither are for none.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    names = pages.columns
    path = [blank("page_file_path")] if "page_file_path" in suggestions.columns else []
    key = F.coalesce(*path, blank("page_id"))
    own = F.sort_array(F.collect_list(F.struct("id", "rule_id", "proposed_text", "original_html", F.map_entries("metadata").alias("metadata"))))
    gathered = suggestions.where(key.isNotNull()).groupBy(key.alias("_key")).agg(own.alias("_s"))
    # the keys of a page in the order in which they are tried
    tried = [F.coalesce(*(blank(c) for c in ("file_path", "identifier") if c in names), F.col("page_id"))] + [F.col(c) for c in ("identifier", "page_id") if c in names]
    joined, found = pages, []
    for k, test in enumerate(tried):
        of = gathered.select(F.col("_key").alias(f"_key{k}"), F.col("_s").alias(f"_s{k}"))
        joined = joined.join(of, test == F.col(f"_key{k}"), "left")
        found.append(F.col(f"_s{k}"))
    joined = joined.select(*names, F.coalesce(*found).alias("_s"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                html, hit = r["html"], 0
                for s in r["_s"] or ():
                    html, ok = apply(html, s | {"metadata": {m["key"]: m["value"] for m in s["metadata"] or ()}})
                    hit += ok
                out.append({n: r[n] for n in names} | {"html": html, "applied": hit, "not_applied": len(r["_s"] or ()) - hit})
            yield pa.RecordBatch.from_pylist(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StructField, StructType

    kind = StructType([*pages.schema.fields, StructField("applied", IntegerType()), StructField("not_applied", IntegerType())])
    arrow = to_arrow_schema(kind)
    return joined.mapInArrow(run, kind)


def answer_json(text: str, confidence: float) -> str:
    """What a model is asked to answer."""
    return json.dumps({"text": text, "confidence": confidence})
