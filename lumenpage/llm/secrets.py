"""Secret scans over an incremental blob ledger.

Rows (path, content) are versions: a path may have many over time. Content is
addressed by its SHA-256, so a blob that many paths or versions hold is one
blob. The ledger has a row per scanned (blob, rule version); only pairs that
it lacks are scanned, and findings join back to every path. A new version of
the rules, or new blobs, cost what they add: what the ledger has is not read
again.

One pass over the texts hashes each and tries the gates, plain JVM patterns
that hold whenever a rule of a version matches; a text that no gate admits goes
no further, and its blob enters the ledger without findings. What is admitted
is scanned once per blob, on the smallest path.

The base rules are one version. A second version adds formats that the base
patterns don't name: private keys, signed web tokens, prefixed tokens of
services, and passwords in addresses. Spans that a base span covers aren't
added; base spans always stay.

Null content is empty content. Repeated rows share a blob and give a row each;
where matches tie, they stand by start and then kind. An empty table gives no
rows. Null paths are kept. Texts of any length are scanned whole. Other columns
are ignored by the scan and returned by ``find``, but for content, blob and
findings, which are its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.llm.common import parts, shared_dir, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group that is the secret itself, and the least characters of that group."""

    kind: str
    pattern: re.Pattern
    group: int = 0
    least: int = 0


@dataclass(frozen=True)
class Rules:
    """A version of rules, and a Java pattern that holds in every text in which one of them matches."""

    version: str
    rules: tuple[Rule, ...]
    gate: str


# The kinds in order, their patterns, and the least length of what is checked.
BASE = Rules(
    "base-1",
    (
        Rule("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
        Rule("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        Rule("hex", re.compile(r"[0-9a-f]{24,}")),
    ),
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}""",
)
MORE = Rules(
    "more-1",
    (
        Rule("key", re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)?")),
        Rule("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
        Rule("service", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}")),
        Rule("login", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:([^\s/@]{1,200})@"), 1, 3),
    ),
    r"-----BEGIN |eyJ[A-Za-z0-9_-]{8}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-|sk_live_|AIza[A-Za-z0-9_-]{35}|://[^\s/:@]{1,100}:[^\s/@]{1,200}@",
)
VERSIONS = (BASE, MORE)
KINDS = tuple(r.kind for v in VERSIONS for r in v.rules)

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: Findings up to which a table of them is broadcast to the paths.
BROADCAST_SPANS = 200_000


def _matches(text: str | None, rules: Rules):
    """(start, place of the kind, end, start and end of the secret itself) of every match."""
    for r in rules.rules:
        for m in r.pattern.finditer(text or ""):
            if m.end(r.group) - m.start(r.group) >= r.least:
                yield m.start(), KINDS.index(r.kind), m.end(), m.span(r.group)


def scan(text: str | None, rules: Rules = BASE) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one text in code points, by start and then kind."""
    return [(KINDS[k], a, z) for a, k, z, _ in sorted(_matches(text, rules))]


def _scan_batches(rules: Rules):
    def run(batches):
        for batch in parts(batches, "content"):
            spans = [[{"kind": k, "start": a, "end": z} for k, a, z in scan(t.as_py(), rules)] for t in batch["content"]]
            yield pa.RecordBatch.from_arrays([batch["blob"], pa.array(spans, _ARROW)], ["blob", "findings"])

    return run


def blob_of(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def addressed(versions: DataFrame, rules: tuple[Rules, ...] = VERSIONS) -> DataFrame:
    """All columns but content, with blob, ``admitted`` (the rule versions whose gates hold), and content where there is any such version.

    It is read several times, so it should be stored.
    """
    names = [c for c in versions.columns if c not in ("content", "blob", "admitted")]
    holds = F.array_compact(F.array(*(F.when(F.col("content").rlike(r.gate), r.version) for r in rules)))
    found = versions.select(*names, "content", blob_of(F.col("content")).alias("blob"), holds.alias("admitted"))
    return found.withColumn("content", F.when(F.size("admitted") > 0, F.col("content")))


def update_ledger(table: DataFrame, ledger: DataFrame | None = None, rules: Rules = BASE) -> DataFrame:
    """Rows (blob, rules_version, findings) to append to the ledger: one for each pair that it doesn't have.

    ``table`` is a stored table of ``addressed`` versions with a path.
    """
    admitted = F.array_contains("admitted", rules.version)
    blobs = table.groupBy("blob").agg(F.min("path").alias("path"), F.max(admitted).alias("admitted"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules_version") == rules.version).select("blob"), "blob", "left_anti")
    # one holder for each blob: (blob, smallest path) is unique but for repeated rows, so no key is hot
    first = blobs.where("admitted").select("blob", "path")
    texts = table.where(admitted).select("blob", "path", "content")
    holders = texts.alias("t").join(first.alias("f"), (F.col("t.blob") == F.col("f.blob")) & F.col("t.path").eqNullSafe(F.col("f.path")), "left_semi")
    scanned = holders.mapInArrow(_scan_batches(rules), f"blob string, findings {SPANS}").groupBy("blob").agg(F.first("findings").alias("findings"))
    return (
        blobs.select("blob")
        .join(scanned, "blob", "left")
        .select("blob", F.lit(rules.version).alias("rules_version"), F.coalesce("findings", F.array().cast(SPANS)).alias("findings"))
    )


def brought_up_to_date(table: DataFrame, folder: str, ledger: DataFrame | None = None, rules: tuple[Rules, ...] = VERSIONS) -> DataFrame:
    """The ledger with every pair of a blob of the stored ``table`` and one of the rule versions; each version appends what it lacks."""
    for r in rules:
        new = stored(update_ledger(table, ledger, r), folder, f"ledger-{r.version}", small=True)
        ledger = new if ledger is None else ledger.unionByName(new)
    return ledger


def findings_of(ledger: DataFrame, rules: tuple[Rules, ...] = VERSIONS) -> DataFrame:
    """Per blob with any: the findings of all versions, the earlier versions first; what an earlier version's span covers is left out of the later."""
    out = None
    for r in rules:
        own = ledger.where((F.col("rules_version") == r.version) & (F.size("findings") > 0)).select("blob", F.col("findings").alias("new"))
        if out is None:
            out = own.withColumnRenamed("new", "findings")
            continue
        out = out.join(own, "blob", "full").select("blob", F.coalesce("findings", F.array().cast(SPANS)).alias("findings"), F.coalesce("new", F.array().cast(SPANS)).alias("new"))
        fresh = F.filter("new", lambda n: ~F.exists("findings", lambda s: (s["start"] < n["end"]) & (n["start"] < s["end"])))
        out = out.select("blob", F.concat("findings", fresh).alias("findings"))
    place = F.create_map(*(F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)))
    keyed = F.array_sort(F.transform("findings", lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return out.select("blob", F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("findings"))


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with a blob, and its findings or null: by broadcast while all findings are few; else Spark splits a blob that many rows hold."""
    few = (found.agg(F.sum(F.size("findings"))).first()[0] or 0) <= BROADCAST_SPANS
    return rows.join(F.broadcast(found) if few else found, "blob", "left")


def find(table: DataFrame, ledger: DataFrame, rules: tuple[Rules, ...] = VERSIONS) -> DataFrame:
    """Each version of the stored ``table`` (all its columns but content) with the findings of its blob."""
    names = [c for c in table.columns if c not in ("content", "blob", "admitted", "findings")]
    return _joined(table.select(*names, "blob"), findings_of(ledger, rules)).select(*names, "blob", F.coalesce("findings", F.array().cast(SPANS)).alias("findings"))


def redact(text: str | None, rules: tuple[Rules, ...] = VERSIONS) -> str | None:
    """The text with each secret (of an assignment or login: its value) replaced by a marker of its kind."""
    found = sorted((*own, KINDS[k]) for r in rules for _, k, _, own in _matches(text, r))
    if not found:
        return text
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind} removed]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, ledger: DataFrame, rules: tuple[Rules, ...] = VERSIONS) -> DataFrame:
    """``docs`` with the secrets of their blobs replaced in text, and n_chars of what is then there.

    Only texts with findings go to Python.
    """
    names = docs.columns
    dirty = findings_of(ledger, rules).withColumnRenamed("blob", "_blob").withColumnRenamed("findings", "_found")
    few = (dirty.agg(F.sum(F.size("_found"))).first()[0] or 0) <= BROADCAST_SPANS
    dirty = dirty.select("_blob", F.lit(True).alias("_dirty"))
    marked = docs.withColumn("_blob", blob_of(F.col("text"))).join(F.broadcast(dirty) if few else dirty, "_blob", "left")

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t.as_py(), rules) for t in texts], pa.string())

    new = marked.withColumn("_new", cleaned(F.when(F.col("_dirty"), F.col("text"))))
    changed = {"text": F.when(F.col("_dirty"), F.col("_new")).otherwise(F.col("text"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("_dirty"), F.char_length("_new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return new.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in names))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, by way of a ledger that both rule versions append to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    table = stored(addressed(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))), folder, "versions", small=True)
    found = find(table, brought_up_to_date(table, folder))
    base = F.filter("findings", lambda s: s["kind"].isin(*(r.kind for r in BASE.rules)))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in BASE.rules]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text("findings").alias("spans"))
