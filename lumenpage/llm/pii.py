"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns give base spans. Candidates (words around an @, and numbers in the
shapes of telephone numbers, addresses of hosts, cards, or plain digits) are the
nodes of a field over each document. A node under a base span is observed; the
labels of all others are free. Neighbours in the text share a chain potential,
and repeated or similar candidates a skip potential, however far apart: the
same address in any case, or the same name before the @; the same digits, or
seven and more that end both. Loopy sum-product message passing runs until the
messages stand still, so an observed mention pushes its label to the others of
its kind: a number written again without its prefix gets the label of its full
form. Free nodes that get a label are added as spans, unless a base span
overlaps them; base spans always stay.

Patterns take all digits and separators that follow each other for one match
and drop it if it fails. Candidates are single numbers, so of two cards side by
side the field labels each, as the patterns label such a number when it stands
alone.

The field is trained here by pseudo-likelihood: unary weights of the shapes, and
both potentials, from the labels of observed nodes and of those that no pattern
knows. Each node is seen twice, once with its shape held out, so that the
potentials learn what linked mentions tell. Nodes that a pattern would match if
they stood alone, or that are similar to an observed one, are of unknown label
and teach nothing. The sample is documented: at most ``max_docs`` documents,
those of the smallest hash of doc_id among all that hold a digit or an @.

A mention is linked to the one before it in its family, so a text with n
candidates has fewer than 3 n links, and the time and memory of a text of any
length follow from its candidates. Null and empty texts have no spans. Repeated
rows are scanned one by one; matches that begin at one place stand by kind. An
empty table gives no rows, and a field that learnt from nothing adds nothing.
Further columns are ignored by the scan, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.llm.common import parts

# The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_ANY = re.compile(r"[0-9@]")
#: Words around an @; numbers by shape: with a +, of hosts, in groups of four, in three parts, plain.
_CANDIDATE = re.compile(
    r"""[^\s@,;:<>()\[\]|"']+@[^\s@,;:<>()\[\]|"']+"""
    r"|\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"
    r"|\+[0-9]{8,15}(?![0-9])"
    r"|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"
    r"|(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"
    r"|(?<![0-9])(?:[0-9]{1,2}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9])[0-9]{5,}"
)
LABELS = ("other", *KINDS)
FEATURES = 16
#: Rounds of messages at most, what counts as standing still, and how near neighbours of the chain are.
ROUNDS, STILL, NEAR_CHARS = 500, 1e-4, 80
#: What a node's label is where it can't be known, and equal digits that make two numbers similar.
UNKNOWN, SIMILAR = -1, 7


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str):
    """Leftmost matches, found from each @: the local part goes back as far as it can."""
    at, begin = text.find("@"), 0
    while at >= 0:
        local = text[begin:at]
        n = len(local) - len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if n else None
        if domain:
            yield at - n, domain.end()
            begin = domain.end()
        else:
            begin = at + 1
        at = text.find("@", max(begin, at + 1))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then kind."""
    if not text or not _ANY.search(text):
        return []
    found = [(a, 0, z) for a, z in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return [(KINDS[k], a, z) for a, k, z in sorted(found)]


@dataclass
class Nodes:
    """The candidates of a text: places, features, known labels (0: known to be none), which are observed, and links."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    labels: np.ndarray
    observed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _families(own: str) -> set[str]:
    """Names that similar candidates share."""
    if "@" in own:
        address = own.lower().strip(".")
        return {address, address.partition("@")[0] + "@"}
    d = _digits(own)
    return {d, "end" + d[-SIMILAR:]} if len(d) >= SIMILAR else {d}


def _similar(a: str, b: str) -> bool:
    """Equal addresses or names before the @; equal digits, or one number the end of the other."""
    if "@" in a or "@" in b:
        return "@" in a and "@" in b
    a, b = _digits(a), _digits(b)
    return a == b or min(len(a), len(b)) >= SIMILAR and (a.endswith(b) or b.endswith(a))


def nodes(text: str, base: list[tuple[str, int, int]]) -> Nodes:
    own = list(_CANDIDATE.finditer(text))
    n = len(own)
    spans = [m.span() for m in own]
    labels, observed = np.full(n, UNKNOWN), np.zeros(n, bool)
    first = 0
    by_start = sorted(base, key=lambda s: s[1])
    reach = np.maximum.accumulate([s[2] for s in by_start]) if by_start else []
    for k, (a, z) in enumerate(spans):
        # base spans of several kinds may overlap one another, so the ends seen so far decide what may be passed
        while first < len(by_start) and reach[first] <= a:
            first += 1
        over = next((s for s in itertools.takewhile(lambda s: s[1] < z, itertools.islice(by_start, first, None)) if s[2] > a), None)
        if over:
            labels[k], observed[k] = LABELS.index(over[0]), True
        elif not base_spans(own[k][0]):
            labels[k] = 0
    skip, last = [], {}
    for k, m in enumerate(own):
        near = {last[x] for x in _families(m[0]) if x in last}
        skip += [(j, k) for j in sorted(near) if _similar(own[j][0], m[0])]
        last |= dict.fromkeys(_families(m[0]), k)
    for j, k in skip:
        # what is like an observed mention may be one, so that it is not one is unknown
        for x, y in ((j, k), (k, j)):
            if observed[x] and not observed[y]:
                labels[y] = UNKNOWN
    chain = [(k, k + 1) for k in range(n - 1) if spans[k + 1][0] - spans[k][1] <= NEAR_CHARS]
    pairs = lambda found: np.array(found, np.int64).reshape(-1, 2)
    return Nodes(spans, np.array([_features(m[0], _digits(m[0])) for m in own], np.float64).reshape(-1, FEATURES), labels, observed, pairs(chain), pairs(skip))


def _features(own: str, d: str) -> list[float]:
    n, dots = len(d), own.split(".")
    return [
        1, "@" in own, "@" in own and "." in own.rpartition("@")[2].strip("."), own[0] == "+", "(" in own, n < 9, 9 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n > 19,
        "@" not in own and 12 <= n <= 19 and luhn(d), len(dots) == 4 and "@" not in own, len(dots) == 4 and all(p.isdigit() and _small(p) for p in dots), " " in own, "-" in own, own.isdigit(),
    ]


@dataclass(frozen=True)
class Field:
    """Unary weights (features x labels) and the symmetric log potentials of chain and skip links."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, own: Nodes) -> tuple[np.ndarray, bool]:
        """The chances of the labels of each node, and whether the messages came to a stand."""
        unary = own.features @ self.weights
        unary[own.observed] = -50.0
        unary[own.observed, own.labels[own.observed]] = 0.0
        links = np.concatenate([own.chain, own.skip])
        still = True
        if len(links):
            table = np.concatenate([np.repeat(self.chain[None], len(own.chain), 0), np.repeat(self.skip[None], len(own.skip), 0)])
            # both directions of each link; the tables are symmetric
            source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
            table = np.concatenate([table, table])
            back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
            message = np.zeros((len(source), len(LABELS)))
            still = False
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                sent = (belief[source] - message[back])[:, :, None] + table
                top = sent.max(1)
                new = top + np.log(np.exp(sent - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                moved = np.abs(new - message).max()
                if moved < STILL:
                    still = True
                    break
                message = 0.25 * message + 0.75 * new
            np.add.at(unary, target, message)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), still


def _neighbours(own: Nodes, links: np.ndarray) -> np.ndarray:
    """For each node, how many of its linked nodes have each known label."""
    out = np.zeros((len(own.labels), len(LABELS)))
    for a, b in ((0, 1), (1, 0)):
        known = own.labels[links[:, b]] != UNKNOWN
        np.add.at(out, (links[known, a], own.labels[links[known, b]]), 1)
    return out


def fit(samples: list[Nodes], rounds: int = 600) -> Field:
    """Maximum pseudo-likelihood, by accelerated gradient, with weights drawn to a prior: none, but that linked mentions agree."""
    k = len(LABELS)
    prior = np.concatenate([np.zeros((FEATURES + k, k)), 2.0 * np.eye(k)])
    prior[0, 0] = 1.0  # without evidence a candidate is none
    rows, known = [np.zeros((0, FEATURES + 2 * k))], [np.zeros(0, np.int64)]
    for s in samples:
        use = s.labels != UNKNOWN
        beside, like = _neighbours(s, s.chain), _neighbours(s, s.skip)
        whole = np.concatenate([s.features, beside, like], 1)[use]
        # with the shape held out, of those that have a mention to learn from
        hidden = whole[like[use].sum(1) > 0].copy()
        hidden[:, 1:FEATURES] = 0
        rows += [whole, hidden]
        known += [s.labels[use], s.labels[use][like[use].sum(1) > 0]]
    x, y = np.concatenate(rows), np.concatenate(known)
    w = prior
    if len(x):
        one, v = np.eye(k)[y], w
        rate = 1.0 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + 1e-3)
        for t in range(rounds):
            p = np.exp((z := x @ v) - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            new = v - rate * (x.T @ (p - one) / len(x) + 1e-3 * (v - prior))
            v, w = new + t / (t + 3) * (new - w), new
    even = lambda m: (m + m.T) / 2
    return Field(w[:FEATURES], even(w[FEATURES : FEATURES + k]), even(w[FEATURES + k :]))


def spans(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    if not text or not _ANY.search(text):
        return base, base
    own = nodes(text, base)
    if own.observed.all():
        return base, base
    belief, _ = field.beliefs(own)
    label = belief.argmax(1)
    added = [(LABELS[label[k]], *own.spans[k]) for k in np.flatnonzero(~own.observed & (label > 0) & (belief.max(1) > 0.5)).tolist()]
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))


def train(docs: DataFrame, max_docs: int = 3000) -> Field:
    """Fit on the candidates of a bounded sample of documents."""
    some = docs.where(F.col("text").rlike("[0-9@]"))
    ids = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(max_docs)
    kinds = {"features": np.float64, "labels": np.int64, "observed": np.bool_, "chain": np.int64, "skip": np.int64}

    def run(batches):
        for batch in parts(batches, "text"):
            found = [nodes(t, base_spans(t)) for t in batch["text"].to_pylist() if t]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(getattr(s, c)).astype(kind).tobytes() for s in found], pa.binary()) for c, kind in kinds.items()], list(kinds))

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(run, ", ".join(f"{c} binary" for c in kinds)).toArrow().to_pylist()
    read = [{c: np.frombuffer(r[c], kind) for c, kind in kinds.items()} for r in rows]
    return fit([Nodes([], r["features"].reshape(-1, FEATURES), r["labels"], r["observed"], r["chain"].reshape(-1, 2), r["skip"].reshape(-1, 2)) for r in read])


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in found)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, base and spans, both arrays of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in parts(batches, "text"):
            base, every = [], []
            for text in batch["text"]:
                own = spans(text.as_py(), field)
                for out, found in zip((base, every), own, strict=True):
                    out.append([{"kind": k, "start": a, "end": z} for k, a, z in found])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])

    shape = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {shape}, spans {shape}")


def digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(_joined(found).encode()).hexdigest()


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(docs))
    text = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
