"""Best-fit packing by patterns of lengths and non-negative least squares.

Documents become ids of a byte-level BPE tokenizer and end with one end id.
Longer ones are cut into full pieces; what is over stands first. The plan
knows the remaining pieces by their lengths alone, so it is as small at 100 TB
as on a laptop: few-document patterns that fill a sequence exactly are fitted
to the histogram of lengths by non-negative least squares, their counts are
rounded down, and best-fit decreasing packs the residual histogram. A plan is
a list of runs (length, ranks -> sequences, offset); pieces are ranked within
their length, and find their sequence by rank.

Null and empty texts are one piece of the end id alone. Repeated rows are
packed as often as they stand there; pieces of one length are equal to the
plan, and which of them goes where is decided by doc_id, piece and start. An
empty table gives no pieces. Long texts are encoded whole, by the defining
tokenizer beyond a million characters; their ids take 4 bytes each. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpage.llm.common import parts, shared_dir, stored

#: Characters for which both tokenizers' Unicode tables surely agree.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u0400-\\u045f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*")
#: Longer texts go through the defining tokenizer alone.
_FAST_CHARS = 1_000_000
#: Shares of the fitted counts that are tried before rounding down.
ROUNDINGS = (1.0, 0.75, 0.5, 0.25, 0.1, 0.05)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _defining(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


@cache
def _fast(ranks: str):
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str | None, tokenizer: str, ranks: str | None) -> list[int]:
    """Ids of one text, as the tokenizer file defines them; ``ranks`` holds the same vocabulary for a faster encoder."""
    if not text:
        return []
    if ranks and len(text) <= _FAST_CHARS and _PLAIN.fullmatch(text):
        return _fast(ranks).encode_ordinary(text)
    return _defining(tokenizer).encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, *, size: int = 1024, end_id: int = 2, tokenizer: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every document; the first piece of a cut one takes what full pieces leave."""
    if tokenizer is None:
        tokenizer, ranks = default_tokenizer(), default_ranks()

    def run(batches):
        for batch in parts(batches, "text"):
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                got = array("I", encode(text.as_py(), tokenizer, ranks))
                got.append(end_id)
                raw, at, k = memoryview(got.tobytes()), 0, 0
                while at < len(got):
                    n = (len(got) % size or size) if not k else size
                    own = raw[4 * at : 4 * (at + n)]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    if keep_ids:
                        ids.append(np.frombuffer(own, np.int32))
                    at, k = at + n, k + 1
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Plan:
    """Runs of pieces: those of ``length`` with ranks from ``rank`` on, ``count`` of them, go to sequences from ``sequence`` on, each at ``offset``."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def patterns(present: np.ndarray, size: int, spread: int = 24) -> np.ndarray:
    """Rows of up to four lengths (0: none) that sum to ``size``: all pairs, and triples and quadruples of evenly chosen lengths."""
    has = np.zeros(size + 1, bool)
    has[present] = True
    found = [np.zeros((0, 4), int)]
    a = present[has[size - present] & (present <= size - present)]
    found.append(np.stack([a, size - a, 0 * a, 0 * a], 1))
    picks = present[np.unique(np.linspace(0, len(present) - 1, min(spread, len(present))).astype(int))] if len(present) else present
    for b in picks:
        rest = size - b - present
        ok = (rest >= present) & (rest <= size) & (rest > 0)
        ok &= has[np.clip(rest, 0, size)]
        found.append(np.stack([np.full(ok.sum(), b), present[ok], rest[ok], 0 * rest[ok]], 1))
        for c in picks[picks >= b]:
            rest = size - b - c - present
            ok = (rest >= present) & (rest > 0)
            ok &= has[np.clip(rest, 0, size)]
            found.append(np.stack([np.full(ok.sum(), b), np.full(ok.sum(), c), present[ok], rest[ok]], 1))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def nnls(cells: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that brings the summed patterns near ``target`` (least squares, accelerated projected gradient); column 0 of the target is no length."""
    n = len(target)
    x = np.zeros(len(cells))
    if not len(cells):
        return x

    def times(v: np.ndarray) -> np.ndarray:
        got = np.bincount(cells.ravel(), np.repeat(v, cells.shape[1]), n)
        got[0] = 0
        return got

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[cells].sum(1)

    v = np.ones(len(cells))
    for _ in range(30):  # the largest eigenvalue, for the step
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(times(y) - target) / max(top, 1e-12))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(histogram: dict[int, int], size: int = 1024) -> Plan:
    """Place every piece of a histogram of lengths: of several roundings of the fitted counts, the one that needs fewest sequences."""
    whole = np.zeros(size + 1, np.int64)
    for length, count in histogram.items():
        whole[length] = count
    rest = whole.copy()
    rest[size] = 0
    cells = patterns(np.flatnonzero(rest), size)
    fitted = nnls(cells, rest.astype(float))
    return min((_placed(whole.copy(), cells, fitted * share, size) for share in ROUNDINGS), key=lambda p: p.sequences)


def _placed(left: np.ndarray, cells: np.ndarray, fitted: np.ndarray, size: int) -> Plan:
    """Patterns by their counts rounded down, then best-fit decreasing; ``left`` is the histogram."""
    out = Plan()
    used = np.zeros(size + 1, np.int64)

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        out.runs.append((length, int(used[length]), count, sequence, offset))
        used[length] += count
        left[length] -= count

    if left[size]:
        put(size, int(left[size]), 0, 0)
        out.sequences = int(used[size])
    for k in np.argsort(-fitted, kind="stable"):
        count = int(fitted[k])
        lengths, times = np.unique(cells[k][cells[k] > 0], return_counts=True)
        count = min(count, int((left[lengths] // times).min()))
        if count <= 0:
            if fitted[k] < 1:
                break
            continue
        at = 0
        for length in cells[k][cells[k] > 0][::-1].tolist():
            put(length, count, out.sequences, at)
            at += length
        out.sequences += count
    # best-fit decreasing over the rest: sequences with the same room are one group of (first, count)
    room: list[list[list[int]]] = [[] for _ in range(size + 1)]
    for length in range(size - 1, 0, -1):
        while left[length]:
            best = next((r for r in range(length, size) if room[r]), size)
            each = best // length  # the fullest sequence takes all that it can, then the next
            want = -(-int(left[length]) // each)
            if best == size:
                first, have = out.sequences, want
                out.sequences += want
            else:
                first, have = room[best].pop()
            full = min(have, int(left[length]) // each)
            over = min(int(left[length]) - full * each, each - 1) if full < have else 0
            for k in range(each):
                n = full + (k < over)
                if n:
                    put(length, n, first, size - best + k * length)
            taken = full + (over > 0)
            if full and each * length < best:
                room[best - each * length].append([first, full])
            if over:
                room[best - over * length].append([first + full, 1])
            if taken < have:
                room[best].append([first + taken, have - taken])
    return out


def pack(split: DataFrame, size: int = 1024, bucket_rows: int = 500) -> DataFrame:
    """Add sequence_id and offset to stored pieces.

    Ranks within a length come from counts per (length, bucket of the row). A
    length has a bucket for each ``bucket_rows`` of its pieces, so no window
    grows with the table, not even that of the full pieces.
    """
    names = [c for c in split.columns if c not in ("sequence_id", "offset")]
    histogram: dict[int, int] = {}
    for length, n in split.groupBy("length").count().toLocalIterator():
        histogram[length] = n
    buckets = F.try_element_at(F.array(*(F.lit(-(-histogram.get(k, 0) // bucket_rows) or 1) for k in range(1, size + 1))), F.col("length").cast("int"))
    keyed = split.select(names).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), buckets))
    counts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    made = plan(histogram, size)
    table = np.array(sorted(made.runs), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_bucket"]).select(*names, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def run(batches):
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            at = np.searchsorted(keys, batch["length"].to_numpy() * (1 << 44) + batch["_rank"].to_numpy(), "right") - 1
            sequence = table[at, 3] + batch["_rank"].to_numpy() - table[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(table[at, 4])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.select(names).schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    split = stored(pieces(docs), shared_dir(spark), "pieces", small=True)
    return pack(split).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
