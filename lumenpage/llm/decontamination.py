"""Benchmark decontamination by spaced-seed hashing.

Texts become words (runs without ASCII white space, A-Z as a-z). A mask is a
pattern of kept and ignored word positions; the hash of the kept words is a
seed. Seeds of the benchmark's items and of the documents are joined by their
hash, and each hit proposes an alignment (a diagonal) of a document with an
item. Items shorter than the widest mask have one seed more, of all their words.

Before the join, a bit map of the benchmark's seeds thins out those of the
documents. It has 64 bits for each seed, two of them set, and 32 MB at most,
beyond which it lets more pass; it never holds back a hit. Neither the items
nor their seeds are gathered on the driver.

Hits are verified: along the diagonal, the best segment is the one with the
highest sum of +1 for an equal and -4 for a different word, so a verified
segment is at least 80 % equal and tolerates substituted words. What is left of
the diagonal on both sides of it is searched again, for segments of five equal
words (or the whole item) at least.

The overlap of a document with an item is the sum of its segments on all
diagonals, from the one with most equal words down; of the later ones counts
only what takes words of neither text again. So words put in, left out or
moved do not hide a copy. Segments that follow each other in both texts, with
eight words at most between them in each, form a passage.

A document is contaminated by an item if the overlap has at least
``min_words`` equal words and either covers ``min_share`` of the item or has a
passage of ``min_run`` equal words.

Null and empty texts hold no words and are never contaminated; neither are
they useful items. Repeated documents are reported one by one, repeated items
under each item_id; ties stand by item_id and then start. An empty table of
documents gives no rows, an empty benchmark no overlaps. Long texts are
hashed whole, and verified whole where they have a hit; they take some 50 bytes
a word. The columns of the documents stay, but for one named overlaps, which
is replaced; the benchmark's further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.llm.common import U64, bit_map, in_bit_map, mix, parts, shared_dir, steps, stored, text_bytes, word_hashes

#: Kept (1) and ignored (0) positions; five words are kept by each.
MASKS = ("11111", "1101011", "1011101", "11000111")
#: Items that one row of candidates holds, more or less; bytes of a table that may be broadcast.
ITEMS, BROADCAST_BYTES = 256, 32 << 20
#: Equal words that a segment needs, as many as a mask keeps; words that may stand between the segments of a passage.
LEAST, GAP = 5, max(map(len, MASKS))

HITS = "array<struct<item_id:bigint,matched:int,length:int,start:int,item_words:int>>"


def _seeds(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, salt * 2 + 1, np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            total = (total + words[k : k + n]) * U64(0x9E3779B97F4A7C15)
            total ^= total >> U64(31)
    return mix(total)


def _widest(masks: tuple[str, ...] = MASKS) -> int:
    return max(map(len, masks))


def _item_seeds(batches):
    """(seed, item_id, item, place) of all masks, and of all words of a short item."""
    for batch in batches:
        seeds, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, raw in enumerate(batch["words"]):
            words = np.frombuffer(raw.as_py(), np.uint64)
            found = [_seeds(words, mask, m) for m, mask in enumerate(MASKS)]
            if len(words) < _widest():
                found.append(_whole(words, len(words)))
            for f in found:
                seeds.append(f)
                owners.append(np.full(len(f), k))
                places.append(np.arange(len(f)))
        owner = pa.array(np.concatenate(owners))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds).view(np.int64)), batch["item_id"].take(owner), batch["item"].take(owner), pa.array(np.concatenate(places), pa.int32())], ["seed", "item_id", "item", "place"])


def _with_words(batches):
    """(item_id, item, words) of the items that have any."""
    for batch in parts(batches, "text"):
        words = []
        for k in range(batch.num_rows):
            raw, at = text_bytes(batch["text"].slice(k, 1))
            words.append(word_hashes(raw, at)[0].tobytes())
        rows = pa.RecordBatch.from_arrays([batch["item_id"], batch["item"], pa.array(words, pa.binary())], ["item_id", "item", "words"])
        yield rows.filter(pa.array([len(w) > 0 for w in words], pa.bool_()))


def _hits(known, lengths: list[int]):
    """(doc, cid, seed, at) of the seeds of documents that the bit map knows."""

    def run(batches):
        for batch in parts(batches, "text"):
            raw, at = text_bytes(batch["text"])
            for i, j in steps(at):
                words, _, _, first = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                row = np.repeat(np.arange(j - i), np.diff(first))
                for m, size in [*((m, len(mask)) for m, mask in enumerate(MASKS)), *((None, n) for n in lengths)]:
                    seeds = _whole(words, size) if m is None else _seeds(words, MASKS[m], m)
                    near = np.flatnonzero(in_bit_map(known.value, seeds.view(np.int64)))
                    near = near[row[near] == row[near + size - 1]]
                    own = pa.array(row[near] + i)
                    yield pa.RecordBatch.from_arrays([batch["doc"].take(own), batch["cid"].take(own), pa.array(seeds[near].view(np.int64)), pa.array((near - first[row[near]]).astype(np.int32))], ["doc", "cid", "seed", "at"])

    return run


def _whole(words: np.ndarray, n: int) -> np.ndarray:
    return _seeds(words, "1" * n, 1000 + n)


def _best_segment(same: np.ndarray) -> tuple[int, int]:
    """Start and end of the segment with the highest sum of +1 and -4; the first such, ending at an equal word."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return start, end


def _segments(same: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """The best segment, and those of what is left on both sides of it."""
    open_ = [(0, len(same))]
    while open_:
        low, high = open_.pop()
        if high - low < least:
            continue
        a, b = _best_segment(same[low:high])
        if int(same[low + a : low + b].sum()) >= least:
            yield low + a, low + b
            open_ += [(low, low + a), (low + b, high)]


def _overlap(words: np.ndarray, item: np.ndarray, segments: set[tuple[int, int, int]]) -> tuple[dict, int]:
    """The sum of segments (start in the document, in the item, length), and the equal words of the longest passage."""
    least = min(LEAST, len(item))
    used, taken, parts = np.zeros(len(item), bool), np.zeros(len(words), bool), []
    sized = sorted((-int((words[i : i + n] == item[p : p + n]).sum()), i, p, n) for i, p, n in segments)
    for _, i, p, n in sized:
        free = ~(used[p : p + n] | taken[i : i + n])
        # of a segment that others overlap, the longest free run
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8))).reshape(-1, 2)
        if not len(edges):
            continue
        a, b = edges[np.argmax(edges[:, 1] - edges[:, 0])].tolist()
        same = words[i + a : i + b] == item[p + a : p + b]
        if int(same.sum()) < (1 if parts else least):
            continue
        used[p + a : p + b] = taken[i + a : i + b] = True
        parts.append((i + a, p + a, b - a, int(same.sum())))
    run = most = 0
    end = (-GAP - 1, -GAP - 1)
    for i, p, n, equal in sorted(parts):
        run = equal + (run if i - end[0] <= GAP and 0 <= p - end[1] <= GAP else 0)
        most, end = max(most, run), (i + n, p + n)
    hit = {"matched": sum(x[3] for x in parts), "length": sum(x[2] for x in parts), "start": parts[0][0] if parts else 0, "item_words": len(item)}
    return hit, most


def verified(words: np.ndarray, items: list[dict], min_words: int, min_share: float, min_run: int) -> list[dict]:
    """The overlaps of a document with its candidates (item_id, words, diagonals)."""
    hits = []
    for candidate in items:
        item = np.frombuffer(candidate["words"], np.uint64)
        segments = set()
        for diagonal in candidate["diagonals"]:
            low, high = max(diagonal, 0), min(diagonal + len(item), len(words))
            same = words[low:high] == item[low - diagonal : high - diagonal]
            segments.update((low + a, low + a - diagonal, b - a) for a, b in _segments(same, min(LEAST, len(item))))
        hit, run = _overlap(words, item, segments)
        if hit["matched"] >= min(min_words, len(item)) and (hit["matched"] >= min_share * len(item) or run >= min_run):
            hits.append({"item_id": candidate["item_id"], **hit})
    return hits


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, cid, text): equal keys have equal texts."""
    return docs.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc"), F.xxhash64("text").alias("cid"), "text")


def _small(table: DataFrame, size) -> DataFrame:
    """A stored table, to be broadcast if its measured size allows; else the join shuffles both sides."""
    return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else table


def overlaps(docs: DataFrame, benchmark: DataFrame, *, min_words: int = 10, min_share: float = 0.5, min_run: int = 13) -> DataFrame:
    """Stored rows (doc, cid, overlaps) of the documents that have any."""
    folder = shared_dir(docs.sparkSession)
    items = benchmark.select("item_id", F.xxhash64("text").alias("item"), "text").where("text IS NOT NULL").distinct()
    items = stored(items.mapInArrow(_with_words, "item_id long, item long, words binary"), folder, "items", small=True)
    seeds = stored(items.mapInArrow(_item_seeds, "seed long, item_id long, item long, place int"), folder, "seeds", small=True)
    # lengths of short items, less than the widest mask has places
    size = F.octet_length("words") / 8
    lengths = sorted(int(r[0]) for r in items.where(size < _widest()).select(size.alias("n")).distinct().collect())
    known = docs.sparkSession.sparkContext.broadcast(bit_map(seeds, "seed"))
    texts = _keyed(docs)
    hits = texts.mapInArrow(_hits(known, lengths), "doc long, cid long, seed long, at int")
    aligned = hits.join(seeds, "seed").groupBy("doc", "cid", "item_id", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    aligned = stored(aligned, folder, "aligned", small=True)
    most = aligned.groupBy("doc", "cid").count().agg(F.max("count")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("a.item", "a.item_id"), F.lit(-(-most // ITEMS) or 1)).alias("bucket")
    same_item = (F.col("a.item") == F.col("i.item")) & F.col("a.item_id").eqNullSafe(F.col("i.item_id"))
    candidates = aligned.alias("a").join(items.alias("i"), same_item).select("doc", "cid", bucket, "a.item_id", "i.words", "diagonals")
    packed = candidates.groupBy("doc", "cid", "bucket").agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("items"))
    packed = stored(packed, folder, "packed", small=True)
    weight = F.aggregate("items", F.lit(64).cast("long"), lambda n, i: n + F.octet_length(i["words"]) + 4 * F.size(i["diagonals"]))

    def verify(batches):
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("matched", pa.int32()), ("length", pa.int32()), ("start", pa.int32()), ("item_words", pa.int32())]))
        for batch in parts(batches, "text"):
            found = []
            for k, own in enumerate(batch["items"].to_pylist()):
                raw, at = text_bytes(batch["text"].slice(k, 1))
                found.append(verified(word_hashes(raw, at)[0], own, min_words, min_share, min_run))
            rows = pa.RecordBatch.from_arrays([batch["doc"], batch["cid"], batch["bucket"], pa.array(found, kind)], ["doc", "cid", "bucket", "overlaps"])
            yield rows.filter(pa.array([len(f) > 0 for f in found], pa.bool_()))

    joined = texts.join(_small(packed, weight), ["doc", "cid"]).select("doc", "cid", "bucket", "text", "items")
    found = joined.mapInArrow(verify, f"doc long, cid long, bucket long, overlaps {HITS}").dropDuplicates(["doc", "cid", "bucket"])
    order = lambda a, b: F.when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).when(a["start"] < b["start"], -1).otherwise(F.when(a["start"] > b["start"], 1).otherwise(0))
    gathered = found.groupBy("doc", "cid").agg(F.flatten(F.collect_list("overlaps")).alias("overlaps"))
    return stored(gathered.withColumn("overlaps", F.array_sort("overlaps", order)), folder, "overlaps", small=True)


def contamination(docs: DataFrame, benchmark: DataFrame, *, min_words: int = 10, min_share: float = 0.5, min_run: int = 13) -> DataFrame:
    """The columns of ``docs`` (but any named overlaps) with overlaps, an array of verified overlaps."""
    found = overlaps(docs, benchmark, min_words=min_words, min_share=min_share, min_run=min_run)
    names = [c for c in docs.columns if c != "overlaps"]
    found = _small(found, 16 + 24 * F.size("overlaps")).select(F.col("doc").alias("_doc"), F.col("cid").alias("_cid"), "overlaps")
    own = docs.select(names)
    return own.join(found, _same(own), "left").select(*names, F.coalesce("overlaps", F.array().cast(HITS)).alias("overlaps"))


def clean(docs: DataFrame, benchmark: DataFrame, *, min_words: int = 10, min_share: float = 0.5, min_run: int = 13) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, with all their columns as they are."""
    found = overlaps(docs, benchmark, min_words=min_words, min_share=min_share, min_run=min_run)
    found = _small(found.select(F.col("doc").alias("_doc"), F.col("cid").alias("_cid")), F.lit(16))
    return docs.join(found, _same(docs), "left_anti")


def _same(docs: DataFrame):
    return (F.coalesce(docs["doc_id"], F.lit(-1)).cast("long") == F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_cid"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, item_ids, and the words matched and length of its largest overlap."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    top = F.array_max(F.transform("overlaps", lambda h: F.struct(h["matched"].alias("m"), h["length"].alias("n"))))
    return found.select(
        "doc_id",
        (F.size("overlaps") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("overlaps", lambda h: h["item_id"]))).alias("item_ids"),
        F.coalesce(top["m"], F.lit(0)).cast("long").alias("matched_words"),
        F.coalesce(top["n"], F.lit(0)).cast("long").alias("overlap_words"),
    )
