"""Suffix-array deduplication: maximal repeats of 200 bytes and more, with all their occurrences.

Texts are UTF-8 bytes. Equal 200-byte windows have the same minimizer (the least
hash of a 32-byte gram in them) at the same place, so each minimizer is an
anchor that owns a run of window starts, and equal windows only meet under one
anchor hash:

1. One pass gives the anchors: their hash, a 128-bit BLAKE2 digest of the bytes
   of the whole run, and the place. Hashes that occur once end here.
2. Equal runs (by digest) are one string to a suffix array, as their suffixes
   tie. Where all runs of a hash are equal, the interval of the whole run is the
   maximal repeat, and all members are its occurrences.
3. The different runs of one hash meet in one task, which builds an enhanced
   suffix array over their bytes. A stack scan of its common-prefix intervals of
   200 bytes and more tests whether the bytes to the left differ (or a run
   begins there); such intervals are maximal repeats, and all their occurrences
   are given, each for every member of its run.
4. A hash with more than ``HOT_RUNS`` different runs would load one task. Its
   suffixes are dealt by the digest of their first 200 bytes instead: each such
   bucket of two and more is the root of the intervals below it, and is given
   with all its occurrences. The covered bytes are the same.

A repeat that is longer than a run is given run after run, with overlaps.
Collisions of the 64-bit hashes cost time, never results.

Null texts are empty; texts under 200 bytes repeat nothing. Repeated rows are
occurrences of one another, and ties stand by place. A null doc_id is kept.
Other columns are ignored, whatever their names. An empty table gives no rows.
Long texts are worked on in stretches of 1 MB; what is held beside a text
follows from its repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpage.llm.common import BYTE, STEP_BYTES, U64, groups, mix, parts, powers, prefix_sums, shared_dir, steps, stored, stretch, text_bytes

SPAN, GRAM = 200, 32
#: Different runs under one hash that a task compares, and bytes of runs that one suffix array takes.
HOT_RUNS, ARRAY_BYTES = 8192, 1 << 20
#: Repeated prefixes of hot hashes (of 16 bytes) up to which they are broadcast to the runs; beyond that the suffixes are joined to them.
PREFIXES = 500_000
#: Spans (of some 32 bytes) up to which a table of them may be broadcast to the texts.
BROADCAST_SPANS = 20_000
#: Places within a stretch of text share a word with the upper bits of a hash.
_PLACE = U64((1 << 28) - 1)
_SYMBOLS = 7
#: What identifies a run by its bytes.
RUN = ["h", "d1", "d2"]


def digests(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of some stretches, as rows of two longs."""
    view = memoryview(raw)
    found = b"".join([hashlib.blake2b(view[a:z], digest_size=16).digest() for a, z in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, ">i8").astype(np.int64).reshape(-1, 2)


def _sliding_min(e: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have, low = 1, e
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(raw: np.ndarray, at: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(row, hash, digest of the run, first start, bytes) of each anchor; starts count within the row. ``raw`` is a few MB at most."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none.astype(np.uint64), none.reshape(-1, 2), none, none
    sums = prefix_sums(raw, BYTE)
    value = mix((sums[gram:] - sums[:-gram]) * powers(n + 1)[1][: n - gram + 1])
    low = _sliding_min((value & ~_PLACE) | np.arange(len(value), dtype=np.uint64), span - gram + 1)
    place = (low & _PLACE).astype(np.int64)  # of the minimizer of the window at each start
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(place)]
    valid = at[1:][row] - np.arange(len(place)) >= span
    begin = valid.copy()
    begin[1:] &= (place[1:] != place[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
    end = valid.copy()
    end[:-1] &= (place[1:] != place[:-1]) | ~valid[1:] | (row[1:] != row[:-1])
    a, z = np.flatnonzero(begin), np.flatnonzero(end) + span
    owner = row[a]
    return owner, value[place[a]], digests(raw.tobytes(), a, z), a - at[:-1][owner], z - a


def stretches(raw: np.ndarray, at: np.ndarray, span: int, most: int = STEP_BYTES):
    """(first row, offset in it, bytes, row bounds): some rows, or a stretch of a long one; stretches of one row share span - 1 bytes, so that each has all windows that start in it."""
    for i, j in steps(at, most):
        a, z = int(at[i]), int(at[j])
        if j - i > 1 or z - a <= 2 * most:
            yield i, 0, raw[a:z], at[i : j + 1] - a
            continue
        for b in range(a, z - span + 1, most):
            own = raw[b : min(z, b + most + span - 1)]
            yield i, b - a, own, np.array([0, len(own)])


def _anchor_rows(span: int):
    """Rows (h, d1, d2, doc, cid, start, size) of each anchor."""

    def run(batches):
        for batch in parts(batches, "text"):
            for i, offset, raw, at in stretches(*text_bytes(batch["text"]), span):
                row, h, digest, start, size = anchors(raw, at, span)
                place = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), batch["doc"].take(place), batch["cid"].take(place), pa.array(start + offset), pa.array(size.astype(np.int32))],
                    [*RUN, "doc", "cid", "start", "size"],
                )

    return run


def _rank(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    new = np.empty(len(keys), bool)
    new[:1] = True
    new[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new) - 1
    return out


class SuffixArray:
    """Enhanced suffix array over some byte strings: those suffixes that have ``span`` bytes, by what follows in their own string."""

    def __init__(self, strings: list[bytes], span: int = SPAN):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        longest = int(self.sizes.max(initial=0))
        self.at = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        symbols = np.full(int(self.at[-1]) + _SYMBOLS, 256, np.uint64)
        for s, a in zip(strings, self.at[:-1], strict=True):
            symbols[a : a + len(s)] = np.frombuffer(s, np.uint8)
        self.symbols = symbols
        n = int(self.at[-1])
        keys = np.zeros(n, np.uint64)
        for k in range(_SYMBOLS):
            keys = keys << U64(9) | symbols[k : k + n]
        # ranks by 7, 14, 28 ... symbols
        ranks, width = [_rank(keys)], _SYMBOLS
        while width < longest:
            r = ranks[-1]
            ahead = np.zeros(n, np.int64)
            ahead[: n - width] = r[width:].astype(np.int64) + 1
            ranks.append(_rank(r.astype(np.int64) << 32 | ahead))
            width *= 2
        string = np.repeat(np.arange(len(strings)), self.sizes + 1)
        room = self.at[string] + self.sizes[string] - np.arange(n)
        starts = np.flatnonzero(room >= span)
        self.order = starts[np.argsort(ranks[-1][starts])]
        self.string, self.room = string, room
        # common prefixes of neighbours, by descending powers and then single symbols
        i, j = self.order[:-1], self.order[1:]
        common = np.zeros(len(i), np.int64)
        most = np.minimum(room[i], room[j]) if len(i) else common
        for level in range(len(ranks) - 1, -1, -1):
            step = _SYMBOLS << level
            inside = (i + common < n) & (j + common < n) & (common + step <= most)
            same = np.zeros(len(i), bool)
            same[inside] = ranks[level][(i + common)[inside]] == ranks[level][(j + common)[inside]]
            common[same] += step
        for _ in range(_SYMBOLS):
            same = (common < most) & (symbols[np.minimum(i + common, n)] == symbols[np.minimum(j + common, n)])
            common[same] += 1
        self.common = common

    def maximal_repeats(self, span: int = SPAN):
        """(length, occurrences as (string, start)) of each common-prefix interval of ``span`` and more whose left bytes differ."""
        for length, places in self.intervals(span):
            yield length, [(int(s), int(p - self.at[s])) for s, p in zip(self.string[places], places, strict=True)]

    def groups(self, span: int = SPAN) -> tuple[np.ndarray, list[bytes]]:
        """Rows (number of the repeat, length, string, start) of all occurrences, and a digest of each repeat's bytes."""
        rows, names = [np.zeros((0, 4), np.int64)], []
        for length, places in self.intervals(span):
            string = self.string[places]
            rows.append(np.stack([np.full(len(places), len(names)), np.full(len(places), length), string, places - self.at[string]], 1))
            names.append(hashlib.blake2b(self.symbols[places[0] : places[0] + length].astype(np.uint8).tobytes(), digest_size=16).digest())
        return np.concatenate(rows), names

    def covered(self, span: int = SPAN) -> np.ndarray:
        """Rows (0, size, string, start) of the stretches that the maximal repeats cover; those that touch are one."""
        reach = np.zeros(int(self.at[-1]) + 1, np.int64)
        for length, places in self.intervals(span):
            reach[places] = np.maximum(reach[places], length)
        own = np.flatnonzero(reach)
        depth = np.zeros(len(reach) + 1, np.int64)
        np.add.at(depth, own, 1)
        np.add.at(depth, own + reach[own], -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(depth) > 0, [False]]).astype(np.int8)))
        first, end = edge[::2], edge[1::2]
        string = self.string[np.minimum(first, len(self.string) - 1)]
        return np.stack([np.zeros(len(first), np.int64), end - first, string, first - self.at[string]], 1)

    def intervals(self, span: int):
        """(length, places in the whole text) of the maximal repeats."""
        long = self.common >= span
        edge = np.flatnonzero(np.diff(np.concatenate([[False], long, [False]]).astype(np.int8)))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            yield from self._intervals(a, z)

    def _intervals(self, a: int, z: int):
        """Stack scan of the neighbours a..z-1, all of whose common prefixes are long."""
        places = self.order[a : z + 1]
        first = self.at[self.string[places]] == places  # nothing is known to the left of a string
        left = np.where(first, -1 - np.arange(len(places)), self.symbols[places - 1].astype(np.int64))
        stack: list[tuple[int, int]] = []  # (length, first place)
        for k in range(z - a + 1):
            now = int(self.common[a + k]) if k < z - a else 0
            begin = k
            while stack and stack[-1][0] > now:
                length, begin = stack.pop()
                if (left[begin : k + 1] != left[begin]).any():
                    yield length, places[begin : k + 1]
            if now and (not stack or stack[-1][0] < now):
                stack.append((now, begin))


def hulls(strings: list[bytes], span: int) -> list[tuple[int, int, int]]:
    """(string, start, end) of those strings that hold a window that any of them holds again: from the byte before the first such window to the end of the last.

    What lies outside can't be part of a repeat, so the suffix array is spared it.
    """
    sizes = np.array([len(x) for x in strings], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(len(strings)), np.maximum(sizes - span + 1, 0))
    if not len(owner):
        return []
    begin = np.flatnonzero(np.repeat(at[1:], sizes) - np.arange(len(raw)) >= span)
    hashed = mix(stretch(prefix_sums(raw, BYTE), begin, begin + span))
    order = np.argsort(hashed)
    same = hashed[order][1:] == hashed[order][:-1]
    again = np.zeros(len(begin), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    own, place = owner[again], begin[again]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(own)) - 1
    return [(int(k), max(0, int(a - at[k]) - 1), int(z - at[k]) + span) for k, a, z in zip(own[first], place[first], place[last], strict=True)]


def _compare(span: int, merged: bool):
    """Runs, sorted by hash, to the maximal repeats among them: a row for each repeat and run, or with ``merged`` for each stretch of a run that they cover; several hashes share one suffix array."""

    def repeats(tables: list[pa.Table]):
        table = pa.concat_tables(tables)
        # equal rows of the table gave their runs more than once
        keys = np.stack([table[c].to_numpy() for c in RUN], 1)
        table = table.take(pa.array(np.sort(np.unique(keys, axis=0, return_index=True)[1])))
        strings = [x.as_py() for x in table["run"]]
        kept = hulls(strings, span)
        array = SuffixArray([strings[k][a:z] for k, a, z in kept], span)
        flat, names = (array.covered(span), [b""]) if merged else array.groups(span)
        index = np.array(kept, np.int64).reshape(-1, 3)
        own, offset = index[flat[:, 2], 0], flat[:, 3] + index[flat[:, 2], 1]
        rows = table.select([*RUN, "n", "doc", "cid", "start"]).take(pa.array(own)).combine_chunks()
        made = {"repeat": pa.array(names, pa.binary()).take(pa.array(flat[:, 0])), "length": pa.array(flat[:, 1]), "offset": pa.array(offset)}
        for name, column in made.items():
            rows = rows.append_column(name, column)
        yield from rows.to_batches()

    def run(batches):
        held: list[pa.Table] = []
        total = 0
        for group in groups(batches, "h"):
            held.append(group)
            total += int(sum(len(x.as_buffer()) for x in group["run"]))
            if total > ARRAY_BYTES:
                yield from repeats(held)
                held, total = [], 0
        if held:
            yield from repeats(held)

    return run


def _cut_runs(batches):
    """The bytes of each wanted run of a text."""
    for batch in parts(batches, "text"):
        out = {c: [] for c in (*RUN, "n", "doc", "cid", "start", "run")}
        for text, doc, cid, wanted in zip(batch["text"], batch["doc"].to_pylist(), batch["cid"].to_pylist(), batch["runs"].to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            for w in wanted:
                for c in (*RUN, "n", "start"):
                    out[c].append(w[c])
                out["doc"].append(doc)
                out["cid"].append(cid)
                out["run"].append(raw[w["start"] : w["start"] + w["size"]])
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "run" else pa.int64()) for c, v in out.items()], list(out))


def _windows(batch: pa.RecordBatch, span: int):
    """(row, digests of all windows, their offsets) of the runs of a batch."""
    for k, raw in enumerate(batch["run"]):
        own = raw.as_buffer().to_pybytes()
        at = np.arange(len(own) - span + 1)
        yield k, digests(own, at, at + span), at


def _prefix_counts(span: int):
    """(h, w1, w2, n): how often each prefix begins a suffix of the runs of a hot hash, combined over a few MB."""

    def run(batches):
        for batch in parts(batches, "run"):
            h = batch["h"].to_numpy()
            flat = np.concatenate([np.zeros((0, 3), np.int64), *(np.concatenate([np.full((len(at), 1), h[k]), found], 1) for k, found, at in _windows(batch, span))])
            own, n = np.unique(flat, axis=0, return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": own[:, 0], "w1": own[:, 1], "w2": own[:, 2], "n": n})

    return run


def _prefixed(span: int, merged: bool, often=None):
    """Of runs of hot hashes: a row for each suffix that begins with a prefix in ``often`` (broadcast, sorted; None: for every suffix, with w1 and w2); ``merged``: for each stretch that these cover."""
    key = [*RUN, "n", "doc", "cid", "start"]

    def run(batches):
        for batch in parts(batches, "run"):
            rows, names, length, offset = [], [], [], []
            for k, found, at in _windows(batch, span):
                hit = at
                if often is not None:
                    first = np.searchsorted(often.value[:, 0], found[:, 0])
                    # digests whose first halves are equal stand together
                    known = [any((often.value[f + d] == w).all() for d in range(8) if f + d < len(often.value) and often.value[f + d, 0] == w[0]) for f, w in zip(first.tolist(), found, strict=True)]
                    hit = at[np.array(known, bool)]
                starts = hit
                if merged and len(hit):
                    new = np.concatenate([[True], np.diff(hit) > span])
                    last = np.append(np.flatnonzero(new)[1:], len(hit)) - 1
                    starts = hit[new]
                    length += (hit[last] + span - starts).tolist()
                else:
                    length += [span] * len(starts)
                rows += [k] * len(starts)
                offset += starts.tolist()
                names.append(found[starts])
            place, names = pa.array(rows, pa.int64()), np.concatenate([np.zeros((0, 2), np.int64), *names])
            yield pa.RecordBatch.from_arrays([*(batch[c].take(place) for c in key), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(length, pa.int64()), pa.array(offset, pa.int64())], [*key, "w1", "w2", "length", "offset"])

    return run


def _with_texts(keyed: DataFrame, table: DataFrame, spans: str, how: str = "inner") -> DataFrame:
    """Join stored rows (doc, cid, array of spans), one for each text that has any, to the texts: by broadcast if all spans are few, else by a shuffle of both."""
    few = (table.agg(F.sum(F.size(spans))).first()[0] or 0) <= BROADCAST_SPANS
    return keyed.join(F.broadcast(table) if few else table, ["doc", "cid"], how)


def _repeats(docs: DataFrame, span: int, hot_runs: int, folder: str, merged: bool = False) -> tuple[DataFrame, DataFrame]:
    """The repeats that different runs have in common, and the members of the runs that occur again.

    Repeats are rows (repeat, length, h, d1, d2, n, doc, cid, start, offset): of
    each run one member, where it starts, and the place of the repeat in it.
    Members are rows (h, d1, d2, doc, cid, start, size, n); n counts equal runs.
    With ``merged``, the stretches of runs that repeats cover are given in their
    place.
    """
    texts = docs.select("doc", "cid", "text").where(F.octet_length("text") >= span)
    found = stored(texts.mapInArrow(_anchor_rows(span), "h long, d1 long, d2 long, doc long, cid long, start long, size int"), folder, "anchors")
    shared = found.groupBy("h").agg(F.count("*").alias("total"), (F.min("d1") < F.max("d1")).alias("mixed")).where("total > 1").select("h", "total", "mixed")
    # stored first, so that the join can split a hash that very many runs have
    shared = stored(shared, folder, "shared")
    marked = stored(found.join(shared, "h"), folder, "marked")
    # where all runs of a hash are equal, there is nothing to compare
    equal = marked.where("NOT mixed").select(*RUN, "doc", "cid", "start", "size", F.col("total").alias("n"))
    mixed = marked.where("mixed").drop("total", "mixed")
    one = F.min(F.struct("doc", "cid", "start", "size")).alias("one")
    runs = stored(mixed.groupBy(*RUN).agg(F.count("*").alias("n"), one).select(*RUN, "n", "one.*"), folder, "runs")
    hot = stored(runs.groupBy("h").count().where(F.col("count") > hot_runs).select("h"), folder, "hot")
    wanted = runs.groupBy("doc", "cid").agg(F.collect_list(F.struct(*RUN, "n", "start", "size")).alias("runs"))
    wanted = stored(wanted, folder, "wanted")
    keyed = texts.withColumn("text", F.col("text").cast("binary"))
    cut = _with_texts(keyed, wanted, "runs").select("doc", "cid", "text", "runs").mapInArrow(_cut_runs, "h long, d1 long, d2 long, n long, doc long, cid long, start long, run binary")
    cut = stored(cut, folder, "cut")
    key = "h long, d1 long, d2 long, n long, doc long, cid long, start long"
    names = ["repeat", "length", *RUN, "n", "doc", "cid", "start", "offset"]
    cold = cut if hot.isEmpty() else cut.join(hot, "h", "left_anti")
    repeats = cold.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(span, merged), f"{key}, repeat binary, length long, offset long").select(names)
    if not hot.isEmpty():
        runs_of_hot = stored(cut.join(hot, "h", "left_semi").dropDuplicates(RUN), folder, "hot-runs")
        often = runs_of_hot.select("h", "run").mapInArrow(_prefix_counts(span), "h long, w1 long, w2 long, n long").groupBy("h", "w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
        often = stored(often, folder, "often")
        shape = f"{key}, w1 long, w2 long, length long, offset long"
        if often.count() <= PREFIXES:
            rows = often.select("w1", "w2").distinct().orderBy("w1", "w2").toArrow()
            known = docs.sparkSession.sparkContext.broadcast(np.stack([rows["w1"].to_numpy(), rows["w2"].to_numpy()], 1).reshape(-1, 2))
            found = runs_of_hot.mapInArrow(_prefixed(span, merged, known), shape)
        else:
            found = runs_of_hot.mapInArrow(_prefixed(span, False), shape).join(often, ["h", "w1", "w2"], "left_semi")
        name = F.concat(*(F.to_binary(F.lpad(F.hex(c), 16, "0"), F.lit("hex")) for c in ("w1", "w2")))
        repeats = repeats.union(found.withColumn("repeat", name).select(names))
    members = equal.unionByName(mixed.join(runs.select(*RUN, "n"), RUN))
    return stored(repeats, folder, "repeats"), members


def repeat_groups(docs: DataFrame, *, span: int = SPAN, hot_runs: int = HOT_RUNS, folder: str | None = None) -> DataFrame:
    """Rows (repeat, length, doc, cid, start): all occurrences of every maximal repeat; ``repeat`` identifies its bytes.

    ``docs`` has doc (long), cid (a 64-bit hash of the text) and text.
    """
    repeats, members = _repeats(docs, span, hot_runs, folder or shared_dir(docs.sparkSession))
    whole = F.concat(*(F.to_binary(F.lpad(F.hex(c), 16, "0"), F.lit("hex")) for c in ("d1", "d2")))
    equal = members.where("n > 1").select(whole.alias("repeat"), F.col("size").cast("long").alias("length"), "doc", "cid", "start")
    among = repeats.select("repeat", "length", *RUN, "offset").join(members.select(*RUN, "doc", "cid", "start"), RUN)
    return equal.union(among.select("repeat", "length", "doc", "cid", (F.col("start") + F.col("offset")).alias("start")))


def repeated_spans(docs: DataFrame, *, span: int = SPAN, hot_runs: int = HOT_RUNS, folder: str | None = None) -> DataFrame:
    """Rows (doc, cid, start, size): the stretches of texts that the repeat groups cover.

    Runs that occur again are covered whole, so of the repeats among different
    runs only those in runs of one member add anything.
    """
    repeats, members = _repeats(docs, span, hot_runs, folder or shared_dir(docs.sparkSession), merged=True)
    equal = members.where("n > 1").select("doc", "cid", "start", F.col("size").cast("long").alias("size"))
    return equal.union(repeats.where("n = 1").select("doc", "cid", (F.col("start") + F.col("offset")).alias("start"), F.col("length").alias("size")))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _kept(batches):
    for batch in parts(batches, "text"):
        size, removed, runs, kept = [], [], [], []
        for text, starts, ends in zip(batch["text"], batch["starts"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans = _merged(list(zip(starts or [], ends or [], strict=True)))
            at, left = 0, hashlib.sha256()
            for a, z in spans:
                left.update(raw[at:a])
                at = z
            left.update(raw[at:])
            size.append(len(raw))
            removed.append(sum(z - a for a, z in spans))
            runs.append(len(spans))
            kept.append(left.hexdigest())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, *, span: int = SPAN, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    folder = shared_dir(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64(text).alias("cid"))
    spans = repeated_spans(keyed, span=span, hot_runs=hot_runs, folder=folder)
    # stretches of a text that touch are one, before they are gathered
    order = Window.partitionBy("doc", "cid").orderBy("start", "end")
    ends = spans.select("doc", "cid", "start", (F.col("start") + F.col("size")).alias("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = ends.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("doc", "cid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gathered = merged.groupBy("doc", "cid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    gathered = stored(gathered.select("doc", "cid", "spans.start", "spans.end").toDF("doc", "cid", "starts", "ends"), folder, "spans")
    joined = _with_texts(keyed.withColumn("text", F.col("text").cast("binary")), gathered, "starts", "left")
    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes under repeated 200-byte strings."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
