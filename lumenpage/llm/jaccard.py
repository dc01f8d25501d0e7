"""N-gram Jaccard join as a join in a metric space.

Texts become words (runs without ASCII white space, A-Z as a-z) and sets of
shingles; the distance is 1 - Jaccard similarity. Pivots create regions, the
triangle inequality says how far a region must look over its border, and
regions are joined recursively:

1. Equal sets are one class (distance 0) and take part once.
2. The first pivots are the shingles themselves, as sets of one: their distance
   to a set is below 1 if it holds them. A set is nearest to all of its shingles
   alike, so a total order decides, common shingles last. As the distance of
   near sets is bounded, the triangle inequality bounds how far down its order
   the first common shingle can stand: n - ceil(t * n) places. A set is
   replicated to all regions up to there; near sets meet in one at least.
   Near sets are of one band of sizes or of neighbouring ones, so a region is a
   shingle with a band and the next larger one; texts that share a shingle by
   chance, whose number grows with the square of the input, seldom have such
   sizes. As the smaller of two near sets has at least 2 t / (1 + t) of its
   shingles in common with the other, the first common one stands higher up in
   it, and a region without a set of the lower band that has it there is none.
   Regions are named by their smallest member and those of one name are a cell.
   They are found by an aggregate and a join, so that a shingle that very many
   sets share is combined before it moves, and its rows can be split. The
   aggregate takes ``SLICES`` turns, each for a part of the shingles.
3. In a cell of up to ``MEMBERS`` sets, the windows bound the similarity of any
   two, and who has no partner left is dropped before whole sets are read; of a
   larger one, too, by pairs of blocks; of one beyond ``BLOCKED`` times that all
   members stay. Windows go to the cells in turns, each of ``TURN`` windows for
   every set, so the disk that they take is in proportion to the input. What is left is joined by the components of who might be near
   whom, so that each whole set moves once.
4. Within a cell, document pivots (each the farthest from those before it) cut
   Voronoi regions: a member goes to its nearest pivot, and to every pivot whose
   distance is within twice the threshold of that, as near sets can't lie
   farther apart. Members near a pivot are linked to it. A region whose members
   are connected is done; the others are cut again. Where pivots no longer part
   the members, those that aren't connected are compared one by one, by what the
   distances to the pivots leave possible.
5. A cell of more than ``MEMBERS`` sets, or ``CELL`` shingles, is cut in the same
   way by Spark, its rows salted, so a group of near copies of any size is
   compared to its pivots by many tasks; what is left of it goes on as above. What
   doesn't shrink is joined as pairs of blocks, of the members that aren't
   connected with all.

The result is exact at every step. Links become components. A text of fewer
words than a shingle is one shingle of all its words; without words (or null) it
has an empty set and no links. Rows with the same doc_id are one document as far
as links go, whatever their texts; a null doc_id has no component and no links.
Repeated rows give a row each; an empty table none. Ties of size or distance
stand by id. A text of any length is one set, sorted in memory at 16 bytes a
word. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.llm.common import U64, bit_map, free_shuffles, groups, in_bit_map, mix, parts, shared_dir, shingle_hashes, steps, stored, text_bytes, word_hashes
from lumenpage.llm.components import components

#: Shingles that may be known as common (8 bytes each, broadcast); this orders work only.
COMMON = 1 << 17
#: A shingle counts as common from so many of the texts in about 16 MB.
COMMON_LEAST = 4
#: Rows of ids up to which a semi-join may broadcast them.
BROADCAST_IDS = 500_000
#: Sets and shingles that a cell may hold in one task, pivots that cut one, and members up to which all pairs are compared.
MEMBERS, CELL, PIVOTS, LEAF = 1000, 4_000_000, 8, 6
#: Turns (a power of two) in which regions are found; the files of one are freed before the next.
SLICES = 2
#: Windows for each set that move at once to the cells.
TURN = 2
#: Times MEMBERS up to which the windows of a cell are compared, as pairs of blocks.
BLOCKED = 20
_TOP = U64(1 << 63)


def shingle_sets(texts: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text."""
    raw, at = text_bytes(texts)
    for i, j in steps(at):
        words, _, _, first = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        hashed = shingle_hashes(words, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                own = np.sort(hashed[a : b - size + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                total = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    total = mix(total + w)
                yield total
            else:
                yield np.zeros(0, np.uint64)


def _key(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of many texts, in ascending order; bounded by COMMON."""

    def run(batches):
        held: list[np.ndarray] = []

        def counted():
            own, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= COMMON_LEAST
            return pa.RecordBatch.from_pydict({"s": own[often].view(np.int64), "n": n[often]})

        total = 0
        for batch in parts(batches, "text"):
            for own in shingle_sets(batch["text"], size):
                held.append(own)
                total += len(own)
                if total > 3_000_000:
                    yield counted()
                    held, total = [], 0
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "s").limit(COMMON).select("s").toArrow()
    return np.sort(rows["s"].to_numpy().view(np.uint64))


def _sets(docs: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """(doc_id, n, key, prefix): prefix holds the window of the set by the total order, as bytes of uint64."""

    def run(batches):
        for batch in parts(batches, "text"):
            n, key, prefix = [], [], []
            for own in shingle_sets(batch["text"], size):
                n.append(len(own))
                key.append(_key(own))
                if not len(own):
                    prefix.append(None)
                    continue
                often = np.zeros(len(own), bool)
                if len(common):
                    often = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
                order = np.sort((own >> U64(1)) | np.where(often, _TOP, U64(0)))
                prefix.append(order[: len(own) - -(-percent * len(own) // 100) + 1].tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "n", "key", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, prefix binary")


def size_bands(n: np.ndarray, percent: int) -> np.ndarray:
    """Bands of set sizes; those of near sets differ by one at most."""
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    return np.floor(np.log(n) / width).astype(np.int64)


def _windows(percent: int, part: int | None = None, known=None):
    """(s, id, low) for each place of a window and each of its two bands.

    ``s`` names the shingle with the lower band; ``low`` are those that the
    smaller of two near sets can first share there. With ``part``, the shingles
    of one slice; with a bit map, the names that it knows.
    """

    def run(batches):
        for batch in parts(batches, "prefix"):
            raw = [x.as_py() for x in batch["prefix"]]
            n, sizes = batch["n"].to_numpy(), np.array([len(x) // 8 for x in raw])
            places = np.frombuffer(b"".join(raw), np.uint64)
            at = np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            low = at <= np.repeat(n - -(-2 * percent * n // (100 + percent)), sizes)
            ids, band = np.repeat(batch["id"].to_numpy(), sizes), np.repeat(size_bands(n, percent), sizes)
            if part is not None:
                own = places & U64(SLICES - 1) == U64(part)
                places, low, ids, band = places[own], low[own], ids[own], band[own]
            for down in (0, 1):
                s, id_, first = mix(places ^ mix((band - down).view(np.uint64))).view(np.int64), ids, low & (down == 0)
                if known is not None:
                    held = in_bit_map(known.value, s)
                    s, id_, first = s[held], ids[held], first[held]
                yield pa.RecordBatch.from_pydict({"s": s, "id": id_, "low": first})

    return run


def _near(a: np.ndarray, b: np.ndarray, inter: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def _halves(batches):
    """The upper halves of a window's order values: they keep the order, but for ties."""
    for batch in parts(batches, "prefix"):
        short = [(np.frombuffer(x.as_py(), np.uint64) >> U64(32)).astype(np.uint32).tobytes() for x in batch["prefix"]]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["n"], pa.array(short, pa.binary())], ["id", "n", "prefix"])


class Postings:
    """Which of some sorted arrays hold the values that an array has."""

    def __init__(self, arrays: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in arrays])
        self.flat = np.concatenate(arrays)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        owner = np.repeat(np.arange(len(arrays)), self.sizes)
        order = np.argsort(self.flat, kind="stable")
        edge = np.concatenate([[True], self.flat[order][1:] != self.flat[order][:-1]])
        self.term = np.empty(len(self.flat), np.int64)
        self.term[order] = np.cumsum(edge) - 1
        self.first = np.flatnonzero(edge)
        self.count = np.diff(np.append(self.first, len(self.flat)))
        self.owners = owner[order]

    def common(self, x: int) -> np.ndarray:
        """For each array, how many values it has in common with array x."""
        mine = self.term[self.at[x] : self.at[x + 1]]
        n = self.count[mine]
        place = np.repeat(self.first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owners[place], minlength=len(self.sizes))


def hopeful_links(ids: np.ndarray, n: np.ndarray, windows: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect sets which might be near, by the halves of their windows.

    Where the window of one ends before that of the other, what it holds and the
    other doesn't is surely missing there, and the reverse holds up to its end;
    this bounds what two sets have in common. Equal halves count as equal.
    """
    m = len(windows)
    postings = Postings(windows)
    keys = np.repeat(np.arange(m), postings.sizes).astype(np.uint64) << U64(32) | postings.flat.astype(np.uint64)
    last = np.array([w[-1] for w in windows], np.uint64)
    label, links = np.arange(m), []
    for x in range(m - 1):
        both = postings.common(x)
        y = np.flatnonzero(both)
        y = y[(y > x) & (label[y] != label[x])]
        y = y[100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])]
        if not len(y):
            continue
        both = both[y]
        # a is the one whose window ends first; of b only what lies before that end is known to lie in both or be missing
        mine = last[x] <= last[y]
        end, other = np.where(mine, last[x], last[y]), np.where(mine, y, x)
        before = np.searchsorted(keys, other.astype(np.uint64) << U64(32) | end) - postings.at[other]
        na, nb = np.where(mine, n[x], n[y]), np.where(mine, n[y], n[x])
        size_a = np.where(mine, postings.sizes[x], postings.sizes[y])
        most = np.minimum(na - np.maximum(size_a - both, 0), nb - np.maximum(before - both, 0))
        most = np.where(last[x] == last[y], np.minimum(na, nb), most)
        for k in y[_near(na, nb, most, percent)].tolist():
            if label[k] != label[x]:
                links.append((int(ids[x]), int(ids[k])))
                label[label == label[k]] = label[x]
    return links


def _hopeful(percent: int):
    """For each cell: links between its members that might be near."""

    def run(batches):
        for cell in groups(batches, "cell"):
            links = hopeful_links(cell["id"].to_numpy(), cell["n"].to_numpy(), [np.frombuffer(x.as_py(), np.uint32) for x in cell["prefix"]], percent) if cell.num_rows > 1 else []
            flat = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": flat[:, 0], "b": flat[:, 1]})

    return run


def join_sets(ids: np.ndarray, sets: list[np.ndarray], percent: int, settled: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is near among the sets; ``settled`` ones are connected already."""
    m = len(sets)
    n = np.array([len(x) for x in sets])
    if m == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if _near(n[0], n[1], inter, percent) else []
    postings = Postings(sets)
    label, links = np.arange(m), []
    if settled is not None and settled.any():
        label[settled] = np.flatnonzero(settled)[0]
    slack = 1 - percent / 100 + 1e-9

    def compared(x: int, region: np.ndarray) -> np.ndarray:
        """Distances of a region to set x; what is near is linked."""
        inter = postings.common(x)[region]
        for y in region[_near(n[x], n[region], inter, percent) & (label[region] != label[x])].tolist():
            if label[y] != label[x]:
                links.append((int(ids[x]), int(ids[y])))
                label[label == label[y]] = label[x]
        return 1 - inter / (n[x] + n[region] - inter)

    def one_by_one(region: np.ndarray, far: np.ndarray) -> None:
        """Compare what isn't connected, smaller groups first; ``far`` has the distances to some pivots."""
        waiting = np.ones(len(region), bool)
        while True:
            own, sizes = np.unique(label[region[waiting]], return_counts=True)
            if len(own) < 2:
                # what waits is one group; the rest was compared with everything
                return
            k = int(np.flatnonzero(waiting & (label[region] == own[np.argmin(sizes)]))[0])
            waiting[k] = False
            open_ = (label[region] != label[region[k]]) & (np.abs(far - far[k]).max(1, initial=0) <= slack)
            if open_.any():
                compared(int(region[k]), region[open_])

    stack = [np.arange(m)]
    while stack:
        region = stack.pop()
        if (label[region] == label[region[0]]).all():
            continue
        if len(region) <= LEAF:
            one_by_one(region, np.zeros((len(region), 0)))
            continue
        # each pivot is the farthest from those before it
        pivot, far = 0, []
        while len(far) < PIVOTS:
            far.append(compared(int(region[pivot]), region))
            nearest = np.min(far, axis=0)
            pivot = int(np.argmax(nearest))
            if nearest[pivot] <= 0:
                break
        far = np.stack(far, 1)
        within = far <= far.min(1, keepdims=True) + 2 * slack
        cut = [region[own] for own in within.T]
        cut = [own for own in cut if (label[own] != label[own[0]]).any()]
        if sum(map(len, cut)) <= 2 * len(region) and all(len(own) < len(region) for own in cut):
            stack += cut
        else:
            one_by_one(region, far)
    return links


def _join_cells(percent: int, key: str = "cell"):
    """Links of the cells, whose rows have id, members and settled."""

    def run(batches):
        for cell in groups(batches, key):
            ids = cell["id"].to_numpy()
            order = np.unique(ids, return_index=True)[1]
            column = cell["members"].combine_chunks() if cell["members"].num_chunks > 1 else cell["members"].chunk(0)
            sets = [np.frombuffer(column[int(k)].as_py(), np.uint64) for k in order]
            settled = cell["settled"].to_numpy()[order]
            links = join_sets(ids[order], sets, percent, settled) if len(order) > 1 else []
            flat = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": flat[:, 0], "b": flat[:, 1]})

    return run


def _cut(percent: int):
    """Members with the pivots of their cell: (cell, part, id, size, settled, linked) by Voronoi regions and windows, and links to near pivots."""
    slack = 2 * (1 - percent / 100) + 1e-9
    names = ["cell", "part", "id", "size", "settled", "linked", "a", "b"]

    def run(batches):
        for batch in parts(batches, "members"):
            rows = []
            for cell, own, raw, settled, pivots in zip(batch["cell"].to_pylist(), batch["id"].to_pylist(), batch["members"], batch["settled"].to_pylist(), batch["pivots"].to_pylist(), strict=True):
                mine = np.frombuffer(raw.as_py(), np.uint64)
                found = []
                for p in pivots:
                    other = np.frombuffer(p["members"], np.uint64)
                    inter = len(np.intersect1d(mine, other, assume_unique=True))
                    found.append((1 - inter / (len(mine) + len(other) - inter), _near(len(mine), len(other), inter, percent), p["id"]))
                    if found[-1][1] and p["id"] != own:
                        rows.append((None,) * 6 + (own, p["id"]))
                least = min(found)[0]
                rows += [(cell, p, own, len(mine), settled, bool(near), None, None) for d, near, p in found if d <= least + slack]
            kinds = [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names)

    return run


def _sorted_cells(members: DataFrame, *key: str) -> DataFrame:
    return members.repartition(*key).sortWithinPartitions(*key)


def _exact(members: DataFrame, counts: DataFrame, whole, percent: int, folder: str, limit: tuple[int, int], level: int = 0) -> DataFrame:
    """Links (a, b) within the cells of the stored ``members`` (cell, id, settled).

    ``counts`` has (id, n); ``whole`` adds the column members, the bytes of the
    set, to such rows. The settled ones of a cell are connected already.
    """
    sized = members.join(counts, "id").groupBy("cell").agg(F.sum("n").alias("total"), F.count("*").alias("count"))
    large = stored(sized.where((F.col("count") > limit[0]) | (F.col("total") > limit[1])), folder, f"oversize-{level}", few=True)
    if large.isEmpty():
        return _sorted_cells(whole(members), "cell").mapInArrow(_join_cells(percent), "a long, b long")
    fitting = stored(members.join(large, "cell", "left_anti"), folder, f"fitting-{level}", few=True)
    links = _sorted_cells(whole(fitting), "cell").mapInArrow(_join_cells(percent), "a long, b long")
    big = stored(whole(stored(members.join(large, "cell", "left_semi"), folder, f"big-ids-{level}", few=True)), folder, f"big-{level}")
    # pivots by the least hash of the id, from what isn't settled; the level changes the choice
    chances = [F.min_by("id", F.xxhash64("id", F.lit(PIVOTS * level + k))) for k in range(PIVOTS)]
    chosen = big.where("NOT settled").groupBy("cell").agg(F.array_distinct(F.array(*chances)).alias("ids")).select("cell", F.explode("ids").alias("id"))
    pivots = big.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen, ["cell", "id"]).dropDuplicates(["cell", "id"])
    pivots = stored(pivots.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("id", "members"))).alias("pivots")), folder, f"pivots-{level}", few=True)
    # a large cell is one key: its rows are salted, and its few pivots repeated
    salt = 64
    salted = big.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salt)))
    repeated = pivots.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salt - 1}L)")))
    cut = salted.join(repeated, ["cell", "salt"]).select("cell", "id", "members", "settled", "pivots")
    cut = stored(cut.mapInArrow(_cut(percent), "cell long, part long, id long, size long, settled boolean, linked boolean, a long, b long"), folder, f"cut-{level}")
    links = links.union(cut.where("a IS NOT NULL").select("a", "b"))
    rows = cut.where("cell IS NOT NULL").withColumn("region", F.xxhash64("cell", "part", F.lit(level)))
    old, new = F.col("settled"), F.col("linked")
    regions = rows.groupBy("cell", "region").agg(
        F.count("*").alias("now"), F.count_if(old).alias("old"), F.count_if(new & ~old).alias("new"), F.count_if(new & old).alias("both"), F.count_if(~new & ~old).alias("open")
    )
    # who is near the pivot and who was settled are one group if they share a member; else the larger group stays settled
    joined = (F.col("both") > 0) | (F.col("old") == 0)
    kept = F.when(joined, "all").when(F.col("old") >= F.col("new"), "old").otherwise("new")
    left = F.when(joined, F.col("open")).otherwise(F.col("open") + F.least("old", "new"))
    regions = regions.join(large.select("cell", "count"), "cell").select("region", "now", "count", kept.alias("kept"), left.alias("left")).where("left > 0")
    regions = stored(regions, folder, f"regions-{level}", few=True)
    go_on = rows.join(F.broadcast(regions) if regions.count() <= BROADCAST_IDS else regions, "region")
    settled = F.when(F.col("kept") == "all", old | new).when(F.col("kept") == "old", old).otherwise(new)
    go_on = stored(go_on.select(F.col("region").alias("cell"), "id", settled.alias("settled"), (F.col("now") <= 0.7 * F.col("count")).alias("shrunk")), folder, f"regions-of-{level}", few=True)
    again, stuck = (go_on.where(c).select("cell", "id", "settled") for c in ("shrunk", "NOT shrunk"))
    if not again.isEmpty():
        links = links.union(_exact(again, counts, whole, percent, folder, limit, level + 1))
    if not stuck.isEmpty():
        links = links.union(_blocks(stuck, counts, whole, percent, limit, folder, level))
    return links


def _blocks(members: DataFrame, counts: DataFrame, whole, percent: int, limit: tuple[int, int], folder: str, level: int) -> DataFrame:
    """Join cells as pairs of blocks within the limit: each block of what isn't settled, with every block."""
    sized = members.join(counts, "id")
    need = lambda test: F.greatest(F.lit(1), F.ceil(2 * F.sum(F.when(test, F.col("n"))) / limit[1]), F.ceil(2 * F.count_if(test) / limit[0]))
    count = sized.groupBy("cell").agg(need(F.lit(True)).alias("blocks"), F.coalesce(need(~F.col("settled")), F.lit(1)).alias("open_blocks"))
    placed = sized.join(count, "cell")
    of = lambda blocks, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(blocks))
    upto = lambda blocks: F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)
    with_open = F.transform(upto("open_blocks"), lambda o: F.xxhash64("cell", o, of("blocks", 1)))
    as_open = F.when(~F.col("settled"), F.transform(upto("blocks"), lambda b: F.xxhash64("cell", of("open_blocks", 2), b))).otherwise(F.array().cast("array<bigint>"))
    rows = stored(placed.select(F.explode(F.array_distinct(F.concat(with_open, as_open))).alias("cell"), "id", "settled"), folder, f"blocks-{level}")
    return _sorted_cells(whole(rows), "cell").mapInArrow(_join_cells(percent), "a long, b long")


def _few(table: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it is small; else a join shuffles both sides."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _classes(sets: DataFrame, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, doc_id, id) of each set: its smallest doc_id and an id of its own; and the doc_ids with several sets, if any.

    The id is the doc_id. Where that has several sets, it is a hash of the key,
    under the first seed by which all ids differ.
    """
    rows = sets.where("doc_id IS NOT NULL")
    several = stored(rows.select("doc_id", "key").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id"), folder, "several", few=True)
    least = stored(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")), folder, "classes")
    if several.isEmpty():
        return least.withColumn("id", F.col("doc_id")), None
    marked = least.join(_few(several.withColumn("mixed", F.lit(True))), "doc_id", "left")
    for seed in itertools.count():
        own = F.when(F.col("mixed"), F.xxhash64("key", F.lit(seed))).otherwise(F.col("doc_id"))
        classes = stored(marked.select("key", "doc_id", own.alias("id")), folder, f"classes-{seed}")
        if classes.groupBy("id").count().where("count > 1").isEmpty():
            return classes, several


def _linked(docs: DataFrame, size: int, percent: int, limit: tuple[int, int], folder: str, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The stored sets of all rows; per key the smallest doc_id of its component and whether the key is the first of that; doc_ids with several sets.

    With ``by_id``, sets of one doc_id are linked too.
    """
    common = common_shingles(docs, size)
    sets = stored(_sets(docs, size, percent, common), folder, "sets")
    named = sets.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes, several = _classes(sets, folder)
    # of rows with equal sets, one stands for all; what is left over is few, or else shuffled
    copies = named.select("key", "doc_id").join(classes.select("key", F.col("doc_id").alias("least")), "key").where("doc_id <> least")
    on = ["key", "doc_id"] if several else ["doc_id"]
    copies = stored(copies.select(on).distinct(), folder, "copies", few=True)
    holders = named.select("key", "doc_id", "n", "prefix").join(_few(copies), on, "left_anti")
    if several:
        holders = holders.join(_few(classes.where("id <> doc_id").select("key", "id")), "key", "left").withColumn("id", F.coalesce("id", "doc_id"))
    else:
        holders = holders.withColumn("id", F.col("doc_id"))
    counts = holders.groupBy("id").agg(F.max("n").alias("n"))
    # the smallest member names a region; a shingle of one set, or of sets of other sizes, makes none
    windows = holders.select("id", "n", "prefix")
    found = []
    for part in range(SLICES):
        rows = windows.mapInArrow(_windows(percent, part), "s long, id long, low boolean").groupBy("s").agg(F.min("id").alias("cell"), F.max("id").alias("last"), F.max("low").alias("low"))
        found.append(stored(rows.where("low AND cell < last").select("s", "cell"), folder, f"shared-{part}"))
        free_shuffles(docs.sparkSession)
    regions = functools.reduce(DataFrame.union, found)
    known = docs.sparkSession.sparkContext.broadcast(bit_map(regions, "s"))
    met = windows.mapInArrow(_windows(percent, known=known), "s long, id long, low boolean").join(regions, "s").where("id <> cell").select("cell", "id").distinct()
    met = stored(met, folder, "met", few=True)
    free_shuffles(docs.sparkSession)
    beside = met.union(met.select("cell", F.col("cell").alias("id")).distinct())
    crowded = stored(beside.groupBy("cell").count().where(F.col("count") > limit[0]), folder, "crowded", few=True)
    # a crowded cell, as of what long texts share by chance, is joined as pairs of blocks; one of a very large group goes on whole
    blocks, own = F.ceil(2 * F.col("count") / limit[0]), F.pmod(F.xxhash64("id"), F.col("blocks"))
    paired = beside.join(_few(crowded.where(F.col("count") <= BLOCKED * limit[0]).select("cell", blocks.alias("blocks"))), "cell")
    paired = paired.select("cell", "id", own.alias("own"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    paired = paired.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "id")
    sparse = beside.join(_few(crowded), "cell", "left_anti").union(paired)
    # windows move once for each cell they are in: cells take turns, so that what moves at once stays in proportion to the input
    turns = int(sparse.count() // max(1, TURN * classes.count())) + 1
    hopes = []
    for turn in range(turns):
        now = sparse.where(F.pmod(F.xxhash64("cell"), F.lit(turns)) == turn)
        ids = stored(now.select("id").distinct(), folder, f"beside-ids-{turn}", few=True)
        halves = windows.join(_few(ids), "id", "left_semi").mapInArrow(_halves, "id long, n long, prefix binary")
        hopes.append(stored(_sorted_cells(now.join(halves, "id"), "cell").mapInArrow(_hopeful(percent), "a long, b long"), folder, f"hopeful-{turn}", few=True))
        free_shuffles(docs.sparkSession)
    whole_cells = beside.join(_few(crowded.where(F.col("count") > BLOCKED * limit[0])), "cell", "left_semi").select(F.col("cell").alias("a"), F.col("id").alias("b"))
    # what might be near, over all cells, is joined as one cell, so that each whole set moves once
    merged = components(functools.reduce(DataFrame.union, hopes, whole_cells), f"{folder}/cells")
    merged = stored(merged.select(F.col("component").alias("cell"), "id", F.lit(False).alias("settled")).distinct(), folder, "merged", few=True)

    def add_sets(batches):
        for batch in parts(batches, "text"):
            own = [s.tobytes() for s in shingle_sets(batch["text"], size)]
            rows = pa.RecordBatch.from_arrays([batch["cell"], batch["id"], batch["settled"], pa.array(own, pa.binary())], ["cell", "id", "settled", "members"])
            yield rows.filter(pa.array([len(s) > 0 for s in own], pa.bool_()))

    def keyed_sets(batches):
        for batch in parts(batches, "text"):
            own = list(shingle_sets(batch["text"], size))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(map(_key, own), pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], ["doc_id", "key", "members"])

    def whole(rows: DataFrame) -> DataFrame:
        if several:
            keyed = rows.join(classes, "id").select("cell", "id", "settled", "key", "doc_id")
            texts = docs.select("doc_id", "text").join(_few(keyed.select("doc_id").distinct()), "doc_id", "left_semi")
            return texts.mapInArrow(keyed_sets, "doc_id long, key binary, members binary").join(_few(keyed), ["doc_id", "key"]).select("cell", "id", "settled", "members")
        texts = docs.select(F.col("doc_id").alias("id"), "text").join(_few(rows), "id").select("cell", "id", "settled", "text")
        return texts.mapInArrow(add_sets, "cell long, id long, settled boolean, members binary")

    links = _exact(merged, counts, whole, percent, folder, limit)
    if several and by_id:
        own = named.join(_few(several), "doc_id", "left_semi").join(classes.select("key", "id"), "key").select("doc_id", "id").distinct()
        own = stored(own, folder, "own", few=True)
        links = links.union(own.join(_few(own.groupBy("doc_id").agg(F.min("id").alias("b"))), "doc_id").select("id", "b"))
    linked = components(links, folder)
    known = classes.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    if several:
        known = stored(known, folder, "known")
        least = known.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("least"))
        known = known.join(least, "component").select("key", F.col("least.doc_id").alias("component_id"), (F.col("key") == F.col("least.key")).alias("first"))
    else:
        known = known.select("key", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("first"))
    return sets, known, several


def jaccard_components(docs: DataFrame, *, size: int = 4, percent: int = 85, limit: tuple[int, int] = (MEMBERS, CELL)) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    sets, known, several = _linked(docs, size, percent, limit, folder, by_id=True)
    out = sets.select("doc_id", "n", "key").join(known.drop("first"), "key", "left")
    component = F.coalesce("component_id", "doc_id")
    if several:
        # rows without words go where the others of their doc_id are
        own = out.join(_few(several), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("own"))
        out = out.join(_few(stored(own, folder, "own-components", few=True)), "doc_id", "left")
        component = F.coalesce("component_id", "own", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def _with_keys(size: int):
    def run(batches):
        for batch in parts(batches, "text"):
            keys = pa.array(map(_key, shingle_sets(batch["text"], size)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "_key"])

    return run


def one_of_each(docs: DataFrame, *, size: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component of near copies: of the smallest doc_id, there of the least key.

    Texts are linked by what they hold alone, so rows of one doc_id that aren't
    near copies all stay. Of rows with one doc_id and no words, one stays. Rows
    without a doc_id stay.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    sets, known, _ = _linked(docs.select("doc_id", "text"), size, percent, (MEMBERS, CELL), folder, by_id=False)
    found = sets.where("doc_id IS NOT NULL").select("doc_id", "key").join(known, "key", "left")
    stays = F.col("key").isNull() | ((F.col("doc_id") == F.col("component_id")) & F.col("first"))
    found = stored(found.select("doc_id", "key", stays.alias("stays")), folder, "components")
    dropped = stored(found.where("NOT stays").select(F.col("doc_id").alias("id")).distinct(), folder, "dropped", few=True)
    again = stored(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")), folder, "repeated", few=True)
    if again.isEmpty():
        return docs.join(_few(dropped), docs["doc_id"] == dropped["id"], "left_anti")
    # of doc_ids with several rows, one row of each set that stays; the others don't move
    single = docs.join(_few(again), docs["doc_id"] == again["id"], "left_anti")
    single = single.join(_few(dropped), single["doc_id"] == dropped["id"], "left_anti")
    rows = docs.join(_few(again), docs["doc_id"] == again["id"], "left_semi")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = rows.mapInArrow(_with_keys(size), f"{schema}, _key binary").dropDuplicates(["doc_id", "_key"])
    kept = found.where("stays").join(_few(again), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("_id"), F.col("key").alias("_own")).distinct()
    kept = stored(kept, folder, "kept")
    rows = rows.join(_few(kept), (F.col("doc_id") == F.col("_id")) & F.col("_key").eqNullSafe(F.col("_own")), "left_semi").drop("_key")
    return single.unionByName(rows)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, by 4-word shingles and a similarity of 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
