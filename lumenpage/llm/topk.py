"""Exact top-k inner products by block-at-a-time pruning.

Candidates are ordered so that like vectors stand together, and cut into
document-range blocks, each with a forward index (its matrix) and, for every
dimension ("term"), the least and greatest value in it. A query's bound for a
block is the sum over dimensions of the larger of weight times least and weight
times greatest. A query visits blocks by falling bound, and is done once the
bound is below its k-th best score; a block whose bound equals that is passed
if no smaller id could still win the tie. Queries that visit the same block in
the same round share one matrix product.

Blocks are packed in shards, queries in chunks, both of bounded size, so neither
side is ever broadcast. Only the bounds of the blocks, 1/128 of the vectors, meet
all queries at first: they name the most promising shard of each chunk, whose
scores give every query a floor for its k-th best. Then shard and chunk meet
only if some bound in the shard reaches the floor of some query in the chunk.
Where vectors have no structure that the bounds could use, all of them meet.

A vector that is null, or holds a null or a value that isn't finite, takes no
part. Vectors of different lengths are compared as if the shorter one ended in
zeros. An empty vector scores 0 with all. Scores are 64-bit integers; where
values are so large that they might not be exact in doubles, integer arithmetic
is used without pruning, and it wraps as Java's does. Several rows with one id
are several candidates. Ties go to the smaller id. Empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpage.llm.common import shared_dir, stored

#: Vectors in a block, and in a shard of blocks; queries in a chunk; shards whose bounds one task sees, and chunks that one task scores.
BLOCK, SHARD, CHUNK, SHARDS, CHUNKS = 256, 8192, 512, 512, 16
#: Pairs of a shard and a chunk that are scored without looking at their bounds first.
FEW = 16
_EXACT = float(1 << 53)


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a long; null if any component isn't finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # floor of a double is a long, held at its limits
    return F.when(embedding.isNotNull() & fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _packed(size: int):
    """Collect the rows (id, v) of a partition, in their order, into rows (ids, matrix, width) of ``size`` vectors."""

    def run(batches):
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def made():
            width = max(map(len, vectors), default=0)
            matrix = np.zeros((len(vectors), width), np.int64)
            for k, v in enumerate(vectors):
                matrix[k, : len(v)] = v
            small = np.abs(matrix).max(initial=0) < 1 << 31
            return pa.RecordBatch.from_pydict({"ids": pa.array([np.array(ids, np.int64).tobytes()]), "matrix": pa.array([matrix.astype(np.int32 if small else np.int64).tobytes()]), "width": pa.array([width], pa.int32()), "small": pa.array([bool(small)])})

        for batch in batches:
            for i, v in zip(batch["id"].to_pylist(), batch["v"], strict=True):
                ids.append(i)
                vectors.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == size:
                    yield made()
                    ids, vectors = [], []
        if ids:
            yield made()

    return run


def _unpack(ids: bytes, matrix: bytes, width: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(matrix, np.int32 if small else np.int64).astype(np.int64).reshape(len(own), width)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _is_exact(queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> bool:
    """Whether all inner products are exact in doubles."""
    size = max(np.abs(least.astype(float)).max(initial=0), np.abs(most.astype(float)).max(initial=0))
    return np.abs(queries.astype(float)).max(initial=0) * size * max(1, queries.shape[1]) < _EXACT


def block_bounds(queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each query and block, what no inner product in the block exceeds."""
    width = max(queries.shape[1], least.shape[1])
    q, least, most = _padded(queries, width), _padded(least, width), _padded(most, width)
    if not _is_exact(q, least, most):
        return np.full((len(q), len(least)), np.inf)
    q = q.astype(float)
    return np.maximum(q, 0) @ most.astype(float).T + np.minimum(q, 0) @ least.astype(float).T


def extremes(matrix: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest values of each block."""
    starts = np.arange(0, len(matrix), block)
    if not matrix.shape[1]:
        return np.zeros((len(starts), 0), np.int64), np.zeros((len(starts), 0), np.int64)
    return np.minimum.reduceat(matrix, starts), np.maximum.reduceat(matrix, starts)


def best_of_shard(queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the k best of a shard for each query, block after block; a query isn't its own candidate, and what is below its floor isn't looked for."""
    width = max(queries.shape[1], matrix.shape[1])
    queries, matrix = _padded(queries, width), _padded(matrix, width)
    starts, n = np.arange(0, len(ids), block), len(queries)
    bounds = block_bounds(queries, *extremes(matrix, block))
    exact = bool(np.isfinite(bounds).all())
    q, m = (queries.astype(float), matrix.astype(float)) if exact else (queries, matrix)
    first = np.minimum.reduceat(ids, starts)
    order = np.stack([np.lexsort((first, -b)) for b in bounds]) if n else np.zeros((0, len(starts)), int)
    least = np.full(n, -np.inf) if floor is None else floor.astype(float)  # the k-th best, as far as known
    last = np.full(n, -1)  # its id, where it is of this shard
    top = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, m.dtype)]
    open_ = np.ones(n, bool)
    for r in range(len(starts)):
        b = order[:, r]
        bound = bounds[np.arange(n), b]
        open_ &= ~(bound < least) if exact else True
        visit = np.flatnonzero(open_ & ~((bound == least) & (last >= 0) & (first[b] > last)))
        if not open_.any():
            break
        found = [top]
        visit = visit[np.argsort(b[visit], kind="stable")]
        for own in np.split(visit, np.flatnonzero(np.diff(b[visit])) + 1) if len(visit) else ():
            part = slice(starts[b[own[0]]], starts[b[own[0]]] + block)
            scores = q[own] @ m[part].T
            keep = query_ids[own][:, None] != ids[part][None, :]
            if exact:
                keep &= scores >= least[own][:, None]
            row, col = np.nonzero(keep)
            found.append([own[row], ids[part][col], scores[row, col]])
        row, owner, score = (np.concatenate(x) for x in zip(*found, strict=True))
        # integers are turned by their complement, which can't overflow
        by = np.lexsort((owner, -score if exact else ~score, row))
        row, owner, score = row[by], owner[by], score[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = [x[rank < k] for x in (row, owner, score)]
        full = top[0][rank[rank < k] == k - 1]
        if exact:
            kth = top[2][rank[rank < k] == k - 1]
            last[full] = np.where(kth >= least[full], top[1][rank[rank < k] == k - 1], last[full])
            least[full] = np.maximum(least[full], kth)
    return list(zip(query_ids[top[0]].tolist(), top[1].tolist(), top[2].astype(np.int64).tolist(), strict=True))


_COLUMNS = ("ids", "matrix", "width", "small")


def _with_bounds(batches):
    """(shard, blocks, width, least, most): the extremes of the blocks of each shard."""
    for batch in batches:
        for row in batch.to_pylist():
            least, most = extremes(_unpack(*(row[c] for c in _COLUMNS))[1])
            yield pa.RecordBatch.from_pydict({"shard": [row["shard"]], "blocks": pa.array([len(least)], pa.int32()), "width": pa.array([row["width"]], pa.int32()), "least": [least.tobytes()], "most": [most.tobytes()]})


def _bounded(found: str):
    """Of some bounds and some chunks: rows (chunk, shard, promise), the best bounds of the queries, summed; or, of chunks with floors, the (chunk, shard) that may hold more."""

    def run(bounds: pa.Table, chunks: pa.Table) -> pa.Table:
        out: dict[str, list] = {"chunk": [], "shard": [], "promise": []}
        for c in chunks.to_pylist():
            _, queries = _unpack(*(c[x] for x in _COLUMNS))
            floor = np.frombuffer(c["floor"]) if found == "pairs" else None
            for s in bounds.select(["shard", "blocks", "width", "least", "most"]).to_pylist():
                shape = s["blocks"], s["width"]
                best = block_bounds(queries, np.frombuffer(s["least"], np.int64).reshape(shape), np.frombuffer(s["most"], np.int64).reshape(shape)).max(1)
                if floor is None or (best >= floor).any():
                    out["chunk"].append(c["chunk"])
                    out["shard"].append(s["shard"])
                    out["promise"].append(float(np.clip(best, -1e300, 1e300).sum()))
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "shard": pa.array(out["shard"], pa.int64()), "promise": pa.array(out["promise"], pa.float64())})

    return run


def _scored(k: int):
    """The best of each (shard, chunk) that meet."""

    def run(shards: pa.Table, chunks: pa.Table) -> pa.Table:
        out = [np.zeros((0, 4), np.int64)]
        for s in shards.to_pylist():
            ids, matrix = _unpack(*(s[c] for c in _COLUMNS))
            for c in chunks.to_pylist():
                query_ids, queries = _unpack(*(c[x] for x in _COLUMNS))
                best = best_of_shard(queries, query_ids, matrix, ids, k, floor=np.frombuffer(c["floor"]) if c["floor"] is not None else None)
                out.append(np.array([(c["chunk"], *b) for b in best], np.int64).reshape(-1, 4))
        flat = np.concatenate(out)
        return pa.table({n: flat[:, k] for k, n in enumerate(("chunk", "query_id", "vec_id", "score"))})

    return run


def _floors(k: int):
    """A chunk with the floor of each query: the k-th best of what its seed shard has."""

    def run(chunks: pa.Table, found: pa.Table) -> pa.Table:
        scores: dict[int, list[int]] = {}
        for i, s in zip(found["query_id"].to_pylist(), found["score"].to_pylist(), strict=True):
            scores.setdefault(i, []).append(s)
        floors = []
        for c in chunks.to_pylist():
            own = [sorted(scores.get(i, ()), reverse=True)[k - 1 : k] for i in np.frombuffer(c["ids"], np.int64).tolist()]
            floors.append(np.array([x[0] if x else -np.inf for x in own], float).tobytes())
        return chunks.select(["chunk", *_COLUMNS]).append_column("floor", pa.array(floors, pa.binary()))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, score); both inputs have (id long, v array<long>) without nulls."""
    # like vectors together: by the dimension of the largest component, and its sign
    lead = F.array_max(F.transform("v", lambda x: F.abs(x)))
    place = F.coalesce(F.array_position(F.transform("v", lambda x: F.abs(x)), lead), F.lit(0))
    sign = F.coalesce(F.signum(F.try_element_at("v", F.greatest(place, F.lit(1)).cast("int"))), F.lit(0))
    ordered = vectors.withColumn("lead", place * 2 + (sign > 0).cast("long"))
    packed = "ids binary, matrix binary, width int, small boolean"
    salt = F.pmod(F.xxhash64("id"), F.lit(16))
    folder = shared_dir(vectors.sparkSession)
    shards = ordered.repartition("lead", salt).sortWithinPartitions("lead", "id").select("id", "v").mapInArrow(_packed(SHARD), packed)
    shards = stored(shards.select(F.monotonically_increasing_id().alias("shard"), *_COLUMNS), folder, "shards")
    chunks = queries.select("id", "v").mapInArrow(_packed(CHUNK), packed).select(F.monotonically_increasing_id().alias("chunk"), *_COLUMNS)
    chunks = stored(chunks, folder, "chunks", small=True)
    n_shards, n_chunks = shards.count(), chunks.count()
    counts = [max(1, -(-n_shards // SHARDS)), max(1, -(-n_chunks // CHUNKS))]
    part, group = (F.pmod(F.xxhash64(c), F.lit(n)) for c, n in zip(("shard", "chunk"), counts, strict=True))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))

    def looked_at(bounds: DataFrame, rows: DataFrame, found: str) -> DataFrame:
        """The bounds of SHARDS shards or so, with CHUNKS chunks or so, in each task."""
        left = bounds.select("*", part.alias("part")).select("*", every(counts[1]).alias("group"))
        right = rows.select("*", group.alias("to_group")).select("*", every(counts[0]).alias("to_part"))
        return left.groupBy("part", "group").cogroup(right.groupBy("to_part", "to_group")).applyInArrow(_bounded(found), "chunk long, shard long, promise double")

    def met(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """The best of the pairs (chunk, shard); a task scores a shard with CHUNKS chunks or so."""
        asked = pairs.select("shard", "chunk", group.alias("group"))
        left = shards.join(asked.select("shard", "group").distinct(), "shard")
        right = asked.join(rows, "chunk").withColumnsRenamed({"shard": "to_shard", "group": "to_group"})
        return left.groupBy("shard", "group").cogroup(right.groupBy("to_shard", "to_group")).applyInArrow(_scored(k), "chunk long, query_id long, vec_id long, score long")

    blank = chunks.withColumn("floor", F.lit(None).cast("binary"))
    if n_shards * n_chunks <= FEW:
        # so few pairs are scored sooner than floors are found
        found = met(shards.select("shard").join(F.broadcast(chunks.select("chunk"))), blank)
    else:
        bounds = stored(shards.mapInArrow(_with_bounds, "shard long, blocks int, width int, least binary, most binary"), folder, "bounds", small=True)
        seeds = looked_at(bounds, blank, "promises").groupBy("chunk").agg(F.max_by("shard", F.struct("promise", "shard")).alias("shard"))
        first = stored(met(stored(seeds, folder, "seeds", small=True), blank), folder, "first", small=True)
        floored = chunks.groupBy("chunk").cogroup(first.withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(_floors(k), f"chunk long, {packed}, floor binary")
        floored = stored(floored, folder, "floored", small=True)
        found = met(stored(looked_at(bounds, floored, "pairs"), folder, "pairs", small=True), floored)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every vector whose id is divisible by 100."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = table.select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return top_k(vectors, vectors.where("id % 100 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
