"""Helpers shared by the training-data operators: shared storage and word hashing.

Executors do not share local folders, so everything that must outlive a stage
is written below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on (a longer text is its own step).
STEP_BYTES = 1 << 20

#: Bits of a bit map for each hash, and its bits at most.
BITS_EACH, BITS_MOST = 64, 1 << 28

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: A second table of random values, for hashes that are independent of those of the first.
BYTE2 = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space, other control characters and ASCII punctuation.
PUNCT = SPACE.copy()
PUNCT[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the session's JVM ends.

    Where the setting is absent, a local master gets a temporary folder of its
    own; on a cluster executors share no such folder, so that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _local_dir()
    made = f"{top.rstrip('/')}/lumenpage-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return made


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="lumenpage-")


def parts(batches, name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that column ``name`` has about ``most`` bytes in each; a longer value is alone.

    What a task holds beside its batch then follows from ``most`` and its longest value, whatever the session's batches are.
    """
    for batch in batches:
        if batch.num_rows:
            _, at = text_bytes(batch[name])
            for i, j in steps(at, most):
                yield batch.slice(i, j - i)


def groups(batches, key: str) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, one table each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[-1][key][0] != part[key][0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def stored(df: DataFrame, folder: str, name: str, small: bool = False, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here, and a lost executor costs nothing before it.

    ``small`` is for little that is made of much: its rows are first dealt to
    as few files as their size asks for, however many tasks made them. Such
    tables, and with ``few`` what comes out of a shuffle, have at most a file for
    every four shuffle partitions of the session (32 at least).
    """
    path, spark = f"{folder}/{name}", df.sparkSession
    if small or few:
        df = (df.hint("rebalance") if small else df).coalesce(max(32, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done.

    It does so when the driver's JVM finds that nothing refers to them, which
    may be long after large steps that leave its heap nearly empty.
    """
    spark.sparkContext._jvm.System.gc()


def bit_map(hashes: DataFrame, name: str) -> np.ndarray:
    """A bit map of the 64-bit hashes in a stored column, as 64-bit words.

    It has ``BITS_EACH`` bits for each row, two of them set, and ``BITS_MOST``
    (32 MB) at most, beyond which it lets more pass; it never holds back a hash
    that it was made of. It is built by an aggregate, so what reaches the driver
    is bounded by its size.
    """
    bits, n = 1 << 16, hashes.count()
    while bits < min(BITS_MOST, BITS_EACH * n):
        bits *= 2
    own = F.col(name)
    places = F.array(own.bitwiseAND(F.lit(bits - 1)), F.shiftright(own, 30).bitwiseAND(F.lit(bits - 1)))
    words = hashes.select(F.explode(places).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits"))
    rows = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def in_bit_map(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of some hashes a bit map lets pass."""
    last, ok = len(held) * 64 - 1, np.ones(len(hashes), bool)
    for place in (hashes & last, (hashes >> 30) & last):
        ok &= (held[place >> 6] >> (place & 63)) & 1 == 1
    return ok


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    if len(_POW[0]) < n:
        m = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_MULT, _INV)):
            step = np.full(m, base, np.uint64)
            step[0] = 1
            _POW[k] = np.cumprod(step, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def prefix_sums(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over the bytes, from which the hash of any stretch follows (see ``stretch``)."""
    up, _ = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
    return sums


def stretch(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``begin`` to ``end``, wherever they stand."""
    return (sums[end] - sums[begin]) * powers(len(sums))[1][begin]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(raw: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE, heads: tuple[int, ...] = ()) -> tuple:
    """Hashes of the words (runs of bytes that aren't ``space``) of some rows, A-Z as a-z.

    Returns (hash of each word, its first byte, its end, first word of each row
    with the count of words at the end). Bytes are counted from ``raw``'s start.
    With ``heads``, a fifth entry has for each length k the hashes of the first
    k bytes of each word (0 for words that are not longer).

    Long texts are worked on in stretches that end between words, so what is
    held beside the words follows from ``STEP_BYTES`` and the longest word.
    """
    found = [(a, _word_hashes(raw[a:z], np.concatenate([[0], at[(at > a) & (at < z)] - a, [z - a]]), space, heads)) for a, z in _between_words(raw, at, space)]
    hashed = np.concatenate([np.zeros(0, np.uint64), *(x[0] for _, x in found)])
    begin = np.concatenate([np.zeros(0, np.int64), *(x[1] + a for a, x in found)])
    end = np.concatenate([np.zeros(0, np.int64), *(x[2] + a for a, x in found)])
    words = hashed, begin, end, np.searchsorted(begin, at)
    return (*words, [np.concatenate([np.zeros(0, np.uint64), *(x[3][k] for _, x in found)]) for k in range(len(heads))]) if heads else words


def _between_words(raw: np.ndarray, at: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``STEP_BYTES`` that end at the end of a row or before white space."""
    a, n = 0, len(raw)
    while a < n:
        z = a + STEP_BYTES
        while z < n and not space[raw[z]]:
            ahead = np.flatnonzero(space[raw[z : z + STEP_BYTES]])
            z += int(ahead[0]) if len(ahead) else STEP_BYTES
            row = int(at[np.searchsorted(at, a + STEP_BYTES)])
            z = min(z, row)
            if z == row:
                break
        z = min(z, n)
        yield a, z
        a = z


def _word_hashes(raw: np.ndarray, at: np.ndarray, space: np.ndarray, heads: tuple[int, ...]) -> tuple:
    """Hash, first byte, end and head hashes of the words of one stretch."""
    n = len(raw)
    solid = ~space[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = at[(at > 0) & (at < n)]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix_sums(_LOWER[raw], BYTE)
    hashed = mix(stretch(sums, begin, end) + (end - begin).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    cut = []
    for k in heads:
        long = end - begin > k
        part = mix(stretch(sums, begin, np.minimum(begin + k, n)) + U64(k * 2 + 1))
        cut.append(np.where(long, part, U64(0)))
    return hashed, begin, end, cut


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (as if all were of one text)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = (total + words[k : k + n]) * U64(_MULT)
        total ^= total >> U64(29)
    return mix(total)
