"""Shared pieces of the text operators: word hashing on Arrow buffers, packed blocks, keyed streams, prefix sums.

A *block* is a row that carries many small entries as binary columns. Operators that touch every word move blocks
instead of rows: entries are cut by the leading bits of their hash into buckets, blocks of one bucket meet in one task,
and a task holds one bucket at a time. The number of buckets follows the size of the input, so a bucket stays small.
"""

import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwatch.operators.lineage import materialise, shared_folder  # noqa: F401  general helpers
from tarnwatch.shipping import ensure_on_workers

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[65:91] = _CODE[97:123]
_POWERS: list = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound what an Arrow batch may hold unless the session already says so."""
    ensure_on_workers(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "268435456", "256MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: memory goes back when it likes
        return None


def tidied(run):
    """A `mapInArrow` function whose worker gives the memory of a finished task back to the system.

    Workers serve many tasks and stages. Without this, each keeps the most that any task before has used: the C library
    learns from freed large arrays to keep such memory, and Arrow's pool keeps its own.
    """

    def held(batches):
        libc = _libc()
        if libc is not None:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays of a MB or more are unmapped as soon as they are freed
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return held


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0]


def bucket_bits(n_bytes: int, per_bucket: int = 12 << 20, least: int = 7) -> int:
    """Bits of the hash that name a bucket, so that a bucket holds the words of about `per_bucket` bytes of text."""
    return max(least, math.ceil(math.log2(max(1, n_bytes / per_bucket))))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(n: int):
    """p^i and p^-i modulo 2^64 for i < n; one table per worker, grown when a longer stretch comes."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, _SEGMENT + 4096)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[:] = out
    return _POWERS


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the byte ranges; polynomial over random byte codes, then mixed with the length."""
    code = _CODE_LOWER if lower else _CODE
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SEGMENT, side="right")))
        power, inverse = _powers(int(ends[j - 1] - base) + 1)
        part = code[data[base:ends[j - 1]]]
        part *= power[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def string_buffers(column: pa.Array):
    """Bytes and offsets of a text column; a NULL is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), off


def row_chunks(off: np.ndarray, limit: int):
    """Row ranges of about `limit` bytes of text; a longer text is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of consecutive texts: byte ranges, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool, hashed: bool = True):
        base = int(off[0])
        part = data[base : int(off[-1])]
        off = off - base
        space = _SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[off] = True
        before = np.empty(len(part), bool)
        if len(part):
            before[0] = True
            before[1:] = space[:-1]
            after = np.empty(len(part), bool)
            after[-1] = True
            after[:-1] = space[1:]
            self.starts = np.flatnonzero(~space & (before | edge[:-1]))
            self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.data = part
        self.first = np.searchsorted(self.starts, off)  # of each text, and the end
        self.counts = np.diff(self.first)
        self.hashes = hash_words(part, self.starts, self.ends, lower) if hashed else None

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def binary_array(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column whose k-th value is the bytes of values[cuts[k]:cuts[k+1]]."""
    values = np.ascontiguousarray(values)
    offsets = (cuts * values.itemsize).astype(np.int32)
    offsets -= offsets[0]
    body = values[cuts[0] : cuts[-1]]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])


def keyed_blocks(batches, key: str, enough: int = 4 << 20):
    """Stream of (key, table) from batches sorted by key; a table holds all rows of its key in this task."""
    held, now = [], None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            k = keys[a]
            if now is not None and k != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = k
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    """All binary values of a column, end to end."""
    parts = []
    for chunk in table.column(name).chunks:
        off = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, chunk.offset * 4)
        raw = chunk.buffers()[2]
        if raw is not None:
            parts.append(np.frombuffer(raw, np.uint8)[off[0] : off[-1]])
    return np.concatenate(parts).view(dtype) if parts else np.zeros(0, dtype)


def by_bucket(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Rows of one key together and in key order within a task, for `keyed_blocks`.

    Where the keys are the numbers below `buckets`, tasks take even stretches of them, and there is one task per bucket
    as soon as there are more buckets than the session's shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets is None:
        return df.repartition(n, key).sortWithinPartitions(key)
    n = max(n, buckets)
    return df.repartitionById(n, F.expr(f"cast(cast({key} as long) * {n} div {buckets} as int)")).sortWithinPartitions(key)


def groups_of(keys: np.ndarray) -> np.ndarray:
    """Cut points of runs of equal values in a sorted array, end included."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def words_column(text, lower: bool = False):
    """Array of the words of a text, in the JVM; a NULL has none."""
    text = F.coalesce(text, F.lit(""))
    if lower:
        text = F.translate(text, UPPER, LOWER)
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text):
    """Number of words, without building them: word starts after white space or at the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list, amounts: dict) -> DataFrame:
    """Running sums *before* each row per key in (bucket, order), without sorting a key's rows in one task.

    `bucket` is an integer column that agrees with the order. Buckets are summed first (combined before the shuffle),
    running sums over buckets give each bucket's start, and rows are ordered only inside (key, bucket).
    `amounts` maps new column names to the summed columns; keys and buckets are never NULL.
    """
    part = keys + [bucket]
    total = df.groupBy(*part).agg(*[F.sum(c).alias(f"_{n}") for n, c in amounts.items()])
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = total.select(*part, *[F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)).alias(f"_{n}") for n in amounts])
    inner = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(n) for n, c in amounts.items()])
    out = ranked.join(starts, part)
    return out.select(*[c for c in ranked.columns if c not in amounts], *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in amounts])


def crc32_of_id(doc_id):
    """crc32 of the id written as text; a NULL id has none (and counts as in no fold)."""
    return F.crc32(doc_id.cast("string").cast("binary"))
