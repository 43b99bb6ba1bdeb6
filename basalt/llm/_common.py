"""Shared pieces of the corpus operators: staging tables, row keys, byte-level word handling."""

from __future__ import annotations

import functools
import gc
import time
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basalt.session import shared

#: Paths staged by whatever runs within `owned`.
_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned(spark: SparkSession):
    """Owns the tables staged within it and deletes them at its end: wrap the operators and the action that writes their
    result. Without an owner they stay in the shared folder."""
    paths: list[str] = []
    token = _OWNER.set(paths)
    try:
        yield
    finally:
        _OWNER.reset(token)
        for path in paths:
            drop(spark, path)
        tidy(spark)


scratch_dir = shared


def owner() -> list[str] | None:
    """Who owns what is staged just now."""
    return _OWNER.get()


def stage(df: DataFrame, label: str, clean: bool = True, of=owner) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    Shuffle files of the finished job are released (clean), so that stages don't add up on disk. of(): its owner.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    if (mine := of()) is not None:
        mine.append(path)
    # Once its rows are told, nothing refers to the finished job any more.
    n = _observed(seen)
    if clean:
        tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._rows = n
    return out


def _observed(seen: Observation) -> int | None:
    """What a finished write has counted; None if that isn't told within seconds."""
    for _ in range(200):
        got = seen._jo.getOrEmpty()
        if got.nonEmpty():
            return int(got.apply("n"))
        time.sleep(0.02)
    return None


def few(df: DataFrame, most: int) -> bool:
    """Whether a frame has at most so many rows: known of a staged table, else counted."""
    n = getattr(df, "_rows", None)
    return n <= most if n is not None else df.limit(most + 1).count() <= most


#: Frames of up to so many rows are handled by one task.
LITTLE = 20_000


def tight(df: DataFrame) -> DataFrame:
    """A staged frame of few rows as one partition: what follows of it needs no shuffle, and one small task for each step."""
    out = df.coalesce(1) if few(df, LITTLE) else df
    out._rows = getattr(df, "_rows", None)
    return out


def united(parts: list[DataFrame]) -> DataFrame:
    """The union of staged frames, its rows known if theirs are."""
    out = functools.reduce(DataFrame.union, parts)
    counts = [getattr(p, "_rows", None) for p in parts]
    out._rows = None if None in counts else sum(counts)
    return out


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffles and broadcasts that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Texts are long: unless the session says otherwise, give Python 1000 rows at a time instead of 10000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def lean(run):
    """The same function of batches, which gives freed memory back to the system before its worker waits for more work."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another libc
                pass

    return go


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def rest(docs: DataFrame, text_col: str, carry: bool) -> list[Column]:
    """What an operator carries along beside its own columns: all but the text as one struct, if asked to."""
    if not carry:
        return []
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return [(F.struct(*others) if others else F.struct(F.lit(0).alias("_0"))).alias("_rest")]


def restored(out: DataFrame, docs: DataFrame, text_col: str = "text", more: list[Column] | None = None) -> DataFrame:
    """The columns of docs again, from _rest and the text of out."""
    return out.select(*[F.col(text_col).alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in docs.columns], *(more or []))


def bucket_of(col: Column, mod: int) -> Column:
    """crc32 of the value as text, modulo mod: the folds of the contracts."""
    return F.pmod(F.crc32(col.cast("string")), F.lit(mod))


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two non-null columns that name a row: its doc_id (null: the largest long) and a hash of id and text."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("_k"), F.xxhash64(F.lit(7), doc_id, text).alias("_h")]


# --- bytes and words ------------------------------------------------------------------------------

#: Bytes that belong to words: everything but ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes that belong to words after lower-casing A-Z: digits, letters and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M = np.uint64(0x9E3779B97F4A7C15)
_MI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, m in (("p", _M), ("i", _MI)):
            out = np.empty(size, np.uint64)
            out[0], filled = 1, 1
            while filled < size:  # doubling: out[a:2a] = out[:a] * m**a
                k = min(filled, size - filled)
                out[filled : filled + k] = out[:k] * (out[filled - 1 : filled] * m)
                filled += k
            _POW[key] = out
    return _POW["p"], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n, (_, off, data) = len(column), column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may cover bytes
        empty = ~column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(at)[empty] > 0).any():
            return utf8(column.fill_null(""))
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of about `most` bytes together, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words_of(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (bytes) of every word, and its row. Rows never share a word."""
    inside = kind[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[1:-1]  # a word that touches a row's edge begins and ends there
    first = first[(first > 0) & (first < len(raw))]
    begins[first] |= inside[first]
    ends[first - 1] |= inside[first - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def hash_words(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial over prefix sums, so that cost is linear in the bytes."""
    if not len(s):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_offsets(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's words in the list of all words."""
    return np.searchsorted(rows, np.arange(n + 1), "left")
