"""Helpers shared by the operators: shared-folder tables, byte views of Arrow text, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhound.session import scratch_path

#: Bytes of text that a task looks at in one numpy step; rows longer than this form a step of their own.
STEP_BYTES = 1 << 20
STEP_ROWS = 1024
#: Odd multipliers of the polynomial and finishing hashes (fixed values: any odd 64-bit numbers do).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


#: Spark's setting by which the shuffle files of a query go when it ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that begin and end inside leave no shuffle files behind; for such as run once, since a second run would shuffle again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read back: one computation, no lineage and no shuffle files behind it."""
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables written by :func:`stored` that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: str, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def texts(column: pa.Array) -> pa.Array:
    """The column with nulls as empty strings."""
    return pc.fill_null(column.cast(pa.string()), "")


def byte_steps(column: pa.Array, limit: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows: (first row, row after the last, their bytes, row offsets into the bytes)."""
    column = texts(column)
    if not len(column):
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, first + rows)
        yield first, last, whole[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def in_steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into such of at most ``limit`` bytes of ``text`` and ``rows`` rows: what is made of them goes before the next."""
    for batch in batches:
        for first, last, _, _ in byte_steps(batch.column("text"), limit, rows):
            yield batch.slice(first, last - first)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, after which the worker gives freed memory back: workers outlive the stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Return the free memory of Arrow and, where the C library has a call for it, of Python to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= MIX_1
    values ^= values >> np.uint64(27)
    values *= MIX_2
    values ^= values >> np.uint64(31)
    return values


class Powers:
    """Powers of ``BASE`` and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> Powers:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.down = np.multiply.accumulate(steps)
        return self


POWERS = Powers()


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """``h[i]``: the polynomial of the first i symbols modulo 2^64, to be cut by :func:`cut_hash`."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * POWERS.to(len(symbols) + 1).up[: len(symbols)], out=out[1:])
    return out


#: Words of more bytes are hashed singly: the polynomial modulo 2^64 takes some regular strings of 1,024 symbols for others.
LONG_WORD = 512


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, end) of ``data``, of any length."""
    out = cut_hash(prefix_hash(data), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i]: end[i]].tobytes(), seed=1)
    return out


def cut_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols [start, end): equal strings have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * POWERS.down[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+`` of the rows laid end to end; none crosses a row."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.ones(len(data), bool)
    first[1:] = space[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(first & ~space)
    stop = np.ones(len(data), bool)
    stop[:-1] = space[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    stop[ends] = True
    end = np.flatnonzero(stop & ~space) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z made lower case."""
    return data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
