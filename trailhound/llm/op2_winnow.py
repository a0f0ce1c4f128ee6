"""Document fingerprints by winnowing.

Every run of ``K`` code points is hashed; in every window of ``WINDOW`` such hashes the smallest is kept, the rightmost of
equal ones, with its position. Two texts that share ``K + WINDOW - 1`` code points in a row share a kept hash. A text of
fewer than ``K`` code points is one run; one with fewer runs than a window is one window; an empty text keeps nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhound.llm.common import cut_hash, partitions, prefix_hash, table, texts

K = 16
WINDOW = 32
#: A kept hash has 44 bits; the other 20 order equal hashes within a piece of the text.
PLACE_BITS = np.uint64(20)
PIECE = 1 << 20
PLACES = np.uint64(PIECE - 1)


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest of each window, the rightmost of equal ones, each once and ascending."""
    window = min(window, len(hashes))
    if not window:
        return np.zeros(0, np.int64)
    kept = []
    for first in range(0, len(hashes) - window + 1, PIECE - window + 1):
        piece = hashes[first: first + PIECE]
        least = (piece >> PLACE_BITS << PLACE_BITS) | (PLACES - np.arange(len(piece), dtype=np.uint64))
        span = 1
        while span < window:  # the minimum of a span from two that overlap
            step = min(span, window - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        kept.append(first + (PLACES - (least & PLACES)).astype(np.int64))
    positions = np.concatenate(kept)
    return positions[np.concatenate(([True], positions[1:] != positions[:-1]))]


def winnow(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (44 bits) and their positions in a text's code points."""
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, len(codes))
    start = np.arange(len(codes) - k + 1)
    hashes = cut_hash(prefix_hash(codes), start, start + k)
    positions = window_minima(hashes, window)
    return hashes[positions] >> PLACE_BITS, positions


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes over all distinct hashes; two empty fingerprints are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    return hashlib.sha256(hashes.astype("<u8").tobytes() + positions.astype("<i8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``hashes`` and ``positions`` (arrays of longs, in text order); columns of these names are replaced.

    One pass without a shuffle. Null text counts as empty.
    """
    kept = docs.drop("hashes", "positions")
    schema = T.StructType([*kept.schema.fields, T.StructField("hashes", T.ArrayType(T.LongType(), False)),
                           T.StructField("positions", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(code_points(x), k, window) for x in texts(batch.column(text)).to_pylist()]
            offsets = pa.array(np.cumsum([0, *(len(p) for _, p in found)]).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *x])))
                      for x in ([h.astype(np.int64) for h, _ in found], [p for _, p in found])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema.names)

    return kept.mapInArrow(run, schema)


def in_descending_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``doc_id`` and ``text`` dealt into ranges of descending ids, each followed by the first row of the next range.

    Range starts are ids drawn by a hash, so each start is a row; its range's predecessor gets a copy marked ``guest``.
    The last range gets a copy of the first row of all. Ids that are null come last; equal ids are in order of text.
    """
    spark = docs.sparkSession
    rows, highest = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    every = max(1, rows // ranges)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0
    starts = np.sort(np.array([r[0] for r in docs.filter(F.col("doc_id").isNotNull() & drawn).select("doc_id").distinct()
                               .collect()], np.int64))  # about ``ranges`` ids
    shared = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.fillna(-(1 << 63)).astype("int64")
        return pd.Series(len(shared.value) - np.searchsorted(shared.value, known.to_numpy(), side="left")).astype("int32")

    at = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    before = F.when(F.col("doc_id").isNotNull() & drawn, F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("guest")))
    around = F.when(F.col("doc_id").eqNullSafe(F.lit(highest)),
                    F.struct(F.lit(len(starts)).alias("part"), F.lit(True).alias("guest")))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "part", F.when(F.col("doc_id").isNull(), F.lit(len(starts))).otherwise(range_of("doc_id"))).select(
        "doc_id", "text", F.explode(F.array_compact(F.array(at, before, around))).alias("at")).select(
        F.col("at.part").alias("part"), F.col("at.guest").alias("guest"), "doc_id", "text")


def with_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last third comes from the next document.

    Texts are shuffled once, into many more ranges than partitions, so that each partition gets an even share.
    """
    spark = docs.sparkSession
    dealt = in_descending_ranges(docs, ranges or 8 * partitions(spark))
    ordered = dealt.repartition(partitions(spark), "part").sortWithinPartitions(
        "part", "guest", F.col("doc_id").desc_nulls_last(), "text")
    strings = ("edited_sha256", "fingerprint", "edited_fingerprint")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in strings],
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
        T.StructField("n_marks", T.LongType())])

    def finished(last: tuple, text: str, codes: np.ndarray, marks: tuple) -> tuple:
        doc_id, own_text, own_codes, own = last
        n = len(own_codes)
        cut = n // 3
        changed = winnow(np.concatenate((own_codes[: n - cut], codes[:cut])))
        edited = own_text[: n - cut] + text[:cut]
        return (doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(*own),
                digest(*changed), likeness(own[0], changed[0]), likeness(own[0], marks[0]), len(own[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_part = None, None
        for batch in batches:
            done = []
            columns = zip(*(batch.column(c) for c in ("part", "guest", "doc_id", "text")))
            for part, guest, doc_id, value in columns:
                part, guest, text = part.as_py(), guest.as_py(), value.as_py()
                if last is None and guest:
                    continue  # a further copy, or a range without rows of its own
                codes = code_points(text)
                marks = winnow(codes)
                if last is not None and last_part == part:
                    done.append(finished(last, text, codes, marks))
                last, last_part = (None, None) if guest else ((doc_id.as_py(), text, codes, marks), part)
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*done), pa_types)], schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_types = [f.type for f in to_arrow_schema(schema)]
    return ordered.mapInArrow(run, schema)


def op2_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` against its edited text and the next document."""
    return with_edits(table(spark, sf_dir, "documents"))
