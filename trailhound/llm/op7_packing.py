"""Best-fit packing by pattern repetition.

Documents become pieces of at most ``CAPACITY`` tokens. The histogram of piece lengths has one entry for each length, so
planning does not grow with the corpus: all patterns of up to three pieces that fill a sequence exactly are enumerated,
non-negative least squares fits their repeat counts to the histogram, counts are rounded down to what is there, and the
pieces left over are packed best fit, longest first, as counts of equal sequences. The plan, a table of length and rank
ranges, is sent to the executors; a piece's rank among those of its length is counted where the piece is cut, and comes after the pieces
of earlier source partitions. Pieces are stored in buckets by source partition, so that they, and the ids on them, are not shuffled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhound.llm.common import freed_shuffles, partitions, table, texts, tidied
from trailhound.llm.op5_bpe import REMEMBERED, codec_of, read_vocabulary
from trailhound.session import scratch_path

CAPACITY = 1024
#: Documents whose pieces a task holds at once.
ROWS = 512
END_ID = 2
#: Steps of the projected gradient that solves the least squares.
STEPS = 600


def patterns(capacity: int) -> np.ndarray:
    """All multisets of one to three lengths that sum to the capacity, as rows of lengths with 0 for no piece."""
    first, second = np.meshgrid(np.arange(1, capacity), np.arange(0, capacity), indexing="ij")
    third = capacity - first - second
    fits = (first >= second) & (second >= third) & (third >= 0) & (second > 0)
    rows = np.stack([x[fits] for x in (first, second, third)], axis=1)
    return np.concatenate((np.array([[capacity, 0, 0]]), rows))


def least_squares(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts x for which the pieces used, A x, come nearest to the histogram.

    Accelerated projected gradient; A is never built, since each pattern touches three entries. Lengths are weighted
    so that longer ones, which are harder to place later, are met first.
    """
    size = len(histogram)
    weight = np.arange(size) / (size - 1)
    weight[0] = 0
    target = histogram * weight
    x = momentum = np.zeros(len(rows))
    # the largest eigenvalue of A'A by power iteration gives the step
    probe = np.ones(len(rows))

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, c], x, size) for c in range(3)) * weight

    def back(residual: np.ndarray) -> np.ndarray:
        weighted = residual * weight
        return weighted[rows[:, 0]] + weighted[rows[:, 1]] + weighted[rows[:, 2]]

    for _ in range(30):
        probe = back(used(probe))
        top = np.linalg.norm(probe)
        probe /= top
    t = 1.0
    for _ in range(STEPS):
        moved = np.maximum(0, momentum - back(used(momentum) - target) / (1.05 * top))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum = moved + (t - 1) / t_next * (moved - x)
        x, t = moved, t_next
    return x


def rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts, rounded down and largest first, each limited to the pieces that are left; ``left`` is reduced in place."""
    out = []
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1:
            break
        lengths = tuple(int(v) for v in rows[i] if v)
        need = np.bincount(lengths, minlength=len(left))
        spots = np.flatnonzero(need)
        repeats = int(min(x[i], (left[spots] // need[spots]).min()))
        if repeats > 0:
            left[spots] -= repeats * need[spots]
            out.append((lengths, repeats))
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pieces left over, longest first, each into the open sequences with the least room that holds it.

    Sequences with the same contents are one entry with a count, so the work depends on lengths and not on pieces.
    """
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                fresh = max(1, count // (capacity // length)) if capacity // length > 1 else count
                each = min(capacity // length, count)
                fresh = min(fresh, count // each)
                rooms[capacity - each * length].append(((length,) * each, fresh))
                count -= each * fresh
                continue
            contents, open_count = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = min(room // length, count)
            taken = min(open_count, count // each)
            if taken < open_count:
                rooms[room].append((contents, open_count - taken))
            rooms[room - each * length].append((contents + (length,) * each, taken))
            count -= each * taken
    return [entry for entries in rooms.values() for entry in entries]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for all pieces of a histogram (index: length)."""
    left = histogram.astype(np.int64).copy()
    rows = patterns(capacity)
    rows = rows[((left[rows] > 0) | (rows == 0)).all(axis=1)]
    done = []
    if len(rows):
        done = rounded(rows, least_squares(rows, left.astype(float)), left)
    return done + best_fit(left, capacity)


def places(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of its runs of pieces, and the sequence of a run's first piece and its offset there."""
    taken = np.zeros(capacity + 1, np.int64)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for lengths, repeats in planned:
        offset = 0
        for length in lengths:
            runs[length].append((int(taken[length]), sequence, offset))
            taken[length] += repeats
            offset += length
        sequence += repeats
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False, remembered: int = REMEMBERED, forget: bool = False) -> DataFrame:
    """One row for each piece: the document's tokens and an end, the first piece shorter where they don't divide.

    Null text counts as empty and is one piece of the end alone. ``source_part``, ``length`` and ``number`` (among the pieces of
    that partition and length) tell pieces apart even where ids repeat. With ``with_ids``, also the piece's ids. With ``forget``,
    workers, which outlive the stage, drop their encoded words after each task.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType()), T.StructField("source_part", T.IntegerType()),
              T.StructField("number", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    schema = T.StructType(fields)
    names = schema.names
    tail = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, part, numbers = codec_of(source.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        codec.words.limit = remembered
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, len(b), ROWS)):
            rows, piece, start, length, crc, number, ids = [], [], [], [], [], [], []
            for i, value in enumerate(texts(batch.column("text"))):
                tokens = np.concatenate((codec.encode(value.as_py()), tail))
                first = len(tokens) % capacity or capacity
                cuts = [0, *range(first, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    number.append(numbers[b - a])
                    numbers[b - a] += 1
                    if with_ids:
                        ids.append(tokens[a:b].astype(np.int32))
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                      pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                      pa.array([part] * len(rows), pa.int32()), pa.array(number, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names)
        if forget:
            codec.words.clear()

    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


def in_buckets(cut: DataFrame) -> DataFrame:
    """``cut`` written to a new table, bucketed by ``source_part``: each task writes one file, and joins by that column move no pieces."""
    spark = cut.sparkSession
    path = scratch_path(spark, "pieces")
    name = "pieces_" + path[-32:]
    with freed_shuffles(spark):
        cut.write.option("path", path).option("compression", "zstd").bucketBy(
            partitions(spark), "source_part").saveAsTable(name)
    return spark.table(name)


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a table of :func:`in_buckets`) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    counts = cut.groupBy("length", "source_part").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length at most
        histogram[row["length"]] = row["n"]
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("source_part")
    starts = counts.select("length", "source_part", (F.sum("n").over(before) - F.col("n")).alias("before")).groupBy(
        "source_part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"))  # an entry for each length
    ranked = cut.join(starts.hint("shuffle_hash"), "source_part")
    columns = cut.columns
    kept = ranked.select(*columns, (F.col("before")[F.col("length")] + F.col("number")).alias("rank"))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                first, base, place = shared.value[int(length)]
                run_of = np.searchsorted(first, ranks[own], side="right") - 1
                sequence[own] = base[run_of] + ranks[own] - first[run_of]
                offset[own] = place[run_of]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)], schema.names)

    return kept.mapInArrow(tidied(run), schema)


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False, remembered: int = REMEMBERED, forget: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their places; an empty table gives an empty table."""
    return placed(in_buckets(pieces(docs, vocabulary_path, capacity, end_id, with_ids, remembered, forget)), capacity)


def op7_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """All ``documents`` in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
