"""Suffix order of many texts, each a string of numbers, by recursion on positions that their content chooses.

A text is cut where its positions skip a number. Equal neighbours form a run, and a run whose number, hashed, is smaller than that of both
runs beside it is a head. A suffix is compared by its key, which goes on to the next head and the number after that run, and, of equal keys, by
the place of the suffix that starts at the head. A key holds for each run its number and its length: runs before a smaller number
come first, shorter ones before longer; of those before a larger number longer ones come first. Since two runs and the
number that follows tell a head, no key is the beginning of another. Heads, named by the order of their keys, are a string at most half as long, which is put in order in the
same way. One range sort orders the keys of each level and no step gathers a key; at most ``BASE_ROWS`` numbers are ordered in one task, and that bound does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhound.llm.common import BASE, discard, mix, partitions, stored, tidied

#: Longest string that one task orders.
BASE_ROWS = 1 << 19
#: Rows of keys that a task builds at once.
KEY_ROWS = 1 << 14
#: Above the length of any run; lengths take five bytes in a key, numbers eight.
TOP = 1 << 40
WIDTH = 13


def base_ranks(names: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes by prefix doubling; the end of the string is smaller than any symbol."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while n and rank.max() < n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return rank - 1


def goes_on(text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether each row but the first continues the string of the row before."""
    return (text[1:] == text[:-1]) & (pos[1:] == pos[:-1] + 1)


def ordered_in_one_task(symbols: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if parts:
            whole = pd.concat(parts).sort_values(["text", "pos"])
            begins = np.concatenate(([True], ~goes_on(whole["text"].to_numpy(), whole["pos"].to_numpy())))
            at = np.arange(len(whole)) + np.cumsum(begins)
            names = np.zeros(len(whole) + begins.sum(), np.int64)  # a 0 before each string
            names[at] = whole["name"].to_numpy()
            yield whole.iloc[np.argsort(base_ranks(names)[at])]

    return symbols.repartition(1).mapInPandas(tidied(run), symbols.schema)


def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches, sorted by ``text``, in pieces that cut no text."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        text = batch.column("text").to_numpy()
        cut = int(np.searchsorted(text, text[-1]))
        if held and (cut or held[-1].column("text")[-1].as_py() != text[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


class Runs:
    """The runs of strings that lie end to end, the heads among them, and the keys of suffixes."""

    def __init__(self, text: np.ndarray, pos: np.ndarray, name: np.ndarray, level: int) -> None:
        on = goes_on(text, pos)
        fresh = np.concatenate(([True], ~(on & (name[1:] == name[:-1]))))
        self.first = np.flatnonzero(fresh)
        self.run = np.cumsum(fresh) - 1
        begins = np.concatenate(([True], ~on))[self.first]
        ends = np.append(begins[1:], True)
        self.name, self.length = name[self.first], np.diff(np.append(self.first, len(name)))
        after = np.append(self.name[1:], 0)
        after[ends] = 0
        self.falls = after < self.name
        # a hash, so that no run of ascending names makes keys long; no two names share one
        order = mix(self.name.astype(np.uint64) + np.uint64(level) * BASE)
        low = ~begins & ~ends
        low[1:-1] &= (order[1:-1] < order[:-2]) & (order[1:-1] < order[2:])
        self.heads = np.flatnonzero(low)
        string = np.cumsum(begins) - 1
        #: Places of the heads as a string of their own: strings stay apart by a gap.
        self.at = np.arange(len(self.heads)) + string[self.heads]
        following = np.searchsorted(self.heads, np.arange(len(string)), side="right")
        there = following < len(self.heads)
        there[there] = string[self.heads[following[there]]] == string[there]
        #: For each run the number of the next head, -1 if the string has none.
        self.next = np.where(there, following, -1)
        last = np.flatnonzero(ends)[string]
        last[there] = self.heads[following[there]]
        # all runs as bytes, an entry of zeros after each string
        slot = np.arange(len(string)) + string
        entries = np.zeros((len(string) + string[-1] + 1, WIDTH), np.uint8)
        entries[slot] = self.entries(np.arange(len(string)), self.length)
        self.bytes = entries.reshape(-1)
        self.start, self.stop = WIDTH * (slot + 1), WIDTH * (slot[last] + 1) + 8

    def entries(self, run: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Name and length of runs of which so much is left, as bytes in the order of the suffixes."""
        turn = np.where(self.falls[run], left, TOP - left)
        return np.concatenate([x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, cut:] for x, cut in ((self.name[run], 0), (turn, 3))], axis=1)

    def keys(self, rows: np.ndarray) -> pa.Array:
        """Keys of the suffixes at these rows."""
        run = self.run[rows]
        start, size = self.start[run], self.stop[run] - self.start[run]
        offsets = np.concatenate(([0], np.cumsum(size + WIDTH)))
        out = np.empty(offsets[-1], np.uint8)
        out[offsets[:-1, None] + np.arange(WIDTH)] = self.entries(run, self.length[run] - (rows - self.first[run]))
        before = np.cumsum(size) - size
        step = np.arange(size.sum())
        out[np.repeat(offsets[:-1] + WIDTH - before, size) + step] = self.bytes[np.repeat(start - before, size) + step]
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def heads_of(symbols: DataFrame, level: int) -> DataFrame:
    """``text``, ``pos`` (a number among the heads) and ``key`` of each head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in whole_texts(batches):
            text, pos, name = (piece.column(c).to_numpy() for c in ("text", "pos", "name"))
            runs = Runs(text, pos, name, level)
            for k in range(0, len(runs.heads), KEY_ROWS):
                rows = runs.first[runs.heads[k: k + KEY_ROWS]]
                yield pa.RecordBatch.from_arrays([pa.array(text[rows]), pa.array(runs.at[k: k + KEY_ROWS]), runs.keys(rows)],
                                                 ["text", "pos", "key"])

    spread = symbols.select("text", "pos", "name").repartition(partitions(symbols.sparkSession), "text").sortWithinPartitions("text", "pos")
    return spread.mapInArrow(tidied(run), "text long, pos long, key binary")


def keyed_suffixes(symbols: DataFrame, ranks: DataFrame, level: int) -> DataFrame:
    """``symbols`` with each suffix's ``key`` and the ``rank`` behind it, from the ``ranks`` of the heads."""
    given, names = ["text", "pos", "name"], symbols.columns
    carried = [f for f in symbols.schema.fields if f.name not in given]
    schema = T.StructType([*symbols.schema.fields, T.StructField("key", T.BinaryType()), T.StructField("rank", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in whole_texts(batches):
            own = piece.column("own").to_numpy(zero_copy_only=False)
            # texts and, in each, heads stand in one order in both
            rank = np.append(piece.column("name").to_numpy()[~own], -1)
            piece = piece.filter(pa.array(own)).combine_chunks()
            runs = Runs(*(piece.column(c).to_numpy() for c in given), level)
            behind = rank[runs.next[runs.run]]
            for k in range(0, len(piece), KEY_ROWS):
                part = piece.slice(k, KEY_ROWS)
                columns = {c: part.column(c).combine_chunks() for c in names}
                columns |= {"key": runs.keys(np.arange(k, k + len(part))), "rank": pa.array(behind[k: k + len(part)])}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    both = symbols.withColumn("own", F.lit(True)).unionByName(ranks.select(
        "text", "pos", F.col("rank").alias("name"), F.lit(False).alias("own"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in carried]))
    spread = both.repartition(partitions(symbols.sparkSession), "text").sortWithinPartitions("text", "own", "pos")
    return spread.mapInArrow(tidied(run), schema)


def named(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored table behind it, and ``text``, ``pos`` and ``name``: how many different keys there are up to the row's own, from 1.

    One sort by key and position, so that a frequent key is cut across tasks; each task numbers the keys that it sees, and a row
    for each partition (hashes of its first and last key, how many) puts the numbers of all of them in line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not len(batch):
                continue
            mark = batch.column("mark").to_numpy()
            fresh = np.concatenate(([before is None or mark[0] != before], mark[1:] != mark[:-1]))
            own = seen + np.cumsum(fresh)
            seen, before = int(own[-1]), mark[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(own.astype(np.int64))],
                                             ["text", "pos", "mark", "part", "own"])

    keys = ["key", "text", "pos"]
    spread = heads.repartitionByRange(partitions(heads.sparkSession), *keys).sortWithinPartitions(*keys)
    local = stored(spread.select("text", "pos", F.xxhash64("key").alias("mark")).mapInArrow(
        tidied(run), "text long, pos long, mark long, part int, own long"), "named")
    rows = local.groupBy("part").agg(F.min_by("mark", "own").alias("first"), F.max_by("mark", "own").alias("last"),
                                     F.max("own").alias("n")).orderBy("part").collect()
    lines, base, before = [], 0, None
    for r in rows:
        base -= before == r["first"]  # the key goes on from the partition before
        lines.append((r["part"], base))
        base, before = base + r["n"], r["last"]
    line = heads.sparkSession.createDataFrame(lines, "part int, base long")
    return local, local.join(F.broadcast(line), "part").select(  # a row for each partition
        "text", "pos", (F.col("base") + F.col("own")).alias("name"))


def suffix_order(symbols: DataFrame, n: int, base_rows: int = BASE_ROWS, wanted: str = "true", level: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """The ``wanted`` rows of ``symbols`` in the order of the suffixes that begin there, within partitions and from each to the next.

    ``symbols``: ``text``, ``pos`` and ``name`` (long, over 0), n rows, and columns that are carried along; from each text a table row's worth. The end of
    a string is smaller than any name; suffixes that are equal up to there stand in any order. Beside it the tables that it reads.
    """
    if n <= base_rows:
        return ordered_in_one_task(symbols).filter(wanted), []
    heads = stored(heads_of(symbols, level), "heads")
    names_table, names = named(heads)
    inner, behind = suffix_order(names, heads.count(), base_rows, level=level + 1)
    ranks = stored(inner.select("text", "pos", F.monotonically_increasing_id().alias("rank")), "ranks")
    discard(heads, names_table, *behind)
    keys = ["key", "rank", "text", "pos"]
    keyed = keyed_suffixes(symbols, ranks, level).filter(wanted)
    order = keyed.repartitionByRange(partitions(symbols.sparkSession), *keys).sortWithinPartitions(*keys)
    return order.select(*symbols.columns), [ranks]


def suffix_ranks(symbols: DataFrame, n: int, base_rows: int = BASE_ROWS) -> DataFrame:
    """``pos`` and ``rank`` (0 upwards) of every suffix of one text; ``symbols``: ``pos`` 0 to n - 1 and ``name`` (long, over 0)."""
    order, behind = suffix_order(symbols.select(F.lit(0).cast("long").alias("text"), "pos", "name"), n, base_rows)
    local = stored(order.select("pos", F.monotonically_increasing_id().alias("tag")), "ranks")
    discard(*behind)
    part, before, lines = F.shiftright("tag", 33).cast("int").alias("part"), 0, []
    for r in local.groupBy(part).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        lines.append((r["part"], before))
        before += r["n"]
    line = symbols.sparkSession.createDataFrame(lines, "part int, before long")
    return local.select("pos", "tag", part).join(F.broadcast(line), "part").select(
        "pos", (F.col("before") + F.col("tag").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
