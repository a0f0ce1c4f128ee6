"""Suffix-array dedup: remove every byte that a repeated string of ``SPAN`` bytes covers.

Ordering all byte suffixes of a corpus would cost many times its size, so the string that is sorted is one of content-cut
symbols. A mark is the smallest (rightmost of equal) hash of ``GRAM`` bytes among ``SPAN - GRAM + 1`` neighbours: every
string of SPAN bytes names one mark by its content alone, so two equal strings have equal marks at equal places.

1. Marks whose gram occurs once in the corpus belong to no repeated string; they cut each document into runs of marks
   that may repeat. A mark's symbol is the text up to the next mark and its gram.
2. The suffixes of the strings of symbols are put in order (:mod:`trailhound.llm.suffixes`). Neighbours
   in that order are compared over the shortest prefix of symbols that spans SPAN bytes: equal prefixes are repeated
   text, and all strings inside it are repeated strings.
3. Strings that begin or end beside whole symbols, at the edges of repeated text, remain. They are handled in blocks of
   ``BLOCK`` neighbours under one mark: blocks whose common bytes occur once go; of blocks with equal bytes one stands for
   all; what then is left is compared string by string.

The same steps cut passages of so many words where a text is taken as the string of its words' hashes instead of its bytes.

Hashes have 64 bits. All groups are counted, joined or represented, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhound.llm.common import (
    BASE, byte_steps, cut_hash, discard, freed_shuffles, mix, partitions, prefix_hash, stored, table, texts, tidied, words)
from trailhound.llm.op2_winnow import window_minima
from trailhound.llm.suffixes import BASE_ROWS, suffix_order
from trailhound.session import scratch_path

SPAN = 400
GRAM = 200
BLOCK = 64


def with_keys(docs: DataFrame) -> DataFrame:
    """``row_key`` (one for each row), ``text``, and ``row`` with all other columns, in a table bucketed by the key.

    Later joins by the key move no texts.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "texts")
    name = "texts_" + path[-32:]
    others = [F.col(c) for c in docs.columns if c != "text"]
    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*others).alias("row"), "text")
    with freed_shuffles(spark):
        keyed.repartition(partitions(spark), "row_key").write.option("path", path).option("compression", "zstd").bucketBy(
            partitions(spark), "row_key").saveAsTable(name)
    return spark.table(name)


def marks_of(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mark positions, their gram hashes, and the prefix hash of the text; no marks if the text is shorter than a span."""
    prefix = prefix_hash(data)
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), prefix
    start = np.arange(len(data) - gram + 1)
    hashes = cut_hash(prefix, start, start + gram)
    at = window_minima(hashes, span - gram + 1)
    return at, hashes[at], prefix


def each_text(batch: pa.RecordBatch, by_words: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Number and bytes of each row's text, or the hashes of its words."""
    for first, last, data, offsets in byte_steps(batch.column("text")):
        if by_words:
            start, end, row = words(data, offsets)
            data, offsets = cut_hash(prefix_hash(data), start, end), np.searchsorted(row, np.arange(last - first + 1))
        for i in range(last - first):
            yield first + i, data[offsets[i]: offsets[i + 1]]


def shared_grams(keyed: DataFrame, span: int, gram: int, by_words: bool = False) -> DataFrame:
    """Gram hashes of marks that occur at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [marks_of(data, span, gram)[1] for _, data in each_text(batch, by_words)]
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.minimum(counts, 2))], ["gram", "n"])

    return keyed.select("text").mapInArrow(tidied(run), "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")).filter("n > 1").select("gram")


def run_bounds(at: np.ndarray, hashes: np.ndarray, length: int, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the span strings that name each mark."""
    window = span - gram + 1
    # a mark takes over from its predecessor when that leaves the window or as soon as it is seen and is no larger
    low = np.zeros(len(at), np.int64)
    takes = hashes[1:] >> np.uint64(20) <= hashes[:-1] >> np.uint64(20)
    low[1:] = np.where(takes, np.maximum(at[1:] - window + 1, 0), at[:-1] + 1)
    high = np.append(low[1:] - 1, length - span)
    return low, high


#: Where a mark stands (its number in the text and its byte) and its shape (how far before it its strings begin and end, how
#: many marks on its prefix ends, how long that is) travel as one number each.
def unpacked(marks: DataFrame) -> DataFrame:
    at = F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF))
    part = lambda k: F.shiftright("shape", 16 * k).bitwiseAND(F.lit(0xFFFF))
    columns = {"place": F.shiftright("spot", 32), "at": at, "low": at - part(0), "high": at - part(1), "far": part(2),
               "end": at + part(3)}
    return marks.withColumns({n: c.cast("int") for n, c in columns.items()}).drop("spot", "shape")


def all_marks(keyed: DataFrame, span: int, gram: int, by_words: bool = False) -> DataFrame:
    """Each mark with its run of strings (``low`` to ``high``), symbol, and the prefix of symbols that spans ``span`` bytes.

    ``far``: how many marks on that prefix ends, 0 where the text ends before; ``end``: the byte after it; ``prefix``: its
    hash. Packed, see :func:`unpacked`; spans of up to 8000 bytes fit.
    """
    schema = "row_key long, spot long, shape long, gram long, symbol long, prefix long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, data in each_text(batch, by_words):
                at, hashes, prefix = marks_of(data, span, gram)
                if not len(at):
                    continue
                low, high = run_bounds(at, hashes, len(data), span, gram)
                number = np.arange(len(at))
                symbol = np.zeros(len(at), np.uint64)
                symbol[:-1] = cut_hash(prefix, at[:-1], at[1:] + gram)
                # the first mark whose gram ends a span or more after the start
                to = np.maximum(np.searchsorted(at, at + span - gram), number + 1)
                there = to < len(at)
                end = np.where(there, at[np.minimum(to, len(at) - 1)] + gram, at)
                whole = np.zeros(len(at), np.uint64)
                whole[there] = mix(cut_hash(prefix, at[there], end[there]) * BASE + (end - at)[there].astype(np.uint64))
                shape = (at - low) | (at - high) << 16 | np.where(there, to - number, 0) << 32 | (end - at) << 48
                columns = (np.full(len(at), keys[i]), number << 32 | at, shape, hashes.view(np.int64),
                           (symbol >> np.uint64(2)).astype(np.int64) + 2, whole.view(np.int64))
                for part, column in zip(parts, columns):
                    part.append(column)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts],
                                                 ["row_key", "spot", "shape", "gram", "symbol", "prefix"])

    return keyed.select("row_key", "text").mapInArrow(tidied(run), schema)


def repeated_prefixes(live: DataFrame, base_rows: int) -> DataFrame:
    """Marks (``row_key``, ``at``, ``end``) whose prefix of symbols also begins at another mark, as neighbours in suffix order.

    A symbol that occurs once is in no repeated prefix, so only others enter the strings; they end where one is missing.
    """
    counts = stored(live.filter("symbol > 2").groupBy("symbol").agg(F.count("*").alias("n")).filter("n > 1").select("symbol"), "symbols")
    kept = stored(live.join(counts, "symbol").select(
        F.col("row_key").alias("text"), F.col("place").cast("long").alias("pos"), F.col("symbol").alias("name"), "at", "end", "far",
        "prefix"), "kept")
    discard(counts)
    order, behind = suffix_order(kept, kept.count(), base_rows, "far > 0")
    beside = stored(neighbours(order.select(F.col("text").alias("row_key"), "at", "end", "prefix")), "beside")
    discard(kept, *behind)
    edges = beside.filter("edge > 0").orderBy("part", "edge").collect()  # two rows for each partition at most
    across = [r for x, y in zip(edges, edges[1:]) if x["part"] < y["part"] and x["prefix"] == y["prefix"] for r in (x, y)]
    columns = ["row_key", "at", "end"]
    more = live.sparkSession.createDataFrame([tuple(r[c] for c in columns) for r in across if not r["same"]],
                                             beside.select(*columns).schema)
    out = stored(beside.filter("same").select(*columns).unionByName(more), "prefixes")
    discard(beside)
    return out


def neighbours(order: DataFrame) -> DataFrame:
    """Rows of each partition whose ``prefix`` the row before or behind has too (``same``), and its first and last row (``edge`` 1 and 2, or 3)."""
    schema = T.StructType([*order.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("edge", T.IntegerType()),
                           T.StructField("same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, edge, held, held_same = TaskContext.get().partitionId(), 1, None, False

        def marked(rows: pa.RecordBatch, edges: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
            take = pa.array(np.flatnonzero(same | (edges > 0)))
            more = [pa.array(np.full(len(same), part, np.int32)), pa.array(edges), pa.array(same)]
            return pa.RecordBatch.from_arrays([c.take(take) for c in (*rows.columns, *more)], schema.names)

        for batch in batches:
            if not len(batch):
                continue
            if held is not None:  # a row waits for the one behind it
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            prefix = batch.column("prefix").to_numpy()
            same, edges = np.zeros(len(batch), bool), np.zeros(len(batch), np.int32)
            same[1:] = prefix[1:] == prefix[:-1]
            same[:-1] |= same[1:]
            same[0] |= held_same
            edges[0] = edge
            held, held_same = batch.slice(len(batch) - 1), bool(same[-1])
            if len(batch) > 1:
                edge = 0
                yield marked(batch.slice(0, len(batch) - 1), edges[:-1], same[:-1])
        if held is not None:
            yield marked(held, np.array([edge | 2], np.int32), np.array([held_same]))

    return order.mapInArrow(tidied(run), schema)


def column_lists(column: pa.Array, names: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Fields of a list of structs as flat arrays, and the offsets of the rows into them; null rows are empty."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return [column.values.field(n).to_numpy().astype(np.int64) for n in names], offsets


def blocks(keyed: DataFrame, runs: DataFrame, span: int, block: int, by_words: bool = False) -> DataFrame:
    """Blocks of strings under live marks: hash of the bytes common to a block (``core``) and of all its bytes (``whole``)."""
    schema = "row_key long, first int, last int, core long, whole long, covered boolean"
    near = runs.join(keyed.select("row_key", "text"), "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            (spots, lows, highs), cuts = column_lists(batch.column("marks"), ["at", "low", "high"])
            (starts, ends), done_cuts = column_lists(batch.column("done"), ["first", "last"])
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, data in each_text(batch, by_words):
                own = slice(cuts[i], cuts[i + 1])
                place, low, high = spots[own], lows[own], highs[own]
                done = joined_ranges(starts[done_cuts[i]: done_cuts[i + 1]], ends[done_cuts[i]: done_cuts[i + 1]])
                prefix = prefix_hash(data)
                first_block, last_block = (place - high) // block, (place - low) // block
                counts = last_block - first_block + 1
                at = np.repeat(place, counts)
                number = np.repeat(first_block, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                begin = at - number * block
                first = np.maximum(begin - block + 1, np.repeat(low, counts))
                last = np.minimum(begin, np.repeat(high, counts))
                core = mix(cut_hash(prefix, begin, begin - block + 1 + span) * BASE + number.astype(np.uint64))
                whole = mix(cut_hash(prefix, first, last + span) * BASE + ((at - first) * span * 2 + at - last).astype(np.uint64))
                covered = np.zeros(len(first), bool)
                if len(done):
                    k = np.searchsorted(done[:, 0], first, side="right") - 1
                    covered = (k >= 0) & (done[np.maximum(k, 0), 1] >= last)
                for part, column in zip(out, (np.full(len(first), keys[i]), first, last, core.view(np.int64),
                                              whole.view(np.int64), covered)):
                    part.append(column)
            if out[0]:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)).cast(t) for p, t in zip(out, types)],
                                                 ["row_key", "first", "last", "core", "whole", "covered"])

    return near.select("row_key", "text", "marks", "done").mapInArrow(tidied(run), schema)


def joined_ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ranges, both ends inclusive, as ascending rows that neither overlap nor touch."""
    if not len(first):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    fresh = np.concatenate(([True], first[1:] > reach[:-1] + 1))
    return np.stack([first[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(first) - 1)]], axis=1)


def single_strings(keyed: DataFrame, wanted: DataFrame, span: int, by_words: bool = False) -> DataFrame:
    """Every string of the wanted blocks (``first`` to ``last``): ``row_key``, ``start`` and its ``hash``."""
    grouped = wanted.groupBy("row_key").agg(F.collect_list(F.struct("first", "last")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            (firsts, lasts), cuts = column_lists(batch.column("blocks"), ["first", "last"])
            for i, data in each_text(batch, by_words):
                prefix = prefix_hash(data)
                starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(
                    firsts[cuts[i]: cuts[i + 1]], lasts[cuts[i]: cuts[i + 1]])])
                for k in range(0, len(starts), 1 << 16):
                    part = starts[k: k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), keys[i])), pa.array(part.astype(np.int32)),
                         pa.array(cut_hash(prefix, part, part + span).view(np.int64))], ["row_key", "start", "hash"])

    return grouped.join(keyed.select("row_key", "text"), "row_key").select("row_key", "text", "blocks").mapInArrow(
        tidied(run), "row_key long, start int, hash long")


def repeated_ranges(keyed: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = BLOCK,
                    base_rows: int = BASE_ROWS, by_words: bool = False) -> DataFrame:
    """``row_key``, ``first``, ``last``: ranges of starts of strings that also start elsewhere (overlaps possible).

    With ``by_words``, all lengths and starts count words. A stored table; those behind it are deleted.
    """
    shared = stored(shared_grams(keyed, span, gram, by_words), "grams")
    packed = stored(all_marks(keyed, span, gram, by_words).join(shared, "gram").drop("gram"), "live")
    discard(shared)
    live = unpacked(packed)
    prefixes = repeated_prefixes(live, base_rows)
    inside = stored(prefixes.select(
        "row_key", F.col("at").alias("first"), (F.col("end") - span).cast("int").alias("last")), "inside")
    discard(prefixes)
    runs = live.groupBy("row_key").agg(F.collect_list(F.struct("at", "low", "high")).alias("marks")).join(
        inside.groupBy("row_key").agg(F.collect_list(F.struct("first", "last")).alias("done")), "row_key", "left")
    cut = stored(blocks(keyed, runs, span, block, by_words), "blocks")
    discard(packed)
    # one entry for blocks of equal bytes; of those that share only their common bytes, each stands for itself
    classes = stored(cut.groupBy("core", "whole").agg(
        F.count("*").alias("n"), F.min(F.struct("row_key", "first", "last")).alias("one"),
        F.min("covered").alias("covered")), "classes")
    open_cores = stored(classes.groupBy("core").agg(
        F.count("*").alias("kinds"), F.max(((F.col("n") == 1) & ~F.col("covered")).cast("int")).alias("open")).filter(
        "kinds > 1 and open = 1").select("core"), "open_cores")
    twice = stored(classes.filter("n > 1 and not covered").select("core", "whole"), "twice")
    equal = stored(cut.join(twice, ["core", "whole"]).select("row_key", "first", "last"), "equal")
    wanted = stored(classes.join(open_cores, "core").select("one.row_key", "one.first", "one.last"), "wanted")
    discard(cut, twice, classes, open_cores)
    strings = stored(single_strings(keyed, wanted, span, by_words), "strings")
    again = stored(strings.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "again")
    alone = strings.join(again, "hash").select("row_key", F.col("start").alias("first"), F.col("start").alias("last"))
    out = stored(inside.unionByName(equal).unionByName(alone), "ranges")
    discard(inside, equal, wanted, strings, again)
    return out


def listed(ranges: DataFrame, name: str) -> DataFrame:
    return ranges.groupBy("row_key").agg(F.collect_list(F.struct("first", "last")).alias(name))


def removed_spans(docs: DataFrame, span: int = SPAN, word_span: int | None = None, **settings) -> DataFrame:
    """``row``, ``text`` and ``spans``: maximal byte ranges [first, last) of the text to remove, none for null text.

    With ``word_span``, also what strings of so many words repeat, from the first to the last word and whatever space stands
    between them.
    """
    keyed = with_keys(docs)
    found = keyed.join(listed(repeated_ranges(keyed, span, **settings), "ranges"), "row_key", "left")
    if word_span:
        by_words = repeated_ranges(keyed, word_span, (word_span + 1) // 2, max(1, word_span // 6), by_words=True,
                                   **{k: v for k, v in settings.items() if k == "base_rows"})
        found = found.join(listed(by_words, "word_ranges"), "row_key", "left")
    schema = T.StructType([keyed.schema["row"], T.StructField("text", T.StringType()), T.StructField(
        "spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])))])

    def in_bytes(text: pa.StringScalar, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(text.as_buffer(), np.uint8)
        start, end, _ = words(data, np.array([0, len(data)]))
        return start[first], end[last + word_span - 1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["spans"].dataType)
        for batch in batches:
            spans = []
            (firsts, lasts), cuts = column_lists(batch.column("ranges"), ["first", "last"])
            if word_span:
                (word_firsts, word_lasts), word_cuts = column_lists(batch.column("word_ranges"), ["first", "last"])
            for i, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                first, last = firsts[start:stop], lasts[start:stop] + span - 1  # bytes of strings from first to last
                if word_span and word_cuts[i] < word_cuts[i + 1]:
                    own = slice(word_cuts[i], word_cuts[i + 1])
                    more = in_bytes(batch.column("text")[i], word_firsts[own], word_lasts[own])
                    first, last = np.concatenate((first, more[0])), np.concatenate((last, more[1]))
                spans.append([{"first": int(a), "last": int(b) + 1} for a, b in joined_ranges(first, last)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(spans, kind)], schema.names)

    return found.drop("row_key").mapInArrow(tidied(run), schema)


def kept_parts(data: bytes, spans: list[dict]) -> list[bytes]:
    """What stands before, between and after the spans."""
    ends = [0, *(x for s in spans for x in (s["first"], s["last"])), len(data)]
    return [data[a:b] for a, b in zip(ends[::2], ends[1::2])]


def digests(docs: DataFrame, **settings) -> DataFrame:
    """Counts and a digest of what remains of each row's text; null text counts as empty."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(texts(batch.column("text")), batch.column("spans")):
                data, spans = text.as_buffer().to_pybytes(), found.as_py()
                kept = b"".join(kept_parts(data, spans))
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                schema.names)

    return removed_spans(docs.select("doc_id", "text"), **settings).select(
        "row.doc_id", "text", "spans").mapInArrow(tidied(run), schema)


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; a character of which any byte is removed goes whole.

    ``n_chars``, where there is such a column, follows the new text. Null text stays null; a text that repeats from end to
    end becomes empty, and its row stays.
    """
    schema = T.StructType([*removed_row(docs), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column("spans")):
                spans = found.as_py()
                out.append("".join(p.decode("utf-8", "ignore") for p in kept_parts(text.as_buffer().to_pybytes(), spans))
                           if spans else text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], schema.names)

    cut = removed_spans(docs, **settings).mapInArrow(tidied(run), schema)
    columns = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("text").isNull(), columns["n_chars"]).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[x.alias(c) for c, x in columns.items()])


def removed_row(docs: DataFrame) -> list[T.StructField]:
    return [T.StructField("row", T.StructType([f for f in docs.schema.fields if f.name != "text"]), False)]


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as bytes, without what strings of 400 bytes repeat."""
    return digests(table(spark, sf_dir, "documents"))
