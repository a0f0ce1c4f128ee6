"""MinHash near-duplicates by fast similarity sketching.

A sketch has ``coordinates`` bins. In round r every element of a set is thrown into the bin that its seeded hash names, with
a value that starts at r; a bin keeps its least value, so a bin once filled is settled. After as many rounds as bins, the
rounds that follow throw every element into one named bin each, so that no coordinate stays empty, however small the set.
Equal coordinates have the similarity of the sets as their expectation, with concentration as for independent draws.

Bands of coordinates give buckets. First, every member of a bucket is compared on the full sets with the smallest of the
bucket, and links join components; most buckets then hold one component besides that leader, and are done. Of the others
the remaining members are dealt into blocks of bounded size, and every two blocks of a bucket are compared set by set inside
one task, which returns a spanning forest of the links found between components and never the pairs. No bucket is capped, and none is gathered.
Equal sets are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhound.llm.common import BASE, byte_steps, discard, lower, mix, stored, table, tidied, word_hashes, words
from trailhound.llm.graph import components, forest

SHINGLE = 3
PERCENT = 85
BANDS = 40
#: Members and set elements of a block, about.
BLOCK = 256
BLOCK_ELEMENTS = 500_000
#: A link of exactly the threshold may be missed by all bands this often at most.
MISS = 1e-8


def rows_per_band(percent: int, bands: int = BANDS, miss: float = MISS) -> int:
    """The longest band with which a pair at the threshold is missed by all bands with at most the given probability."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each row, ascending within the row, and the rows' offsets into them."""
    data = lower(data)
    start, end, row = words(data, offsets)
    word = word_hashes(data, start, end)
    n_rows = len(offsets) - 1
    counts = np.bincount(row, minlength=n_rows)
    folded = np.full(len(word), np.uint64(size))
    out, out_row = [], []
    for k in range(1, size + 1):
        stop = len(word) - k + 1
        if stop <= 0:
            break
        folded = mix(folded[:stop] * BASE + word[k - 1: k - 1 + stop])
        # shorter rows give their only sequence, all other rows give sequences of the full size
        whole = (row[:stop] == row[k - 1: k - 1 + stop]) & ((counts[row[:stop]] == k) if k < size else True)
        out.append(folded[whole])
        out_row.append(row[:stop][whole])
    values = np.concatenate(out) if out else np.zeros(0, np.uint64)
    rows = np.concatenate(out_row) if out else np.zeros(0, np.int64)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[fresh], rows[fresh]
    return values, np.searchsorted(rows, np.arange(n_rows + 1))


def sketches(values: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of coordinates for each set; an empty set keeps the largest value everywhere."""
    n_rows = len(offsets) - 1
    empty = np.uint64((1 << 64) - 1)
    out = np.full((n_rows, coordinates), empty)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    open_rows = np.diff(offsets) > 0
    low = np.uint64(0xFFFFFFFF)
    for r in range(2 * coordinates):
        here = open_rows[row]
        values, row = values[here], row[here]
        if not len(row):
            break
        draw = mix(values + mix(np.array([r + 1], np.uint64)))
        bins = (((draw >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32)).astype(np.int64) if r < coordinates \
            else np.full(len(row), r - coordinates)
        np.minimum.at(flat, row * coordinates + bins, (np.uint64(r) << np.uint64(32)) | (draw & low))
        rows_now = np.flatnonzero(open_rows)
        open_rows[rows_now] = (out[rows_now] == empty).any(axis=1)
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sketch), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sketch), np.uint64(b + 1))
        for c in range(b * rows, (b + 1) * rows):
            key = mix(key * BASE + sketch[:, c])
        out[:, b] = key
    return out


def set_digests(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit sums over each set: with its size, its name."""
    out = []
    for seed in (1, 2):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ mix(np.array([seed], np.uint64))), out=sums[1:])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out


def sketched(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n``, the set's name (``a``, ``b``) and its band keys; none for an empty set."""
    rows = rows_per_band(percent)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_steps(batch.column("text")):
                values, cuts = shingle_sets(data, offsets, size)
                n = np.diff(cuts)
                a, b = set_digests(values, cuts)
                keys = band_keys(sketches(values, cuts, BANDS * rows), BANDS, rows).view(np.int64)
                keys = keys[n > 0].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), batch.column("text_hash").slice(first, last - first),
                     pa.array(n.astype(np.int64)), pa.array(a), pa.array(b),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(([0], (n > 0) * BANDS))).astype(np.int32)),
                                              pa.array(keys))], schema.names)

    return docs.select("doc_id", "text", text_hash()).mapInArrow(tidied(run), schema)


def text_hash() -> Column:
    """Tells apart the texts of one id; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``rep`` and its set as bytes (ascending 64-bit hashes) for the wanted classes (``rep``, ``doc_id`` of a member, ``a``, ``b``)."""
    near = docs.select("doc_id", "text").join(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("rep")
            want = [batch.column(c).to_numpy() for c in ("a", "b")]
            for first, last, data, offsets in byte_steps(batch.column("text")):
                values, cuts = shingle_sets(data, offsets, size)
                names = set_digests(values, cuts)
                # where an id stands on several texts, only the one that gave the set counts
                same = np.flatnonzero((names[0] == want[0][first:last]) & (names[1] == want[1][first:last]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first).take(pa.array(same)), pa.array(
                        [values[cuts[i]: cuts[i + 1]].tobytes() for i in same], pa.binary())], ["rep", "members"])

    return near.mapInArrow(tidied(run), "rep long, members binary").dropDuplicates(["rep"])  # repeated rows give one set again


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``u``, ``v``) whose full sets reach the threshold."""
    one = sets.select(F.col("rep").alias("u"), F.col("members").alias("u_set"))
    other = sets.select(F.col("rep").alias("v"), F.col("members").alias("v_set"))
    met = pairs.join(one, "u").join(other, "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("u_set"), batch.column("v_set"))):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("u", "v")], ["u", "v"])

    return met.select("u", "v", "u_set", "v_set").mapInArrow(run, pairs.select("u", "v").schema)


def linked_in_blocks(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``u``, ``v``) among the components of each bucket: a forest for each two of its blocks.

    ``dealt``: ``key``, ``rep``, ``component`` (of the links known before: those within one are not given again), ``chunk``
    (the block) and ``chunks`` (how many blocks the bucket has).
    """
    blocks = stored(dealt.join(sets, "rep").groupBy("key", "chunk", "chunks").agg(
        F.collect_list(F.struct("component", "members")).alias("block")), "blocks")
    one = blocks.select("key", F.col("block").alias("a"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("chunk"))
    met = one.join(blocks.select("key", "chunk", F.col("block").alias("b")), ["key", "chunk"])

    def unpacked(block: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, members = block.values.field("component").to_numpy(), block.values.field("members")
        parts = [np.frombuffer(m.as_buffer(), np.uint64) for m in members]
        return names, np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("a"), batch.column("b")):
                (names, values, cuts), (others, other_values, other_cuts) = unpacked(x), unpacked(y)
                words = np.unique(np.concatenate((values, other_values)))
                code, other_code = np.searchsorted(words, values), np.searchsorted(words, other_values)
                sizes, other_sizes = np.diff(cuts), np.diff(other_cuts)
                here = np.zeros(len(words), np.int64)
                u, v = [], []
                for i in range(len(names)):
                    own = code[cuts[i]: cuts[i + 1]]
                    here[own] = 1
                    shared = np.add.reduceat(here[other_code], other_cuts[:-1])
                    here[own] = 0
                    near = np.flatnonzero(100 * shared >= percent * (sizes[i] + other_sizes - shared))
                    u.append(np.full(len(near), names[i]))
                    v.append(others[near])
                nodes, roots = forest(np.concatenate(u), np.concatenate(v))
                tied = nodes != roots
                yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(roots[tied])], ["u", "v"])

    return met.select("a", "b").mapInArrow(tidied(run), "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept`` and ``text_hash`` for every row of ``docs``.

    Null text counts as empty; a row without words links with nothing. A null id cannot name a component: such a row
    takes part in none, and is kept. Repeated rows share a class. Different texts under one id are different
    documents that share a name: each links for itself. Ids may be of any type that has an order. Other columns are not looked at.
    """
    known = stored(sketched(docs, size, percent), "sketches")
    real = known.filter("n > 0 and doc_id is not null")
    # a class is a set: its number stands for it in links, its smallest id only names the component in the end
    classes = stored(real.groupBy("a", "b", "n").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")).withColumn(
        "rep", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key"), "keys")
    live = stored(keyed.join(shared, "key"), "live")
    wanted = classes.join(live.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "a", "b")
    sets = stored(full_sets(docs, wanted, size), "sets")
    led = stored(live.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lead")), "leaders")
    joined = live.join(led, "key").filter(
        (F.col("rep") != F.col("lead.rep"))
        & (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")))
    pairs = stored(joined.select(F.greatest("rep", "lead.rep").alias("u"), F.least("rep", "lead.rep").alias("v")).distinct(),
                   "pairs")
    found = stored(verified(pairs, sets, percent), "found")
    groups = stored(components(found), "groups")
    discard(shared, pairs)
    # leaders have met every member of their bucket and leave it; a bucket goes on if what remains is of more than one component
    rest = live.join(led.select("key", F.col("lead.rep").alias("rep")), ["key", "rep"], "left_anti")
    rest = stored(rest.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("component")), "rest")
    discard(live, led)
    mixed = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"),
                                    F.sum("n").alias("elements")).filter("x <> y")
    chunks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    open_buckets = stored(mixed.select("key", chunks.alias("chunks")), "mixed")
    if not open_buckets.isEmpty():
        dealt = rest.join(open_buckets, "key").select("key", "rep", "component", "chunks", F.pmod(
            F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"))
        more = stored(linked_in_blocks(dealt, sets, percent), "found")
        discard(groups)
        groups = stored(components(found.unionByName(more)), "groups")
        discard(more)
    discard(sets, rest, open_buckets, found)
    placed = stored(classes.select("a", "b", "n", "rep", "doc_id").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "a", "b", "n", "doc_id", F.coalesce("component", "rep").alias("group")), "placed")
    least = placed.groupBy("group").agg(F.min("doc_id").alias("component"))
    named = stored(placed.drop("doc_id").join(least, "group").drop("group"), "named")
    discard(classes, groups, placed)
    out = known.select("doc_id", "text_hash", "n", "a", "b").join(named, ["a", "b", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    result = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
    result.behind = (known, named)  # tables that the result reads: to be discarded once it is stored
    return result


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by sets of 3-word shingles, linked from a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
