"""Nearest neighbours by vantage-point trees, one for each shard.

The largest inner product is a smallest distance once every vector gets one more dimension that brings all of them to the
length of the longest, and a query gets that length and nothing in the new dimension; the triangle inequality then holds. A tree
over a bounded sample deals all vectors into leaves, leaves of more vectors than a shard holds are split by hash, and each
shard is stored with a tree of its own. A query first searches the shard that it would be in, which bounds the distance of
its 20th neighbour; then blocks of queries go to the other shards within that bound.

At a vantage point a part of the tree is left out if the triangle inequality puts it ``factor`` times the bound away or more.
Factor one leaves out only what cannot hold a neighbour and so is exact; a smaller one looks at less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailhound.llm.common import partitions, stored, table

NEAREST = 20
FACTOR = 0.4
#: Numbers in a shard's vectors (16,384 vectors of 64 dimensions), vectors in a leaf of its tree.
SHARD_VALUES = 1 << 20
LEAF = 128
#: Vectors of a length that the dealing tree is fitted on, and the fewest of them behind one of its leaves.
SAMPLE = 8192
SAMPLE_LEAF = 16
#: Queries that travel and are searched together, and blocks that one task searches in a copy of a shard.
BLOCK = 256
LANE = 64
#: Rounding that bounds allow for, as a share of the lengths.
SLACK = 1e-9


@dataclass
class Node:
    """Points [first, last) of the tree's order: a leaf, or a vantage point (``first``) with near and far parts and their distances from it."""

    first: int
    last: int
    near: Node | None = None
    far: Node | None = None
    reach: tuple[float, float, float, float] = field(default=(0.0, 0.0, 0.0, 0.0))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the dimension that brings them to the length ``longest``."""
    rest = np.sqrt(np.maximum(longest ** 2 - (vectors ** 2).sum(axis=1), 0))
    return np.concatenate((vectors, rest[:, None]), axis=1)


def aimed(queries: np.ndarray, longest: float) -> np.ndarray:
    """Queries brought to the length ``longest``, with nothing in the new dimension: the order of inner products stays."""
    size = np.sqrt((queries ** 2).sum(axis=1, keepdims=True))
    return np.concatenate((queries / size * longest, np.zeros((len(queries), 1))), axis=1)


def distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - vantage) ** 2).sum(axis=1))


def grow(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple]]:
    """Order of the points and the nodes (first, last, near, far, four distances) of a tree over them, the root first.

    The vantage point of a part is the point farthest from its first one: far ones tell points apart best.
    """
    order, nodes = np.arange(len(points)), []

    def build(first: int, last: int) -> int:
        at = len(nodes)
        nodes.append((first, last, -1, -1, 0.0, 0.0, 0.0, 0.0))
        if last - first <= leaf:
            return at
        part = order[first:last]
        best = int(np.argmax(distances(points[part], points[part[0]])))
        part[[0, best]] = part[[best, 0]]
        away = distances(points[part[1:]], points[part[0]])
        half = len(away) // 2
        split = np.argpartition(away, half)
        part[1:] = part[1:][split]
        away = away[split]
        near, far = build(first + 1, first + 1 + half), build(first + 1 + half, last)
        nodes[at] = (first, last, near, far, away[:half].min(), away[:half].max(), away[half:].min(), away[half:].max())
        return at

    if len(points):
        build(0, len(points))
    return order, nodes


class Best:
    """The ``k`` best (largest product, then smallest id) found so far for each of a block of queries."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, longest: float, floor: np.ndarray):
        self.queries, self.ids, self.k, self.longest = queries, ids, k, longest
        self.size = np.sqrt((queries ** 2).sum(axis=1))
        self.floor = floor.copy()  # the k-th best product, from below
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def bound(self, which: np.ndarray) -> np.ndarray:
        """Distance of the k-th best among lifted vectors."""
        product = self.floor[which] / self.size[which] * self.longest
        return np.sqrt(np.maximum(2 * self.longest ** 2 - 2 * product, 0))

    def look(self, which: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        products = self.queries[which] @ vectors.T
        slack = SLACK * self.size[which] * self.longest
        i, j = np.nonzero(products >= (self.floor[which] - slack)[:, None])
        other = self.ids[which[i]] != ids[j]
        i, j = i[other], j[other]
        if not len(i):
            return
        # a sum in one fixed order: equal vectors get equal products, whatever block they are in
        exact = (self.queries[which[i]] * vectors[j]).sum(axis=1)
        query, score, vec = (np.concatenate(x) for x in zip(self.found, (which[i], exact, ids[j]), strict=True))
        order = np.lexsort((vec, -score, query))
        query, score, vec = query[order], score[order], vec[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.found = (query[keep], score[keep], vec[keep])
        full = place == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])


def search(best: Best, factor: float, points: np.ndarray, ids: np.ndarray, nodes: list[tuple]) -> None:
    """Walk the tree with all queries of ``best`` at once, nearer parts first; ``points`` in the tree's order, lifted."""
    lifted_queries = aimed(best.queries, best.longest)
    slack = SLACK * best.longest
    stack = [(0, np.arange(len(best.ids)), np.zeros(len(best.ids)))] if nodes else []
    while stack:
        at, which, gap = stack.pop()
        which = which[gap <= factor * best.bound(which) + slack]
        if not len(which):
            continue
        first, last, near, far, *reach = nodes[at]
        if near < 0:
            best.look(which, points[first:last, :-1], ids[first:last])
            continue
        best.look(which, points[first: first + 1, :-1], ids[first: first + 1])
        away = np.sqrt(((lifted_queries[which] - points[first]) ** 2).sum(axis=1))
        gaps = [np.maximum(np.maximum(away - high, low - away), 0) for low, high in (reach[:2], reach[2:])]
        inside = gaps[0] <= gaps[1]
        for chosen, order in ((~inside, (near, far)), (inside, (far, near))):  # what is pushed last is walked first
            if chosen.any():
                for child in order:
                    stack.append((child, which[chosen], gaps[child == far][chosen]))


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


@dataclass
class Dealer:
    """For one length of vector: the longest one's length, and the dealing tree's nodes over its vantage points."""

    longest: float
    points: np.ndarray
    nodes: list[tuple]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every vantage point it goes to the part whose distances it fits better."""
        points, out = lifted(vectors, self.longest), np.zeros(len(vectors), np.int64)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            at, which = stack.pop()
            first, _, near, far, *reach = self.nodes[at]
            if near < 0:
                out[which] = at
                continue
            inside = distances(points[which], self.points[first]) <= (reach[1] + reach[2]) / 2
            stack += [(near, which[inside]), (far, which[~inside])]
        return out


def dealers(rows: DataFrame, longest: dict[int, tuple[float, int]]) -> dict[int, Dealer]:
    """A dealing tree for each length of vector, over a sample of ``SAMPLE`` vectors with the smallest hashes."""
    out = {}
    for d, (size, n) in longest.items():
        drawn = rows.filter(F.col("d") == d).select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()
        points = lifted(matrix(drawn.column("vector").combine_chunks(), d), size)
        leaves = max(1, math.ceil(n * d / SHARD_VALUES))
        order, nodes = grow(points, max(SAMPLE_LEAF, len(points) // leaves))
        out[d] = Dealer(size, points[order], nodes)
    return out


def dealt(rows: DataFrame, found: dict[int, Dealer]) -> DataFrame:
    """Rows with ``leaf`` in the dealing tree of their length."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, leaf = batch.column("d").to_numpy(), np.zeros(len(batch), np.int64)
            for d in np.unique(length).tolist():
                at = np.flatnonzero(length == d)
                leaf[at] = shared.value[d].leaves(matrix(batch.column("vector").take(pa.array(at)), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return rows.select("vec_id", "d", "vector").mapInArrow(run, "vec_id long, d int, vector array<double>, leaf long")


def in_shards(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with ``shard``: their leaf, split by the vector's hash into as many parts as the leaf needs."""
    part = F.pmod(F.xxhash64("vector"), F.coalesce("parts", F.lit(1)))
    return rows.join(parts, ["d", "leaf"], "left").withColumn("shard", F.concat_ws("/", "d", "leaf", part)).drop("parts")


def index(rows: DataFrame, found: dict[int, Dealer]) -> DataFrame:
    """A row for each shard: its vectors in the order of its tree, their ids, and the tree."""
    lengths = {d: x.longest for d, x in found.items()}
    schema = "shard string, d int, leaf long, ids binary, vectors binary, nodes binary"

    def packed(part: pa.Table) -> pa.RecordBatch:
        d = part.column("d")[0].as_py()
        vectors = matrix(part.column("vector").combine_chunks(), d)
        order, nodes = grow(lifted(vectors, lengths[d]), LEAF)
        ids = part.column("vec_id").to_numpy()[order]
        return pa.RecordBatch.from_pylist([{
            "shard": part.column("shard")[0].as_py(), "d": d, "leaf": part.column("leaf")[0].as_py(), "ids": ids.astype(np.int64).tobytes(),
            "vectors": vectors[order].tobytes(), "nodes": np.array(nodes, float).tobytes()}], INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            names = batch.column("shard").to_numpy(zero_copy_only=False)
            turns = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(turns[:-1], turns[1:], strict=True):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if held and held[0].column("shard")[0].as_py() != names[a]:
                    yield packed(pa.concat_tables(held))
                    held = []
                held.append(part)
        if held:
            yield packed(pa.concat_tables(held))

    return rows.repartition(4 * partitions(rows.sparkSession), "shard").sortWithinPartitions("shard", "vec_id").mapInArrow(run, schema)


INDEX = pa.schema([("shard", pa.string()), ("d", pa.int32()), ("leaf", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()),
                   ("nodes", pa.binary())])
BLOCKS = "shard string, d int, block long, ids binary, vectors binary, floors binary"


def blocks(queries: DataFrame, found: dict[int, Dealer], parts: dict[tuple[int, int], int], factor: float | None) -> DataFrame:
    """Queries packed by the shard they go to: their own, or (with ``factor``) all others that the dealing tree puts within their bounds.

    ``queries``: vec_id, d, vector, leaf, shard and ``floor``, the k-th best product so far.
    """
    shared = queries.sparkSession.sparkContext.broadcast((found, parts))

    def reached(dealer: Dealer, vectors: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        best = Best(vectors, np.zeros(len(vectors), np.int64), 1, dealer.longest, floor)
        aims, bounds, stack = aimed(vectors, dealer.longest), best.bound(np.arange(len(vectors))), [(0, np.arange(len(vectors)))]
        while stack:
            at, which = stack.pop()
            first, _, near, far, *reach = dealer.nodes[at]
            if near < 0:
                yield at, which
                continue
            # rows beside the sample may lie nearer or farther than its own: only the cut between the parts bounds them
            away, cut = distances(aims[which], dealer.points[first]), (reach[1] + reach[2]) / 2
            limit = factor * bounds[which] + SLACK * dealer.longest
            stack += [(near, which[away - cut <= limit]), (far, which[cut - away <= limit])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealers_, parts_ = shared.value
        for batch in batches:
            length, ids = batch.column("d").to_numpy(), batch.column("vec_id").to_numpy()
            home = batch.column("shard").to_numpy(zero_copy_only=False)
            floors = batch.column("floor").to_numpy()
            for d in np.unique(length).tolist():
                at = np.flatnonzero(length == d)
                vectors = matrix(batch.column("vector").take(pa.array(at)), d)
                if factor is None:
                    goals = [(s, np.flatnonzero(home[at] == s)) for s in np.unique(home[at]).tolist()]
                else:
                    goals = [(f"{d}/{leaf}/{part}", which[home[at[which]] != f"{d}/{leaf}/{part}"])
                             for leaf, which in reached(dealers_[d], vectors, floors[at]) for part in range(parts_.get((d, leaf), 0))]
                for shard, which in goals:
                    for a in range(0, len(which), BLOCK):
                        w = which[a: a + BLOCK]
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
                            (shard, pa.string()), (d, pa.int32()), (int(ids[at[w[0]]]), pa.int64()), (ids[at[w]].tobytes(), pa.binary()),
                            (vectors[w].tobytes(), pa.binary()), (floors[at[w]].tobytes(), pa.binary()))],
                            ["shard", "d", "block", "ids", "vectors", "floors"])

    return queries.select("vec_id", "d", "vector", "shard", "floor").mapInArrow(run, BLOCKS)


def searched(packed: DataFrame, shards: DataFrame, found: dict[int, Dealer], k: int, factor: float) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: the ``k`` best of each query in each shard it was sent to.

    A shard goes to each task that searches it once, ahead of the blocks of queries: as one lane, or for a shard that very many
    blocks were sent to, as several.
    """
    lengths = {d: x.longest for d, x in found.items()}
    sent = stored(packed, "blocks")
    lanes = sent.groupBy("shard").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    sides = ["shard", "lane", "kind", "d", "ids", "vectors", "nodes", "floors"]
    left = shards.join(lanes, "shard").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).withColumns(
        {"kind": F.lit(0), "floors": F.lit(None).cast("binary")})
    right = sent.join(lanes, "shard").withColumns({
        "lane": F.pmod(F.xxhash64("block", "ids"), F.col("lanes")).cast("int"), "kind": F.lit(1), "nodes": F.lit(None).cast("binary")})
    both = left.select(*sides).unionByName(right.select(*sides))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = ids = nodes = None
        for batch in batches:
            for row in range(len(batch)):
                d, kind = batch.column("d")[row].as_py(), batch.column("kind")[row].as_py()
                get = lambda c, t: np.frombuffer(batch.column(c)[row].as_buffer(), t)  # noqa: B023, E731
                if kind == 0:
                    ids, points = get("ids", np.int64).copy(), lifted(get("vectors", float).reshape(-1, d), lengths[d])
                    nodes = [(*map(int, n[:4]), *n[4:].tolist()) for n in get("nodes", float).reshape(-1, 8)]
                    continue
                best = Best(get("vectors", float).reshape(-1, d), get("ids", np.int64), k, lengths[d], get("floors", float))
                search(best, factor, points, ids, nodes)
                query, score, vec = best.found
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[query]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    dealt_out = both.repartition(4 * partitions(both.sparkSession), "shard", "lane").sortWithinPartitions("shard", "lane", "kind")
    return dealt_out.mapInArrow(run, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column, k: int = NEAREST, factor: float = FACTOR, id_col: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for the rows for which ``queries`` holds, their ``k`` nearest among all others.

    ``queries`` may use the columns ``vec_id`` (whole number), ``d`` and ``vector``. Rows without an id or a usable vector take no part;
    vectors of different length are never compared. Repeated rows of one id and vector count once; an id on several
    vectors is a candidate with each, and never one for itself. Ties go to the smaller id. Empty tables give no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & usable("vector")).withColumn("d", F.size("vector"))
    # of equal vectors only the first k + 1 ids can be among a query's k nearest, its own left out
    copies = rows.distinct().withColumn("copy", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id")))
    points = stored(copies.filter(F.col("copy") <= k + 1).drop("copy"), "points")
    sizes = points.groupBy("d").agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("longest"),
                                    F.count("*").alias("n")).collect()
    found = dealers(points, {r["d"]: (r["longest"], r["n"]) for r in sizes})
    placed = stored(dealt(points, found), "placed")
    full = F.ceil(F.count("*") * F.col("d") / F.lit(SHARD_VALUES)).cast("int").alias("parts")
    parts = stored(placed.groupBy("d", "leaf").agg(full), "parts")
    shards = stored(index(in_shards(placed, parts), found), "index")
    asked = stored(in_shards(dealt(rows.filter(queries).distinct(), found), parts), "queries")
    counts = {(r["d"], r["leaf"]): r["parts"] for r in parts.collect()}
    none = F.lit(float("-inf"))
    home = stored(searched(blocks(asked.withColumn("floor", none), found, counts, None), shards, found, k, factor), "home")
    floor = ranked(home, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    bounded = asked.join(floor, "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
    away = searched(blocks(bounded, found, counts, factor), shards, found, k, factor)
    return ranked(home.unionByName(away), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th row of ``embeddings``."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
