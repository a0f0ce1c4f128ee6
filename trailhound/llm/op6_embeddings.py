"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of a label become one class with a count. Unit vectors are turned into the directions of most variance (from
second moments summed across partitions), so that a product is nearly settled by its leading terms. Rows in an order
that keeps neighbours together are cut into tiles of bounded size. Two tiles meet only if their boxes in the leading
dimensions lie within reach. Inside a pair of tiles, products grow block by block of dimensions; what the rest can add is
at most the product of the suffix norms, and pairs that cannot reach the threshold are dropped. Tiles return sums of
links and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhound.llm.common import stored, table
from trailhound.llm.graph import components, forest

THRESHOLD = 0.93
#: Vectors in a tile; dimensions of a tile's box; first block of dimensions of a product.
TILE = 1024
BOX = 8
BLOCK = 8
#: Products this near to the threshold are computed again from the vectors as given.
NEAR = 1e-9


def usable(vector: str) -> Column:
    """Whether a vector can link: not null or empty, all components finite, and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def second_moments(classes: DataFrame) -> dict[int, np.ndarray]:
    """Sums of outer products of unit vectors, for each length of vector: their squared length bounds what is fetched."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for d, vectors in frame.groupby("d")["vector"]:
                unit = units(np.stack(vectors.to_list()).astype(float))
                sums[d] = sums.get(d, 0) + unit.T @ unit
        for d, total in sums.items():
            yield pd.DataFrame({"d": d, "i": np.arange(d), "row": list(total)})

    partial = classes.select("d", "vector").mapInPandas(run, "d int, i int, row array<double>")
    cells = partial.select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in cells.collect():
        out.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["x"]
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def directions(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions by falling variance, and the spread along each."""
    values, vectors = np.linalg.eigh(moments)
    return vectors[:, ::-1], np.sqrt(np.maximum(values[::-1], 0) / max(np.trace(moments), 1e-300))


def interleaved(turned: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """A number whose order keeps vectors together that are near in the first four directions."""
    lead = min(4, turned.shape[1])
    scaled = turned[:, :lead] / np.maximum(spread[:lead], 1e-12)
    level = np.clip((scaled + 3) / 6 * 64, 0, 63).astype(np.int64)
    out = np.zeros(len(turned), np.int64)
    for bit in range(5, -1, -1):
        for c in range(lead):
            out = out << 1 | (level[:, c] >> bit & 1)
    return out


def tiles(classes: DataFrame, bases: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Bounded tiles of each label with their boxes; ``classes``: rep, label, d, vector, n."""
    shared = classes.sparkSession.sparkContext.broadcast(bases)

    def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, part in frame.groupby("d"):
                basis, spread = shared.value[d]
                turned = units(np.stack(part["vector"].to_list()).astype(float)) @ basis
                yield part.assign(place=interleaved(turned, spread), vector=[x.astype(float) for x in part["vector"]])

    keyed = classes.mapInPandas(key, "rep long, label string, d int, vector array<double>, n long, place long")
    ordered = keyed.repartitionByRange("label", "d", "place", "rep").sortWithinPartitions("label", "d", "place", "rep")
    schema = ("tile string, label string, d int, reps binary, counts binary, vectors binary, "
              "low array<double>, high array<double>")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            groups = [g for _, g in held.groupby(["label", "d"], sort=False)]
            for group in groups[:-1]:
                yield packed(group)
            held = groups[-1]
            while len(held) >= TILE:
                yield packed(held.iloc[:TILE])
                held = held.iloc[TILE:]
        if held is not None and len(held):
            yield packed(held)

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for first in range(0, len(group), TILE):
            part = group.iloc[first: first + TILE]
            label, d = part["label"].iloc[0], int(part["d"].iloc[0])
            vectors = np.stack(part["vector"].to_list())
            turned = units(vectors) @ shared.value[d][0]
            lead = turned[:, :BOX]
            rest = np.sqrt(np.maximum(0, 1 - (lead ** 2).sum(axis=1)))
            box = np.concatenate((lead, rest[:, None]), axis=1)
            out.append((f"{label}/{d}/{part['place'].iloc[0]}/{part['rep'].iloc[0]}", label, d,
                        part["rep"].to_numpy(np.int64).tobytes(), part["n"].to_numpy(np.int64).tobytes(),
                        vectors.tobytes(), box.min(axis=0), box.max(axis=0)))
        return pd.DataFrame(out, columns=["tile", "label", "d", "reps", "counts", "vectors", "low", "high"])

    return ordered.mapInPandas(cut, schema)


def tile_pairs(cut: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a <= b, of tiles whose boxes come within reach of the threshold, found by cells of the first axis."""
    reach = max(1e-6, (2 - 2 * threshold) ** 0.5 + 1e-6)
    boxes = cut.select("tile", "label", "d", "low", "high")
    cell = lambda c, by: F.floor(F.element_at(c, 1) / reach).cast("int") + by
    left = boxes.select("label", "d", F.col("tile").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"),
                        F.explode(F.sequence(cell("low", -1), cell("high", 1))).alias("cell"))
    right = boxes.select("label", "d", F.col("tile").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"),
                         F.explode(F.sequence(cell("low", 0), cell("high", 0))).alias("cell"))
    gap = F.zip_with(F.zip_with("b_low", "a_high", lambda x, y: x - y), F.zip_with("a_low", "b_high", lambda x, y: x - y),
                     lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= reach * reach
    return left.join(right, ["label", "d", "cell"]).filter((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()


def linked(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) whose cosine reaches the threshold."""
    unit_a, unit_b = units(a), units(b)
    turned_a, turned_b = unit_a @ basis, unit_b @ basis
    d = turned_a.shape[1]
    rest = lambda x, at: np.sqrt(np.maximum(0, (x[:, at:] ** 2).sum(axis=1)))
    at, step = min(BLOCK, d), BLOCK
    total = turned_a[:, :at] @ turned_b[:, :at].T
    i, j = np.nonzero(total + np.outer(rest(turned_a, at), rest(turned_b, at)) >= threshold - NEAR)
    total = total[i, j]
    while at < d and len(i):
        end = min(d, at + step)
        for first in range(0, len(i), 1 << 18):  # in pieces, so that memory stays bounded
            part = slice(first, first + (1 << 18))
            total[part] += np.einsum("ij,ij->i", turned_a[i[part], at:end], turned_b[j[part], at:end])
        at, step = end, 2 * step
        keep = total + rest(turned_a, at)[i] * rest(turned_b, at)[j] >= threshold - NEAR
        i, j, total = i[keep], j[keep], total[keep]
    for k in np.flatnonzero(np.abs(total - threshold) < NEAR):
        x, y = a[i[k]], b[j[k]]
        total[k] = float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)))
    keep = total >= threshold
    return i[keep], j[keep]


def compared(cut: DataFrame, bases: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float) -> DataFrame:
    """For each class and pair of tiles: ``links`` (sum of linked counts) and ``root`` (a class it is tied to)."""
    shared = cut.sparkSession.sparkContext.broadcast(bases)
    sides = {x: cut.select(F.col("tile").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("d", "reps", "counts", "vectors")])
             for x in "ab"}
    met = stored(tile_pairs(cut, threshold), "tile_pairs").join(sides["a"], "a").join(sides["b"], "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                get = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                d = get["a_d"]
                read = lambda x: (np.frombuffer(get[f"{x}_reps"], np.int64), np.frombuffer(get[f"{x}_counts"], np.int64),
                                  np.frombuffer(get[f"{x}_vectors"], float).reshape(-1, d))  # noqa: B023
                (ra, na, va), (rb, nb, vb) = read("a"), read("b")
                i, j = linked(va, vb, shared.value[d][0], threshold)
                if get["a"] == get["b"]:
                    i, j = i[i != j], j[i != j]  # each link from both ends
                    reps, links = ra, np.bincount(i, nb[j], len(ra))
                else:
                    reps = np.concatenate((ra, rb))
                    links = np.concatenate((np.bincount(i, nb[j], len(ra)), np.bincount(j, na[i], len(rb))))
                if not len(i):
                    continue
                nodes, roots = forest(ra[i], rb[j])
                links = links.astype(np.int64)
                order = np.argsort(reps)
                found = order[np.searchsorted(reps[order], nodes)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links[found]), pa.array(roots)],
                                                 ["rep", "links", "root"])

    return met.mapInArrow(run, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``.

    Rows without a label or a usable vector link with nothing; vectors of different length never link. Repeated rows
    are vectors of their own that link with each other. Ids are integers; a row without one links with nothing. Different
    vectors under one id are one node with the links of all of them.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label).cast("string").alias("label"),
                          F.col(vector).alias("vector"))
    able = rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("vector"))
    classes = stored(able.groupBy("label", "vector").agg(
        F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("n")).select(
        "rep", "label", F.size("vector").alias("d"), "vector", "n"), "classes")
    bases = {d: directions(m) for d, m in second_moments(classes).items()}
    cut = stored(tiles(classes, bases), "tiles")
    met = stored(compared(cut, bases, threshold), "met")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(met.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    summed = stored(classes.join(links, "rep", "left").join(
        found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "vector", "n", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("component", "rep").alias("component")), "summed")
    known = rows.withColumn("able", F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("vector"))
    joined = known.join(summed, (known["label"] == summed["label"]) & (known["vector"] == summed["vector"]) & known["able"],
                        "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce(F.col("n") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
                         component.cast("long").alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings`` against those of the same label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
