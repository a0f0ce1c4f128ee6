"""Connected components of a link table, by alternating large-star and small-star steps over stored tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhound.llm.common import discard, stored


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that each reaches over the links (u, v)."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = flat[: len(u)], flat[len(u):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        fresh = root.copy()
        np.minimum.at(fresh, x, least)
        np.minimum.at(fresh, y, least)
        np.minimum.at(fresh, root[x], least)
        np.minimum.at(fresh, root[y], least)
        fresh = fresh[fresh]
        if (fresh == root).all():
            return nodes, nodes[root]
        root = fresh


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every node that has a link; ``links``: ``u``, ``v``.

    Each step ties nodes to the smallest neighbour they know of. Minima are written before they are joined, so that the
    join is between two plain exchanges and a node with very many neighbours is split. Loops and repeats are ignored.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
                       "large")
        discard(least, *([edges] if hasattr(edges, "stored_path") else []))
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        # done when every node has one smaller neighbour and none of those has one itself
        tops = least.select(F.col("m").alias("u"))
        if least.filter("n > 1").isEmpty() and tops.join(least, "u", "left_semi").isEmpty():
            nodes = least.select(F.col("u").alias("node"), F.col("m").alias("component"))
            return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
        joined = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(joined.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        discard(least, large)
