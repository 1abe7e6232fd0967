"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.llm.storage import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node that it sees (itself included)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, component)`` for every node with an edge to another node; the component is
    its smallest node.

    Neighbours meet by joins and minima, never as one list, so a node with a third of all edges is reduced before the
    shuffle and split by the skew join.  Every round is written to the shared folder; the rounds end when the edges stay
    as they are (number and checksum).  Self-links, repeated and null edges count for nothing; no edges, no rows."""
    clean = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    now = cut(_small_star(clean), name)
    seen = _mark(now)
    while seen[0]:
        now = cut(_small_star(_large_star(now)), name)
        then, seen = seen, _mark(now)
        if then == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v) and, for each, the smallest node that it reaches through them: as many rows as nodes,
    however many links there are."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = both[:len(u)], both[len(u):]
    least = np.arange(len(nodes))
    while True:
        new = least.copy()
        np.minimum.at(new, x, least[y])
        np.minimum.at(new, y, least[x])
        new = np.minimum(new, new[new])
        if (new == least).all():
            return nodes, nodes[least]
        least = new


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]
