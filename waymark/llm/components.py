"""Connected components of a distributed edge list, by alternating large and small stars.

Every round is two aggregations and two equi-joins over the edges.  The
aggregations combine before the shuffle, and the nodes with most edges, at most
``HOT`` of them, are joined by broadcast, so that a star's centre is no task of
its own.  Every aggregation and every join is cut by a table in the shared
folder, so a lost executor repeats one of them at most, and the driver plans
one at a time: a join repeats the plan of both its sides, so that a round in
one plan has hundreds of nodes, which adaptive execution lists again after
every stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import forget, join_hot, materialize


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each node the least node it reaches in a boolean adjacency."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = materialize(both.groupBy("src").agg(F.least("src", F.min("dst")).alias("m"), F.count("*").alias("n")))
    moved = join_hot(both, least, "src", "n", 2 * total).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    out = materialize(moved.distinct())
    forget(edges.sparkSession, least)
    return out


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = materialize(down.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n")))
    moved = join_hot(down, least, "src", "n", total).where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    out = materialize(moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct())
    forget(edges.sparkSession, least)
    return out


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 64) -> DataFrame:
    """``(node, root)`` for each node with an edge to another, ``root`` the least node reachable.

    Null ends and loops are ignored; repeated edges count once; no edges give no
    rows. Rounds grow with the logarithm of the nodes; should they not settle in
    ``most_rounds``, that is an error.
    """
    edges = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")
    edges = materialize(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    spark, before = edges.sparkSession, None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, old = state, edges
        # Large stars keep about the number of edges, so it does for both joins.
        large = _large_star(edges, state[0])
        edges = _small_star(large, state[0])
        forget(spark, old, large)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
