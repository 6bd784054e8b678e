"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise, release


def _nearest(edges: DataFrame, total: int) -> DataFrame:
    """u, v, m: m is the least of u and all nodes that share an edge with it in this table of directed edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(edges, least, "u", total)


def _measured(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of the links (a, b); nodes are longs, nulls and loops are ignored.

    Large-star and small-star rounds: each pulls a node's neighbours to the least of them, without listing any
    component in one task; the minima are partial aggregates, and the edges of a star's centre stay where they are while the
    centre's minimum is broadcast to them. Every round is a table, and those before it are deleted.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _measured(edges)
    while state.n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_nearest(both, 2 * state.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        near = _nearest(large, state.n)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges, old = state, materialise(small), edges
        release(old, large)
        state = _measured(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
