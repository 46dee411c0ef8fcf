"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import merged, stored


def _lowest(arcs: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, itself included.  Summed up before the shuffle, so hubs are no load."""
    lowest = arcs.groupBy("u").agg(F.min("v").alias("m"))
    return stored(lowest.select("u", F.least("u", "m").alias("m")), "lowest")


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    return (
        arcs.join(merged(_lowest(arcs)), "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .where("hi <> lo")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    lowest = _lowest(arcs)
    moved = (
        arcs.join(merged(lowest), "u")
        .where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    )
    return moved.unionByName(lowest.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))"), F.expr("sum(hi % 1000003)")).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another one.

    Nulls and loops are no edges; repeated edges count once.  An empty table gives an empty table.  Each round
    replaces a node's edges by edges to its smallest neighbour, so the number of edges never grows, and writes them
    to the shared folder; it ends when a round changes nothing.  Nothing but three numbers reaches the driver.
    """
    edges = stored(
        edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges"
    )
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(stored(_large_star(edges), "large")), "small")
        state, last = _state(edges), state
        if state == last:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
