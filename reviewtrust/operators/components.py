"""Connected components of a pair table, as alternating star joins.

Each round is two aggregates and two equi-joins, and the number of rounds grows with the
logarithm of the component size, so a long chain of near copies does not need a long loop.
A hub node appears as one hot join key; AQE splits that partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewtrust.session import Workspace


def _both_ways(edges: DataFrame, group: str) -> DataFrame:
    return edges.select(
        group,
        F.explode(
            F.array(
                F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
            )
        ).alias("e"),
    ).select(group, "e.u", "e.v")


def _star(rows: DataFrame, group: str, keep_larger: bool) -> DataFrame:
    """Hang the neighbours of every node on the node's smallest neighbour (or itself)."""
    lowest = (
        rows.groupBy(group, "u")
        .agg(F.min("v").alias("m"))
        .select(group, "u", F.least("u", "m").alias("m"))
    )
    joined = rows.join(lowest, [group, "u"])
    if keep_larger:
        linked = joined.where(F.col("v") > F.col("u")).select(
            group, F.col("v").alias("a"), F.col("m").alias("b")
        )
    else:
        neighbours = joined.where(F.col("v") != F.col("m")).select(
            group, F.col("v").alias("a"), F.col("m").alias("b")
        )
        own = lowest.select(group, F.col("u").alias("a"), F.col("m").alias("b"))
        linked = neighbours.unionByName(own)
    return linked.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, group: str = "product_id", max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(group, a, b)`` with its component's lowest id.

    Returns ``(group, node, component)`` for nodes that have at least one edge.
    """
    space = Workspace(edges.sparkSession, "components")
    current = space.write(
        edges.select(group, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    previous = None
    for _ in range(max_rounds):
        large = _star(_both_ways(current, group), group, keep_larger=True)
        downhill = large.select(group, F.col("a").alias("u"), F.col("b").alias("v"))
        current = space.write(_star(downhill, group, keep_larger=False))
        state = current.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64(group, "a", "b").cast("decimal(38,0)")).alias("digest"),
        ).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("connected components did not settle")
    members = current.select(group, F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(group, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
