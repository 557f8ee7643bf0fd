"""Distributed connected components by alternating large and small stars.

Each half round is one aggregation and one join of the edge table; no
neighbourhood is ever collected. The number of rounds grows with the logarithm
of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.plans.shared import materialise, release


def _stars(pairs: DataFrame) -> DataFrame:
    """The least ``v`` of each ``u`` (itself included), beside every pair."""
    least = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    # An exchange of its own below the join, so that AQE can split a hot u.
    return pairs.join(least.hint("rebalance"), "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    near = _stars(edges)
    hang = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hang.unionByName(near.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """Components of an undirected graph.

    ``edges`` has two columns ``a`` and ``b`` of one ordered type. Rows with a
    null end, loops and repeated rows are allowed and say nothing. Returns
    ``node, component`` for every node that has an edge to another one;
    ``component`` is the least node that can be reached. No edges: no rows.
    """
    pairs = edges.select(F.col(a).alias("p"), F.col(b).alias("q")).where("p <> q")
    now = materialise(pairs.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct())
    seen = _state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        new = materialise(_small(_large(now).where("u > v").distinct()).where("u > v").distinct())
        release(now)
        now, before, seen = new, seen, _state(new)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
