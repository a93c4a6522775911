"""Connected components of large graphs with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _pull_to_least(pairs: DataFrame, strictly_above: bool) -> DataFrame:
    """Link what stands beside u to the least node beside u. The minima are written first, so that the join
    has a shuffle on both sides and Spark can split the partition of a node with very many neighbours."""
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = pairs.join(least, "u")
    if strictly_above:  # larger neighbours go to the least of u and its neighbours
        return joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return joined.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: two columns of one ordered type) that has a link to
    another node; component is the least node reachable. Nulls and loops are left out.

    Alternates two contractions until the links are stars: neighbours above a node move to the least node
    beside it, then neighbours below. The rounds needed grow with the logarithm of the graph; each is a
    partial aggregation and a join, written to the shared folder, and nothing is collected but two numbers.
    """
    ends = edges.where("u is not null and v is not null and u <> v")
    now = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark[0] == 0 or mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        upper = materialize(_pull_to_least(both, True).where("u <> v").distinct(), "links")
        now = materialize(_pull_to_least(upper, False).where("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
