"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and equi joins that Spark can split
when a node is hot; edges never leave the executors. After each round the edges are written
to the shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, m): every edge with what `least` says of u. They are joined by another expression
    of u than the one that least was summed up by, so that both sides are dealt out anew for the
    join and Spark can split a hub's edges over many tasks."""
    return edges.select(F.bitwise_not("u").alias("k"), "u", "v").join(least.select(F.bitwise_not("u").alias("k"), "m"), "k").select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges hold u > v already."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u long, v long) -> (node, component), component being the smallest node
    reachable; nodes without an edge are absent, self loops and repeats are ignored, null
    ends are dropped. Rounds needed grow with the logarithm of the longest path; after max_rounds
    of them, which no table has been seen to need, it is an error."""
    cur = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u is not null and v is not null and u <> v").distinct(),
        "cc",
    )
    seen = None
    for _ in range(max_rounds):
        mark = cur.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
            # a forest of stars: no centre is anybody's leaf
        ).first()
        if mark.n == 0 or (mark.n, mark.h) == seen:
            break
        seen = (mark.n, mark.h)
        nxt = cut(_small_star(_large_star(cur)), "cc")
        drop(cur)
        cur = nxt
    else:
        raise RuntimeError("connected components did not settle")
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)
