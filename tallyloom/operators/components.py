"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edges, so a component of any size is
spread over all tasks.  Rounds are written to the shared folder, and end when the edge
table no longer changes (a logarithmic number of rounds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import released, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least of them: the larger neighbours (large star), or the smaller ones and the node (small star).

    edges has u, v with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u")
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge other than to itself; root is the least node of the component.

    edges has two long columns, in any direction, with repeats or not; rows with a null are passed over.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now = saved(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = now.agg(F.count(F.lit(1)), mark).first()
    for _ in range(rounds if before[0] else 0):
        last, now = now, saved(_star(_star(now, True), False), "edges")
        released(last)
        after = now.agg(F.count(F.lit(1)), mark).first()
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
