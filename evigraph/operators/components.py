"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a smaller node that has none to a smaller one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return not nodes.where("up > 1 OR (up = 1 AND least = 0)").limit(1).count()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node.

    ``component`` is the smallest node reachable. Null ends and self-loops are ignored,
    repeated edges count once. Only minima are aggregated, so a hub never gathers its
    neighbours in one task. Every round is written to the shared folder; the loop ends
    when all edges lead to the smallest node and raises if ``max_rounds`` do not suffice.
    """
    now = materialize(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "cc",
        compact=True,
    )
    for _ in range(max_rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        step = materialize(_small_star(_large_star(now)), "cc", compact=True)
        release(now)
        now = step
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
