"""Walks over the graph: neighbourhoods, shortest paths, all simple paths.

Every step is a join of a frontier with the adjacency list; visited nodes are removed by
anti-join, and levels are written to shared storage so plans stay short.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators.graph import adjacency
from evigraph.runtime import count_rows, materialize, release


def ego(edges: DataFrame, nodes: DataFrame | str, hops: int = 1, link_types: Iterable[str] | None = None) -> DataFrame:
    """``(node, hops)`` of everything within ``hops`` of the start nodes, themselves included."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(nodes,)], "node string") if isinstance(nodes, str) else nodes.select("node").distinct()
    seen = seen.withColumn("hops", F.lit(0))
    near = adjacency(edges, link_types).select("node", "other").distinct()
    for hop in range(1, hops + 1):
        ahead = seen.where(F.col("hops") == hop - 1).join(near, "node").select(F.col("other").alias("node")).distinct()
        new = ahead.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop))
        grown = materialize(seen.unionByName(new), f"ego-{hop}")
        release(seen)
        seen = grown
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, max_hops: int = 6, link_types: Iterable[str] | None = None) -> DataFrame:
    """``(step, node, edge_id)`` along one shortest undirected path; empty if there is none.

    Among equal routes each node keeps the smallest edge id; a start equal to its end gives
    no path.
    """
    spark = edges.sparkSession
    shape = "step int, node string, edge_id string"
    near = materialize(adjacency(edges, link_types).select("node", "other", "edge_id"), "near")
    seen = spark.createDataFrame([(start, None, None, 0)], "node string, parent string, edge_id string, hop int")
    if start == end:
        return spark.createDataFrame([], shape)
    for hop in range(1, max_hops + 1):
        ahead = seen.where(F.col("hop") == hop - 1).select(F.col("node").alias("parent")).join(near.withColumnRenamed("node", "parent"), "parent")
        best = ahead.groupBy(F.col("other").alias("node")).agg(F.min(F.struct("edge_id", "parent")).alias("m"))
        new = best.join(seen.select("node"), "node", "left_anti").select("node", "m.parent", "m.edge_id", F.lit(hop).alias("hop"))
        grown = materialize(seen.unionByName(new), f"path-{hop}")
        release(seen)
        seen = grown
        if seen.where(F.col("node") == end).limit(1).count():
            back, node = [], end
            for step in range(hop, 0, -1):  # one row for each hop
                r = seen.where((F.col("node") == node) & (F.col("hop") == step)).first()
                back.append((step, r.node, r.edge_id))
                node = r.parent
            return spark.createDataFrame([(0, start, None), *reversed(back)], shape)
        if not seen.where(F.col("hop") == hop).limit(1).count():
            break
    return spark.createDataFrame([], shape)


def nearest(edges: DataFrame, start: str, targets: DataFrame, max_hops: int = 4) -> tuple[str, int] | None:
    """The target (column node) that the fewest hops lead to, the smallest of several, and how many."""
    spark = edges.sparkSession
    near = materialize(adjacency(edges).select("node", "other").distinct(), "near")
    seen = spark.createDataFrame([(start, 0)], "node string, hop int")
    others = targets.select("node").where(F.col("node") != start)
    for hop in range(1, max_hops + 1):
        ahead = seen.where(F.col("hop") == hop - 1).join(near, "node").select(F.col("other").alias("node")).distinct()
        new = materialize(ahead.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), f"ring-{hop}")
        hit = new.join(others, "node", "left_semi").agg(F.min("node")).first()[0]
        if hit is not None:
            return hit, hop
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
    return None


def all_paths(edges: DataFrame, start: str, end: str, max_hops: int = 4, limit: int | None = 25) -> DataFrame:
    """``(hops, path, edge_ids)``: simple paths, shortest first; parallel edges are distinct.

    Partial paths are only extended to nodes from which the end can still be reached in the
    hops that are left, and longer paths are not sought once shorter ones fill the limit.
    """
    near = materialize(adjacency(edges).select("node", "other", "edge_id"), "near")
    left = ego(edges, end, max_hops).withColumnsRenamed({"node": "other", "hops": "left"})
    paths = edges.sparkSession.createDataFrame([(start, [start], [])], "node string, path array<string>, edge_ids array<string>")
    found, known = None, 0
    for hop in range(1, max_hops + 1 if start != end else 0):
        step = (
            paths.join(near, "node")
            .where(~F.array_contains("path", F.col("other")))
            .join(left.where(F.col("left") <= max_hops - hop), "other")
            .select(F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"))
        )
        step = materialize(step, f"paths-{hop}")
        done = step.where(F.col("node") == end).select(F.lit(hop).alias("hops"), "path", "edge_ids")
        found = done if found is None else found.unionByName(done)
        known += count_rows(done) if limit is not None else 0
        if limit is not None and known >= limit:
            break
        paths = step.where(F.col("node") != end)
    if found is None:
        return edges.sparkSession.createDataFrame([], "hops int, path array<string>, edge_ids array<string>")
    found = found.orderBy("hops", "path", "edge_ids")
    return found if limit is None else found.limit(limit)
