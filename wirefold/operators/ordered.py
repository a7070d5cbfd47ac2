"""Traces in the order in which a queue would make them, with fixed-size state per node."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.operators.graph import RESOLVED, UNRESOLVED
from wirefold.operators.ranks import numbered
from wirefold.session import cut_lineage


class OrderedTrace(NamedTuple):
    """Keyed by ``start`` (one trace per distinct start node); ``requests`` (request id -> start) fans
    them out. ``step`` and ``place`` count from 1."""
    steps: DataFrame      # start, step, src, edge_ord, cand_ord, dst, depth
    terminals: DataFrame  # start, place, node: terminal nodes by first sighting
    blocked: DataFrame    # start, place, src, edge_ord, depth: unresolved edges as they are met
    reached: DataFrame    # start, node, depth, rank: nodes by first sighting, rank within their depth
    requests: DataFrame


def ordered_trace(starts: DataFrame, edges: DataFrame, nodes: DataFrame, *, req_id: str = "request_id",
                  start: str = "start", src: str = "src", dst: str = "dst", edge_ord: str = "edge_ord",
                  cand_ord: str = "cand_ord", status: str = "status", node: str = "node",
                  terminal: str = "terminal", max_depth: int | None = None, checkpoint_every: int = 4) -> OrderedTrace:
    """Breadth-first trace along resolved edges with the number of every step.

    A queue takes nodes in the order in which they were first seen, and a node's edges by
    (edge_ord, cand_ord). So nodes of one depth are ordered by (rank of the first node that led to
    them, edge_ord, cand_ord): a level keeps one number per node instead of the way to it. Ranks,
    steps and places are numbers within a start over range partitions and prefix sums
    (``numbered``), so a start that reaches most of the graph is no single task.

    Tables are those of ``graph.reach``: a start that is no node has an empty trace, an edge to a
    node already seen is a step but is not followed again, nodes at ``max_depth`` are not expanded.
    """
    e = cut_lineage(edges.select(
        F.col(src).alias("src"), F.col(edge_ord).cast("bigint").alias("edge_ord"),
        F.col(cand_ord).cast("bigint").alias("cand_ord"), F.col(dst).alias("dst"), F.col(status).alias("status")))
    resolved = e.where(F.col("status") == RESOLVED).drop("status")
    unresolved = e.where(F.col("status") == UNRESOLVED).drop("status")
    beans = nodes.select(F.col(node).alias("node"), F.col(terminal).alias("terminal"))
    requests = starts.select(F.col(req_id), F.col(start).alias("start"))

    level = cut_lineage(requests.select(F.col("start").alias("node")).distinct().join(beans.select("node"), "node")
                        .select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank")))
    reached, depth = level, 0
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        sights = (level.select("start", "rank", F.col("node").alias("src")).join(resolved, "src")
                  .groupBy("start", F.col("dst").alias("node"))
                  .agg(F.min(F.struct("rank", "edge_ord", "cand_ord")).alias("_by")))
        new = sights.join(reached.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", "_by.*")
        depth += 1
        level = cut_lineage(numbered(new.withColumnRenamed("rank", "_from"), ["start"], ["_from", "edge_ord", "cand_ord"], "rank")
                            .select("start", "node", F.lit(depth).alias("depth"), "rank"))
        reached = reached.unionByName(level)
        if depth % checkpoint_every == 0:
            reached = cut_lineage(reached)

    expanded = (reached if max_depth is None else reached.where(F.col("depth") < max_depth)).withColumnRenamed("node", "src")
    order = ["depth", "rank", "edge_ord", "cand_ord"]
    steps = cut_lineage(numbered(expanded.join(resolved, "src"), ["start"], order, "step").select(
        "start", (F.col("step") + 1).alias("step"), "src", "edge_ord", "cand_ord", "dst", (F.col("depth") + 1).alias("depth")))
    met = (steps.join(beans.where("terminal").select(F.col("node").alias("dst")), "dst")
           .groupBy("start", F.col("dst").alias("node")).agg(F.min("step").alias("step")))
    terminals = numbered(met, ["start"], ["step"], "place").select("start", (F.col("place") + 1).alias("place"), "node")
    blocked = (numbered(expanded.join(unresolved, "src"), ["start"], order, "place")
               .select("start", (F.col("place") + 1).alias("place"), "src", "edge_ord", "depth"))
    return OrderedTrace(steps, terminals, blocked, reached, requests)
