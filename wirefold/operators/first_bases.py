"""First base of every node by path doubling: one row per node, however many starts ask."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.operators.graph import first_base
from wirefold.session import cut_lineage


def run_to_end(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ended, circling) of ``links`` (node, to, len; at most one row per node).

    ``ended`` has the last node that each node's links lead to and the length of the way, found in
    ``log2`` of its length rounds: each round every row takes over the row of the node it points to.
    ``circling`` are the nodes whose links never end.
    """
    rows = cut_lineage(links)
    rounds = math.ceil(math.log2(rows.count() + 1)) + 1
    for _ in range(rounds):
        ahead = rows.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("len").alias("_len"))
        rows = cut_lineage(rows.join(ahead, "to", "left").select(
            "node", F.coalesce("_to", "to").alias("to"), (F.col("len") + F.coalesce("_len", F.lit(0))).alias("len"),
            F.col("_to").isNotNull().alias("open")))
        if rows.where("open").isEmpty():
            break
    return rows.where("not open").drop("open"), rows.where("open").select("node")


def first_bases(parents: DataFrame, bases: DataFrame, *, child: str = "child", parent: str = "parent",
                ord: str = "ord", base_owner: str = "owner", base_ord: str = "ord",
                base: str = "base") -> DataFrame:
    """``node, base, walk_len`` for every node from which a depth-first walk finds a base: a node's own
    bases in their order, then its parents in theirs, no node twice. ``walk_len`` counts the
    nodes of the way to it, the node itself included. Nodes that find none have no row.

    1. Nodes without a base and with one parent are links; chains of them are run through by doubling, so
       only forks, ends and owners of bases are left.
    2. From the owners back over the edges left, level by level: the nodes that can reach a base at all.
    3. Each of these goes to its first parent that can. Every step is the least one possible, so
       where these steps end, the way is the least of all walks, which is what depth-first order asks.
       Doubling again finds the ends and lengths.
    4. Steps that run in a circle (types that extend each other) depend on where the walk began. Their
       forks, and no others, take the walk that keeps one state per start (``graph.first_base``).

    State is one row per node in 1 to 3; rounds are the logarithm of the chains plus, in 2, the most
    forks on a shortest way to a base. Equal positions go by the smaller parent or base; repeated rows count once;
    rows with a null node, parent or base are left out.
    """
    own = cut_lineage(bases.select(F.col(base_owner).alias("node"), F.col(base_ord).cast("bigint").alias("_i"), F.col(base).alias("base"))
                      .where("node is not null and base is not null")
                      .groupBy("node").agg(F.min(F.struct("_i", "base"))["base"].alias("base")))
    edges = (parents.select(F.col(child).alias("node"), F.col(parent).alias("to"), F.col(ord).cast("bigint").alias("_o"))
             .where("node is not null and to is not null").groupBy("node", "to").agg(F.min("_o").alias("_o")))
    # what stands behind a node's own base is never looked at
    edges = cut_lineage(edges.join(own.select("node"), "node", "left_anti"))
    # nor what ends without one
    goes_on = edges.select("node").unionByName(own.select("node")).distinct()
    edges = cut_lineage(edges.join(goes_on.withColumnRenamed("node", "to"), "to", "left_semi"))
    degree = edges.groupBy("node").agg(F.count("*").alias("_n"), F.min("to").alias("to"))
    ended, circling = run_to_end(degree.where("_n = 1").select("node", "to", F.lit(1).cast("long").alias("len")))
    ended, circling = cut_lineage(ended), cut_lineage(circling)
    skip = ended.select(F.col("node").alias("to"), F.col("to").alias("_end"), F.col("len").alias("_len"))
    forks = (edges.join(degree.where("_n > 1").select("node"), "node", "left_semi")
             .join(circling.select(F.col("node").alias("to")), "to", "left_anti")
             .join(skip, "to", "left")
             .select("node", F.coalesce("_end", "to").alias("to"), "_o", F.col("to").alias("_first"),
                     (F.lit(1) + F.coalesce("_len", F.lit(0))).alias("len")))
    forks = cut_lineage(forks)

    live = frontier = own.select("node")
    while not frontier.isEmpty():
        back = forks.select(F.col("node").alias("_from"), F.col("to").alias("node"))
        frontier = cut_lineage(back.join(frontier, "node").select(F.col("_from").alias("node")).distinct()
                               .join(live, "node", "left_anti"))
        live = cut_lineage(live.unionByName(frontier))

    steps = (forks.join(live.select(F.col("node").alias("to")), "to", "left_semi")
             .groupBy("node").agg(F.min(F.struct("_o", "_first", "to", "len")).alias("_s"))
             .select("node", "_s.to", "_s.len"))
    far, lost = run_to_end(steps)
    at = own.select("node", "base", F.lit(1).cast("long").alias("walk_len"))
    solved = at.unionByName(far.join(own.withColumnRenamed("node", "to"), "to").select(
        "node", "base", (F.col("len") + 1).alias("walk_len")))
    if not lost.isEmpty():
        places = edges.withColumn("_o", F.row_number().over(Window.partitionBy("node").orderBy("_o", "to")))
        walked = first_base(lost.select(F.col("node").alias("_start"), "node"), places.withColumnRenamed("node", "child"),
                            own.withColumn("i", F.lit(0)), req_id="_start", start="node", child="child", parent="to",
                            ord="_o", base_owner="node", base_ord="i", base="base")
        solved = solved.unionByName(walked.select(F.col("_start").alias("node"), "base",
                                                  F.size("key").cast("long").alias("walk_len")))
    solved = cut_lineage(solved)
    through = ended.join(solved.withColumnRenamed("node", "to"), "to").select(
        "node", "base", (F.col("len") + F.col("walk_len")).alias("walk_len"))
    return solved.unionByName(through)
