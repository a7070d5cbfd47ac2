"""Reachability shared between starts: strongly connected components, and one answer for each."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.operators import node_sets as NS
from wirefold.operators.graph import closure
from wirefold.session import cut_lineage

SMALL = 200_000  # rows of a frontier (two longs each) that go to the edges, instead of edges to them
HUBS = 8         # components whose way onward is walked once for all that lead into them


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with no end among ``nodes(node)``."""
    return (edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti")
            .join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti"))


def _to_edges(front: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(front) if rows <= SMALL else front


def _both_ways(e: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``(node, component)`` of the component of the node with most ways in times ways out, and the edges
    that may lie in another one: a walk along and a walk against the edges, level by level together.
    No component has an end that only one walk met and an end that the other or none met."""
    degrees = (e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
               .join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in")), "node"))
    pivot = degrees.orderBy(F.desc(F.col("in") * F.col("out")), "node").limit(1).select("node")
    ways = cut_lineage(e.select(F.lit(True).alias("along"), "src", "dst")
                       .union(e.select(F.lit(False), F.col("dst"), F.col("src"))).repartition("src"))
    seen = front = cut_lineage(pivot.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("along"), "node"))
    rows, level = front.count(), 0
    while rows:
        level += 1
        nxt = (ways.join(_to_edges(front.withColumnRenamed("node", "src"), rows), ["along", "src"])
               .select("along", F.col("dst").alias("node")).distinct())
        front = cut_lineage(nxt.join(seen, ["along", "node"], "left_anti"))
        rows = front.count()
        seen = seen.unionByName(front)
        if level % 4 == 0:
            seen = cut_lineage(seen)
    if not level:
        return None
    met = cut_lineage(seen.groupBy("node").agg(F.bit_or(F.when(F.col("along"), 1).otherwise(2)).alias("met")))
    own = met.where("met = 3").select("node")
    found = own.crossJoin(own.agg(F.min("node").alias("component")))
    side = lambda to: met.select(F.col("node").alias(to), F.col("met").alias(f"_{to}"))
    left = (e.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
            .where("_src <=> _dst and coalesce(_src, 0) <> 3").select("src", "dst"))
    return cut_lineage(found.select("node", "component")), cut_lineage(left)


def strongly_connected(nodes: DataFrame, edges: DataFrame, *, node: str = "node", src: str = "src",
                       dst: str = "dst") -> DataFrame:
    """``(node, component)`` of every node: ``component`` is the smallest node among those that it can
    reach and that can reach it.

    First the component of one well linked node, by a walk in each direction: often it holds most of the
    graph, and edges between what only one walk met and the rest leave with it. Then
    rounds of colours: every node takes the smallest node that reaches it; a node of its own colour
    is a root, and what reaches the root inside its colour is its component, which then leaves the
    graph. Before a round, nodes without a way in or without a way out are trimmed as long as there
    are any: they are alone.
    A step sends one row per edge whose source changed; state is one row per node, whatever the
    size of a component. Edges to nodes outside ``nodes``, loops and repeated edges change nothing.
    """
    names = nodes.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct()
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()
    e = cut_lineage(e.join(names.withColumnRenamed("node", "src"), "src", "left_semi")
                    .join(names.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    found = None
    first = _both_ways(e)
    if first:
        found, e = first[0].withColumnRenamed("component", "colour"), first[1]
    while True:
        size = e.count()
        while size:  # each pass is checkpointed, as it reads the edges three times
            e = cut_lineage(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
                            .join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            before, size = size, e.count()
            if size == before:
                break
        if not size:
            break
        colour = cut_lineage(e.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("_m"))
                             .select("node", F.least("node", "_m").alias("colour"), (F.col("_m") < F.col("node")).alias("new")))
        changed = colour.where("new")
        while not changed.isEmpty():
            offers = (changed.select(F.col("node").alias("src"), "colour").join(e, "src")
                      .groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer")))
            colour = cut_lineage(colour.join(offers, "node", "left").select(
                "node", F.least("colour", "offer").alias("colour"), F.coalesce(F.col("offer") < F.col("colour"), F.lit(False)).alias("new")))
            changed = colour.where("new")
        colour = colour.select("node", "colour")
        inner = cut_lineage(e.join(colour.toDF("src", "_a"), "src").join(colour.toDF("dst", "_b"), "dst")
                            .where("_a = _b").select("src", "dst"))
        seen = front = cut_lineage(colour.where("node = colour"))
        level = 0
        while not front.isEmpty():
            level += 1
            front = cut_lineage(front.select(F.col("node").alias("dst"), "colour").join(inner, "dst")
                                .select(F.col("src").alias("node"), "colour").distinct()
                                .join(seen.select("node"), "node", "left_anti"))
            seen = seen.unionByName(front)
            if level % 4 == 0:
                seen = cut_lineage(seen)
        seen = cut_lineage(seen)
        found = seen if found is None else found.unionByName(seen)
        e = cut_lineage(_without(e, seen))
    if found is None:
        return names.withColumn("component", F.col("node"))
    return (names.join(found.select("node", F.col("colour").alias("component")), "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))


class Shared(NamedTuple):
    """``members``: node, component of every node; ``answers``: component, node: the marked nodes that
    members of a component meet on ways of at least one step. All members have the same answer."""
    members: DataFrame
    answers: DataFrame


def shared_reach(starts: DataFrame, edges: DataFrame, nodes: DataFrame, *, start: str = "start", src: str = "src",
                 dst: str = "dst", node: str = "node", marked: str = "terminal") -> Shared:
    """Marked nodes that each start can reach, worked out once per component on the way of any start.

    The graph of components has no circle. From the ``HUBS`` largest components the marked nodes behind
    them are found once; elsewhere sets of marked nodes and of hubs met travel against the edges, as
    rows of bits (``node_sets``), and stop at hubs. A start's set is the union of its own and its
    hubs' sets, and its members are listed last: rows of (component, marked node) are the answer
    itself and are neither joined nor grouped. Requests join ``members`` and ``answers``.
    """
    members = cut_lineage(strongly_connected(nodes, edges, node=node, src=src, dst=dst))
    raw = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    between = cut_lineage(raw.join(members.toDF("src", "a"), "src").join(members.toDF("dst", "b"), "dst")
                          .groupBy("a", "b").agg(F.count("*").alias("n")))
    circles = between.where("a = b").select(F.col("a").alias("component"))
    steps = between.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    asked = cut_lineage(starts.select(F.col(start).alias("node")).join(members, "node").select("component").distinct())
    ids = NS.numbers(nodes.where(F.col(marked)).select(F.col(node).alias("node")).join(members, "node").select("node"))
    marks = ids.join(members, "node").select("component", "_id")
    hubs = (members.groupBy("component").count().where("count > 1").orderBy(F.desc("count"), "component").limit(HUBS)
            .select(F.col("component").alias("hub")))
    hubs = cut_lineage(hubs)
    behind = _behind(hubs, steps)
    from_hub = cut_lineage(NS.sets(behind.join(marks, "component"), ["hub"], "_id"))
    # the rest of the way: no step out of a hub or into one, but a note of the hub
    to = F.broadcast(hubs)
    plain = steps.join(to.withColumnRenamed("hub", "src"), "src", "left_anti")
    enters = plain.join(to.withColumnRenamed("hub", "dst"), "dst").select(F.col("src").alias("component"), F.col("dst").alias("hub"))
    plain = cut_lineage(plain.join(to.withColumnRenamed("hub", "dst"), "dst", "left_anti").select("src", "dst"))
    on_the_way = cut_lineage(closure(asked.join(to.withColumnRenamed("hub", "component"), "component", "left_anti"), plain,
                                     node="component").select(F.col("node").alias("component")))
    plain = cut_lineage(plain.join(on_the_way.withColumnRenamed("component", "src"), "src", "left_semi"))
    place = hubs.select("hub", F.monotonically_increasing_id().alias("_id"))
    place = cut_lineage(place)  # few rows: any numbers will do
    noted = (NS.sets(enters.join(place, "hub"), ["component"], "_id").withColumn("of_hubs", F.lit(True))
             .unionByName(NS.sets(marks, ["component"], "_id").withColumn("of_hubs", F.lit(False))))
    keys = ["component", "of_hubs"]
    sets = front = cut_lineage(noted.join(on_the_way, "component", "left_semi"))
    rows, level = front.count(), 0
    while rows:
        level += 1
        back = plain.join(_to_edges(front.withColumnRenamed("component", "dst"), rows * NS.WORDS), "dst")
        front = cut_lineage(NS.union(back.withColumnRenamed("src", "component"), keys, without=sets))
        rows = front.count()
        sets = sets.unionByName(front)
        if level % 4 == 0:
            sets = cut_lineage(NS.union(sets, keys))
    sets = cut_lineage(NS.union(sets.join(asked, "component", "left_semi"), keys))
    led = (NS.members(sets.where("of_hubs"), ["component"], "_id").join(place, "_id").select("component", "hub")
           .unionByName(asked.join(hubs.withColumnRenamed("hub", "component"), "component").select("component", F.col("component").alias("hub"))))
    whole = NS.union(sets.where("not of_hubs").drop("of_hubs").unionByName(led.join(from_hub, "hub").drop("hub")), ["component"])
    # a node that lies on no circle does not meet itself
    own = (members.where("node = component").join(circles.distinct(), "component", "left_anti").join(ids, "node")
           .select("component", F.col("_id").alias("_own")))
    whole = NS.drop_member(whole.join(own, "component", "left"), "_own")
    return Shared(members, NS.nodes(whole, ["component"], ids, "node").select("component", "node"))


def _behind(hubs: DataFrame, steps: DataFrame) -> DataFrame:
    """``hub, component``: each hub and the components that it leads to."""
    seen = front = cut_lineage(hubs.select("hub", F.col("hub").alias("component")))
    rows, level = front.count(), 0
    while rows:
        level += 1
        nxt = (steps.join(_to_edges(front.withColumnRenamed("component", "src"), rows), "src")
               .select("hub", F.col("dst").alias("component")).distinct())
        front = cut_lineage(nxt.join(seen, ["hub", "component"], "left_anti"))
        rows = front.count()
        seen = seen.unionByName(front)
        if level % 4 == 0:
            seen = cut_lineage(seen)
    return seen
