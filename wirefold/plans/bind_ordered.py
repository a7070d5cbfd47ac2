"""Ordered traces bound to the driver tables.

Beans are customers (terminal when in debt); an order is an edge from its customer to the one that
its key points at, in key order, unresolved when the key divides by 17. Every supplier's key is a
start. A customer has about ten orders whatever the scale, so traces of a depth limit grow with the starts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators.ordered import ordered_trace
from wirefold.plans.registry import query, table

DEPTH = 2


def order_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n")).first().n
    ok = F.col("o_orderkey") % 17 != 0
    return o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("edge_ord"), F.lit(0).alias("cand_ord"),
                    F.when(ok, F.col("o_orderkey") * 7 % n + 1).alias("dst"),
                    F.when(ok, F.lit("resolved")).otherwise(F.lit("unresolved")).alias("status"))


def _trace(spark, sf_dir):
    starts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("start"))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_acctbal") < 0).alias("terminal"))
    return ordered_trace(starts, order_edges(spark, sf_dir), nodes, max_depth=DEPTH)


_SQL = """
WITH n AS (SELECT count(*) AS n FROM customer),
e AS (SELECT o_custkey AS src, o_orderkey AS ord, o_orderkey * 7 % n + 1 AS dst, o_orderkey % 17 <> 0 AS ok FROM orders, n),
st AS (SELECT s_suppkey AS start FROM supplier JOIN customer ON c_custkey = s_suppkey),
r AS (SELECT start, start AS node, 0 AS depth, 0 AS rank FROM st
      UNION ALL
      SELECT start, dst, 1, row_number() OVER (PARTITION BY start ORDER BY min(ord)) - 1
      FROM st JOIN e ON e.src = st.start WHERE ok AND dst <> start GROUP BY start, dst),
met AS (SELECT start, depth, src, ord, dst, ok, rank FROM r JOIN e ON e.src = r.node),
steps AS (SELECT start AS request_id, row_number() OVER (PARTITION BY start ORDER BY depth, rank, ord) AS step,
                 src, ord AS edge_ord, dst, CAST(depth + 1 AS BIGINT) AS depth FROM met WHERE ok)"""


@query("trace_order", _SQL + "SELECT * FROM steps")
def q_trace_order(spark, sf_dir):
    """Every step of every trace with its number in the order of the queue."""
    t = _trace(spark, sf_dir)
    return t.requests.join(t.steps, "start").select("request_id", "step", "src", "edge_ord", "dst", "depth")


@query("trace_terminal_order", _SQL + """
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY min(step)) AS place, dst AS node
FROM steps JOIN customer ON c_custkey = dst WHERE c_acctbal < 0 GROUP BY request_id, dst""")
def q_trace_terminal_order(spark, sf_dir):
    """Terminal beans of every trace in the order of their first sighting."""
    t = _trace(spark, sf_dir)
    return t.requests.join(t.terminals, "start").select("request_id", "place", "node")


@query("trace_blocked_order", _SQL + """
SELECT start AS request_id, row_number() OVER (PARTITION BY start ORDER BY depth, rank, ord) AS place, src,
       ord AS edge_ord, CAST(depth AS BIGINT) AS depth FROM met WHERE NOT ok""")
def q_trace_blocked_order(spark, sf_dir):
    """Unresolved edges in the order in which the traces meet them."""
    t = _trace(spark, sf_dir)
    return t.requests.join(t.blocked, "start").select("request_id", "place", "src", "edge_ord", "depth")
