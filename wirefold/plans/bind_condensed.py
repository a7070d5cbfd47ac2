"""Shared reachability bound to the driver tables: customers are nodes (marked when in debt), urgent
orders the edges of ``bind_ordered``, every supplier's key a start."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators.condensed import shared_reach, strongly_connected
from wirefold.plans.registry import query, table


def urgent_edges(spark, sf_dir):
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n")).first().n
    return (table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
            .select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % n + 1).alias("dst")))


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_acctbal") < 0).alias("terminal"))


_SQL = """
WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
e AS (SELECT DISTINCT o_custkey AS src, o_orderkey * 7 % n + 1 AS dst FROM orders, n WHERE o_orderpriority = '1-URGENT'),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
reach AS MATERIALIZED (SELECT * FROM r),
members AS (SELECT c_custkey AS node, least(c_custkey, coalesce(min(x.b), c_custkey)) AS component
            FROM customer LEFT JOIN (SELECT f.a, f.b FROM reach f JOIN reach g ON g.a = f.b AND g.b = f.a) x ON x.a = c_custkey
            GROUP BY c_custkey)"""


@query("strong_components", _SQL + "SELECT node, component FROM members")
def q_strong_components(spark, sf_dir):
    """The strongly connected component of every customer in the graph of urgent orders."""
    return strongly_connected(_nodes(spark, sf_dir), urgent_edges(spark, sf_dir))


@query("shared_terminals", _SQL + """
SELECT DISTINCT m.component, r.b AS node FROM supplier JOIN members m ON m.node = s_suppkey
JOIN reach r ON r.a = m.node JOIN customer ON c_custkey = r.b WHERE c_acctbal < 0""")
def q_shared_terminals(spark, sf_dir):
    """Customers in debt that the component of each start can reach, once per component."""
    starts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("start"))
    return shared_reach(starts, urgent_edges(spark, sf_dir), _nodes(spark, sf_dir)).answers.select("component", "node")
