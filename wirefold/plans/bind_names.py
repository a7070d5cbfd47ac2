"""Lookups of partly qualified names bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators.name_ranges import lookup_suffix
from wirefold.plans.registry import query, table

_KEYS = ["repo"]

_SQL = """
WITH ent AS (SELECT DISTINCT 'r' || CAST(c_nationkey % 3 AS VARCHAR) AS repo, 'org.m' || CAST(c_custkey // 40 AS VARCHAR) || '.p'
               || CAST(c_custkey // 4 AS VARCHAR) || '.' || CASE c_custkey % 3 WHEN 0 THEN 'Main' ELSE 'C' || CAST(c_custkey // 8 AS VARCHAR) END AS q
             FROM customer),
req AS (SELECT 'r' || CAST(o_custkey % 3 AS VARCHAR) AS repo, o_orderkey AS request_id, CASE o_orderkey % 5
          WHEN 0 THEN 'Main' WHEN 1 THEN 'C' || CAST(o_custkey // 8 AS VARCHAR)
          WHEN 2 THEN 'p' || CAST(o_custkey // 4 AS VARCHAR) || '.Main'
          WHEN 3 THEN 'org.m' || CAST(o_custkey // 40 AS VARCHAR) || '.p' || CAST(o_custkey // 4 AS VARCHAR) || '.C' || CAST(o_custkey // 8 AS VARCHAR)
          ELSE 'ain' END AS name FROM orders),
asked AS (SELECT DISTINCT repo, name FROM req),
hit AS (SELECT a.repo, a.name, e.q AS candidate FROM asked a JOIN ent e ON e.repo = a.repo AND e.q = a.name
        UNION ALL
        SELECT a.repo, a.name, e.q FROM asked a JOIN ent e ON e.repo = a.repo AND ends_with(e.q, '.' || a.name)
        WHERE NOT EXISTS (SELECT 1 FROM ent x WHERE x.repo = a.repo AND x.q = a.name)),
cnt AS (SELECT repo, name, count(*) AS n, min(candidate) AS one FROM hit GROUP BY ALL)"""


def _lookups(spark, sf_dir):
    """Customers as classes, a third of them named ``Main``; orders ask by last segment, by two
    segments, by the whole name, or by letters that end a segment but are none."""
    c = lambda col, div=1: F.floor(F.col(col) / div).cast("string")
    cust = table(spark, sf_dir, "customer")
    k = "c_custkey"
    ents = cust.select(F.concat(F.lit("r"), (F.col("c_nationkey") % 3).cast("string")).alias("repo"), F.concat(
        F.lit("org.m"), c(k, 40), F.lit(".p"), c(k, 4), F.lit("."),
        F.when(F.col(k) % 3 == 0, "Main").otherwise(F.concat(F.lit("C"), c(k, 8)))).alias("qualified"))
    o, way = "o_custkey", F.col("o_orderkey") % 5
    req = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), (F.col(o) % 3).cast("string")).alias("repo"), F.col("o_orderkey").alias("request_id"),
        F.when(way == 0, "Main").when(way == 1, F.concat(F.lit("C"), c(o, 8)))
        .when(way == 2, F.concat(F.lit("p"), c(o, 4), F.lit(".Main")))
        .when(way == 3, F.concat(F.lit("org.m"), c(o, 40), F.lit(".p"), c(o, 4), F.lit(".C"), c(o, 8)))
        .otherwise("ain").alias("name"))
    return lookup_suffix(req, ents, req_id="request_id", name="name", qualified="qualified", keys=_KEYS)


@query("lookup_suffix_answers", _SQL + """
SELECT req.repo, request_id, req.name, CASE WHEN n IS NULL THEN 'not-found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status,
       CAST(coalesce(n, 0) AS BIGINT) AS n_matches, CASE WHEN n = 1 THEN one END AS candidate
FROM req LEFT JOIN cnt ON cnt.repo = req.repo AND cnt.name = req.name""")
def q_lookup_suffix_answers(spark, sf_dir):
    """Every request's status and number of matches, from places in the sorted list of names."""
    return _lookups(spark, sf_dir).answers


@query("lookup_suffix_matches", _SQL + """
SELECT hit.repo, hit.name, candidate FROM hit JOIN cnt ON cnt.repo = hit.repo AND cnt.name = hit.name WHERE n > 1""")
def q_lookup_suffix_matches(spark, sf_dir):
    """The matches of each ambiguous name, once per scope."""
    return _lookups(spark, sf_dir).matches
