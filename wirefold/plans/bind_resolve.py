"""Name-resolution operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import resolve as RS
from wirefold.plans.registry import query, table


def _customers(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select("c_custkey", "c_nationkey", F.col("n_regionkey").alias("c_region")))


def _suppliers(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("s_region")))


@query("resolve_ladder", """
WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey AS c_region
           FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT s_suppkey, s_nationkey, n_regionkey AS s_region
      FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
r1 AS (SELECT c_custkey, (SELECT min(s_suppkey) FROM s WHERE s.s_suppkey = c.c_custkey % 127) AS k
       FROM c WHERE c_custkey % 5 = 0),
r2 AS (SELECT c_custkey, (SELECT min(s_suppkey) FROM s WHERE s.s_suppkey % 10 = c.c_custkey % 10
                          AND s.s_nationkey = c.c_nationkey) AS k FROM c),
r3 AS (SELECT c_custkey, (SELECT min(s_suppkey) FROM s WHERE s.s_suppkey % 10 = c.c_custkey % 10
                          AND s.s_region = c.c_region) AS k FROM c)
SELECT c.c_custkey,
  CASE WHEN c.c_custkey % 5 = 0 THEN r1.k WHEN r2.k IS NOT NULL THEN r2.k ELSE r3.k END AS s_suppkey,
  CASE WHEN c.c_custkey % 5 = 0 THEN CASE WHEN r1.k IS NOT NULL THEN 'exact' END
       WHEN r2.k IS NOT NULL THEN 'nation' WHEN r3.k IS NOT NULL THEN 'region' END AS rung,
  CASE WHEN c.c_custkey % 5 = 0 THEN CASE WHEN r1.k IS NOT NULL THEN 'resolved' ELSE 'final-miss' END
       WHEN coalesce(r2.k, r3.k) IS NOT NULL THEN 'resolved' ELSE 'no-match' END AS status
FROM c LEFT JOIN r1 USING (c_custkey) LEFT JOIN r2 USING (c_custkey) LEFT JOIN r3 USING (c_custkey)
""")
def q_resolve_ladder(spark, sf_dir):
    """Customer -> supplier by a three-rung ladder; the exact rung is final (no fall-through)."""
    refs = _customers(spark, sf_dir)
    targets = _suppliers(spark, sf_dir)
    rungs = [
        RS.Rung("exact", [F.col("c_custkey") % 127], [F.col("s_suppkey")],
                applies=F.col("c_custkey") % 5 == 0, final=True),
        RS.Rung("nation", [F.col("c_custkey") % 10, F.col("c_nationkey")],
                [F.col("s_suppkey") % 10, F.col("s_nationkey")]),
        RS.Rung("region", [F.col("c_custkey") % 10, F.col("c_region")],
                [F.col("s_suppkey") % 10, F.col("s_region")]),
    ]
    out = RS.resolve_ladder(refs, targets, rungs, ref_id=["c_custkey"],
                            target_cols=["s_suppkey"], target_order=["s_suppkey"])
    return out.select("c_custkey", "s_suppkey", "rung", "status")


_LOOKUP_SQL = """
WITH ents AS (SELECT DISTINCT {q} AS q, p_name AS s FROM part),
req AS (SELECT p_partkey AS request_id,
               CASE p_partkey % 3 WHEN 0 THEN {q} WHEN 1 THEN {r1} ELSE {r2} END AS name FROM part),
ex AS (SELECT r.request_id, e.q AS candidate FROM req r JOIN (SELECT DISTINCT q FROM ents) e
       ON e.q = r.name),
sm AS (SELECT r.request_id, e.q AS candidate FROM req r JOIN ents e ON {cond}
       WHERE r.request_id NOT IN (SELECT request_id FROM ex)),
hits AS (SELECT DISTINCT * FROM (SELECT * FROM ex UNION ALL SELECT * FROM sm)),
cnt AS (SELECT request_id, count(*) AS n FROM hits GROUP BY 1)
SELECT r.request_id, r.name,
       CASE WHEN coalesce(n, 0) = 0 THEN 'not-found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status,
       CAST(coalesce(n, 0) AS BIGINT) AS n_matches, h.candidate
FROM req r LEFT JOIN hits h USING (request_id) LEFT JOIN cnt USING (request_id)
"""


@query("lookup_outcome", _LOOKUP_SQL.format(
    q="p_brand || '.' || p_name", r1="p_name", r2="p_name || ' x'", cond="e.s = r.name"))
def q_lookup_outcome(spark, sf_dir):
    """Name lookup, simple-name mode: exact qualified hit wins alone, else all simple-name hits."""
    part = table(spark, sf_dir, "part")
    q = F.concat_ws(".", "p_brand", "p_name")
    ents = part.select(q.alias("qualified"), F.col("p_name").alias("simple"))
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, q).when(k == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" x")))
    req = part.select(F.col("p_partkey").alias("request_id"), name.alias("name"))
    return RS.lookup_outcome(req, ents, req_id="request_id", name="name", qualified="qualified",
                             simple="simple", mode="simple")


@query("lookup_outcome_suffix", _LOOKUP_SQL.format(
    q="p_type || '.' || p_brand || '.' || p_name", r1="p_brand || '.' || p_name", r2="p_name",
    cond="ends_with(e.q, '.' || r.name)"))
def q_lookup_outcome_suffix(spark, sf_dir):
    """Name lookup, suffix mode: a partly qualified name matches any qualified name ending in it."""
    part = table(spark, sf_dir, "part")
    q = F.concat_ws(".", "p_type", "p_brand", "p_name")
    ents = part.select(q.alias("qualified"), F.col("p_name").alias("simple"))
    k = F.col("p_partkey") % 3
    name = (F.when(k == 0, q).when(k == 1, F.concat_ws(".", "p_brand", "p_name"))
            .otherwise(F.col("p_name")))
    req = part.select(F.col("p_partkey").alias("request_id"), name.alias("name"))
    return RS.lookup_outcome(req, ents, req_id="request_id", name="name", qualified="qualified",
                             mode="suffix")


def _imported(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    imports = li.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey",
                        F.concat(F.lit("supp."), F.col("l_suppkey").cast("string")).alias("name"))
    return RS.imported_fqcn(imports, path="l_orderkey", name="name",
                            order=["l_linenumber", "l_partkey", "l_suppkey"],
                            simple=F.col("l_returnflag"))


@query("imported_fqcn", """
SELECT l_orderkey, l_returnflag AS simple, 'supp.' || CAST(l_suppkey AS VARCHAR) AS fqcn
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag
                           ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""")
def q_imported_fqcn(spark, sf_dir):
    """First import (line order) per (order, return flag) among the order's line items."""
    return _imported(spark, sf_dir)


@query("resolve_simple", """
WITH imp AS (
  SELECT l_orderkey, l_returnflag AS simple, 'supp.' || CAST(l_suppkey AS VARCHAR) AS fqcn
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag
                             ORDER BY l_linenumber, l_partkey, l_suppkey) = 1),
refs AS (SELECT o_orderkey, ['R','A','N'][(o_orderkey % 3) + 1] AS simple,
                CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS package
         FROM orders)
SELECT r.o_orderkey, r.simple, r.package,
       coalesce(i.fqcn, CASE WHEN r.package <> '' THEN r.package || '.' || r.simple END, r.simple) AS fqcn,
       CASE WHEN i.fqcn IS NOT NULL THEN 'import' WHEN r.package <> '' THEN 'package' ELSE 'bare' END AS source
FROM refs r LEFT JOIN imp i ON i.l_orderkey = r.o_orderkey AND i.simple = r.simple""")
def q_resolve_simple(spark, sf_dir):
    """Orders resolve a flag name: explicit import of the order, else package + name, else name."""
    flags = F.array(F.lit("R"), F.lit("A"), F.lit("N"))
    refs = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.element_at(flags, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("simple"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("o_orderpriority")).alias("package"))
    imp = _imported(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    return RS.resolve_simple(refs, imp, path="o_orderkey", simple="simple", package="package")


@query("resolve_constant", """
WITH consts AS (SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size % 3 <> 0),
brand_min AS (SELECT p_brand, min(p_retailprice) AS v FROM consts GROUP BY 1),
li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p.p_brand
       FROM lineitem LEFT JOIN part p ON l_partkey = p.p_partkey)
SELECT li.l_orderkey, CAST(li.l_linenumber AS BIGINT) AS l_linenumber, li.l_partkey, li.l_suppkey,
       coalesce(c.p_retailprice, b.v) AS value,
       CASE WHEN c.p_retailprice IS NOT NULL THEN 'own' WHEN b.v IS NOT NULL THEN 'brand' END AS rung
FROM li LEFT JOIN consts c ON c.p_partkey = li.l_partkey
        LEFT JOIN brand_min b ON b.p_brand = li.p_brand""")
def q_resolve_constant(spark, sf_dir):
    """Line item -> constant: own part's price if it is a constant, else the brand's minimum."""
    part = table(spark, sf_dir, "part")
    consts = part.where(F.col("p_size") % 3 != 0).select("p_partkey", "p_brand", "p_retailprice")
    ref_id = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = (table(spark, sf_dir, "lineitem").select(*ref_id)
          .join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left")
          .select(*ref_id, "p_brand"))
    price = F.col("p_retailprice").alias("value")
    own = consts.select(F.col("p_partkey").alias("l_partkey"), price, F.lit(0).alias("ord"))
    brand = consts.select("p_brand", price, F.col("p_retailprice").alias("ord"))
    out = RS.resolve_constant(li, [("own", own, ["l_partkey"]), ("brand", brand, ["p_brand"])])
    return out.select(*ref_id, "value", "rung")


@query("known_types", """
SELECT DISTINCT k AS type_key FROM (SELECT s_suppkey AS k FROM supplier
                                    UNION ALL SELECT l_suppkey FROM lineitem)""")
def q_known_types(spark, sf_dir):
    """Searchable names: supplier keys and the supplier keys referenced by line items."""
    return RS.known_types(
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("type_key")),
        table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("type_key")))


@query("fact_dedupe_last", """
SELECT md5(text) AS text_key, doc_id, source, lang
FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) = 1""")
def q_fact_dedupe_last(spark, sf_dir):
    """Documents keyed by the hash of their text: the highest doc_id wins each key."""
    docs = table(spark, sf_dir, "documents").select(
        F.md5("text").alias("text_key"), "doc_id", "source", "lang")
    winners, _ = RS.fact_dedupe_last(docs, key=["text_key"], order=["doc_id"])
    return winners
