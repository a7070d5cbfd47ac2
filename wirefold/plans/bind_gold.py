"""Gold endpoints over facts that Spark derives from the driver tables.

Nations are repositories. Every supplier is a file with a controller; the controllers of a nation share
two FQCNs, so most FQCNs are declared in several files. Customers are methods of a supplier's class.
Suppliers whose key divides by 5 have no mapping of their own and implement ``p.I``, which two files
declare; the last one counts. Prefixes: every third key has one, every twelfth plus two an unreadable one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.plans import gold
from wirefold.plans.registry import query, table
from wirefold.sources.java_facts import FACT_COLUMNS, FACT_SCHEMA


def _fill(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a fact table; what ``df`` lacks is null."""
    cols = [F.col(c) if c in df.columns else F.lit(None) for c in FACT_COLUMNS[kind]]
    types = {f.name: f.dataType for f in FACT_SCHEMA.fields}
    return df.select("repo", "snapshot", *[x.cast(types[c]).alias(c) for x, c in zip(cols, FACT_COLUMNS[kind])])


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def supplier_facts(spark, sf_dir) -> gold.Facts:
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.format_string("r%d", F.col("s_nationkey").cast("int")).alias("repo"), F.lit("s").alias("snapshot"),
        F.format_string("m%08d/C.java", key).alias("path"), F.concat(F.lit("p.C"), (key % 2).cast("string")).alias("fqcn"),
        F.lit("p").alias("package"), F.lit(0).alias("type_ord"), F.lit(2).alias("line"), F.lit(False).alias("is_annotation"),
        F.lit(True).alias("is_top_level"))
    heirs = key % 5 == 0
    n = s.count()
    repos = s.select("repo", "snapshot").distinct()
    ifaces = repos.select("*", F.explode(F.array(*[F.lit(f"i{i}/I.java") for i in (1, 2)])).alias("path")).select(
        "*", F.lit("p.I").alias("fqcn"), F.lit("I").alias("simple_name"), F.lit("p").alias("package"), F.lit(0).alias("type_ord"),
        F.lit(1).alias("line"), F.lit(True).alias("is_interface"), F.lit(False).alias("is_annotation"), F.lit(True).alias("is_top_level"))
    types = _union(_fill(s.withColumn("is_interface", F.lit(False)).withColumn("simple_name", F.substring_index("fqcn", ".", -1)), "types"),
                   _fill(ifaces, "types"))
    supers = _fill(s.where(heirs).withColumn("relation", F.lit("implements")).withColumn("ord", F.lit(0))
                   .withColumn("written_name", F.lit("I")), "supertypes")
    # methods: customers, own pings of some heirs, the methods of the interfaces
    c = (table(spark, sf_dir, "customer").select((F.col("c_custkey") % n + 1).alias("s_suppkey"), F.col("c_custkey").alias("ord"))
         .join(s.drop("line"), "s_suppkey").withColumn("name", F.concat(F.lit("m"), F.col("ord").cast("string")))
         .withColumn("line", F.col("ord") + 10).withColumn("mapped", ~heirs)
         .withColumn("kind", F.when(F.col("ord") % 9 == 0, F.lit("name")).otherwise(F.lit("literal")))
         .withColumn("text", F.when(F.col("ord") % 9 == 0, F.lit("X")).otherwise(F.concat(F.lit("/c"), F.col("ord").cast("string")))))
    ping = (s.where(key % 10 == 0).withColumn("ord", F.lit(0)).withColumn("name", F.lit("ping")).withColumn("line", F.lit(3))
            .withColumn("mapped", F.lit(False)).withColumn("kind", F.lit("literal")).withColumn("text", F.lit("")))
    of_iface = F.array(F.struct(F.lit(0).alias("ord"), F.lit("ping").alias("name"), F.lit(5).alias("line"), F.lit("literal").alias("kind"),
                                F.concat(F.lit("/ping"), F.substring("path", 2, 1)).alias("text")),
                       F.struct(F.lit(1).alias("ord"), F.lit("bad").alias("name"), F.lit(7).alias("line"), F.lit("other").alias("kind"),
                                F.lit("f()").alias("text")))
    theirs = (ifaces.drop("line").withColumn("_m", F.explode(of_iface)).select("*", "_m.*").drop("_m").withColumn("mapped", F.lit(True)))
    cols = ["repo", "snapshot", "path", "fqcn", "ord", "name", "line", "mapped", "kind", "text"]
    m = _union(*[x.select(*[F.col(k).cast("long") if k in ("ord", "line") else F.col(k) for k in cols]) for x in (c, ping, theirs)])
    methods = _fill(m.withColumn("is_private", F.lit(False)).withColumn("is_static", F.lit(False)), "methods")
    # annotations: @RestController, @RequestMapping, @GetMapping
    prefix = F.when(key % 3 == 0, F.lit("literal")).when(key % 12 == 2, F.lit("other"))
    cls = s.withColumn("owner_kind", F.lit("type")).withColumn("owner_id", F.col("fqcn")).withColumn("kind", prefix)
    rest = cls.withColumn("ord", F.lit(0)).withColumn("written_name", F.lit("RestController")).withColumn("shape", F.lit("marker"))
    base = (cls.where(prefix.isNotNull()).withColumn("ord", F.lit(1)).withColumn("written_name", F.lit("RequestMapping"))
            .withColumn("shape", F.lit("single")).withColumn("text", F.concat(F.lit("/s"), key.cast("string"))))
    get = (m.where("mapped").withColumn("owner_kind", F.lit("method")).withColumn("shape", F.lit("single"))
           .withColumn("owner_id", F.concat("fqcn", F.lit("#m"), F.col("ord").cast("string"))).withColumn("written_name", F.lit("GetMapping"))
           .withColumn("ord", F.lit(0)))
    ann = _union(*[_fill(x.drop("text").withColumn("simple_name", F.col("written_name")), "annotations") for x in (rest, base, get)])
    values = _union(*[_fill(x.withColumn("annotation_ord", F.col("ord")).withColumn("attr", F.lit("value")).withColumn("ord", F.lit(0))
                            .withColumn("expr_kind", F.col("kind")).withColumn("expr_text", F.col("text")).withColumn("in_array", F.lit(False)),
                            "annotation_values") for x in (base, get)])
    none = repos.limit(0)
    empty = {k: _fill(none, k) for k in ("imports", "fields", "params", "calls", "assigns", "parse_failures")}
    entry, _ = gold.RS.fact_dedupe_last(types, key=["repo", "snapshot", "fqcn"], order=["path", "type_ord"])
    return gold.Facts(entry, supers, empty["imports"], ann, values, empty["fields"], methods, empty["params"], empty["calls"],
                      empty["assigns"], empty["parse_failures"], types)


_SQL = """
WITH n AS (SELECT count(*) AS n FROM supplier),
s AS (SELECT s_suppkey AS k, 'r' || CAST(s_nationkey AS VARCHAR) AS repo, 'p.C' || CAST(s_suppkey % 2 AS VARCHAR) AS fqcn,
             'm' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '/C.java' AS path, s_suppkey % 5 = 0 AS heir,
             CASE WHEN s_suppkey % 3 = 0 THEN '/s' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS prefix,
             s_suppkey % 3 <> 0 AND s_suppkey % 12 = 2 AS bad FROM supplier),
m AS (SELECT s.*, c_custkey AS c FROM customer, n JOIN s ON s.k = c_custkey % n.n + 1 WHERE NOT s.heir AND NOT s.bad)"""


@query("gold_endpoints", _SQL + """
SELECT repo, prefix || '/c' || CAST(c AS VARCHAR) AS path_pattern, fqcn, 'm' || CAST(c AS VARCHAR) AS method_name, path,
       CAST(c + 10 AS BIGINT) AS line FROM m WHERE c % 9 <> 0
UNION ALL
SELECT repo, prefix || '/ping2', fqcn, 'ping', CASE WHEN k % 10 = 0 THEN path ELSE 'i2/I.java' END,
       CASE WHEN k % 10 = 0 THEN 3 ELSE 5 END FROM s WHERE heir AND NOT bad""")
def q_gold_endpoints(spark, sf_dir):
    """Every handler of every file, also where files share a FQCN; inherited ones where they stand."""
    e = gold.endpoints(supplier_facts(spark, sf_dir)).endpoints
    return e.select("repo", "path_pattern", "fqcn", "method_name", "path", F.col("line").cast("long").alias("line"))


@query("gold_unresolved", _SQL + """
SELECT repo, path, CAST(2 AS BIGINT) AS line, fqcn AS location, 'non-literal-expression' AS reason FROM s WHERE bad
UNION ALL
SELECT repo, path, c + 10, fqcn || '#m' || CAST(c AS VARCHAR), 'constant-reference' FROM m WHERE c % 9 = 0
UNION ALL
SELECT repo, 'i2/I.java', 7, fqcn || '#bad', 'non-literal-expression' FROM s WHERE heir AND NOT bad""")
def q_gold_unresolved(spark, sf_dir):
    """Every mapping that cannot be indexed, those of implemented interfaces included."""
    u = gold.endpoints(supplier_facts(spark, sf_dir)).unresolved
    return u.select("repo", "path", F.col("line").cast("long").alias("line"), "location", "reason")
