"""Candidate-resolution operators bound to the driver tables.

Customers are injection sites, suppliers candidate beans. A contract is a nation and a run of
``PER_RUN`` supplier keys: about two suppliers implement each, however many there are. The binding
only shapes rows; every decision is made by the operators in ``wirefold.operators.candidates``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import candidates as C
from wirefold.plans.registry import query, table


PER_RUN = 50


def _contract(nation, run):
    return F.concat_ws(".", F.col(nation).cast("string"), run.cast("string"))


def _site_contract(spark, sf_dir):
    runs = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("n")).first().n // PER_RUN + 1
    run = F.col("c_custkey") % runs
    return _contract("c_nationkey", run), run


def _suppliers(spark, sf_dir, dropped: bool):
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", _contract("s_nationkey", F.floor(F.col("s_suppkey") / PER_RUN)).alias("s_contract"),
        (F.col("s_acctbal") > 9000).alias("is_primary"),
        (F.col("s_acctbal") < 0).alias("is_conditional"))
    return s.where(F.col("s_suppkey") % 3 != 0) if dropped else s


def _sites(spark, sf_dir):
    contract, run = _site_contract(spark, sf_dir)
    qual = F.when(F.col("c_mktsegment") == "BUILDING", F.format_string(
        "Supplier#%09d", (run * PER_RUN + F.col("c_custkey") % PER_RUN).cast("int")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", contract.alias("contract"), "c_mktsegment", qual.alias("qualifier"))


def candidate_edges(spark, sf_dir, dropped=False):
    sites = _sites(spark, sf_dir)
    cands = _suppliers(spark, sf_dir, dropped)
    return C.resolve_candidate(sites, cands, contract="contract", qualifier="qualifier",
                               cand_contract="s_contract", cand_id="s_suppkey",
                               cand_name="s_name", cand_order="s_suppkey",
                               primary="is_primary", conditional="is_conditional")


_SQL_SITES = """
runs AS (SELECT max(s_suppkey) // 50 + 1 AS n FROM supplier),
site AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_custkey % n AS run,
                CAST(c_nationkey AS VARCHAR) || '.' || CAST(c_custkey % n AS VARCHAR) AS contract FROM customer, runs)"""
_SQL_SUPPLIERS = """
SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) || '.' || CAST(s_suppkey // 50 AS VARCHAR) AS s_contract,
       s_acctbal > 9000 AS prim, s_acctbal < 0 AS cond FROM supplier"""


def _sql_candidate(dropped: bool) -> str:
    where = "WHERE s_suppkey % 3 <> 0" if dropped else ""
    return f"""
WITH {_SQL_SITES},
s AS ({_SQL_SUPPLIERS} {where}),
st AS (SELECT s_contract, count(*) AS n, count_if(prim) AS np, bool_or(cond) AS anyc,
              min(s_suppkey) AS first_id, min(CASE WHEN prim THEN s_suppkey END) AS prim_id
       FROM s GROUP BY 1),
nm AS (SELECT s_contract, s_name, min(s_suppkey) AS id FROM s GROUP BY 1, 2),
c AS (SELECT c_custkey, contract, c_mktsegment,
             CASE WHEN c_mktsegment = 'BUILDING'
                  THEN 'Supplier#' || lpad(CAST(run * 50 + c_custkey % 50 AS VARCHAR), 9, '0') END AS qualifier
      FROM site),
j AS (SELECT c.*, coalesce(st.n, 0) AS n, st.np, st.anyc, st.first_id, st.prim_id, nm.id AS named
      FROM c LEFT JOIN st ON st.s_contract = c.contract
             LEFT JOIN nm ON nm.s_contract = c.contract AND nm.s_name = c.qualifier),
k AS (SELECT *, CASE WHEN n = 0 THEN NULL
                     WHEN qualifier IS NOT NULL AND named IS NOT NULL THEN 'qualifier'
                     WHEN qualifier IS NOT NULL THEN NULL
                     WHEN anyc THEN NULL
                     WHEN n = 1 THEN 'single-implementation'
                     WHEN np = 1 THEN 'primary' END AS kind FROM j)
SELECT c_custkey, contract, c_mktsegment, qualifier,
       CASE WHEN kind IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status, kind,
       CASE WHEN n = 0 THEN 'no-implementation-found'
            WHEN kind IS NOT NULL THEN NULL
            WHEN qualifier IS NOT NULL THEN 'multiple-candidates'
            WHEN anyc THEN 'conditional-candidates'
            ELSE 'multiple-candidates' END AS reason,
       CASE kind WHEN 'qualifier' THEN named WHEN 'single-implementation' THEN first_id
                 WHEN 'primary' THEN prim_id END AS target,
       CAST(n AS BIGINT) AS n_candidates
FROM k"""


@query("resolve_candidate", _sql_candidate(False))
def q_resolve_candidate(spark, sf_dir):
    """Every customer site resolved against the suppliers of its contract by the interface ladder."""
    return candidate_edges(spark, sf_dir, dropped=False)


@query("resolve_candidate_dropped", _sql_candidate(True))
def q_resolve_candidate_dropped(spark, sf_dir):
    """As resolve_candidate with every third supplier removed, so more contracts have none."""
    return candidate_edges(spark, sf_dir, dropped=True)


# --- edges derived from resolve_candidate: beans own ten sites each -----------------------------

def _edges(spark, sf_dir):
    e = candidate_edges(spark, sf_dir, dropped=False)
    return e.select(F.concat(F.lit("C"), (F.col("c_custkey") / 10).cast("long").cast("string")).alias("bean"),
                    (F.col("c_custkey") % 10).alias("edge_ord"),
                    F.concat(F.lit("N"), "contract").alias("declared"),
                    F.concat(F.lit("S"), F.col("target").cast("string")).alias("target"),
                    "status", "kind", "reason", "contract")


_SQL_EDGES = _sql_candidate(False)
_SQL_EDGE_VIEW = f"""
e AS (SELECT 'C' || CAST(c_custkey // 10 AS VARCHAR) AS bean, c_custkey % 10 AS edge_ord,
             'N' || contract AS declared, 'S' || CAST(target AS VARCHAR) AS target,
             status, kind, reason, contract
      FROM ({_SQL_EDGES}))"""


@query("unresolved_by_reason", f"""
WITH {_SQL_EDGE_VIEW}
SELECT reason, count(*) AS n FROM e WHERE status = 'unresolved' GROUP BY reason""")
def q_unresolved_by_reason(spark, sf_dir):
    """Unresolved sites of resolve_candidate counted by reason."""
    return C.unresolved_by_reason(_edges(spark, sf_dir))


@query("bean_dependencies", f"""
WITH {_SQL_EDGE_VIEW}
SELECT bean, CAST(count(*) AS BIGINT) AS n_edges,
       string_agg(CAST(edge_ord AS VARCHAR) || ':' || status || ':' || coalesce(kind, reason) || ':'
                  || coalesce(target, '-'), ',' ORDER BY edge_ord) AS edges
FROM e GROUP BY bean""")
def q_bean_dependencies(spark, sf_dir):
    """Each bean's edges in declaration order, rendered ord:status:kind-or-reason:target."""
    e = _edges(spark, sf_dir)
    deps = C.bean_dependencies(e, bean="bean", edge_ord="edge_ord",
                               fields=["status", "kind", "reason", "target"])
    render = F.transform("edges", lambda x: F.concat_ws(
        ":", x["ord"].cast("string"), x["status"], F.coalesce(x["kind"], x["reason"]),
        F.coalesce(x["target"], F.lit("-"))))
    return deps.select("bean", "n_edges", F.array_join(render, ",").alias("edges"))


@query("dependents", f"""
WITH {_SQL_EDGE_VIEW},
s AS ({_SQL_SUPPLIERS}),
req AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS type_name FROM supplier
        UNION SELECT 'N' || s_contract FROM s),
ec AS (SELECT e.bean, e.edge_ord, 'S' || CAST(s.s_suppkey AS VARCHAR) AS candidate
       FROM e JOIN s ON s.s_contract = e.contract WHERE e.status = 'unresolved'
       AND e.reason IN ('multiple-candidates', 'conditional-candidates')),
v AS (SELECT r.type_name, e.bean, e.edge_ord, 1 AS rk FROM req r JOIN e ON e.target = r.type_name
      UNION ALL SELECT r.type_name, e.bean, e.edge_ord, 2 FROM req r JOIN e ON e.declared = r.type_name
      UNION ALL SELECT r.type_name, ec.bean, ec.edge_ord, 3 FROM req r JOIN ec ON ec.candidate = r.type_name)
SELECT type_name, bean, edge_ord,
       CASE min(rk) WHEN 1 THEN 'target' WHEN 2 THEN 'declared-type' ELSE 'candidate' END AS via
FROM v GROUP BY type_name, bean, edge_ord""")
def q_dependents(spark, sf_dir):
    """Who depends on each supplier and contract: via target, else declared type, else candidate."""
    e = _edges(spark, sf_dir)
    sup = _suppliers(spark, sf_dir, dropped=False).select("s_suppkey", "s_contract")
    unresolved = e.where((F.col("status") == "unresolved")
                         & F.col("reason").isin(C.REASON_MULTIPLE, C.REASON_CONDITIONAL))
    ec = unresolved.join(sup, F.col("s_contract") == F.col("contract")).select(
        "bean", "edge_ord", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("candidate"))
    req = (sup.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("type_name"))
           .unionByName(sup.select(F.concat(F.lit("N"), "s_contract").alias("type_name"))))
    return C.dependents(req, e, ec, req_type="type_name", bean="bean", edge_ord="edge_ord",
                        target="target", declared="declared", candidate="candidate")


# --- universe, implementations, collections, direct, names, site filter -------------------------

@query("universe", """
WITH u AS (SELECT CAST(s_nationkey AS VARCHAR) || '.' || CAST(s_suppkey % 10 AS VARCHAR) AS fqcn,
                  'supplier' AS source, s_suppkey AS member, 0 AS prio FROM supplier
           UNION ALL
           SELECT CAST(c_nationkey AS VARCHAR) || '.' || CAST(c_custkey % 10 AS VARCHAR),
                  'customer', c_custkey, 1 FROM customer)
SELECT fqcn, source, member FROM u
QUALIFY row_number() OVER (PARTITION BY fqcn ORDER BY prio, member) = 1""")
def q_universe(spark, sf_dir):
    """Beans keyed by nation + last digit: suppliers first, customers only where absent."""
    fq = lambda n, k: F.concat_ws(".", F.col(n).cast("string"), (F.col(k) % 10).cast("string"))
    sup = table(spark, sf_dir, "supplier").select(
        fq("s_nationkey", "s_suppkey").alias("fqcn"), F.lit("supplier").alias("source"),
        F.col("s_suppkey").alias("member"), F.col("s_suppkey").alias("scan_ord"))
    cus = table(spark, sf_dir, "customer").select(
        fq("c_nationkey", "c_custkey").alias("fqcn"), F.lit("customer").alias("source"),
        F.col("c_custkey").alias("member"), F.col("c_custkey").alias("scan_ord"))
    return C.universe([(0, sup), (1, cus)]).select("fqcn", "source", "member")


@query("implementations", """
SELECT CAST(s_nationkey AS BIGINT) AS contract, s_suppkey AS bean, s_suppkey AS bean_ord
FROM supplier WHERE s_acctbal >= 0""")
def q_implementations(spark, sf_dir):
    """Nation -> suppliers that implement it directly; suppliers in debt are not beans."""
    s = table(spark, sf_dir, "supplier")
    beans = s.where(F.col("s_acctbal") >= 0).select("s_suppkey")
    sup = s.select("s_suppkey", "s_nationkey")
    return C.implementations(beans, sup, bean="s_suppkey", bean_ord="s_suppkey",
                             contract="s_nationkey")


_SEG_CONTAINER = {"BUILDING": ("List", "[nation]"), "FURNITURE": ("Set", "[nation]"),
                  "AUTOMOBILE": ("Map", "['String', nation]"),
                  "MACHINERY": ("Map", "['Long', nation]"), "HOUSEHOLD": ("List", "[]")}


@query("resolve_collection", f"""
WITH {_SQL_SITES.replace('site AS', 'c0 AS')},
c AS (SELECT c_custkey, contract AS nation, c_mktsegment FROM c0),
site AS (SELECT c_custkey,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'List' WHEN 'FURNITURE' THEN 'Set'
                WHEN 'HOUSEHOLD' THEN 'List' ELSE 'Map' END AS container,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['String', nation] WHEN 'MACHINERY' THEN ['Long', nation]
                WHEN 'HOUSEHOLD' THEN []::VARCHAR[] ELSE [nation] END AS args FROM c),
el AS (SELECT c_custkey, container, args,
          CASE WHEN container = 'Map' THEN len(args) = 2 AND args[1] = 'String' ELSE len(args) = 1 END AS ok
       FROM site),
el2 AS (SELECT *, CASE WHEN ok THEN (CASE WHEN container = 'Map' THEN args[2] ELSE args[1] END) END AS elem FROM el),
im AS (SELECT s_contract AS contract, s_suppkey FROM ({_SQL_SUPPLIERS}))
SELECT e.c_custkey, e.container, array_to_string(e.args, ',') AS args,
       CASE WHEN ok AND im.s_suppkey IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status,
       CASE WHEN ok AND im.s_suppkey IS NOT NULL THEN 'collection' END AS kind,
       CASE WHEN NOT ok THEN 'collection-injection' WHEN im.s_suppkey IS NULL THEN 'no-implementation-found' END AS reason,
       CASE WHEN ok THEN im.s_suppkey END AS candidate
FROM el2 e LEFT JOIN im ON im.contract = e.elem""")
def q_resolve_collection(spark, sf_dir):
    """Collection sites (List/Set/Map of a contract by market segment) -> all implementations."""
    seg = F.col("c_mktsegment")
    nation, _ = _site_contract(spark, sf_dir)
    container = (F.when(seg == "BUILDING", "List").when(seg == "FURNITURE", "Set")
                 .when(seg == "HOUSEHOLD", "List").otherwise("Map"))
    args = (F.when(seg == "AUTOMOBILE", F.array(F.lit("String"), nation))
            .when(seg == "MACHINERY", F.array(F.lit("Long"), nation))
            .when(seg == "HOUSEHOLD", F.array().cast("array<string>"))
            .otherwise(F.array(nation)))
    sites = table(spark, sf_dir, "customer").select("c_custkey", container.alias("container"),
                                                    args.alias("type_args"))
    sup = _suppliers(spark, sf_dir, dropped=False)
    impls = C.implementations(sup.select("s_suppkey"), sup.select("s_suppkey", "s_contract"),
                              bean="s_suppkey", bean_ord="s_suppkey", contract="s_contract")
    out = C.resolve_collection(sites, impls, container="container", type_args="type_args")
    return out.select("c_custkey", "container", F.array_join("type_args", ",").alias("args"),
                      "status", "kind", "reason", "candidate")


@query("resolve_direct", """
WITH t AS (SELECT p_partkey, p_type IN ('PROMO', 'MEDIUM', 'LARGE') AS iface FROM part
           WHERE p_partkey % 13 <> 0),
b AS (SELECT p_partkey, p_type = 'PROMO' AS terminal FROM part
      WHERE p_partkey % 13 <> 0 AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO')),
d AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
        CASE WHEN t.p_partkey IS NULL THEN 'unscanned'
             WHEN NOT t.iface AND b.p_partkey IS NOT NULL THEN 'concrete'
             WHEN t.iface AND coalesce(b.terminal, false) THEN 'terminal'
             WHEN t.iface THEN 'interface' ELSE 'non-bean-class' END AS decision
      FROM lineitem l LEFT JOIN t ON t.p_partkey = l.l_partkey LEFT JOIN b ON b.p_partkey = l.l_partkey)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
       CASE WHEN decision IN ('concrete', 'terminal') THEN 'resolved'
            WHEN decision = 'interface' THEN 'pending' ELSE 'unresolved' END AS status,
       CASE WHEN decision IN ('concrete', 'terminal') THEN decision END AS kind,
       CASE WHEN decision IN ('unscanned', 'non-bean-class') THEN 'not-a-scanned-bean' END AS reason
FROM d""")
def q_resolve_direct(spark, sf_dir):
    """Line item -> part type: concrete bean, terminal interface, interface (ladder next) or not a
    scanned bean; every 13th part is outside the scan."""
    part = table(spark, sf_dir, "part").where(F.col("p_partkey") % 13 != 0)
    types = part.select("p_partkey", F.col("p_type").isin("PROMO", "MEDIUM", "LARGE").alias("iface"))
    beans = part.where(F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO")).select(
        "p_partkey", (F.col("p_type") == "PROMO").alias("terminal"))
    sites = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                    "l_suppkey")
    return C.resolve_direct(sites, types, beans, site_type="l_partkey", type_fqcn="p_partkey",
                            is_interface="iface", bean_fqcn="p_partkey", terminal="terminal")


@query("bean_name", """
SELECT p_partkey,
  CASE WHEN p_size % 10 = 0 THEN p_brand ELSE
    lower(substr(s, 1, 1)) || substr(s, 2) END AS bean_name
FROM (SELECT p_partkey, p_size, p_brand,
             array_to_string(list_transform(string_split(p_name, ' '),
                             lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS s
      FROM part)""")
def q_bean_name(spark, sf_dir):
    """Bean names of parts: explicit brand where the size ends in 0, else the decapitalised
    CamelCase simple name."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_replace(F.initcap("p_name"), " ", "").alias("simple"),
        F.when(F.col("p_size") % 10 == 0, F.col("p_brand")).alias("explicit"))
    return part.select("p_partkey",
                       C.bean_name(part, simple_name="simple", explicit="explicit").alias("bean_name"))


@query("site_filter", """
WITH f AS (SELECT p_partkey,
  CASE p_partkey % 8 WHEN 0 THEN 'String' WHEN 1 THEN 'BigDecimal'
       WHEN 2 THEN 'java.time.' || w WHEN 3 THEN 'javax.sql.' || w ELSE w END AS type_written,
  p_type = 'SMALL' AS is_primitive, p_size % 7 = 0 AS is_static, p_size % 11 = 0 AS initialised
  FROM (SELECT *, upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS w
        FROM part))
SELECT p_partkey, type_written,
  CASE WHEN is_static THEN 'static' WHEN initialised THEN 'initialised' WHEN is_primitive THEN 'primitive'
       WHEN type_written IN ('String', 'Integer', 'Long', 'Double', 'Float', 'Boolean', 'Byte', 'Short',
                             'Character', 'Object', 'BigDecimal', 'BigInteger') THEN 'value-type'
       WHEN starts_with(type_written, 'java.') OR starts_with(type_written, 'javax.') THEN 'jdk-type'
  END AS excluded_by
FROM f""")
def q_site_filter(spark, sf_dir):
    """Parts as fields: which are dependency sites, and why the others are not."""
    w = F.element_at(F.split("p_name", " "), 2)
    w = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    k = F.col("p_partkey") % 8
    tw = (F.when(k == 0, "String").when(k == 1, "BigDecimal")
          .when(k == 2, F.concat(F.lit("java.time."), w)).when(k == 3, F.concat(F.lit("javax.sql."), w))
          .otherwise(w))
    fields = table(spark, sf_dir, "part").select(
        "p_partkey", tw.alias("type_written"), (F.col("p_type") == "SMALL").alias("is_primitive"),
        (F.col("p_size") % 7 == 0).alias("is_static"), (F.col("p_size") % 11 == 0).alias("initialised"))
    out = C.site_filter(fields, type_written="type_written", is_primitive="is_primitive",
                        is_static="is_static", initialised="initialised")
    return out.select("p_partkey", "type_written", "excluded_by")


@query("all_beans", """
WITH u AS (SELECT CAST(s_nationkey AS VARCHAR) || '.' || CAST(s_suppkey % 10 AS VARCHAR) AS fqcn,
                  'supplier' AS source, s_suppkey AS member, 0 AS prio FROM supplier
           UNION ALL
           SELECT CAST(c_nationkey AS VARCHAR) || '.' || CAST(c_custkey % 10 AS VARCHAR),
                  'customer', c_custkey, 1 FROM customer)
SELECT fqcn, source, member FROM u
QUALIFY row_number() OVER (PARTITION BY fqcn ORDER BY prio, member) = 1
ORDER BY fqcn""")
def q_all_beans(spark, sf_dir):
    """All beans of the universe binding, sorted by FQCN."""
    return C.all_beans(q_universe(spark, sf_dir))


@query("factory_sites", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
       'B' || CAST(o_custkey AS VARCHAR) AS bean
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'""")
def q_factory_sites(spark, sf_dir):
    """Urgent orders as @Bean factory methods producing their customer's bean; their line items
    are the method parameters, hence that bean's sites."""
    fm = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("m"),
        F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("produced"))
    params = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.lit(0).alias("m"), "l_linenumber", "l_partkey", "l_suppkey")
    out = C.factory_sites(params, fm, owner="l_orderkey", method_ord="m", produced="produced")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "bean")
