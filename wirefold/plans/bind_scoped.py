"""Operators under a two-column scope (``repo``, ``snapshot``): the same names stand in several scopes
and must not meet across them. Scopes are taken from the keys of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import candidates as C
from wirefold.operators import resolve as RS
from wirefold.operators import roles as RL
from wirefold.operators import routes as R
from wirefold.plans.bind_routes import (SEVEN_ROUTES, _sql_is_var, _sql_match, _sql_requests, _sql_segs, page_requests,
                                        seven_routes)
from wirefold.plans.bind_candidates import _sql_candidate, candidate_edges
from wirefold.plans.bind_routes2 import _SQL_METHODS, _methods
from wirefold.plans.registry import ORACLE, query, table

KEYS = ["repo", "snapshot"]


def _scope(key: str):
    return [F.concat(F.lit("r"), (F.col(key) % 3).cast("string")).alias("repo"),
            F.concat(F.lit("s"), (F.col(key) % 2).cast("string")).alias("snapshot")]


def _sql_scope(key: str) -> str:
    return f"'r' || CAST({key} % 3 AS VARCHAR) AS repo, 's' || CAST({key} % 2 AS VARCHAR) AS snapshot"


_ROUTES = ", ".join(f"({i}::BIGINT, '{v or 'GET'}', '{p}')" for i, v, p in SEVEN_ROUTES)


@query("route_resolve_scoped", f"""
WITH req0 AS ({_sql_requests()}),
req AS (SELECT *, CASE WHEN request_id % 7 = 0 THEN 'r9' ELSE 'r' || CAST(request_id % 3 AS VARCHAR) END AS repo,
               's' || CAST(request_id % 2 AS VARCHAR) AS snapshot FROM req0),
rt AS (SELECT route_id, http_method, path_pattern, 'r' || CAST(a AS VARCHAR) AS repo, 's' || CAST(b AS VARCHAR) AS snapshot
       FROM (VALUES {_ROUTES}) t(route_id, http_method, path_pattern), (VALUES (0), (1), (2)) x(a), (VALUES (0), (1)) y(b)
       WHERE (route_id + a + b) % 3 <> 0),
m AS (SELECT q.request_id, t.route_id, t.path_pattern FROM req q JOIN rt t USING (repo, snapshot)
      WHERE (t.http_method = 'ANY' OR t.http_method = q.verb) AND {_sql_match(_sql_segs('t.path_pattern'), _sql_segs('q.req_path'))}
      QUALIFY row_number() OVER (PARTITION BY q.request_id ORDER BY
        len(list_filter({_sql_segs('t.path_pattern')}, lambda s: {_sql_is_var('s')})), t.route_id) = 1)
SELECT req.repo, req.snapshot, req.request_id, m.route_id, m.path_pattern,
       CASE WHEN req.repo = 'r9' THEN 'unknown_scope' WHEN m.route_id IS NULL THEN 'miss' ELSE 'resolved' END AS status
FROM req LEFT JOIN m USING (request_id)""")
def q_route_resolve_scoped(spark, sf_dir):
    """Page requests in six scopes, each with its own part of the seven routes; every seventh asks
    about a repository that was never indexed."""
    repo = F.when(F.col("request_id") % 7 == 0, "r9").otherwise(F.concat(F.lit("r"), (F.col("request_id") % 3).cast("string")))
    req = page_requests(spark, sf_dir).select("*", repo.alias("repo"), _scope("request_id")[1])
    routes = (seven_routes(spark, "GET")
              .withColumn("a", F.explode(F.array(*map(F.lit, range(3))))).withColumn("b", F.explode(F.array(*map(F.lit, range(2)))))
              .where((F.col("route_id") + F.col("a") + F.col("b")) % 3 != 0))
    routes = routes.select("*", F.concat(F.lit("r"), F.col("a").cast("string")).alias("repo"),
                           F.concat(F.lit("s"), F.col("b").cast("string")).alias("snapshot"))
    out = R.with_unknown_scopes(R.route_resolve(req, routes, keys=KEYS), routes, keys=KEYS)
    return out.select(*KEYS, "request_id", "route_id", "path_pattern", "status")


@query("resolve_candidate_scoped", f"""
WITH s AS (SELECT {_sql_scope('s_suppkey')}, s_nationkey, s_suppkey, s_acctbal > 9000 AS prim, s_acctbal < 0 AS cond FROM supplier),
c AS (SELECT {_sql_scope('c_custkey')}, c_custkey, c_nationkey FROM customer),
st AS (SELECT repo, snapshot, s_nationkey, count(*) AS n, count_if(prim) AS np, bool_or(cond) AS anyc, min(s_suppkey) AS first_id,
         min(CASE WHEN prim THEN s_suppkey END) AS prim_id FROM s GROUP BY ALL)
SELECT c.repo, c.snapshot, c.c_custkey,
       CASE WHEN n IS NULL THEN 'no-implementation-found' WHEN anyc THEN 'conditional-candidates' WHEN n = 1 THEN NULL
            WHEN np = 1 THEN NULL ELSE 'multiple-candidates' END AS reason,
       CASE WHEN n IS NULL OR anyc THEN NULL WHEN n = 1 THEN first_id WHEN np = 1 THEN prim_id END AS target
FROM c LEFT JOIN st ON st.repo = c.repo AND st.snapshot = c.snapshot AND s_nationkey = c_nationkey""")
def q_resolve_candidate_scoped(spark, sf_dir):
    """Customer sites of six scopes; a nation's suppliers count only in their own scope."""
    cands = table(spark, sf_dir, "supplier").select(
        *_scope("s_suppkey"), "s_suppkey", "s_name", "s_nationkey", (F.col("s_acctbal") > 9000).alias("is_primary"),
        (F.col("s_acctbal") < 0).alias("is_conditional"))
    sites = table(spark, sf_dir, "customer").select(*_scope("c_custkey"), "c_custkey", "c_nationkey",
                                                    F.lit(None).cast("string").alias("qualifier"))
    out = C.resolve_candidate(sites, cands, contract="c_nationkey", qualifier="qualifier", cand_contract="s_nationkey",
                              cand_id="s_suppkey", cand_name="s_name", cand_order="s_suppkey", primary="is_primary",
                              conditional="is_conditional", keys=KEYS)
    return out.select(*KEYS, "c_custkey", "reason", "target")


@query("lookup_outcome_scoped", f"""
WITH ent AS (SELECT DISTINCT {_sql_scope('p_partkey')}, p_brand || '.' || p_name AS qualified, p_name AS simple FROM part),
req AS (SELECT {_sql_scope('p_partkey')}, p_partkey AS request_id,
          CASE WHEN p_partkey % 4 = 0 THEN p_brand || '.' || p_name ELSE p_name END AS name FROM part),
hit AS (SELECT req.repo, req.snapshot, request_id, qualified FROM req JOIN ent USING (repo, snapshot)
        WHERE qualified = name OR (simple = name AND NOT EXISTS (SELECT 1 FROM ent e WHERE e.repo = req.repo
              AND e.snapshot = req.snapshot AND e.qualified = req.name)))
SELECT repo, snapshot, request_id, qualified AS candidate,
       CASE count(qualified) OVER (PARTITION BY request_id) WHEN 0 THEN 'not-found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status
FROM req LEFT JOIN hit USING (repo, snapshot, request_id)""")
def q_lookup_outcome_scoped(spark, sf_dir):
    """Parts by qualified or simple name, within their scope only."""
    part = table(spark, sf_dir, "part")
    qualified = F.concat_ws(".", "p_brand", "p_name")
    ents = part.select(*_scope("p_partkey"), qualified.alias("qualified"), F.col("p_name").alias("simple"))
    req = part.select(*_scope("p_partkey"), F.col("p_partkey").alias("request_id"),
                      F.when(F.col("p_partkey") % 4 == 0, qualified).otherwise(F.col("p_name")).alias("name"))
    out = RS.lookup_outcome(req, ents, req_id="request_id", name="name", qualified="qualified", simple="simple", keys=KEYS)
    return out.select(*KEYS, "request_id", "candidate", "status")


@query("bean_dependencies_lookup", f"""
WITH e AS (SELECT c_custkey // 10 AS k, c_custkey % 10 AS edge_ord, status, coalesce(kind, reason) AS why, target
           FROM ({_sql_candidate(False)})),
ent AS (SELECT DISTINCT k, 'q' || CAST(k % 2 AS VARCHAR) || '.C' || CAST(k // 2 AS VARCHAR) AS bean, 'C' || CAST(k // 2 AS VARCHAR) AS simple FROM e),
req AS (SELECT k AS request_id, CASE WHEN k % 7 = 0 THEN 'X' WHEN k % 3 = 0 THEN simple ELSE bean END AS name FROM ent),
hit AS (SELECT request_id, ent.k, bean FROM req JOIN ent ON bean = name OR simple = name),
st AS (SELECT request_id, k, bean, CASE count(bean) OVER (PARTITION BY request_id) WHEN 0 THEN 'not-found' WHEN 1 THEN 'found'
         ELSE 'ambiguous' END AS status FROM req LEFT JOIN hit USING (request_id))
SELECT request_id, status, CASE status WHEN 'found' THEN 'type' WHEN 'ambiguous' THEN 'match' END AS part, bean AS item, NULL AS detail FROM st
UNION ALL SELECT request_id, st.status, 'edge', CAST(edge_ord AS VARCHAR), e.status || ':' || why || ':' || coalesce(CAST(target AS VARCHAR), '-')
FROM st JOIN e USING (k) WHERE st.status = 'found'""")
def q_bean_dependencies_lookup(spark, sf_dir):
    """beanDependencies by qualified name, by a simple name that two beans share, or by an unknown
    name: the edges of a found bean, the matches of an ambiguous name."""
    key = F.floor(F.col("c_custkey") / 10)
    bean = F.format_string("q%d.C%d", (key % 2).cast("int"), F.floor(key / 2).cast("long"))
    simple = F.concat(F.lit("C"), F.floor(key / 2).cast("string"))
    e = candidate_edges(spark, sf_dir).select(
        key.alias("k"), bean.alias("candidate"), simple.alias("simple"), (F.col("c_custkey") % 10).alias("item"),
        F.concat_ws(":", "status", F.coalesce("kind", "reason"), F.coalesce(F.col("target").cast("string"), F.lit("-"))).alias("detail"))
    ents = e.select("k", F.col("candidate").alias("qualified"), "simple").distinct()
    req = ents.select(F.col("k").alias("request_id"), F.when(F.col("k") % 7 == 0, "X").when(F.col("k") % 3 == 0, F.col("simple"))
                      .otherwise(F.col("qualified")).alias("name"))
    look = RS.lookup_outcome(req, ents, req_id="request_id", name="name", qualified="qualified", simple="simple")
    return RS.lookup_answer(look, [("edge", e.select("candidate", "item", "detail"))], req_id="request_id")


@query("slice_info", """
WITH a AS (SELECT user_id AS test, event_id AS o, CASE event_type WHEN 'view' THEN '@SpringBootTest' WHEN 'purchase' THEN '@ExtendWith(E.class)'
             ELSE '@Tag("x")' END AS t FROM events WHERE event_type <> 'signup'),
i AS (SELECT user_id AS test, 'E' || CAST(event_id % 5 AS VARCHAR) AS s, arg_min('org.x.E' || CAST(event_id % 5 AS VARCHAR), event_id) AS imp
      FROM events WHERE event_type = 'signup' AND event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY ALL),
w AS (SELECT e.user_id AS test, e.event_id AS o, coalesce(i.imp, CASE WHEN e.user_id % 3 = 0 THEN '' ELSE 'com.p' || CAST(e.user_id % 4 AS VARCHAR) || '.' END
        || 'E' || CAST(e.event_id % 5 AS VARCHAR)) AS fq
      FROM events e LEFT JOIN i ON i.test = e.user_id AND i.s = 'E' || CAST(e.event_id % 5 AS VARCHAR) WHERE e.event_type = 'purchase'),
x AS (SELECT test, string_agg(t, '|' ORDER BY o, t) AS class_annotations, bool_or(t = '@SpringBootTest') AS is_context FROM a GROUP BY test),
y AS (SELECT test, string_agg(fq, '|' ORDER BY o) AS extend_with FROM w GROUP BY test)
SELECT test, class_annotations, coalesce(extend_with, '') AS extend_with, is_context FROM x LEFT JOIN y USING (test)""")
def q_slice_info(spark, sf_dir):
    """Users as test classes: annotation texts in order, @ExtendWith classes by import, own package or bare
    name, and whether a context starts."""
    ev = table(spark, sf_dir, "events").withColumn("path", F.col("user_id").cast("string"))
    et = F.col("event_type")
    anns = ev.where(et != "signup").select(
        F.col("user_id").alias("test"), F.col("event_id").alias("ord"),
        F.when(et == "view", "@SpringBootTest").when(et == "purchase", "@ExtendWith(E.class)").otherwise('@Tag("x")').alias("text"))
    simple = F.concat(F.lit("E"), (F.col("event_id") % 5).cast("string"))
    ext = ev.where(et == "purchase").select(
        F.col("user_id").alias("test"), "path", simple.alias("type_name"), F.col("event_id").alias("value_ord"),
        F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("com.p"), (F.col("user_id") % 4).cast("string"))).alias("package"))
    imps = ev.where(et == "signup").select(
        "path", F.concat(F.lit("org.x."), simple).alias("name"), F.col("event_id").alias("ord"),
        (F.col("event_id") % 7 == 0).alias("is_static"), (F.col("event_id") % 11 == 0).alias("is_wildcard"))
    out = RL.slice_info(anns, ext, imps, test="test", path="path", ord="ord", text="text", package="package")
    return out.select("test", F.array_join("class_annotations", "|").alias("class_annotations"),
                      F.array_join("extend_with", "|").alias("extend_with"), "is_context")


@query("route_answer_unresolved", f"""
WITH {_SQL_METHODS},
un AS (SELECT page_id, {_sql_scope('page_id')}, reason FROM rm WHERE reason IS NOT NULL)
SELECT page_id, repo, snapshot, reason FROM un
WHERE (repo, snapshot) IN (SELECT (repo, snapshot) FROM ({ORACLE['route_resolve_scoped']}) WHERE status = 'miss')""")
def q_route_answer_unresolved(spark, sf_dir):
    """What a miss shows beside its suggestions: the unresolved mappings of its scope, once per scope."""
    unresolved = _methods(spark, sf_dir).where("reason is not null").select("page_id", *_scope("page_id"), "reason")
    return R.scopes_with_miss(q_route_resolve_scoped(spark, sf_dir), unresolved, keys=KEYS).select(
        "page_id", *KEYS, "reason")
