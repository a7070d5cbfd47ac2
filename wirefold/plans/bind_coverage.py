"""Coverage and flag operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import coverage as CV
from wirefold.operators import roles as RL
from wirefold.operators import resolve as RS
from wirefold.plans import bind_candidates as BC
from wirefold.plans import bind_lifecycle as BL
from wirefold.plans import bind_routes2 as BR2
from wirefold.plans import bind_tx_roles as BT
from wirefold.plans.registry import ORACLE, QUERIES, query, table


def _sub(name: str) -> str:
    return f"({ORACLE[name]})"


@query("index_status", f"""
SELECT 'endpoints' AS metric, NULL AS reason, count(*) AS n FROM {_sub('route_expand')} t WHERE status = 'resolved'
UNION ALL SELECT 'files', NULL, count(*) FROM {_sub('select_sources')} t
UNION ALL SELECT 'beans', NULL, count(*) FROM {_sub('universe')} t
UNION ALL SELECT 'unresolved_sites', reason, count(*) FROM {_sub('resolve_candidate')} t
          WHERE status = 'unresolved' GROUP BY reason
UNION ALL SELECT 'unresolved_mappings', reason, count(*) FROM {_sub('route_unresolved')} t GROUP BY reason
UNION ALL SELECT 'parse_failures', NULL, count(*) FROM {_sub('parse_quarantine')} t WHERE status = 'rejected'
UNION ALL SELECT 'shadowed_duplicates', NULL, CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM documents GROUP BY md5(text)
          HAVING count(*) > 1)
""")
def q_index_status(spark, sf_dir):
    """indexStatus: endpoint, file, bean, failure and shadowed-duplicate counts and the two reason breakdowns, long form."""
    endpoints = QUERIES["route_expand"](spark, sf_dir).where(F.col("status") == "resolved")
    files = QUERIES["select_sources"](spark, sf_dir)
    beans = QUERIES["universe"](spark, sf_dir)
    sites = BC.candidate_edges(spark, sf_dir).where(F.col("status") == "unresolved")
    mappings = BR2._unresolved(spark, sf_dir)
    failures = QUERIES["parse_quarantine"](spark, sf_dir).where(F.col("status") == "rejected")
    _, shadowed = RS.fact_dedupe_last(table(spark, sf_dir, "documents").select(F.md5("text").alias("text_key"), "doc_id"),
                                      key=["text_key"], order=["doc_id"])
    out = CV.index_status([("shadowed_duplicates", shadowed, None, "n_shadowed"), ("endpoints", endpoints, None), ("files", files, None),
                           ("beans", beans, None), ("unresolved_sites", sites, "reason"),
                           ("unresolved_mappings", mappings, "reason"),
                           ("parse_failures", failures, None)])
    return out.select("metric", "reason", "n")


_EVENT_ANN = {"view": "Profile", "click": "ConditionalOnProperty", "purchase": "Primary",
              "signup": "Component", "error": "ConditionalOnMissingBean"}


@query("conditional_flag", """
SELECT user_id, bool_or(a = 'Profile' OR starts_with(a, 'ConditionalOn')) AS flag FROM (
  SELECT user_id, CASE event_type WHEN 'view' THEN 'Profile' WHEN 'click' THEN 'ConditionalOnProperty'
    WHEN 'purchase' THEN 'Primary' WHEN 'signup' THEN 'Component' ELSE 'ConditionalOnMissingBean' END AS a
  FROM events) GROUP BY user_id""")
def q_conditional_flag(spark, sf_dir):
    """Users as candidate beans annotated by their events: conditional iff any is @Profile or @ConditionalOn*."""
    ann = F.create_map(*[x for kv in _EVENT_ANN.items() for x in map(F.lit, kv)])
    a = (table(spark, sf_dir, "events")
         .select("user_id", ann[F.col("event_type")].alias("simple_name")))
    return CV.flag_by_owner(a, owner="user_id", flag=CV.conditional_flag("simple_name"))


@query("controller_filter", """
SELECT p_partkey FROM part WHERE p_size % 2 = 1 AND EXISTS (
  SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND
  (CASE WHEN l_returnflag = 'R' THEN 'RestController' WHEN l_returnflag = 'A' THEN 'Controller'
        ELSE 'org.springframework.stereotype.Controller' END) IN ('Controller', 'RestController'))""")
def q_controller_filter(spark, sf_dir):
    """Parts as classes (even sizes are interfaces) annotated by their line items; only the
    written names Controller/RestController make a controller."""
    types = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("iface"))
    rf = F.col("l_returnflag")
    ann = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("owner"),
        F.when(rf == "R", "RestController").when(rf == "A", "Controller")
        .otherwise("org.springframework.stereotype.Controller").alias("written_name"))
    return CV.controller_filter(types, ann, type_id="p_partkey", is_interface="iface",
                                owner="owner", written_name="written_name").select("p_partkey")


_SLICE_BY_EVENT = {"view": "@SpringBootTest", "click": "@WebMvcTest(controllers = X.class)",
                   "purchase": "@ExtendWith(MockitoExtension.class)", "signup": "@DataJpaTestX",
                   "error": "@Tag(\"slow\")"}


@query("context_slice_flag", """
SELECT user_id, bool_or(regexp_extract(t, '^@?([A-Za-z0-9_$]*)', 1) IN ('SpringBootTest', 'WebMvcTest',
  'DataJpaTest', 'JdbcTest', 'WebFluxTest', 'DataMongoTest', 'RestClientTest', 'JsonTest', 'DataRedisTest',
  'DataLdapTest', 'DataR2dbcTest')) AS is_context FROM (
  SELECT user_id, CASE event_type WHEN 'view' THEN '@SpringBootTest' WHEN 'click' THEN '@WebMvcTest(controllers = X.class)'
    WHEN 'purchase' THEN '@ExtendWith(MockitoExtension.class)' WHEN 'signup' THEN '@DataJpaTestX'
    ELSE '@Tag("slow")' END AS t FROM events) GROUP BY user_id""")
def q_context_slice_flag(spark, sf_dir):
    """Users as test classes with class-annotation texts from their events: a context test
    iff the first identifier of some text is one of the eleven slice annotations."""
    m = F.create_map(*[x for kv in _SLICE_BY_EVENT.items() for x in map(F.lit, kv)])
    texts = table(spark, sf_dir, "events").select("user_id", m[F.col("event_type")].alias("text"))
    return texts.groupBy("user_id").agg(F.bool_or(RL.context_slice_flag(F.array("text"))).alias("is_context"))


@query("constants", """
SELECT p_partkey, p_name AS value FROM part
WHERE (p_type = 'PROMO' OR (p_size % 2 = 0 AND p_size % 3 = 0)) AND p_brand <> 'Brand#1'
  AND p_partkey % 4 <> 0""")
def q_constants(spark, sf_dir):
    """Parts as fields: interface fields (PROMO) or static final ones (size divisible by 2 and 3)
    of type String (brand other than Brand#1) with a string-literal initialiser."""
    f = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_type") == "PROMO").alias("iface"),
        (F.col("p_size") % 2 == 0).alias("st"), (F.col("p_size") % 3 == 0).alias("fin"),
        F.when(F.col("p_brand") == "Brand#1", "Integer").otherwise("String").alias("tw"),
        F.when(F.col("p_partkey") % 4 == 0, "other").otherwise("string_literal").alias("ik"),
        F.concat(F.lit('"'), F.col("p_name"), F.lit('"')).alias("it"))
    out = CV.constants(f, owner_is_interface="iface", is_static="st", is_final="fin",
                       type_written="tw", init_kind="ik", init_text="it")
    return out.select("p_partkey", "value")


@query("test_wiring", f"""WITH {BT._SQL_ROLES},
ent AS (SELECT DISTINCT user_id AS test, 'p' || CAST(user_id % 2 AS VARCHAR) || '.U' || CAST(user_id // 2 AS VARCHAR) AS cls,
          'U' || CAST(user_id // 2 AS VARCHAR) AS simple FROM events),
req AS (SELECT test AS request_id, CASE WHEN test % 10 = 0 THEN 'X' WHEN test % 3 = 0 THEN simple ELSE cls END AS name FROM ent),
hit AS (SELECT request_id, cls, test FROM req JOIN ent ON cls = name UNION SELECT request_id, cls, test FROM req JOIN ent ON simple = name),
st AS (SELECT request_id, cls, test, CASE count(cls) OVER (PARTITION BY request_id) WHEN 0 THEN 'not-found' WHEN 1 THEN 'found'
          ELSE 'ambiguous' END AS status FROM req LEFT JOIN hit USING (request_id)),
m AS (SELECT test, 'role' AS part, type_fqcn AS item, role || coalesce(':' || kind, '') AS detail FROM dr WHERE role IS NOT NULL
      UNION ALL SELECT test, 'unresolved', type_fqcn, annotation FROM dr WHERE role IS NULL
      UNION ALL SELECT test, 'static', type_fqcn, scope FROM ({ORACLE['static_roles']}) WHERE role IS NOT NULL
      UNION ALL SELECT user_id, 'context', CAST(is_context AS VARCHAR), NULL FROM ({ORACLE['context_slice_flag']}))
SELECT request_id, status, CASE status WHEN 'found' THEN 'type' WHEN 'ambiguous' THEN 'match' END AS part, cls AS item, NULL AS detail FROM st
UNION ALL SELECT request_id, status, part, item, detail FROM st JOIN m USING (test) WHERE status = 'found'""")
def q_test_wiring(spark, sf_dir):
    """testWiring for every test class: by its qualified name, by a simple name that two share, or by
    an unknown name. Its roles with kinds, annotations that do not resolve, static freezes with
    their scope and whether it starts a context; the matches of an ambiguous name."""
    cls = lambda c: F.format_string("p%d.U%d", (F.col(c) % 2).cast("int"), F.floor(F.col(c) / 2).cast("long"))
    simple = lambda c: F.concat(F.lit("U"), F.floor(F.col(c) / 2).cast("string"))
    dr = BT._annotations(spark, sf_dir).withColumn("candidate", cls("test"))
    roles = dr.where("role is not null").select("candidate", F.col("type_fqcn").alias("item"),
                                                F.concat_ws(":", "role", "kind").alias("detail"))
    unresolved = dr.where("role is null").select("candidate", F.col("type_fqcn").alias("item"),
                                                 F.col("annotation").alias("detail"))
    static = (QUERIES["static_roles"](spark, sf_dir).where("role is not null")
              .select(cls("test").alias("candidate"), F.col("type_fqcn").alias("item"), F.col("scope").alias("detail")))
    context = QUERIES["context_slice_flag"](spark, sf_dir).select(
        cls("user_id").alias("candidate"), F.col("is_context").cast("string").alias("item"),
        F.lit(None).cast("string").alias("detail"))
    tests = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    req = tests.select(u.alias("request_id"), F.when(u % 10 == 0, "X").when(u % 3 == 0, simple("user_id"))
                       .otherwise(cls("user_id")).alias("name"))
    ents = tests.select(cls("user_id").alias("qualified"), simple("user_id").alias("simple"))
    look = RS.lookup_outcome(req, ents, req_id="request_id", name="name", qualified="qualified",
                             simple="simple", mode="simple")
    return RS.lookup_answer(look, [("role", roles), ("unresolved", unresolved), ("static", static), ("context", context)],
                            req_id="request_id")
