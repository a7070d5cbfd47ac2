"""Transaction-boundary and test-role operators bound to the driver tables.

Transactions: a line item is a method of its order (the class). Its own annotation is
``l_returnflag = 'R'``, the class-level one ``o_orderpriority = '1-URGENT'``, private is
``l_linestatus = 'O'``; the method name is ``l_linenumber``; consecutive lines of an order call
each other. Test roles: a user is a test class; an event is a field or call whose annotation or
construction follows from ``event_type`` and whose type is ``'T' || event_id % 37``.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wirefold.operators import boundaries as B
from wirefold.operators import resolve as RS
from wirefold.operators import roles as RL
from wirefold.plans.registry import query, table

MEMBER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _flags(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        *MEMBER, (F.col("l_returnflag") == "R").alias("own"),
        (F.col("l_linestatus") == "O").alias("is_private"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("class_level"))
    out = B.effective_flag(li, orders, member_owner="l_orderkey", owner_id="o_orderkey",
                           own="own", inherited="class_level", excluded="is_private")
    return out.select(*MEMBER, "transactional", "source", "dead")


_SQL_FLAGS = """
f AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
         l_returnflag = 'R' AS own, l_linestatus = 'O' AS priv,
         coalesce(o_orderpriority = '1-URGENT', false) AS cls
      FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, own OR (cls AND NOT priv) AS transactional,
         CASE WHEN own THEN 'method' WHEN cls AND NOT priv THEN 'class' ELSE 'none' END AS source,
         own AND priv AS dead FROM f)"""


@query("effective_flag", f"WITH {_SQL_FLAGS} SELECT * FROM g")
def q_effective_flag(spark, sf_dir):
    """Per line item (method): transactional, and whether by its own annotation or its order's."""
    return _flags(spark, sf_dir)


@query("dead_annotation", f"""WITH {_SQL_FLAGS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, transactional FROM g WHERE dead""")
def q_dead_annotation(spark, sf_dir):
    """Own annotation on a private method: warned about, and still reported transactional."""
    return _flags(spark, sf_dir).where("dead").select(*MEMBER, "transactional")


def _calls(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    recv = (F.when(F.col("l_quantity") > 40, "other").when(F.col("l_quantity") > 20, "this")
            .otherwise("none"))
    c = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("caller"),
                  F.lead("l_linenumber").over(w).cast("long").alias("callee"), recv.alias("receiver"))
    return c.where(F.col("callee").isNotNull())


_SQL_CALLS = """
c AS (SELECT * FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS caller,
         CAST(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS callee,
         CASE WHEN l_quantity > 40 THEN 'other' WHEN l_quantity > 20 THEN 'this' ELSE 'none' END AS receiver
      FROM lineitem) WHERE callee IS NOT NULL),
si AS (SELECT c.* FROM c WHERE receiver IN ('none', 'this') AND callee <> caller
       AND EXISTS (SELECT 1 FROM g WHERE g.l_orderkey = c.l_orderkey AND g.l_linenumber = c.callee
                   AND g.transactional))"""


def _self_calls(spark, sf_dir):
    flags = _flags(spark, sf_dir).withColumn("name", F.col("l_linenumber").cast("long"))
    return B.self_invocation(_calls(spark, sf_dir), flags, owner="l_orderkey", caller="caller",
                             callee="callee", receiver="receiver", member_name="name")


@query("self_invocation", f"WITH {_SQL_FLAGS}, {_SQL_CALLS} SELECT * FROM si")
def q_self_invocation(spark, sf_dir):
    """Unqualified calls to another transactional method name of the same order."""
    return _self_calls(spark, sf_dir)


_SQL_CLASS = "'r' || CAST({k} % 5 AS VARCHAR) || '.ord' || CAST({k} // 5 AS VARCHAR)"


def _class_name(key: str):
    return F.format_string("r%d.ord%d", (F.col(key) % 5).cast("int"), F.floor(F.col(key) / 5).cast("long"))


@query("tx_answer", f"""WITH {_SQL_FLAGS}, {_SQL_CALLS},
ent AS (SELECT DISTINCT {_SQL_CLASS.format(k='l_orderkey')} AS cls, split_part({_SQL_CLASS.format(k='l_orderkey')}, '.', 2) AS tail
        FROM lineitem),
req AS (SELECT o_orderkey AS request_id,
          CASE WHEN o_orderkey % 10 = 0 THEN 'ord.x' WHEN o_orderkey % 3 = 0 THEN 'ord' || CAST(o_orderkey // 5 AS VARCHAR)
               ELSE {_SQL_CLASS.format(k='o_orderkey')} END AS name FROM orders),
hit AS (SELECT request_id, cls FROM req JOIN ent ON cls = name
        UNION SELECT request_id, cls FROM req JOIN ent ON tail = name WHERE name NOT IN (SELECT cls FROM ent)),
look AS (SELECT request_id, cls, count(cls) OVER (PARTITION BY request_id) AS n FROM req LEFT JOIN hit USING (request_id)),
st AS (SELECT request_id, cls, CASE n WHEN 0 THEN 'not-found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM look),
m AS (SELECT {_SQL_CLASS.format(k='l_orderkey')} AS cls, 'method' AS part, CAST(l_linenumber AS VARCHAR) AS item,
        CAST(transactional AS VARCHAR) || ':' || source AS detail FROM g
      UNION ALL SELECT {_SQL_CLASS.format(k='l_orderkey')}, 'dead-annotation', CAST(l_linenumber AS VARCHAR), NULL FROM g WHERE dead
      UNION ALL SELECT {_SQL_CLASS.format(k='l_orderkey')}, 'self-call', CAST(caller AS VARCHAR) || '>' || CAST(callee AS VARCHAR), receiver FROM si)
SELECT request_id, status, CASE status WHEN 'found' THEN 'type' WHEN 'ambiguous' THEN 'match' END AS part, cls AS item, NULL AS detail FROM st
UNION ALL SELECT request_id, status, part, item, detail FROM st JOIN m USING (cls) WHERE status = 'found'""")
def q_tx_answer(spark, sf_dir):
    """transactionalBoundaries for every order: by its qualified name, by a last part that several
    share, or by an unknown name. Methods with their flag and its source, annotations on private
    methods, self calls; the matches of an ambiguous name."""
    flags = _flags(spark, sf_dir).withColumn("candidate", _class_name("l_orderkey"))
    item = F.col("l_linenumber").cast("string").alias("item")
    none = F.lit(None).cast("string").alias("detail")
    methods = flags.select("candidate", item, F.concat_ws(":", F.col("transactional").cast("string"), "source").alias("detail"))
    dead = flags.where("dead").select("candidate", item, none)
    selfs = _self_calls(spark, sf_dir).select(
        _class_name("l_orderkey").alias("candidate"),
        F.concat_ws(">", F.col("caller").cast("string"), F.col("callee").cast("string")).alias("item"),
        F.col("receiver").alias("detail"))
    k = F.col("o_orderkey")
    req = table(spark, sf_dir, "orders").select(
        k.alias("request_id"),
        F.when(k % 10 == 0, "ord.x").when(k % 3 == 0, F.concat(F.lit("ord"), F.floor(k / 5).cast("string")))
        .otherwise(_class_name("o_orderkey")).alias("name"))
    ents = table(spark, sf_dir, "lineitem").select(_class_name("l_orderkey").alias("qualified")).distinct()
    look = RS.lookup_outcome(req, ents, req_id="request_id", name="name", qualified="qualified", mode="suffix")
    return RS.lookup_answer(look, [("method", methods), ("dead-annotation", dead), ("self-call", selfs)],
                            req_id="request_id")


# --- test roles ------------------------------------------------------------------------------

ANNOTATION_BY_EVENT = {"view": "Mock", "click": "Spy", "purchase": "InjectMocks",
                       "signup": "MockitoBean", "error": "MockBean"}
_KNOWN_SQL = ", ".join(f"('{s}', '{q}', {repr(k) if k else 'NULL'})"
                       for s, q, k in RL.KNOWN_ANNOTATIONS)


def _annotations(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ann = F.create_map(*[x for kv in ANNOTATION_BY_EVENT.items() for x in map(F.lit, kv)])
    simple = ann[F.col("event_type")]
    known = RL.known_annotations(spark)
    fa = ev.select("event_id", F.col("user_id").alias("test"),
                   F.concat(F.lit("T"), (F.col("event_id") % 37).cast("string")).alias("type_fqcn"),
                   simple.alias("annotation"))
    # what the test file imports for that simple name: the real one, or a look-alike
    imported = fa.join(known, fa["annotation"] == known["simple_name"], "left").select(
        *fa.columns, F.when(F.col("event_id") % 4 != 0, F.col("required_fqcn"))
        .otherwise(F.concat(F.lit("com.example.support."), F.col("annotation"))).alias("imported"))
    return RL.declared_roles(imported, simple_name="annotation", imported_fqcn="imported")


_SQL_ROLES = f"""
known(simple_name, required_fqcn, kind) AS (VALUES {_KNOWN_SQL}),
fa AS (SELECT event_id, user_id AS test, 'T' || CAST(event_id % 37 AS VARCHAR) AS type_fqcn,
          CASE event_type WHEN 'view' THEN 'Mock' WHEN 'click' THEN 'Spy' WHEN 'purchase' THEN 'InjectMocks'
               WHEN 'signup' THEN 'MockitoBean' WHEN 'error' THEN 'MockBean' END AS annotation
       FROM events),
dr AS (SELECT fa.*, CASE WHEN fa.event_id % 4 <> 0 THEN k.required_fqcn
                         ELSE 'com.example.support.' || fa.annotation END AS imported,
          CASE WHEN fa.event_id % 4 <> 0 THEN (CASE WHEN k.kind IS NULL THEN 'real' ELSE 'mocked' END) END AS role,
          CASE WHEN fa.event_id % 4 <> 0 THEN k.kind END AS kind,
          CASE WHEN fa.event_id % 4 <> 0 THEN 'resolved' ELSE 'unresolved' END AS status
       FROM fa JOIN known k ON k.simple_name = fa.annotation)"""


@query("declared_roles", f"""WITH {_SQL_ROLES}
SELECT event_id, test, type_fqcn, annotation, role, kind, status FROM dr""")
def q_declared_roles(spark, sf_dir):
    """Event fields by annotation: accepted only when the real annotation is imported."""
    return _annotations(spark, sf_dir).select("event_id", "test", "type_fqcn", "annotation",
                                              "role", "kind", "status")


@query("role_usage", f"""WITH {_SQL_ROLES}
SELECT DISTINCT type_fqcn, role, test FROM dr WHERE role IS NOT NULL""")
def q_role_usage(spark, sf_dir):
    """testDoubleUsage: distinct tests per (type, role)."""
    return RL.role_usage(_annotations(spark, sf_dir), type_col="type_fqcn", role="role", test="test")


@query("unclassified_context", f"""WITH {_SQL_ROLES},
types AS (SELECT DISTINCT test // 8 AS repo, type_fqcn FROM fa),
ctx AS (SELECT DISTINCT user_id // 8 AS repo, user_id AS test FROM events WHERE user_id % 2 = 0)
SELECT t.type_fqcn, c.test FROM types t JOIN ctx c USING (repo)
WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.role IS NOT NULL AND dr.type_fqcn = t.type_fqcn
                  AND dr.test = c.test)""")
def q_unclassified_context(spark, sf_dir):
    """Context tests (even user ids) that mention a requested type in no role; eight
    users make a repository, and a type is requested in those that mention it."""
    repo = lambda user: F.floor(F.col(user) / 8).alias("repo")
    roles = _annotations(spark, sf_dir).where(F.col("role").isNotNull()).select("*", repo("test"))
    ev = table(spark, sf_dir, "events").select("*", repo("user_id"))
    types = ev.select("repo", F.concat(F.lit("T"), (F.col("event_id") % 37).cast("string"))
                      .alias("type_fqcn"))
    ctx = ev.where(F.col("user_id") % 2 == 0).select("repo", F.col("user_id").alias("test"))
    out = RL.unclassified_context(types, ctx, roles, type_col="type_fqcn", test="test", keys=["repo"])
    return out.select("type_fqcn", "test")


@query("role_usage_request", f"""WITH {_SQL_ROLES},
req AS (SELECT DISTINCT user_id // 8 AS repo, 'T' || CAST(event_id % 40 AS VARCHAR) AS type_fqcn FROM events),
used AS (SELECT DISTINCT test // 8 AS repo, type_fqcn, role, test FROM dr WHERE role IS NOT NULL),
ctx AS (SELECT DISTINCT user_id // 8 AS repo, user_id AS test FROM events WHERE user_id % 2 = 0)
SELECT r.repo, r.type_fqcn, b.bucket, (SELECT count(*) FROM used u WHERE u.repo = r.repo AND u.type_fqcn = r.type_fqcn
         AND u.role = b.bucket) AS n_tests
FROM req r, (VALUES ('real'), ('mocked'), ('static')) b(bucket)
UNION ALL
SELECT r.repo, r.type_fqcn, 'unclassified', (SELECT count(*) FROM ctx c WHERE c.repo = r.repo AND NOT EXISTS (
         SELECT 1 FROM used u WHERE u.repo = c.repo AND u.type_fqcn = r.type_fqcn AND u.test = c.test)) FROM req r""")
def q_role_usage_request(spark, sf_dir):
    """testDoubleUsage for types of eight-user repositories, three of which no test ever names."""
    repo = lambda user: F.floor(F.col(user) / 8).alias("repo")
    ev = table(spark, sf_dir, "events").select("*", repo("user_id"))
    req = ev.select("repo", F.concat(F.lit("T"), (F.col("event_id") % 40).cast("string")).alias("type_fqcn"))
    roles = _annotations(spark, sf_dir).select("*", repo("test"))
    ctx = ev.where(F.col("user_id") % 2 == 0).select("repo", F.col("user_id").alias("test"))
    return RL.usage_answer(req, roles, ctx, type_col="type_fqcn", role="role", test="test", keys=["repo"])


_CONSTRUCT_SQL = """
v AS (SELECT event_id, user_id AS test,
        CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'mock' WHEN 'purchase' THEN 'spy'
             WHEN 'signup' THEN 'mockStatic' ELSE 'other' END AS value_kind,
        CASE user_id % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'before_each' ELSE 'method' END AS origin,
        'T' || CAST(event_id % 37 AS VARCHAR) AS value_type FROM events)"""


@query("constructed_roles", f"""WITH {_CONSTRUCT_SQL}
SELECT event_id, test, origin, value_kind,
  CASE WHEN origin IN ('field', 'before_each') THEN
    CASE WHEN value_kind = 'new' THEN 'real' WHEN value_kind IN ('mock', 'spy') THEN 'mocked' END END AS role,
  CASE WHEN origin IN ('field', 'before_each') THEN
    CASE value_kind WHEN 'mock' THEN 'MOCK_CALL' WHEN 'spy' THEN 'SPY_CALL' END END AS kind,
  CASE WHEN origin IN ('field', 'before_each') AND value_kind IN ('new', 'mock', 'spy') THEN value_type END AS type_fqcn
FROM v""")
def q_constructed_roles(spark, sf_dir):
    """Field initialisers and @BeforeEach assignments by construction kind; assignments in other
    methods are not recorded."""
    et = F.col("event_type")
    kind = (F.when(et == "view", "new").when(et == "click", "mock").when(et == "purchase", "spy")
            .when(et == "signup", "mockStatic").otherwise("other"))
    u = F.col("user_id") % 3
    origin = F.when(u == 0, "field").when(u == 1, "before_each").otherwise("method")
    v = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("test"), origin.alias("origin"), kind.alias("value_kind"),
        F.concat(F.lit("T"), (F.col("event_id") % 37).cast("string")).alias("value_type"))
    recorded = RL.constructed_roles(v.where(F.col("origin").isin("field", "before_each")),
                                    value_kind="value_kind", value_type="value_type")
    other = v.where(~F.col("origin").isin("field", "before_each")).select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("role", "kind", "type_fqcn")])
    return recorded.unionByName(other).select("event_id", "test", "origin", "value_kind", "role",
                                              "kind", "type_fqcn")


@query("static_roles", """
SELECT event_id, user_id AS test,
  CASE WHEN event_id % 5 <> 0 THEN 'static' END AS role,
  CASE WHEN event_id % 5 <> 0 THEN 'T' || CAST(event_id % 37 AS VARCHAR) END AS type_fqcn,
  CASE WHEN event_id % 5 <> 0 THEN
    CASE user_id % 3 WHEN 0 THEN 'm' || CAST(user_id AS VARCHAR) WHEN 1 THEN '@BeforeEach'
         ELSE 'f' || CAST(event_id AS VARCHAR) END END AS scope,
  CASE WHEN event_id % 5 <> 0 THEN 'resolved' ELSE 'unresolved' END AS status
FROM events WHERE event_type = 'signup'""")
def q_static_roles(spark, sf_dir):
    """mockStatic calls (signup events): scope is the method, @BeforeEach, or the field."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    u = F.col("user_id") % 3
    calls = ev.select(
        "event_id", F.col("user_id").alias("test"),
        F.when(F.col("event_id") % 5 != 0, "class_literal").otherwise("other").alias("arg_kind"),
        F.concat(F.lit("T"), (F.col("event_id") % 37).cast("string")).alias("arg_type"),
        F.when(u == 0, "method").when(u == 1, "before_each").otherwise("field").alias("scope_kind"),
        F.when(u == 0, F.concat(F.lit("m"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("scope_name"))
    out = RL.static_roles(calls, arg_kind="arg_kind", arg_type="arg_type", scope_kind="scope_kind",
                          scope_name="scope_name")
    return out.select("event_id", "test", "role", "type_fqcn", "scope", "status")


@query("import_matches", """
WITH refs AS (SELECT c_custkey, c_custkey % 50 AS path,
                'pkg' || CAST(c_nationkey % 5 AS VARCHAR) || '.N' || CAST(c_nationkey AS VARCHAR) AS fqcn,
                'pkg' || CAST(c_nationkey % 5 AS VARCHAR) AS pkg FROM customer),
imp AS (SELECT o_custkey % 50 AS path,
          CASE WHEN o_orderkey % 7 = 0 THEN 'pkg' || CAST(o_orderkey % 5 AS VARCHAR)
               ELSE 'pkg' || CAST(o_orderkey % 5 AS VARCHAR) || '.N' || CAST(o_orderkey % 25 AS VARCHAR) END AS name,
          o_orderkey % 7 = 0 AS is_wildcard, o_orderkey % 11 = 0 AS is_static FROM orders)
SELECT c_custkey, path, fqcn FROM refs r
WHERE EXISTS (SELECT 1 FROM imp i WHERE NOT i.is_static AND i.path = r.path AND
              ((NOT i.is_wildcard AND i.name = r.fqcn) OR (i.is_wildcard AND i.name = r.pkg)))""")
def q_import_matches(spark, sf_dir):
    """Customers whose 'file' imports their nation's class exactly or by package wildcard."""
    refs = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 50).alias("path"),
        F.concat(F.lit("pkg"), (F.col("c_nationkey") % 5).cast("string"), F.lit(".N"),
                 F.col("c_nationkey").cast("string")).alias("fqcn"))
    ok = F.col("o_orderkey")
    pkg = F.concat(F.lit("pkg"), (ok % 5).cast("string"))
    imps = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("path"),
        F.when(ok % 7 == 0, pkg).otherwise(F.concat(pkg, F.lit(".N"), (ok % 25).cast("string"))).alias("name"),
        (ok % 7 == 0).alias("is_wildcard"), (ok % 11 == 0).alias("is_static"))
    return RL.import_matches(refs, imps, path="path", fqcn="fqcn")
