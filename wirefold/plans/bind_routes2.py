"""Verb and path extraction, expansion, inheritance, unresolved mappings, suggestions and the
answer payload, bound to the driver tables.

Pages are mapping annotations whose verb and path attributes are shaped by ``page_id``;
customers are controllers implementing their nation; the suggestion catalogue is the seven
routes plus every href of every page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.functions import paths as P
from wirefold.operators import routes as R
from wirefold.plans.bind_routes import (_SQL_URL_PATH, _sql_norm, _sql_resolve, page_requests,
                                        resolve_pages, seven_routes, SEVEN_ROUTES)
from wirefold.plans.registry import query, table
from wirefold.sources.text import link_facts

SHORT = list(R.SHORTHAND_MAPPINGS)
VERB8 = R.REQUEST_METHOD_NAMES
_SQL_SHORT = "[" + ", ".join(f"'{s}'" for s in SHORT) + "]"
_SQL_VERB8 = "[" + ", ".join(f"'{v}'" for v in VERB8) + "]"


# --- route_methods / mapping_reasons ---------------------------------------------------------

def _method_inputs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    k = F.col("page_id") % 5
    sel = (F.col("page_id") / 5).cast("long")
    short = F.array(*[F.lit(s) for s in SHORT])
    verb8 = F.array(*[F.lit(v) for v in VERB8])
    mappings = pages.select(
        "page_id",
        F.when(k == 0, F.element_at(short, (sel % 5 + 1).cast("int"))).otherwise(F.lit("RequestMapping"))
        .alias("simple_name"),
        F.when(k == 0, "single").when(k == 1, "marker").otherwise("normal").alias("shape"))
    v = F.element_at(verb8, (sel % 8 + 1).cast("int"))
    first = pages.where(k >= 2).select(
        "page_id", F.lit(0).alias("ord"),
        F.when(k == 2, "field_access").when(k == 3, "name").otherwise("other").alias("expr_kind"),
        F.when(k == 2, F.concat(F.lit("RequestMethod."), v)).when(k == 3, v)
        .otherwise(F.lit("methods()")).alias("expr_text"),
        ((k == 3) & (F.col("page_id") % 3 == 0)).alias("shadowed"))
    second = pages.where((k == 2) & (F.col("page_id") % 3 == 0)).select(
        "page_id", F.lit(1).alias("ord"), F.lit("field_access").alias("expr_kind"),
        F.lit("RequestMethod.GET").alias("expr_text"), F.lit(False).alias("shadowed"))
    return mappings, first.unionByName(second)


def _methods(spark, sf_dir):
    mappings, values = _method_inputs(spark, sf_dir)
    return R.route_methods(mappings, values, mapping_id="page_id", simple_name="simple_name",
                           shape="shape")


_SQL_METHODS = f"""
m AS (SELECT page_id, page_id % 5 AS k, {_SQL_SHORT}[(page_id // 5) % 5 + 1] AS short,
             {_SQL_VERB8}[(page_id // 5) % 8 + 1] AS v FROM pages),
rm AS (SELECT page_id,
  CASE k WHEN 0 THEN CASE short WHEN 'GetMapping' THEN 'GET' WHEN 'PostMapping' THEN 'POST'
                       WHEN 'PutMapping' THEN 'PUT' WHEN 'DeleteMapping' THEN 'DELETE' ELSE 'PATCH' END
         WHEN 1 THEN 'ANY'
         WHEN 2 THEN CASE WHEN page_id % 3 = 0 THEN v || ',GET' ELSE v END
         WHEN 3 THEN CASE WHEN page_id % 3 = 0 THEN NULL ELSE v END
         ELSE NULL END AS verbs,
  CASE WHEN k = 4 OR (k = 3 AND page_id % 3 = 0) THEN 'unresolved' ELSE 'resolved' END AS status,
  CASE WHEN k = 4 THEN 'non-literal-expression' WHEN k = 3 AND page_id % 3 = 0 THEN 'constant-reference' END AS reason
  FROM m)"""


@query("route_methods", f"WITH {_SQL_METHODS} SELECT * FROM rm")
def q_route_methods(spark, sf_dir):
    """HTTP verbs of each page's mapping: shorthand, ANY, RequestMethod.X, bare name (rejected
    when shadowed by a constant) or a non-literal expression."""
    out = _methods(spark, sf_dir)
    return out.select("page_id", F.array_join("verbs", ",").alias("verbs"), "status", "reason")


@query("mapping_reasons", f"""WITH {_SQL_METHODS}
SELECT reason, count(*) AS n FROM rm WHERE status = 'unresolved' GROUP BY reason""")
def q_mapping_reasons(spark, sf_dir):
    """Unresolved mappings counted by reason."""
    return (_methods(spark, sf_dir).where(F.col("status") == "unresolved")
            .groupBy("reason").agg(F.count("*").alias("n")))


# --- route_paths / route_unresolved --------------------------------------------------------------

def _path_inputs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", P.url_path("url").alias("up"))
    k = F.col("page_id") % 5
    lit = F.when(F.col("page_id") % 7 == 0, F.concat("up", F.lit("/**"))).otherwise(F.col("up"))
    first = pages.where(k <= 3).select(
        "page_id", F.lit(0).alias("ord"),
        F.when(k.isin(0, 2), "literal").when(k == 1, "name").otherwise("field_access").alias("expr_kind"),
        F.when(k.isin(0, 2), lit).when((k == 1) & (F.col("page_id") % 2 == 0), F.col("up"))
        .alias("value"))
    second = pages.where(k == 2).select("page_id", F.lit(1).alias("ord"),
                                        F.lit("other").alias("expr_kind"),
                                        F.lit(None).cast("string").alias("value"))
    return pages.select("page_id"), first.unionByName(second)


def _paths(spark, sf_dir):
    mappings, values = _path_inputs(spark, sf_dir)
    return R.route_paths(mappings, values, mapping_id="page_id")


_SQL_PATHS = f"""
pp AS (SELECT page_id, page_id % 5 AS k, {_SQL_URL_PATH} AS up FROM pages),
pl AS (SELECT page_id, k, CASE WHEN page_id % 7 = 0 THEN up || '/**' ELSE up END AS lit, up FROM pp),
rp AS (SELECT page_id,
  CASE WHEN k IN (0, 2) THEN [lit]
       WHEN k = 1 AND page_id % 2 = 0 THEN [up]
       WHEN k = 4 THEN ['']
       ELSE []::VARCHAR[] END AS paths,
  CASE WHEN k = 1 AND page_id % 2 <> 0 THEN 'constant-reference'
       WHEN k = 2 THEN 'non-literal-expression'
       WHEN k = 3 THEN 'constant-reference' END AS bad_reason FROM pl)"""


@query("route_paths", f"""WITH {_SQL_PATHS}
SELECT page_id, array_to_string(paths, '|') AS paths, bad_reason FROM rp""")
def q_route_paths(spark, sf_dir):
    """Path attribute of each page's mapping: literals and resolved constants kept in order,
    the first unextractable component reported; absent attribute -> ['']."""
    return _paths(spark, sf_dir).select("page_id", F.array_join("paths", "|").alias("paths"),
                                        "bad_reason")


def _unresolved(spark, sf_dir):
    meth = _methods(spark, sf_dir).select("page_id", "verbs", F.col("reason").alias("m_reason"))
    paths = _paths(spark, sf_dir)
    j = meth.join(paths, "page_id")
    m_bad = j.where(F.col("m_reason").isNotNull()).select("page_id", F.col("m_reason").alias("reason"))
    p_bad = j.where(F.col("m_reason").isNull() & F.col("bad_reason").isNotNull()).select(
        "page_id", F.col("bad_reason").alias("reason"))
    ok = j.where(F.col("m_reason").isNull()).withColumn("base", F.array(F.lit("")))
    ex = R.route_expand(ok.select("page_id", "base", "paths", "verbs"), base_paths="base",
                        paths="paths", verbs="verbs")
    e_bad = ex.where(F.col("status") == "unresolved").select("page_id", "reason")
    return m_bad.unionByName(p_bad).unionByName(e_bad)


@query("route_unresolved", f"""WITH {_SQL_METHODS}, {_SQL_PATHS},
j AS (SELECT rm.page_id, rm.reason AS m_reason, rp.paths, rp.bad_reason FROM rm JOIN rp USING (page_id))
SELECT page_id, m_reason AS reason FROM j WHERE m_reason IS NOT NULL
UNION ALL SELECT page_id, bad_reason FROM j WHERE m_reason IS NULL AND bad_reason IS NOT NULL
UNION ALL SELECT page_id, 'unsupported-pattern' FROM (SELECT page_id, unnest(paths) AS p FROM j
          WHERE m_reason IS NULL) WHERE contains(CASE WHEN p = '' THEN '/' ELSE p END, '*')""")
def q_route_unresolved(spark, sf_dir):
    """Every mapping that cannot be indexed, with its reason: bad verb, bad path component, or a
    pattern containing '*'."""
    return _unresolved(spark, sf_dir)


# --- route_expand ----------------------------------------------------------------------------------

@query("route_expand", """
WITH c AS (SELECT c_custkey, c_mktsegment, lower(n_name) AS nn, c_nationkey
           FROM customer JOIN nation ON n_nationkey = c_nationkey),
x AS (SELECT c_custkey,
        CASE WHEN c_nationkey % 2 = 0 THEN ['/' || nn, '/all'] ELSE ['/' || nn] END AS bases,
        CASE WHEN c_custkey % 4 = 0 THEN ['/c' || CAST(c_custkey AS VARCHAR), '/c' || CAST(c_custkey AS VARCHAR) || '/*']
             ELSE ['/c' || CAST(c_custkey AS VARCHAR)] END AS ps,
        CASE WHEN c_mktsegment = 'BUILDING' THEN ['GET', 'POST'] ELSE ['GET'] END AS vs FROM c),
b AS (SELECT c_custkey, unnest(bases) AS base, ps, vs FROM x),
b2 AS (SELECT c_custkey, base, unnest(ps) AS mp, vs FROM b),
p AS (SELECT c_custkey, base || mp AS path_pattern, vs FROM b2)
SELECT c_custkey, unnest(vs) AS http_method, path_pattern, 'resolved' AS status, NULL AS reason
FROM p WHERE NOT contains(path_pattern, '*')
UNION ALL SELECT c_custkey, NULL, path_pattern, 'unresolved', 'unsupported-pattern'
FROM p WHERE contains(path_pattern, '*')""")
def q_route_expand(spark, sf_dir):
    """Customers as handler methods: nation prefix(es) x customer path(s) x verbs."""
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    nn = F.concat(F.lit("/"), F.lower("n_name"))
    cp = F.concat(F.lit("/c"), F.col("c_custkey").cast("string"))
    m = c.select(
        "c_custkey",
        F.when(F.col("c_nationkey") % 2 == 0, F.array(nn, F.lit("/all"))).otherwise(F.array(nn)).alias("bases"),
        F.when(F.col("c_custkey") % 4 == 0, F.array(cp, F.concat(cp, F.lit("/*")))).otherwise(F.array(cp))
        .alias("ps"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("GET"), F.lit("POST")))
        .otherwise(F.array(F.lit("GET"))).alias("vs"))
    out = R.route_expand(m, base_paths="bases", paths="ps", verbs="vs")
    return out.select("c_custkey", "http_method", "path_pattern", "status", "reason")


# --- route_inherit ---------------------------------------------------------------------------------

@query("route_inherit", """
WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0),
i AS (SELECT n_nationkey, lower(n_name) AS nn, '/' || lower(r_name) AS rp FROM nation
      JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 <> 0),
mm AS (SELECT n_nationkey, 'list' AS method_name, ['GET'] AS vs, '/' || nn AS p, rp FROM i
       UNION ALL SELECT n_nationkey, 'byId', ['GET', 'DELETE'], '/' || nn || '/{id}', rp FROM i),
e AS (SELECT c.c_custkey, CAST(mm.n_nationkey AS VARCHAR) AS iface, mm.method_name,
        CASE WHEN c.c_custkey % 2 = 0 THEN '/c' || CAST(c.c_custkey % 10 AS VARCHAR) ELSE mm.rp END || mm.p AS path_pattern,
        mm.vs, CASE WHEN mm.method_name = 'list' AND c.c_acctbal > 0 THEN 'implementation' ELSE 'interface' END AS handler
      FROM c JOIN mm ON mm.n_nationkey = c.c_nationkey)
SELECT c_custkey, iface, method_name, unnest(vs) AS http_method, path_pattern, 'resolved' AS status,
       NULL AS reason, handler FROM e
UNION ALL
SELECT c_custkey, NULL, NULL, NULL, NULL, 'unresolved', 'interface-mappings-not-found', NULL
FROM c WHERE c_nationkey % 5 = 0""")
def q_route_inherit(spark, sf_dir):
    """Customers without own mappings inherit their nation's mappings; their own prefix (even
    ids) beats the interface's region prefix; every fifth nation is not scanned."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    cust = table(spark, sf_dir, "customer")
    ctrls = cust.select(
        "c_custkey", (F.col("c_custkey") % 3 == 0).alias("has_own"),
        (F.col("c_custkey") % 2 == 0).alias("has_class"),
        F.array(F.concat(F.lit("/c"), (F.col("c_custkey") % 10).cast("string"))).alias("class_paths"))
    impl = cust.select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0,
                                           F.col("c_nationkey").cast("string")).alias("iface"))
    ni = (nation.where(F.col("n_nationkey") % 5 != 0)
          .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
          .select(F.col("n_nationkey").cast("string").alias("iface"), F.lower("n_name").alias("nn"),
                  F.array(F.concat(F.lit("/"), F.lower("r_name"))).alias("iface_paths")))
    im = (ni.select("iface", "iface_paths", F.lit("list").alias("method_name"),
                    F.array(F.lit("GET")).alias("verbs"),
                    F.array(F.concat(F.lit("/"), F.col("nn"))).alias("paths"))
          .unionByName(ni.select("iface", "iface_paths", F.lit("byId").alias("method_name"),
                                 F.array(F.lit("GET"), F.lit("DELETE")).alias("verbs"),
                                 F.array(F.concat(F.lit("/"), F.col("nn"), F.lit("/{id}"))).alias("paths"))))
    methods = cust.where(F.col("c_acctbal") > 0).select("c_custkey", F.lit("list").alias("method_name"))
    out = R.route_inherit(ctrls, impl, im, methods, ctrl="c_custkey", has_own_mappings="has_own",
                          has_class_mapping="has_class", class_paths="class_paths", iface="iface",
                          iface_paths="iface_paths", method_name="method_name", verbs="verbs",
                          paths="paths")
    return out.select("c_custkey", "iface", "method_name", "http_method", "path_pattern", "status",
                      "reason", "handler")


# --- route_suggest / route_answer ---------------------------------------------------------------

def _catalogue(spark, sf_dir):
    seven = seven_routes(spark, "GET")
    links = link_facts(table(spark, sf_dir, "pages"), doc_id="page_id", text="html", out="href")
    lr = links.select((F.lit(1_000_000) + F.col("page_id") * 100_000 + F.col("pos")).alias("route_id"),
                      F.lit("GET").alias("http_method"), F.col("href").alias("path_pattern"))
    lr = lr.withColumn("scan_ord", F.col("route_id"))
    return seven.unionByName(lr)


def _suggest(spark, sf_dir):
    res = resolve_pages(spark, sf_dir, "GET")
    misses = res.where(F.col("status") == "miss").select("request_id", "verb", F.col("req_path").alias("path"))
    return R.route_suggest(misses, _catalogue(spark, sf_dir))


def _sql_dist(p: str, q: str) -> str:
    """Segment edit distance in DuckDB: two nested list_reduce folds over the DP rows."""
    isv = "(starts_with(ps.s, '{') AND ends_with(ps.s, '}'))"
    inner = (f"list_reduce(list_transform({q}, lambda s, j: {{'s': s, 'j': j}}), "
             f"lambda row, qs: list_append(row, least(row[-1] + 1, prev[qs.j + 1] + 1, "
             f"prev[qs.j] + CASE WHEN {isv} OR ps.s = qs.s THEN 0 ELSE 1 END)), [ps.i])")
    return (f"list_reduce(list_transform({p}, lambda s, i: {{'s': s, 'i': i}}), "
            f"lambda prev, ps: {inner}, range(0, len({q}) + 1))[-1]")


def _segs(x: str) -> str:
    return f"list_filter(string_split({x}, '/'), lambda s: s <> '')"


_SQL_SUGGEST = f"""
res AS ({_sql_resolve('GET')}),
miss AS (SELECT request_id, verb, {_segs('req_path')} AS q FROM res WHERE status = 'miss'),
cat AS (SELECT route_id, http_method, path_pattern, route_id AS scan_ord FROM
          (VALUES {", ".join(f"({i}::BIGINT, '{v or 'GET'}', '{p}')" for i, v, p in SEVEN_ROUTES)})
          AS t(route_id, http_method, path_pattern)
        UNION ALL
        SELECT 1000000 + page_id * 100000 + pos, 'GET', href, 1000000 + page_id * 100000 + pos FROM
          (SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS BIGINT) AS pos, unnest(h) AS href
           FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))),
cat2 AS (SELECT *, {_segs(_sql_norm('path_pattern'))} AS p FROM cat),
sc AS (SELECT m.request_id, c.route_id, c.http_method, c.path_pattern, c.scan_ord,
         CAST(CASE WHEN c.http_method = 'ANY' OR c.http_method = m.verb THEN 0 ELSE 1000 END
              + {_sql_dist('c.p', 'm.q')} AS BIGINT) AS score
       FROM miss m, cat2 c),
top AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score, scan_ord) AS rank
        FROM sc QUALIFY rank <= 5)"""


@query("route_suggest", f"""WITH {_SQL_SUGGEST}
SELECT request_id, rank, route_id, http_method, path_pattern, score FROM top""")
def q_route_suggest(spark, sf_dir):
    """Five closest routes (seven routes + every page href) for each page request that missed."""
    return _suggest(spark, sf_dir).select("request_id", "rank", "route_id", "http_method",
                                          "path_pattern", F.col("score").cast("long").alias("score"))


@query("route_answer", f"""WITH {_SQL_SUGGEST}, {_SQL_METHODS}, {_SQL_PATHS},
j AS (SELECT rm.page_id, rm.reason AS m_reason, rp.paths, rp.bad_reason FROM rm JOIN rp USING (page_id)),
un AS (SELECT page_id FROM j WHERE m_reason IS NOT NULL
       UNION ALL SELECT page_id FROM j WHERE m_reason IS NULL AND bad_reason IS NOT NULL
       UNION ALL SELECT page_id FROM (SELECT page_id, unnest(paths) AS p FROM j WHERE m_reason IS NULL)
                 WHERE contains(CASE WHEN p = '' THEN '/' ELSE p END, '*')),
nu AS (SELECT count(*) AS n FROM un),
sg AS (SELECT request_id, string_agg(path_pattern, ' | ' ORDER BY rank) AS suggestions FROM top GROUP BY 1)
SELECT res.request_id, res.status, res.route_id, res.path_pattern,
       CASE WHEN res.status = 'miss' THEN sg.suggestions END AS suggestions,
       (SELECT n FROM nu) AS n_unresolved,
       CASE WHEN res.status = 'miss' AND (SELECT n FROM nu) > 0
            THEN 'some mappings could not be resolved statically; the handler may be among them' END AS warning
FROM res LEFT JOIN sg USING (request_id)""")
def q_route_answer(spark, sf_dir):
    """resolveEndpoint for every page request: handler on a hit; suggestions, the unresolved
    count and a warning on a miss."""
    res = resolve_pages(spark, sf_dir, "GET").select("request_id", "status", "route_id", "path_pattern")
    sug = _suggest(spark, sf_dir)
    unres = _unresolved(spark, sf_dir)
    return R.route_answer(res, sug, unres)
