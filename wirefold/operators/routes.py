"""Route resolution: which handler serves each request.

Requests are rows, so a million lookups are one job. A request is matched only against the
routes of its own ``keys`` (normally ``repo, snapshot``) through an equi-join on
``(keys, n_segments, anchor)``: a pattern is filed under its first literal segment, and each
request probes each of its own segments once. Nothing is compared pairwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wirefold.functions import paths as P
from wirefold.plans.sizing import top_k
from wirefold.session import cut_lineage

ROUTE_COLS = ("route_id", "http_method", "path_pattern", "n_vars")


def prepare_requests(requests: DataFrame, *, verb: str = "verb", path: str = "path") -> DataFrame:
    """Adds ``req_verb`` (upper case), ``req_path`` (normalised) and ``req_segs``."""
    return (requests
            .withColumn("req_verb", F.upper(F.col(verb)))
            .withColumn("req_path", P.normalize_path(path))
            .withColumn("req_segs", P.segments("req_path")))


def prepare_routes(routes: DataFrame, *, keys: Sequence[str] = (), route_id: str = "route_id",
                   route_verb: str = "http_method", pattern: str = "path_pattern",
                   tie: str = "scan_ord") -> DataFrame:
    """Route table in join form: one row per pattern with its length, anchor and variable count."""
    segs = P.segments(P.normalize_path(pattern))
    return routes.select(
        *keys,
        F.col(route_id).alias("route_id"),
        F.col(route_verb).alias("http_method"),
        F.col(pattern).alias("path_pattern"),
        F.col(tie).alias("route_tie"),
        segs.alias("route_segs"),
    ).select("*",
             F.size("route_segs").alias("route_n"),
             P.anchor("route_segs").alias("route_anchor"),
             P.var_count("route_segs").alias("n_vars"))


def _matches(req: DataFrame, rt: DataFrame, keys: Sequence[str], req_id: str) -> DataFrame:
    probe = req.select(*keys, req_id, "req_verb", "req_segs",
                       F.size("req_segs").alias("route_n"),
                       F.explode(P.probes("req_segs")).alias("route_anchor"))
    joined = probe.join(rt, [*keys, "route_n", "route_anchor"], "inner")
    return joined.filter(P.verb_matches("http_method", "req_verb")
                         & P.pattern_matches("route_segs", "req_segs"))


def route_match(requests: DataFrame, routes: DataFrame, *, keys: Sequence[str] = (),
                req_id: str = "request_id", verb: str = "verb", path: str = "path",
                route_id: str = "route_id", route_verb: str = "http_method",
                pattern: str = "path_pattern", tie: str = "scan_ord") -> DataFrame:
    """All (request, route) pairs where the verb is equal or ANY, the segment counts are equal and
    every pattern segment is a variable or equal to the request segment."""
    req = prepare_requests(requests, verb=verb, path=path)
    rt = prepare_routes(routes, keys=keys, route_id=route_id, route_verb=route_verb,
                        pattern=pattern, tie=tie)
    m = _matches(req, rt, keys, req_id)
    return m.select(*keys, req_id, "route_id", "http_method", "path_pattern", "n_vars", "route_tie")


def route_resolve(requests: DataFrame, routes: DataFrame, *, keys: Sequence[str] = (),
                  req_id: str = "request_id", verb: str = "verb", path: str = "path",
                  route_id: str = "route_id", route_verb: str = "http_method",
                  pattern: str = "path_pattern", tie: str = "scan_ord") -> DataFrame:
    """One row per request: the matching route with the fewest variable segments, ties to the
    lowest ``tie`` (scan order). ``status`` is ``resolved`` or ``miss``; misses keep null route
    columns so that rows in = resolved + miss.

    Plan: requests explode into probes, probe the route table (AQE picks the join by its real
    size), and fold back per request with one minimum over (variables, tie, route); the probes of
    one request sit in one partition, so the partial aggregate collapses them before the shuffle.
    No window over the catalogue, so its size and the absence of ``keys`` do not matter.
    """
    keys = list(keys)
    req = prepare_requests(requests, verb=verb, path=path)
    rt = prepare_routes(routes, keys=keys, route_id=route_id, route_verb=route_verb,
                        pattern=pattern, tie=tie)
    carried = [c for c in req.columns if c not in (*keys, req_id, "req_segs")]
    probe = req.select(*keys, req_id, *carried, "req_segs",
                       F.size("req_segs").alias("route_n"),
                       F.explode(P.probes("req_segs")).alias("route_anchor"))
    joined = probe.join(rt, [*keys, "route_n", "route_anchor"], "left")
    ok = P.verb_matches("http_method", "req_verb") & P.pattern_matches("route_segs", "req_segs")
    best = F.min(F.when(ok, F.struct("n_vars", "route_tie", "route_id", "http_method", "path_pattern")))
    out = joined.groupBy(*keys, req_id, *carried).agg(best.alias("_w"))
    out = out.select(*keys, req_id, *carried, *[F.col("_w")[c].alias(c) for c in ROUTE_COLS])
    return out.withColumn("status", F.when(F.col("route_id").isNull(), F.lit("miss"))
                          .otherwise(F.lit("resolved")))


UNKNOWN_SCOPE = "unknown_scope"


def with_unknown_scopes(answers: DataFrame, scopes: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Requests about a scope that was never indexed get the status ``unknown_scope``, which is not
    a miss: ``scopes`` lists the indexed ones."""
    known = scopes.select(*keys).distinct().withColumn("_known", F.lit(True))
    out = answers.join(known, list(keys), "left")
    return out.withColumn("status", F.when(F.col("_known"), F.col("status")).otherwise(F.lit(UNKNOWN_SCOPE))).drop("_known")


# --- verbs, paths, expansion, inheritance, unresolved ------------------------------------------

# Fixed values of the endpoint rules.
SHORTHAND_MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT",
                      "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
MAPPING_ANNOTATIONS = ["RequestMapping", *SHORTHAND_MAPPINGS]
REQUEST_METHOD_NAMES = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE"]
CONTROLLER_ANNOTATIONS = ["Controller", "RestController"]
REASON_CONSTANT = "constant-reference"
REASON_NON_LITERAL = "non-literal-expression"
REASON_UNSUPPORTED = "unsupported-pattern"
REASON_IFACE_MISSING = "interface-mappings-not-found"


def _reason_for(kind: Column) -> Column:
    return F.when(kind.isin("name", "field_access"), F.lit(REASON_CONSTANT)).otherwise(
        F.lit(REASON_NON_LITERAL))


def route_methods(mappings: DataFrame, method_values: DataFrame, *, mapping_id: str,
                  simple_name: str, shape: str, keys: Sequence[str] = ()) -> DataFrame:
    """HTTP verbs of each mapping annotation.

    Shorthands give their fixed verb; a non-normal ``@RequestMapping`` or one without a
    ``method`` attribute gives ``ANY``. ``method_values`` holds the components of the
    ``method`` attribute (``ord``, ``expr_kind``, ``expr_text``, ``shadowed``): ``X.NAME`` counts
    as ``NAME``; a bare name counts only if it is one of the eight verbs and no string constant
    of that name is in scope (``shadowed``). Any other component drops the whole mapping with a
    reason. Adds ``verbs`` (array in attribute order), ``status``, ``reason``.
    """
    keys = list(keys)
    kind, text = F.col("expr_kind"), F.col("expr_text")
    verb = (F.when(kind == "field_access", F.substring_index(text, ".", -1))
            .when((kind == "name") & text.isin(REQUEST_METHOD_NAMES) & ~F.coalesce(F.col("shadowed"), F.lit(False)),
                  text))
    per = (method_values.select(*keys, F.col(mapping_id).alias("_m"), "ord", kind.alias("_k"),
                                verb.alias("_v"))
           .groupBy(*keys, "_m").agg(
               F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(),
                                                  F.struct("ord", "_v")))).alias("_vs"),
               F.min_by("_k", F.when(F.col("_v").isNull(), F.col("ord"))).alias("_bad"),
               F.count("*").alias("_n")))
    j = mappings.join(per, [mappings[k] == per[k] for k in keys] + [mappings[mapping_id] == per["_m"]],
                      "left")
    short = F.create_map(*[x for kv in SHORTHAND_MAPPINGS.items() for x in map(F.lit, kv)])
    sn = F.col(simple_name)
    vs = F.transform("_vs", lambda x: x["_v"])
    verbs = (F.when(short[sn].isNotNull(), F.array(short[sn]))
             .when(F.col(shape) != "normal", F.array(F.lit(P.ANY_METHOD)))
             .when(F.col("_n").isNull(), F.array(F.lit(P.ANY_METHOD)))
             .when(F.col("_bad").isNotNull(), F.lit(None).cast("array<string>"))
             .when(F.size(vs) == 0, F.array(F.lit(P.ANY_METHOD)))
             .otherwise(vs))
    bad = short[sn].isNull() & (F.col(shape) == "normal") & F.col("_bad").isNotNull()
    return j.select(*[mappings[c] for c in mappings.columns], verbs.alias("verbs"),
                    F.when(bad, F.lit("unresolved")).otherwise(F.lit("resolved")).alias("status"),
                    F.when(bad, _reason_for(F.col("_bad"))).alias("reason"))


def route_paths(mappings: DataFrame, path_values: DataFrame, *, mapping_id: str,
                keys: Sequence[str] = ()) -> DataFrame:
    """The ``value``/``path`` attribute of each mapping: every extractable component in order
    (``value`` = the literal, or the constant it resolves to), and the reason for the first
    component that is not. An absent or empty attribute gives ``[""]``. Adds ``paths``,
    ``bad_reason`` (null if none)."""
    keys = list(keys)
    per = (path_values.select(*keys, F.col(mapping_id).alias("_m"), "ord", "expr_kind", "value")
           .groupBy(*keys, "_m").agg(
               F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(),
                                                  F.struct("ord", "value")))).alias("_ps"),
               F.min_by("expr_kind", F.when(F.col("value").isNull(), F.col("ord"))).alias("_bad")))
    j = mappings.join(per, [mappings[k] == per[k] for k in keys] + [mappings[mapping_id] == per["_m"]],
                      "left")
    ps = F.transform("_ps", lambda x: x["value"])
    paths = F.when(F.col("_ps").isNull() | ((F.size("_ps") == 0) & F.col("_bad").isNull()),
                   F.array(F.lit(""))).otherwise(ps)
    return j.select(*[mappings[c] for c in mappings.columns], paths.alias("paths"),
                    F.when(F.col("_bad").isNotNull(), _reason_for(F.col("_bad"))).alias("bad_reason"))


def route_expand(mappings: DataFrame, *, base_paths: str, paths: str, verbs: str) -> DataFrame:
    """Class paths x method paths x verbs, combined. A combined pattern containing '*' is
    unresolved (``unsupported-pattern``) once per (base, path); the rest are endpoints with
    their expansion order ``(base_ord, path_ord, verb_ord)`` kept for ties."""
    e = (mappings.select("*", F.posexplode(F.col(base_paths)).alias("base_ord", "_base"))
         .select("*", F.posexplode(F.col(paths)).alias("path_ord", "_path"))
         .withColumn("path_pattern", P.combine_paths("_base", "_path")))
    bad = e.where(F.col("path_pattern").contains("*"))
    good = (e.where(~F.col("path_pattern").contains("*"))
            .select("*", F.posexplode(F.col(verbs)).alias("verb_ord", "http_method")))
    keep = [c for c in mappings.columns]
    endpoints = good.select(*keep, "http_method", "path_pattern",
                            F.struct("base_ord", "path_ord", "verb_ord").alias("expand_ord"),
                            F.lit("resolved").alias("status"), F.lit(None).cast("string").alias("reason"))
    rejects = bad.select(*keep, F.lit(None).cast("string").alias("http_method"), "path_pattern",
                         F.struct("base_ord", "path_ord", F.lit(None).cast("int").alias("verb_ord"))
                         .alias("expand_ord"),
                         F.lit("unresolved").alias("status"), F.lit(REASON_UNSUPPORTED).alias("reason"))
    return endpoints.unionByName(rejects)


def route_inherit(controllers: DataFrame, implements: DataFrame, iface_mappings: DataFrame,
                  impl_methods: DataFrame, *, ctrl: str, has_own_mappings: str,
                  has_class_mapping: str, class_paths: str, iface: str, iface_paths: str,
                  method_name: str, verbs: str, paths: str) -> DataFrame:
    """Mappings a controller inherits from the interfaces it implements.

    Only a controller without any own method mapping inherits (one own mapping switches it off).
    Its own class prefix beats the interface's (never concatenated). The handler is the
    implementing method of that name if there is one, else the interface method. If nothing
    was indexed and an implemented type is missing (``iface`` null: not scanned or not an
    interface), one ``interface-mappings-not-found`` row is emitted.
    """
    c = controllers.where(~F.col(has_own_mappings))
    imp = c.join(implements, ctrl, "inner")
    found = imp.where(F.col(iface).isNotNull())
    m = found.join(iface_mappings, iface, "inner")
    base = F.when(F.col(has_class_mapping), F.col(class_paths)).otherwise(F.col(iface_paths))
    m = m.withColumn("_bases", base)
    ex = route_expand(m.select(ctrl, iface, method_name, "_bases", paths, verbs),
                      base_paths="_bases", paths=paths, verbs=verbs)
    im = impl_methods.select(F.col(ctrl).alias("__ic"), F.col(method_name).alias("__im")).distinct()
    ex = ex.join(im, (ex[ctrl] == im["__ic"]) & (ex[method_name] == im["__im"]), "left")
    ex = ex.withColumn("handler", F.when(F.col("__ic").isNotNull(), F.lit("implementation"))
                       .otherwise(F.lit("interface"))).drop("__ic", "__im", "_bases", paths, verbs)
    indexed = ex.where(F.col("status") == "resolved").select(ctrl).distinct()
    missing = (imp.where(F.col(iface).isNull()).select(ctrl).distinct()
               .join(indexed, ctrl, "left_anti"))
    miss_rows = missing.select(ctrl, F.lit(None).cast("string").alias(iface),
                               F.lit(None).cast("string").alias(method_name),
                               F.lit(None).cast("string").alias("http_method"),
                               F.lit(None).cast("string").alias("path_pattern"),
                               F.lit("unresolved").alias("status"),
                               F.lit(REASON_IFACE_MISSING).alias("reason"),
                               F.lit(None).cast("string").alias("handler"),
                               F.lit(None).cast(ex.schema["expand_ord"].dataType).alias("expand_ord"))
    return ex.select(ctrl, F.col(iface).cast("string").alias(iface),
                     F.col(method_name).cast("string").alias(method_name), "http_method",
                     "path_pattern", "status", "reason", "handler", "expand_ord").unionByName(miss_rows)


# --- suggestions for misses --------------------------------------------------------------------

# Stand for a segment that few routes carry, in patterns and in requests; never equal.
_RARE_ROUTE, _RARE_REQUEST = "\x00route", "\x00request"


def _common_only(df: DataFrame, segs: str, common: DataFrame, ids: Sequence[str], keys: Sequence[str],
                 rare: str, keep) -> DataFrame:
    """``df`` with ``view``: its segments with every literal that is not common replaced."""
    own = (df.select(*keys, *ids, F.explode(F.array_distinct(segs)).alias("_seg"))
           .join(common, [*keys, "_seg"]).groupBy(*keys, *ids).agg(F.collect_set("_seg").alias("_common")))
    out = df.join(own, [*keys, *ids], "left")
    known = F.coalesce("_common", F.array().cast("array<string>"))
    return out.withColumn("view", F.transform(segs, lambda x: F.when(keep(x) | F.array_contains(known, x), x)
                                              .otherwise(F.lit(rare)))).drop("_common")


def route_suggest(misses: DataFrame, routes: DataFrame, *, keys: Sequence[str] = (),
                  req_id: str = "request_id", verb: str = "verb", path: str = "path",
                  route_id: str = "route_id", route_verb: str = "http_method",
                  pattern: str = "path_pattern", tie: str = "scan_ord",
                  limit: int = P.SUGGESTION_LIMIT, common_df: int = 64) -> DataFrame:
    """Closest routes for each miss: score = segment edit distance (a variable segment matches
    anything) + 1000 if the verb does not match; stable by scan order; ``limit`` per miss.

    Exact for every verb and limit, without a miss x catalogue product:

    1. Each distinct (scope, verb, path) is answered once. Of routes with equal verb and segments
       only the first ``limit`` can be suggested.
    2. A literal on more than ``common_df`` patterns of the scope is common. Routes that share a
       rarer literal with the request are met by an equi-join on it: at most ``common_df`` each.
    3. Every other route can share common literals only. With rare literals blotted out, routes
       fall into few shapes, and requests into few views; the score of a route with its shape is
       never below its own, and equal to it when nothing rare is shared. So only the first
       ``limit`` routes of a shape matter, and of those only the best ``limit`` for the view:
       any other route has ``limit`` routes before it. Shapes meet views on scope and length.
    4. What 2 and 3 give is scored exactly and cut to ``limit``.
    """
    keys = list(keys)
    all_misses = prepare_requests(misses, verb=verb, path=path).select(*keys, req_id, "req_verb", "req_segs")
    req = cut_lineage(all_misses.select(*keys, "req_verb", "req_segs").distinct()
                      .withColumn("_q", F.monotonically_increasing_id()))
    rt = prepare_routes(routes, keys=keys, route_id=route_id, route_verb=route_verb,
                        pattern=pattern, tie=tie)
    rt = cut_lineage(top_k(rt, [*keys, "http_method", "route_segs"], [F.col("route_tie")], limit,
                           "_dup").drop("_dup").withColumn("_r", F.monotonically_increasing_id()))
    lits = rt.select(*keys, "_r", F.explode(F.array_distinct(
        F.filter("route_segs", lambda x: ~P.is_var(x)))).alias("_seg"))
    common = cut_lineage(lits.groupBy(*keys, "_seg").agg(F.count("*").alias("_df"))
                         .where(F.col("_df") > common_df).select(*keys, "_seg"))

    def score(df, route_segs, req_segs):
        pen = F.when(P.verb_matches("http_method", "req_verb"), F.lit(0)).otherwise(
            F.lit(P.VERB_MISMATCH_PENALTY))
        return df.withColumn("score", pen + P.segment_distance(route_segs, req_segs))

    by_literal = (req.select(*keys, "_q", F.explode(F.array_distinct("req_segs")).alias("_seg"))
                  .join(common, [*keys, "_seg"], "left_anti")
                  .join(lits, [*keys, "_seg"]).select("_q", "_r"))
    shaped = _common_only(rt, "route_segs", common, ["_r"], keys, _RARE_ROUTE, P.is_var)
    shapes = top_k(shaped, [*keys, "http_method", "view"], [F.col("route_tie")], limit, "_n").select(
        *keys, "route_n", "http_method", "route_tie", "_r", F.col("view").alias("shape"))
    viewed = cut_lineage(_common_only(req, "req_segs", common, ["_q"], keys, _RARE_REQUEST,
                                      lambda x: F.lit(False)).select(*keys, "_q", "req_verb", "view"))
    lengths = [r[0] for r in rt.select("route_n").distinct().orderBy("route_n").collect()]  # pattern lengths
    views = (viewed.select(*keys, "req_verb", "view").distinct()
             .withColumn("route_n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))))
    by_shape = top_k(score(views.join(shapes, [*keys, "route_n"]), "shape", "view"),
                     [*keys, "req_verb", "view"], [F.col("score"), F.col("route_tie")], limit, "_n")
    by_shape = viewed.join(by_shape.select(*keys, "req_verb", "view", "_r"), [*keys, "req_verb", "view"]).select("_q", "_r")
    found = by_literal.unionByName(by_shape).distinct()
    scored = score(found.join(req, "_q").join(
        rt.select("_r", "route_id", "http_method", "path_pattern", "route_tie", "route_segs"), "_r"),
        "route_segs", "req_segs")
    top = top_k(scored, ["_q"], [F.col("score"), F.col("route_tie")], limit, "rank")
    top = top.select(*keys, "req_verb", "req_segs", "rank", "route_id", "http_method", "path_pattern", "score")
    return all_misses.join(top, [*keys, "req_verb", "req_segs"]).select(
        *keys, req_id, "rank", "route_id", "http_method", "path_pattern", "score")


def route_answer(resolved: DataFrame, suggestions: DataFrame, unresolved: DataFrame, *,
                 keys: Sequence[str] = (), req_id: str = "request_id") -> DataFrame:
    """The resolveEndpoint payload per request: a hit names its handler; a miss lists up to five
    suggestions; both carry the unresolved-mapping count of their scope, and a miss with
    unresolved mappings carries a warning that the answer may be incomplete."""
    keys = list(keys)
    out_cols = resolved.columns
    counted = unresolved.groupBy(*keys).agg(F.count("*").alias("n_unresolved"))  # one row per scope
    # at most ``limit`` suggestions per request: a bounded array
    sug = (suggestions.groupBy(*keys, req_id)
           .agg(F.array_sort(F.collect_list(F.struct("rank", "path_pattern"))).alias("_s")))
    j = resolved.join(sug, [*keys, req_id], "left")
    j = j.join(counted, keys, "left") if keys else j.withColumn(
        "n_unresolved", F.lit(counted.first()["n_unresolved"]))
    n = F.coalesce(F.col("n_unresolved"), F.lit(0))
    miss = F.col("status") == "miss"
    return j.select(*[F.col(c) for c in out_cols],
                    F.when(miss, F.array_join(F.transform("_s", lambda x: x["path_pattern"]), " | "))
                    .alias("suggestions"),
                    n.cast("long").alias("n_unresolved"),
                    F.when(miss & (n > 0), F.lit("some mappings could not be resolved statically; "
                                                 "the handler may be among them")).alias("warning"))


def scopes_with_miss(answers: DataFrame, unresolved: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """The unresolved mappings that a miss has to show: those of every scope with a miss, once per
    scope (each miss of the scope refers to them by its ``keys``)."""
    return unresolved.join(answers.where(F.col("status") == "miss").select(*keys).distinct(), list(keys), "left_semi")
