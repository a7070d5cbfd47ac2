"""Which implementation wins at each injection site, and who depends on whom.

Candidate lists are never joined to sites wholesale: each contract's candidates are folded
first into one row of statistics (count, primaries, conditionals, first, sole primary) and each
(contract, bean name) into its first candidate, so a site joins two one-row-per-key tables. A
contract implemented by a third of all beans costs one partial aggregate, not a fan-out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the bean rules.
STEREOTYPES = ["RestController", "Controller", "Service", "Repository", "Configuration", "Component"]
REPOSITORY_BASES = ["Repository", "CrudRepository", "ListCrudRepository",
                    "PagingAndSortingRepository", "ListPagingAndSortingRepository",
                    "JpaRepository", "MongoRepository", "ElasticsearchRepository",
                    "R2dbcRepository", "CoroutineCrudRepository"]
COLLECTION_TYPES = ["List", "Set", "Collection", "Map"]
NON_BEAN_SIMPLE_TYPES = ["String", "Integer", "Long", "Double", "Float", "Boolean", "Byte", "Short",
                         "Character", "Object", "BigDecimal", "BigInteger"]

RESOLVED, UNRESOLVED = "resolved", "unresolved"
KIND_CONCRETE, KIND_TERMINAL = "concrete", "terminal"
KIND_QUALIFIER, KIND_SINGLE, KIND_PRIMARY = "qualifier", "single-implementation", "primary"
KIND_COLLECTION = "collection"
REASON_NONE = "no-implementation-found"
REASON_MULTIPLE = "multiple-candidates"
REASON_CONDITIONAL = "conditional-candidates"
REASON_NOT_BEAN = "not-a-scanned-bean"
REASON_COLLECTION = "collection-injection"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def site_filter(fields: DataFrame, *, type_written: str, is_primitive: str, is_static: str,
                initialised: str) -> DataFrame:
    """Classify every field: a dependency site is non-static, uninitialised, non-primitive, not
    one of the 12 value types and not written ``java.*``/``javax.*``. Nothing is dropped: the
    rows that are not sites say why in ``excluded_by``."""
    t = F.col(type_written)
    why = (F.when(F.col(is_static), F.lit("static"))
           .when(F.col(initialised), F.lit("initialised"))
           .when(F.col(is_primitive), F.lit("primitive"))
           .when(t.isin(NON_BEAN_SIMPLE_TYPES), F.lit("value-type"))
           .when(t.startswith("java.") | t.startswith("javax."), F.lit("jdk-type")))
    return fields.withColumn("excluded_by", why).withColumn("is_site", why.isNull())


def bean_name(beans: DataFrame, *, simple_name: str, explicit: str | None = None) -> Column:
    """Explicit single-member stereotype value, else the simple name with its first letter
    lowered."""
    s = F.col(simple_name)
    decap = F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))
    return F.coalesce(F.col(explicit), decap) if explicit else decap


def universe(branches: Sequence[tuple[int, DataFrame]], *, fqcn: str = "fqcn",
             scan_ord: str = "scan_ord", keys: Sequence[str] = ()) -> DataFrame:
    """Bean universe from prioritised branches (e.g. stereotyped classes, then factory methods):
    per (keys, fqcn) the row of the lowest (priority, scan_ord) wins, so a later branch only
    adds what is absent."""
    tagged = None
    for prio, df in branches:
        d = df.withColumn("_prio", F.lit(prio))
        tagged = d if tagged is None else tagged.unionByName(d)
    payload = [c for c in tagged.columns if c not in (*keys, fqcn)]
    best = tagged.groupBy(*keys, fqcn).agg(
        F.min_by(F.struct(*payload), F.struct("_prio", scan_ord)).alias("_b"))
    return best.select(*keys, fqcn, *[F.col("_b")[c].alias(c) for c in payload if c != "_prio"])


def implementations(beans: DataFrame, supertypes: DataFrame, *, bean: str, bean_ord: str,
                    contract: str, keys: Sequence[str] = ()) -> DataFrame:
    """contract -> beans that implement it directly, with the bean order kept as a column
    (never a dense rank over a hot contract)."""
    sup = supertypes.select(*keys, F.col(bean).alias("_b"), F.col(contract).alias("contract"))
    b = beans.select(*keys, F.col(bean).alias("_b"), F.col(bean_ord).alias("bean_ord"))
    return (b.join(sup, [*keys, "_b"], "inner")
            .select(*keys, "contract", F.col("_b").alias("bean"), "bean_ord").distinct())


def resolve_direct(sites: DataFrame, types: DataFrame, beans: DataFrame, *, site_type: str,
                   type_fqcn: str, is_interface: str, bean_fqcn: str, terminal: str,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Before the interface ladder: a scanned concrete bean -> ``concrete``; a terminal interface
    -> ``terminal``; a scanned non-bean class or an unscanned type -> ``not-a-scanned-bean``;
    a non-terminal interface goes on to the interface ladder (``decision = 'interface'``)."""
    t = types.select(*keys, F.col(type_fqcn).alias("__t"), F.col(is_interface).alias("__iface"))
    b = beans.select(*keys, F.col(bean_fqcn).alias("__t"), F.col(terminal).alias("__terminal"),
                     F.lit(True).alias("__bean"))
    tb = t.join(b, [*keys, "__t"], "left")
    j = sites.join(tb, [sites[k] == tb[k] for k in keys] + [sites[site_type] == tb["__t"]], "left")
    decision = (F.when(F.col("__t").isNull(), F.lit("unscanned"))
                .when(~F.col("__iface") & F.col("__bean").isNotNull(), F.lit(KIND_CONCRETE))
                .when(F.col("__iface") & F.coalesce(F.col("__terminal"), F.lit(False)), F.lit(KIND_TERMINAL))
                .when(F.col("__iface"), F.lit("interface"))
                .otherwise(F.lit("non-bean-class")))
    status = (F.when(decision.isin(KIND_CONCRETE, KIND_TERMINAL), F.lit(RESOLVED))
              .when(decision == "interface", F.lit("pending"))
              .otherwise(F.lit(UNRESOLVED)))
    kind = F.when(decision.isin(KIND_CONCRETE, KIND_TERMINAL), decision)
    reason = F.when(decision.isin("unscanned", "non-bean-class"), F.lit(REASON_NOT_BEAN))
    return j.select(*[sites[c] for c in sites.columns], status.alias("status"),
                    kind.alias("kind"), reason.alias("reason"))


def contract_stats(candidates: DataFrame, *, contract: str, cand_id: str, cand_order: str,
                   primary, conditional, keys: Sequence[str] = ()) -> DataFrame:
    """One row per contract: n, n_primary, any_conditional, first candidate, sole primary."""
    prim = _c(primary)
    return candidates.groupBy(*keys, F.col(contract).alias("_contract")).agg(
        F.count("*").alias("n_candidates"),
        F.count_if(prim).alias("n_primary"),
        F.bool_or(_c(conditional)).alias("any_conditional"),
        F.min_by(F.col(cand_id), F.col(cand_order)).alias("first_candidate"),
        F.min_by(F.when(prim, F.col(cand_id)), F.when(prim, F.col(cand_order))).alias("primary_candidate"))


def resolve_candidate(sites: DataFrame, candidates: DataFrame, *, contract: str, qualifier: str,
                      cand_contract: str, cand_id: str, cand_name: str, cand_order: str,
                      primary, conditional, keys: Sequence[str] = ()) -> DataFrame:
    """The interface ladder, in order: no candidate -> ``no-implementation-found``; a qualifier
    naming a candidate -> ``qualifier`` (first in bean order), naming none ->
    ``multiple-candidates``; any conditional candidate -> ``conditional-candidates``; exactly one
    -> ``single-implementation``; exactly one primary -> ``primary``; else
    ``multiple-candidates``. Adds status, kind, reason, target, n_candidates."""
    keys = list(keys)
    stats = contract_stats(candidates, contract=cand_contract, cand_id=cand_id,
                           cand_order=cand_order, primary=primary, conditional=conditional,
                           keys=keys)
    named = (candidates.groupBy(*keys, F.col(cand_contract).alias("_contract"),
                                F.col(cand_name).alias("_qual"))
             .agg(F.min_by(F.col(cand_id), F.col(cand_order)).alias("named_candidate")))
    s = sites.withColumn("_contract", F.col(contract)).withColumn("_qual", F.col(qualifier))
    j = (s.join(stats, [*keys, "_contract"], "left")
         .join(named, [*keys, "_contract", "_qual"], "left"))
    n = F.coalesce(F.col("n_candidates"), F.lit(0))
    q = F.col("_qual").isNotNull()
    kind = (F.when(n == 0, None)
            .when(q & F.col("named_candidate").isNotNull(), F.lit(KIND_QUALIFIER))
            .when(q, None)
            .when(F.col("any_conditional"), None)
            .when(n == 1, F.lit(KIND_SINGLE))
            .when(F.col("n_primary") == 1, F.lit(KIND_PRIMARY)))
    reason = (F.when(n == 0, F.lit(REASON_NONE))
              .when(q & F.col("named_candidate").isNotNull(), None)
              .when(q, F.lit(REASON_MULTIPLE))
              .when(F.col("any_conditional"), F.lit(REASON_CONDITIONAL))
              .when(n == 1, None)
              .when(F.col("n_primary") == 1, None)
              .otherwise(F.lit(REASON_MULTIPLE)))
    target = (F.when(kind == KIND_QUALIFIER, F.col("named_candidate"))
              .when(kind == KIND_SINGLE, F.col("first_candidate"))
              .when(kind == KIND_PRIMARY, F.col("primary_candidate")))
    status = F.when(kind.isNotNull(), F.lit(RESOLVED)).otherwise(F.lit(UNRESOLVED))
    return j.select(*[F.col(c) for c in sites.columns], status.alias("status"), kind.alias("kind"),
                    reason.alias("reason"), target.alias("target"),
                    n.cast("long").alias("n_candidates"))


def collection_element(container: str, type_args: str) -> tuple[Column, Column]:
    """(element type, ok) of a collection site: List/Set/Collection<X> -> X; Map<String, X> -> X;
    a raw type or a non-String map key is not ok (``collection-injection``)."""
    c, a = F.col(container), F.col(type_args)
    is_map = c == "Map"
    ok = (F.when(is_map, (F.size(a) == 2) & (F.element_at(a, 1) == "String"))
          .otherwise(F.size(a) == 1))
    elem = F.when(ok, F.when(is_map, F.element_at(a, 2)).otherwise(F.element_at(a, 1)))
    return elem, ok


def resolve_collection(sites: DataFrame, impls: DataFrame, *, container: str, type_args: str,
                       keys: Sequence[str] = ()) -> DataFrame:
    """Collection sites in long form: a resolved site gets one row per implementation of its
    element type (``bean``, ``bean_ord``; target stays null); a raw type or non-String key is
    ``collection-injection``; an element without implementations is
    ``no-implementation-found``. Unresolved sites keep one row with null candidate."""
    elem, ok = collection_element(container, type_args)
    s = sites.withColumn("_elem", elem).withColumn("_ok", ok)
    im = impls.select(*keys, F.col("contract").alias("_elem"), "bean", "bean_ord")
    j = s.join(im, [*keys, "_elem"], "left")
    status = F.when(F.col("_ok") & F.col("bean").isNotNull(), F.lit(RESOLVED)).otherwise(F.lit(UNRESOLVED))
    kind = F.when(F.col("_ok") & F.col("bean").isNotNull(), F.lit(KIND_COLLECTION))
    reason = (F.when(~F.col("_ok"), F.lit(REASON_COLLECTION))
              .when(F.col("bean").isNull(), F.lit(REASON_NONE)))
    return j.select(*[F.col(c) for c in sites.columns], status.alias("status"), kind.alias("kind"),
                    reason.alias("reason"),
                    F.when(F.col("_ok"), F.col("bean")).alias("candidate"),
                    F.when(F.col("_ok"), F.col("bean_ord")).alias("candidate_ord"))


def factory_sites(params: DataFrame, factory_methods: DataFrame, *, owner: str, method_ord: str,
                  produced: str, keys: Sequence[str] = ()) -> DataFrame:
    """``@Bean`` method parameters are the sites of the bean the method produces (a factory-made
    bean has no field sites). Parameters still pass ``site_filter`` downstream."""
    fm = factory_methods.select(*keys, owner, method_ord, F.col(produced).alias("bean"))
    return params.join(fm, [*keys, owner, method_ord], "inner")


def all_beans(beans: DataFrame, *, fqcn: str = "fqcn", keys: Sequence[str] = ()) -> DataFrame:
    """Every bean, sorted by FQCN within its scope (a range-partitioned sort; no single task)."""
    return beans.orderBy(*keys, fqcn)


def dependents(requests: DataFrame, edges: DataFrame, edge_candidates: DataFrame, *,
               req_type: str, bean: str, edge_ord: str, target: str, declared: str,
               candidate: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per requested type, every edge that references it, tagged with the first of
    ``target`` / ``declared-type`` / ``candidate``. Three equi-joins (never one OR-join), then
    the lowest tag per (request, edge)."""
    keys = list(keys)
    req = requests.select(*keys, F.col(req_type).alias("_type")).distinct()
    e = edges.select(*keys, bean, edge_ord, target, declared)
    via_t = req.join(e.withColumnRenamed(target, "_type"), [*keys, "_type"]) \
        .select(*keys, "_type", bean, edge_ord, F.lit(1).alias("_rank"))
    via_d = req.join(e.withColumnRenamed(declared, "_type"), [*keys, "_type"]) \
        .select(*keys, "_type", bean, edge_ord, F.lit(2).alias("_rank"))
    ec = edge_candidates.select(*keys, bean, edge_ord, F.col(candidate).alias("_type"))
    via_c = req.join(ec, [*keys, "_type"]).select(*keys, "_type", bean, edge_ord,
                                                  F.lit(3).alias("_rank"))
    allv = via_t.unionByName(via_d).unionByName(via_c)
    best = allv.groupBy(*keys, "_type", bean, edge_ord).agg(F.min("_rank").alias("_rank"))
    via = (F.when(F.col("_rank") == 1, F.lit("target"))
           .when(F.col("_rank") == 2, F.lit("declared-type")).otherwise(F.lit("candidate")))
    return best.select(*keys, F.col("_type").alias(req_type), bean, edge_ord, via.alias("via"))


def bean_dependencies(edges: DataFrame, *, bean: str, edge_ord: str, fields: Sequence[str],
                      keys: Sequence[str] = ()) -> DataFrame:
    """One bean's edges in declaration order. A bean's own field list is bounded by its source,
    so it is folded into one ordered array per bean."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(edge_ord).alias("ord"),
                                                   *[F.col(f) for f in fields])))
    return edges.groupBy(*keys, bean).agg(ordered.alias("edges"),
                                          F.count("*").alias("n_edges"))


def unresolved_by_reason(edges: DataFrame, *, status: str = "status", reason: str = "reason",
                         keys: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """Unresolved sites counted by reason (partial aggregation before the shuffle). Across a
    fleet, ``rollup=True`` adds per-scope and grand totals (null reason / null keys)."""
    unres = edges.where(F.col(status) == UNRESOLVED)
    grouped = unres.rollup(*keys, reason) if rollup else unres.groupBy(*keys, reason)
    return grouped.agg(F.count("*").alias("n"))
