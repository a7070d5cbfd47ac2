"""Gold tables from fact tables: one Spark plan per question, over every (repo, snapshot).

``facts`` are the tagged rows of ``extract_facts``. Everything below is joins, windows and
aggregates keyed by ``(repo, snapshot)``; no step looks at one repository at a time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirefold.operators import candidates as C
from wirefold.operators import coverage as CV
from wirefold.operators import graph as G
from wirefold.operators.first_bases import first_bases
from wirefold.operators import resolve as RS
from wirefold.operators import roles as RL
from wirefold.operators import routes as R
from wirefold.operators import boundaries as B
from wirefold.session import cut_lineage
from wirefold.sources.java_facts import fact_table

K = ["repo", "snapshot"]
ROUTE_SEP = "\u0002"  # joins the parts of a handler id; cannot occur in source text


class Facts(NamedTuple):
    types: DataFrame
    supertypes: DataFrame
    imports: DataFrame
    annotations: DataFrame
    values: DataFrame
    fields: DataFrame
    methods: DataFrame
    params: DataFrame
    calls: DataFrame
    assigns: DataFrame
    failures: DataFrame
    units: DataFrame  # every declaration of every file; ``types`` has one entry per FQCN


def split_facts(facts: DataFrame) -> Facts:
    """The fact tables; duplicate FQCNs keep the type of the last file in path order."""
    units = fact_table(facts, "types")
    types, _ = RS.fact_dedupe_last(units, key=[*K, "fqcn"], order=["path", "type_ord"])
    return Facts(types, fact_table(facts, "supertypes"), fact_table(facts, "imports"),
                 fact_table(facts, "annotations"), fact_table(facts, "annotation_values"),
                 fact_table(facts, "fields"), fact_table(facts, "methods"),
                 fact_table(facts, "params"), fact_table(facts, "calls"),
                 fact_table(facts, "assigns"), fact_table(facts, "parse_failures"), units)


def table_entries(f: Facts) -> Facts:
    """The facts of the type-table entries alone: of files that declare the same FQCN, the one whose
    type won brings its supertypes, members and annotations, the others nothing."""
    entry = f.types.select(*K, "fqcn", "path")

    def own(df, owner=None):
        keyed = df if owner is None else df.withColumn("fqcn", owner)
        kept = keyed.join(entry, [*K, "fqcn", "path"], "left_semi")
        return kept.select(*df.columns)

    by_id = _owner_class()
    return f._replace(supertypes=own(f.supertypes), annotations=own(f.annotations, by_id), values=own(f.values, by_id),
                      fields=own(f.fields), methods=own(f.methods), params=own(f.params), calls=own(f.calls),
                      assigns=own(f.assigns))


def _owner_class(owner_id: str = "owner_id") -> Column:
    return F.split(F.col(owner_id), "#").getItem(0)


# --- type resolution from a file's point of view --------------------------------------------------

def resolve_type_names(refs: DataFrame, f: Facts, *, name: str, path: str, package: str) -> DataFrame:
    """The reference ladder for a written type name seen in a file: (1) dotted -> that exact
    FQCN or nothing; (2) an explicit import ending '.Name' -> that FQCN or nothing; (3) same
    package; (4) the first wildcard import that names a scanned type. Adds ``resolved``.
    Rungs 1 and 2 are final (an import pointing outside the scan does not fall through)."""
    # resolution depends only on (name, file, package): resolve each distinct triple once and
    # join back on it (no row ids, so a recomputed branch cannot disagree with another)
    imports = f.imports.where(~F.col("is_static"))
    explicit = imports.where(~F.col("is_wildcard")).select(
        *K, F.col("path").alias("_p"), F.substring_index("name", ".", -1).alias("_n"),
        F.col("name").alias("_imp"), F.col("ord").alias("_o"))
    explicit = explicit.groupBy(*K, "_p", "_n").agg(F.min_by("_imp", "_o").alias("_imp"))
    wild = imports.where(F.col("is_wildcard")).select(*K, F.col("path").alias("_p"),
                                                      F.col("name").alias("_pkg"), F.col("ord").alias("_o"))
    tnames = f.types.select(*K, F.col("fqcn").alias("_t"))
    keys = [*K, "_n", "_p", "_pk"]
    base = refs.select(*K, F.col(name).alias("_n"), F.col(path).alias("_p"),
                       F.coalesce(F.col(package), F.lit("")).alias("_pk")).distinct()
    dotted = base.where(F.col("_n").contains("."))
    simple = base.where(~F.col("_n").contains("."))
    r1 = (dotted.join(tnames.withColumnRenamed("_t", "_n").withColumn("resolved", F.col("_n")),
                      [*K, "_n"], "left").select(*keys, "resolved", F.lit(1).alias("_rung")))
    has_imp = simple.join(explicit, [*K, "_p", "_n"], "inner")
    r2 = (has_imp.join(tnames.withColumnRenamed("_t", "_imp").withColumn("_hit", F.lit(True)),
                       [*K, "_imp"], "left")
          .select(*keys, F.when(F.col("_hit"), F.col("_imp")).alias("resolved"), F.lit(2).alias("_rung")))
    rest = simple.join(has_imp.select(*keys), keys, "left_anti")
    same = rest.withColumn("_t", F.when(F.col("_pk") != "", F.concat_ws(".", "_pk", "_n"))
                           .otherwise(F.col("_n")))
    r3 = same.join(tnames, [*K, "_t"], "inner").select(*keys, F.col("_t").alias("resolved"),
                                                       F.lit(3).alias("_rung"))
    wc = (rest.join(wild, [*K, "_p"], "inner").withColumn("_t", F.concat_ws(".", "_pkg", "_n"))
          .join(tnames, [*K, "_t"], "inner")
          .groupBy(*keys).agg(F.min_by("_t", "_o").alias("resolved")).withColumn("_rung", F.lit(4)))
    allr = r1.unionByName(r2).unionByName(r3).unionByName(wc.select(*keys, "resolved", "_rung"))
    best = allr.groupBy(*keys).agg(F.min_by("resolved", "_rung").alias("resolved"))
    r = (refs.withColumn("_n", F.col(name)).withColumn("_p", F.col(path))
         .withColumn("_pk", F.coalesce(F.col(package), F.lit(""))))
    return r.join(best, keys, "left").drop("_n", "_p", "_pk")


# --- constants and annotation values ----------------------------------------------------------------

def string_constants(f: Facts) -> DataFrame:
    """Constants by FQCN and name; where several files declare the same one, the last in path order
    counts, also if the type's entry comes from another file."""
    owners = f.units.select(*K, "fqcn", "path", "type_ord", F.col("is_interface").alias("_iface"))
    flds = f.fields.join(owners, [*K, "fqcn", "path"], "inner")
    c = CV.constants(flds, owner_is_interface="_iface", is_static="is_static", is_final="is_final",
                     type_written="type_written", init_kind="init_kind", init_text="init_text")
    return (c.groupBy(*K, F.col("fqcn").alias("owner"), "name")
            .agg(F.max_by("value", F.struct("path", "type_ord", "ord")).alias("value")))


def resolve_values(f: Facts) -> DataFrame:
    """Every annotation value with the string it stands for (null when it cannot be known):
    a literal is itself; a bare name is a constant of the own class, else of a statically
    imported class (explicit, then wildcard, in import order); ``A.NAME`` is a constant of A,
    A resolved by the type ladder."""
    consts = string_constants(f)
    # a value is read in its own file: imports and package come from there
    types = f.units.select(*K, F.col("fqcn").alias("_cls"), "path", F.col("package").alias("_pkg"))
    v = (f.values.withColumn("_cls", _owner_class()).join(types, [*K, "_cls", "path"], "left")
         .withColumn("_path", F.col("path")))
    ref_id = [*K, "path", "owner_id", "annotation_ord", "attr", "ord"]  # the natural key of a value
    own = (v.where(F.col("expr_kind") == "name")
           .join(consts.withColumnRenamed("owner", "_cls").withColumnRenamed("name", "expr_text"),
                 [*K, "_cls", "expr_text"], "inner")
           .select(*ref_id, "value", F.lit(0).alias("_rord")))
    st = f.imports.where(F.col("is_static")).select(
        *K, F.col("path").alias("_path"), F.col("ord").alias("_io"),
        F.when(F.col("is_wildcard"), F.col("name")).otherwise(
            F.regexp_replace("name", r"\.[^.]*$", "")).alias("_owner"),
        F.when(~F.col("is_wildcard"), F.substring_index("name", ".", -1)).alias("_member"))
    via_static = (v.where(F.col("expr_kind") == "name").join(st, [*K, "_path"], "inner")
                  .where(F.col("_member").isNull() | (F.col("_member") == F.col("expr_text")))
                  .join(consts.withColumnRenamed("owner", "_owner").withColumnRenamed("name", "expr_text"),
                        [*K, "_owner", "expr_text"], "inner")
                  .select(*ref_id, "value", F.col("_io").alias("_rord")))
    fa = v.where(F.col("expr_kind") == "field_access").select(
        *ref_id, "_path", "_pkg", F.regexp_replace("expr_text", r"\.[^.]*$", "").alias("_q"),
        F.substring_index("expr_text", ".", -1).alias("_member"))
    fa = resolve_type_names(fa, f, name="_q", path="_path", package="_pkg")
    via_fa = (fa.join(consts.withColumnRenamed("owner", "resolved").withColumnRenamed("name", "_member"),
                      [*K, "resolved", "_member"], "inner")
              .select(*ref_id, "value", F.lit(0).alias("_rord")))
    lit = v.where(F.col("expr_kind") == "literal").select(*ref_id, F.col("expr_text").alias("value"),
                                                          F.lit(0).alias("_rord"))
    out = RS.resolve_constant(v, [("literal", lit, ref_id), ("own", own, ref_id), ("static-import", via_static, ref_id),
                                  ("qualified", via_fa, ref_id)], order="_rord")
    return out


# --- endpoints -----------------------------------------------------------------------------------

class Endpoints(NamedTuple):
    endpoints: DataFrame
    unresolved: DataFrame


_UNIT_SEP = "\u0003"  # joins path and FQCN to the id of one declaration in one file


def _unit(owner: str = "fqcn", path: str = "path") -> Column:
    """Id of a declaration (or of a member of one) that files with the same FQCN do not share."""
    return F.concat(path, F.lit(_UNIT_SEP), owner)


def endpoints(f: Facts) -> Endpoints:
    """Every handler of every controller, and every mapping that could not be indexed (with its
    file, line, location and reason).

    Controllers are taken from every file, also where several files declare the same FQCN: all ids
    carry the path. Types that a file names are looked up in the type table (one entry per FQCN).
    """
    # read four times below: materialise once so the plan stays small and recovery is cheap
    vals = cut_lineage(resolve_values(f)).withColumn("owner_id", _unit("owner_id"))
    ann = f.annotations.withColumn("owner_id", _unit("owner_id"))
    units = f.units.withColumn("uid", _unit())
    ctrls = CV.controller_filter(units, ann.where(F.col("owner_kind") == "type"), type_id="uid",
                                 is_interface="is_interface", owner="owner_id",
                                 written_name="written_name", keys=K)
    ann_id = F.concat_ws("@", "owner_id", F.col("ord").cast("string"))
    vals = vals.withColumn("_aid", F.concat_ws("@", "owner_id", F.col("annotation_ord").cast("string")))
    path_vals = vals.where(F.col("attr").isin("value", "path")).select(
        *K, "_aid", "ord", "expr_kind", "value")
    meth_vals = vals.where(F.col("attr") == "method").select(
        *K, "_aid", "ord", "expr_kind", "expr_text",
        ((F.col("expr_kind") == "name") & F.col("value").isNotNull()).alias("shadowed"))
    # class-level prefixes: the first @RequestMapping of a class or interface
    cls_map = (ann.where((F.col("owner_kind") == "type") & (F.col("written_name") == "RequestMapping"))
               .groupBy(*K, F.col("owner_id").alias("uid"))
               .agg(F.min(F.struct("ord", ann_id.alias("_aid"), "line")).alias("_a")).select(*K, "uid", "_a._aid", "_a.line"))
    prefixes = R.route_paths(cls_map, path_vals, mapping_id="_aid", keys=K).select(
        *K, "uid", F.col("paths").alias("base"), F.col("bad_reason").alias("base_bad"), F.col("line").alias("base_line"))
    ctrl = (ctrls.select(*K, "uid", "fqcn", "path", "type_ord", "line").join(prefixes, [*K, "uid"], "left")
            .withColumn("has_cls", F.col("base").isNotNull())
            .withColumn("base", F.coalesce("base", F.array(F.lit("")))))
    base_unres = ctrl.where(F.col("base_bad").isNotNull()).select(
        *K, "path", F.col("base_line").alias("line"), F.col("fqcn").alias("location"), F.col("base_bad").alias("reason"))
    ctrl_ok = cut_lineage(ctrl.where(F.col("base_bad").isNull() | (F.size("base") > 0)))
    # method mappings of any declaration
    methods = f.methods.select(*K, _unit().alias("uid"), F.col("ord").alias("m_ord"), F.col("name").alias("method_name"),
                               F.col("line").alias("m_line"), F.col("path").alias("m_path"),
                               F.concat_ws("#m", _unit(), F.col("ord").cast("string")).alias("owner_id"))
    maps = (ann.where((F.col("owner_kind") == "method") & F.col("written_name").isin(R.MAPPING_ANNOTATIONS))
            .select(*K, "owner_id", F.col("ord").alias("a_ord"), ann_id.alias("_aid"),
                    F.col("written_name").alias("simple_name"), "shape")
            .join(methods, [*K, "owner_id"], "inner"))
    maps = R.route_methods(maps, meth_vals, mapping_id="_aid", simple_name="simple_name", shape="shape", keys=K)
    maps = cut_lineage(R.route_paths(maps, path_vals, mapping_id="_aid", keys=K).select(
        *K, "uid", "m_ord", "a_ord", "method_name", "m_line", "m_path", "verbs", "paths", "status", "reason", "bad_reason"))
    own = (ctrl_ok.join(maps, [*K, "uid"])
           .select(*K, "uid", "fqcn", F.col("path").alias("file"), F.col("m_line").alias("line"), "method_name", "base",
                   "verbs", "paths", "status", "reason", "bad_reason",
                   F.struct(F.col("path"), "type_ord", F.lit(-1).alias("impl_ord"), "m_ord", "a_ord").alias("at")))
    inherited, iface_unres, missing = _inherited(f, ctrl_ok, maps, prefixes, methods)
    sites = own.unionByName(inherited)
    # verbs, then paths, then patterns: what cannot be read is reported where the handler stands
    location = F.concat_ws("#", "fqcn", "method_name")
    where = [*K, F.col("file").alias("path"), "line", location.alias("location")]
    verb_unres = sites.where(F.col("status") == "unresolved").select(*where, "reason")
    readable = sites.where(F.col("status") == "resolved")
    path_unres = readable.where(F.col("bad_reason").isNotNull()).select(*where, F.col("bad_reason").alias("reason"))
    expanded = cut_lineage(R.route_expand(
        readable.select(*K, "uid", "fqcn", "file", "line", "method_name", "at", "base", "paths", "verbs"),
        base_paths="base", paths="paths", verbs="verbs"))
    pattern_unres = expanded.where(F.col("status") == "unresolved").select(*where, "reason")
    found = expanded.where(F.col("status") == "resolved")
    # nothing indexed, and an implemented type is out of sight
    lost = (missing.join(found.select(*K, "uid").distinct(), [*K, "uid"], "left_anti")
            .select(*K, "path", "line", F.col("fqcn").alias("location"), F.lit(R.REASON_IFACE_MISSING).alias("reason")))
    eps = found.select(*K, "http_method", "path_pattern", "fqcn", "method_name", F.col("file").alias("path"), "line",
                       F.struct("at.*", "expand_ord").alias("scan_ord"))
    unresolved = (base_unres.unionByName(verb_unres).unionByName(path_unres).unionByName(pattern_unres)
                  .unionByName(iface_unres).unionByName(lost))
    return Endpoints(eps, unresolved)


def _inherited(f: Facts, ctrl: DataFrame, maps: DataFrame, prefixes: DataFrame, methods: DataFrame):
    """Mappings that controllers without any of their own take from the interfaces they implement:
    ``(mappings, rejects, controllers with an implemented type that is no scanned interface)``.

    The own class prefix beats the interface's; an interface whose needed prefix is unknown is
    rejected as a whole. A handler stands at the controller's first method of that name, else at
    the interface's method."""
    heirs = ctrl.join(maps.select(*K, "uid").distinct(), [*K, "uid"], "left_anti")
    names = (f.supertypes.where(F.col("relation") == "implements").withColumn("uid", _unit())
             .select(*K, "uid", "written_name", "ord", "path")
             .join(f.units.select(*K, _unit().alias("uid"), F.col("package").alias("_pkg")), [*K, "uid"]))
    names = names.join(heirs.select(*K, "uid"), [*K, "uid"], "left_semi")
    names = resolve_type_names(names, f, name="written_name", path="path", package="_pkg")
    ifaces = f.types.where("is_interface").select(*K, F.col("fqcn").alias("resolved"), _unit().alias("iface"),
                                                  F.col("path").alias("i_path"))
    pairs = (heirs.join(names.select(*K, "uid", "resolved", F.col("ord").alias("impl_ord")), [*K, "uid"])
             .join(ifaces, [*K, "resolved"], "left"))
    missing = pairs.where(F.col("iface").isNull()).select(*K, "uid", "fqcn", "path", "line").distinct()
    theirs = prefixes.select(*K, F.col("uid").alias("iface"), F.col("base").alias("i_base"), F.col("base_bad").alias("i_bad"),
                             F.col("base_line").alias("i_line"))
    pairs = pairs.where(F.col("iface").isNotNull()).join(theirs, [*K, "iface"], "left")
    unknown = ~F.col("has_cls") & F.col("i_bad").isNotNull() & (F.size("i_base") == 0)
    rejects = pairs.where(unknown).select(*K, F.col("i_path").alias("path"), F.col("i_line").alias("line"),
                                          F.col("fqcn").alias("location"), F.col("i_bad").alias("reason"))
    base = F.when(F.col("has_cls"), F.col("base")).otherwise(F.coalesce("i_base", F.array(F.lit(""))))
    first = methods.groupBy(*K, "uid", "method_name").agg(F.min_by("m_line", "m_ord").alias("own_line"))
    got = (pairs.where(~F.coalesce(unknown, F.lit(False))).withColumn("base", base)
           .join(maps.withColumnRenamed("uid", "iface"), [*K, "iface"])
           .join(first, [*K, "uid", "method_name"], "left"))
    here = F.col("own_line").isNotNull()
    return (got.select(*K, "uid", "fqcn", F.when(here, F.col("path")).otherwise(F.col("m_path")).alias("file"),
                       F.when(here, F.col("own_line")).otherwise(F.col("m_line")).alias("line"), "method_name", "base",
                       "verbs", "paths", "status", "reason", "bad_reason",
                       F.struct("path", "type_ord", "impl_ord", "m_ord", "a_ord").alias("at")), rejects, missing)


def resolve_requests(requests: DataFrame, eps: DataFrame, *, req_id: str = "request_id") -> DataFrame:
    """route_resolve over gold endpoints, scoped by (repo, snapshot); ``scan_ord`` breaks ties."""
    routes = eps.withColumn("route_id", F.concat_ws(ROUTE_SEP, "http_method", "path_pattern", "fqcn", "method_name"))
    return R.route_resolve(requests, routes, keys=K, req_id=req_id, tie="scan_ord")


# --- beans and edges -------------------------------------------------------------------------------

class Beans(NamedTuple):
    beans: DataFrame
    edges: DataFrame
    edge_candidates: DataFrame


def custom_stereotypes(f: Facts) -> DataFrame:
    """Annotation types declared in the sources that carry a stereotype, directly or through
    other custom ones (fixpoint), keyed by simple name."""
    decl = f.types.where("is_annotation").select(*K, F.col("simple_name").alias("name"), "fqcn")
    on = (f.annotations.where(F.col("owner_kind") == "type").join(
        decl.select(*K, F.col("fqcn").alias("owner_id"), "name"), [*K, "owner_id"])
        .select(*K, F.col("simple_name").alias("src"), F.col("name").alias("dst")))
    seeds = decl.select(*K).distinct().withColumn(
        "node", F.explode(F.array(*[F.lit(s) for s in C.STEREOTYPES])))
    reach = G.closure(seeds, on, keys=K)
    return reach.where(F.col("level") > 0).select(*K, F.col("node").alias("name")).distinct()


def beans(f: Facts) -> Beans:
    """Beans and their edges. Every declaration of a FQCN in any file can make it a bean, the last one
    says what kind; members, supertypes and flags are those of the type table's entry."""
    every = f
    f = table_entries(f)
    types, units = f.types, f.units
    tann = every.annotations.where(F.col("owner_kind") == "type").select(
        *K, F.col("owner_id").alias("fqcn"), "path", "ord", "simple_name", "text", "shape")
    custom = custom_stereotypes(every._replace(types=units)).withColumn("_custom", F.lit(True))
    builtin_rank = F.array_position(F.array(*[F.lit(s) for s in C.STEREOTYPES]), F.col("simple_name"))
    st = (tann.join(custom.withColumnRenamed("name", "simple_name"), [*K, "simple_name"], "left")
          .where((builtin_rank > 0) | F.col("_custom").isNotNull())
          .select(*K, "fqcn", "path", "simple_name",
                  F.struct(F.when(builtin_rank > 0, builtin_rank).otherwise(F.lit(100)), F.col("ord")).alias("_r")))
    stereo = st.groupBy(*K, "fqcn", "path").agg(F.min_by("simple_name", "_r").alias("stereotype"))
    classes = (units.where(~F.col("is_interface") & ~F.col("is_annotation"))
               .join(stereo, [*K, "fqcn", "path"], "inner")
               .select(*K, "fqcn", "stereotype", "path", "line", F.lit(False).alias("terminal"), _scan_ord()))
    mappers = (units.where(F.col("is_interface") & ~F.col("is_annotation"))
               .join(tann.where(F.col("simple_name") == "Mapper").select(*K, "fqcn", "path").distinct(), [*K, "fqcn", "path"])
               .select(*K, "fqcn", F.lit("Mapper").alias("stereotype"), "path", "line",
                       F.lit(True).alias("terminal"), _scan_ord()))
    repos = _repository_interfaces(every).join(mappers.select(*K, "fqcn", "path"), [*K, "fqcn", "path"], "left_anti")
    declared = classes.unionByName(mappers).unionByName(repos)
    # the last declaration defines a bean, the first one its place in the order
    declared = (declared.groupBy(*K, "fqcn").agg(
        F.max_by(F.struct("stereotype", "path", "line", "terminal"), "scan_ord").alias("_b"), F.min("scan_ord").alias("scan_ord"))
        .select(*K, "fqcn", "_b.*", "scan_ord"))
    made = cut_lineage(_factory_methods(every))
    # each of these is read several times below: materialise once (small plans, cheap recovery)
    universe = cut_lineage(C.universe([(0, declared), (1, _factory_beans(made))], keys=K))
    # sites: uninitialised instance fields and @Bean method parameters
    fields = C.site_filter(f.fields.withColumn("_init", F.col("init_kind").isNotNull()),
                           type_written="type_written", is_primitive="is_primitive",
                           is_static="is_static", initialised="_init").where("is_site")
    fann = f.annotations.where(F.col("owner_kind") == "field")
    qual = _qualifiers(f, fann)
    # class beans: their instance fields; factory beans: their @Bean method parameters only;
    # terminal beans have no sites
    field_beans = universe.where(~F.col("terminal") & (F.col("stereotype") != "Bean")).select(*K, "fqcn")
    fsites = (fields.join(field_beans, [*K, "fqcn"], "inner")
              .withColumn("owner_id", F.concat_ws("#f", "fqcn", F.col("ord").cast("string")))
              .join(qual, [*K, "path", "owner_id"], "left")
              .select(*K, F.col("fqcn").alias("bean"), F.col("ord").alias("site_ord"),
                      F.col("name").alias("field_name"), "type_written", "type_args", "line", "path",
                      "qualifier"))
    psites = _factory_params(every, made, universe)
    sites = fsites.unionByName(psites)
    # declared type -> FQCN (collection containers keep their own name)
    pk = units.select(*K, "path", F.col("package").alias("_pkg")).distinct()
    sites = sites.join(pk, [*K, "path"], "left")
    is_coll = F.col("type_written").isin(C.COLLECTION_TYPES)
    elem, ok = C.collection_element("type_written", "type_args")
    sites = sites.withColumn("_lookup", F.when(is_coll, elem).otherwise(F.col("type_written")))
    sites = resolve_type_names(sites, f, name="_lookup", path="path", package="_pkg")
    imported = RS.imported_fqcn(f.imports.where(~F.col("is_static") & ~F.col("is_wildcard")),
                                path="path", name="name", order=["ord"], keys=K)
    sites = cut_lineage(
        sites.join(imported.select(*K, "path", F.col("simple").alias("_lookup"),
                                   F.col("fqcn").alias("_impfq")), [*K, "path", "_lookup"], "left")
        .withColumn("declared_fqcn", F.coalesce("resolved", "_impfq")).drop("_impfq"))
    cands = cut_lineage(_implementations(f, universe))
    impls = cands.select(*K, F.col("contract"), F.col("bean_fqcn").alias("bean"), "bean_ord")
    # collection sites
    coll = sites.where(is_coll).withColumn("_elem", F.col("declared_fqcn"))
    coll = coll.withColumn("_args_ok", ok)
    coll_long = (coll.join(impls.select(*K, F.col("contract").alias("_elem"), F.col("bean").alias("candidate"),
                                        "bean_ord"), [*K, "_elem"], "left"))
    coll_edges = coll_long.select(
        *K, "bean", "site_ord", "field_name", "type_written", "declared_fqcn", "line",
        F.when(F.col("_args_ok") & F.col("candidate").isNotNull(), F.lit("resolved")).otherwise(F.lit("unresolved")).alias("status"),
        F.when(F.col("_args_ok") & F.col("candidate").isNotNull(), F.lit(C.KIND_COLLECTION)).alias("kind"),
        F.when(~F.col("_args_ok"), F.lit(C.REASON_COLLECTION)).when(F.col("candidate").isNull(), F.lit(C.REASON_NONE)).alias("reason"),
        F.lit(None).cast("string").alias("target"),
        F.when(F.col("_args_ok"), F.col("candidate")).alias("candidate"),
        F.when(F.col("_args_ok"), F.col("bean_ord")).alias("cand_ord"))
    # direct sites
    direct = sites.where(~is_coll)
    tinfo = types.select(*K, "fqcn", "is_interface")
    d = C.resolve_direct(direct.withColumn("_decl", F.col("declared_fqcn")), tinfo,
                         universe.select(*K, "fqcn", "terminal"), site_type="_decl", type_fqcn="fqcn",
                         is_interface="is_interface", bean_fqcn="fqcn", terminal="terminal", keys=K)
    d_done = d.where(F.col("status") != "pending").select(
        *K, "bean", "site_ord", "field_name", "type_written", "declared_fqcn", "line", "status", "kind",
        "reason", F.when(F.col("status") == "resolved", F.col("declared_fqcn")).alias("target"))
    pending = d.where(F.col("status") == "pending").drop("status", "kind", "reason")
    cinfo = cands.select(*K, "contract", F.col("bean_fqcn").alias("cand"), F.col("name").alias("cand_name"),
                         "bean_ord", "is_primary", "is_conditional")
    ic = C.resolve_candidate(pending, cinfo, contract="declared_fqcn", qualifier="qualifier",
                             cand_contract="contract", cand_id="cand", cand_name="cand_name",
                             cand_order="bean_ord", primary="is_primary", conditional="is_conditional",
                             keys=K)
    iface_edges = ic.select(*K, "bean", "site_ord", "field_name", "type_written", "declared_fqcn", "line",
                            "status", "kind", "reason", "target")
    edges = (d_done.unionByName(iface_edges)
             .unionByName(coll_edges.select(*K, "bean", "site_ord", "field_name", "type_written",
                                            "declared_fqcn", "line", "status", "kind", "reason", "target")
                          .dropDuplicates([*K, "bean", "site_ord"])))
    unres_multi = ic.where(F.col("reason").isin(C.REASON_MULTIPLE, C.REASON_CONDITIONAL)).select(
        *K, "bean", "site_ord", "declared_fqcn")
    edge_cands = (unres_multi.join(cinfo.withColumnRenamed("contract", "declared_fqcn"), [*K, "declared_fqcn"])
                  .select(*K, "bean", F.col("site_ord").alias("edge_ord"), F.col("cand").alias("candidate"),
                          F.col("bean_ord").alias("cand_ord"))
                  .unionByName(coll_edges.where(F.col("status") == "resolved").select(
                      *K, "bean", F.col("site_ord").alias("edge_ord"), "candidate", "cand_ord")))
    return Beans(universe, edges, edge_cands)


def _qualifiers(f: Facts, fann: DataFrame) -> DataFrame:
    """The first ``@Qualifier`` of each site, if it is written ``@Qualifier("x")``; the named form
    ``value = "x"`` and arrays say nothing."""
    q = (fann.where(F.col("simple_name") == "Qualifier").groupBy(*K, "path", "owner_id")
         .agg(F.min(F.struct(F.col("ord").alias("annotation_ord"), "shape")).alias("_q"))
         .select(*K, "path", "owner_id", "_q.*").where(F.col("shape") == "single"))
    v = f.values.where((F.col("attr") == "value") & (F.col("expr_kind") == "literal")
                       & ~F.coalesce(F.col("in_array"), F.lit(False))).select(
        *K, "path", "owner_id", "annotation_ord", F.col("expr_text").alias("qualifier"))
    return q.join(v, [*K, "path", "owner_id", "annotation_ord"]).select(*K, "path", "owner_id", "qualifier")


def _scan_ord(prio: int = 0, method_ord: Column | None = None) -> Column:
    """Place of a bean: declared ones by file and position, then made ones by file and method."""
    return F.struct(F.lit(prio).alias("prio"), "path", "type_ord",
                    (F.lit(-1) if method_ord is None else method_ord).cast("long").alias("m_ord")).alias("scan_ord")


def _repository_interfaces(f: Facts) -> DataFrame:
    """Interfaces built on a repository base, directly or through scanned parent interfaces."""
    own = f.units.where(F.col("is_interface") & ~F.col("is_annotation"))
    ext = (f.supertypes.where(F.col("relation") == "extends")
           .join(own.select(*K, "fqcn", "path", F.col("package").alias("_pkg")), [*K, "fqcn", "path"]))
    res = resolve_type_names(ext, f, name="written_name", path="path", package="_pkg")
    kc = lambda c: F.concat_ws("\u0001", *K, c)
    simple_written = F.substring_index("written_name", ".", -1)
    bases = res.where(simple_written.isin(C.REPOSITORY_BASES)).select(
        kc(_unit()).alias("owner"), F.col("ord"), simple_written.alias("base"))
    entry = f.types.where(F.col("is_interface") & ~F.col("is_annotation")).select(
        *K, F.col("fqcn").alias("resolved"), _unit().alias("_entry"))
    parents = (res.join(entry, [*K, "resolved"], "inner")
               .select(kc(_unit()).alias("child"), kc("_entry").alias("parent"), "ord"))
    found = first_bases(parents, bases).select(F.col("node").alias("_k"), F.col("base").alias("stereotype"))
    return (own.withColumn("_k", kc(_unit())).join(found, "_k", "inner")
            .select(*K, "fqcn", "stereotype", "path", "line", F.lit(True).alias("terminal"), _scan_ord()))


def _factory_methods(f: Facts) -> DataFrame:
    """Per produced FQCN its first ``@Bean`` method of a ``@Configuration`` class, in file order."""
    config = (f.annotations.where((F.col("owner_kind") == "type") & (F.col("simple_name") == "Configuration"))
              .select(*K, F.col("owner_id").alias("fqcn"), "path").distinct())
    bean_m = (f.annotations.where((F.col("owner_kind") == "method") & (F.col("simple_name") == "Bean"))
              .select(*K, "owner_id", "path").distinct())
    owner = f.units.where(~F.col("is_interface")).select(*K, "fqcn", "path", "type_ord", F.col("package").alias("_pkg"))
    m = (f.methods.withColumn("owner_id", F.concat_ws("#m", "fqcn", F.col("ord").cast("string")))
         .join(bean_m, [*K, "owner_id", "path"]).join(config, [*K, "fqcn", "path"]).join(owner, [*K, "fqcn", "path"]))
    res = resolve_type_names(m, f, name="return_type", path="path", package="_pkg").where(F.col("resolved").isNotNull())
    cols = ["fqcn", "path", "type_ord", "line", F.col("ord").alias("method_ord")]
    return (res.groupBy(*K, "resolved").agg(F.min_by(F.struct(*cols), F.struct("path", "type_ord", "ord")).alias("_m"))
            .select(*K, "resolved", "_m.*"))


def _factory_beans(made: DataFrame) -> DataFrame:
    return made.select(*K, F.col("resolved").alias("fqcn"), F.lit("Bean").alias("stereotype"), "path", "line",
                       F.lit(False).alias("terminal"), _scan_ord(1, F.col("method_ord")))


def _factory_params(f: Facts, made: DataFrame, universe: DataFrame) -> DataFrame:
    """``@Bean`` method parameters are sites of the bean the method produces, if nothing but the
    method makes it a bean."""
    only = universe.where(F.col("stereotype") == "Bean").select(*K, F.col("fqcn").alias("resolved"))
    made = made.join(only, [*K, "resolved"], "left_semi").select(*K, "fqcn", "path", "method_ord", "resolved")
    p = C.factory_sites(f.params, made, owner="fqcn", method_ord="method_ord", produced="resolved", keys=[*K, "path"])
    p = p.where(~F.col("is_primitive") & ~F.col("type_written").isin(C.NON_BEAN_SIMPLE_TYPES)
                & ~F.col("type_written").startswith("java.") & ~F.col("type_written").startswith("javax."))
    p = p.withColumn("owner_id", F.concat("fqcn", F.lit("#m"), F.col("method_ord").cast("string"), F.lit("#p"),
                                          F.col("ord").cast("string")))
    qual = _qualifiers(f, f.annotations.where(F.col("owner_kind") == "param"))
    return p.join(qual, [*K, "path", "owner_id"], "left").select(
        *K, "bean", (F.lit(1 << 20) + F.col("ord")).alias("site_ord"), F.col("name").alias("field_name"),
        "type_written", "type_args", "line", "path", "qualifier")


def _implementations(f: Facts, universe: DataFrame) -> DataFrame:
    """contract -> beans that directly implement it, with bean name, order and flags."""
    sup = (f.supertypes.where(F.col("relation") == "implements")
           .join(f.types.select(*K, "fqcn", F.col("package").alias("_pkg")), [*K, "fqcn"]))
    res = resolve_type_names(sup, f, name="written_name", path="path", package="_pkg")
    b = universe.select(*K, F.col("fqcn").alias("bean_fqcn"), "scan_ord")
    impl = (res.where(F.col("resolved").isNotNull())
            .select(*K, F.col("fqcn").alias("bean_fqcn"), F.col("resolved").alias("contract"))
            .join(b, [*K, "bean_fqcn"]))
    tann = f.annotations.where(F.col("owner_kind") == "type")
    flags = tann.groupBy(*K, F.col("owner_id").alias("bean_fqcn")).agg(
        F.bool_or(F.col("simple_name") == "Primary").alias("is_primary"),
        F.bool_or(CV.conditional_flag("simple_name")).alias("is_conditional"))
    explicit = (tann.where(F.col("simple_name").isin(C.STEREOTYPES) & (F.col("shape") == "single"))
                .select(*K, F.col("owner_id").alias("bean_fqcn"), F.col("ord").alias("annotation_ord"), "owner_id",
                        F.array_position(F.array(*map(F.lit, C.STEREOTYPES)), F.col("simple_name")).alias("_rank"))
                .join(f.values.where((F.col("expr_kind") == "literal") & ~F.coalesce(F.col("in_array"), F.lit(False)))
                      .select(*K, "owner_id", "annotation_ord", "expr_text"), [*K, "owner_id", "annotation_ord"])
                # the stereotype list decides, not the order in which they are written
                .groupBy(*K, "bean_fqcn").agg(F.min_by("expr_text", F.struct("_rank", "annotation_ord")).alias("explicit")))
    simple = f.types.select(*K, F.col("fqcn").alias("bean_fqcn"), "simple_name")
    out = (impl.join(flags, [*K, "bean_fqcn"], "left").join(explicit, [*K, "bean_fqcn"], "left")
           .join(simple, [*K, "bean_fqcn"], "left"))
    return out.select(*K, "contract", "bean_fqcn", F.col("scan_ord").alias("bean_ord"),
                      C.bean_name(out, simple_name="simple_name", explicit="explicit").alias("name"),
                      F.coalesce("is_primary", F.lit(False)).alias("is_primary"),
                      F.coalesce("is_conditional", F.lit(False)).alias("is_conditional"))


# --- transactions ---------------------------------------------------------------------------------

def transactions(f: Facts) -> tuple[DataFrame, DataFrame]:
    """(tx_methods, self_invocations) for every class; interfaces are skipped."""
    f = table_entries(f)
    ann = f.annotations
    own = (ann.where((F.col("owner_kind") == "method") & (F.col("simple_name") == "Transactional"))
           .select(*K, "owner_id").distinct().withColumn("own", F.lit(True)))
    cls = (ann.where((F.col("owner_kind") == "type") & (F.col("simple_name") == "Transactional"))
           .select(*K, F.col("owner_id").alias("fqcn")).distinct().withColumn("class_level", F.lit(True)))
    owners = (f.types.select(*K, "fqcn", "is_interface").join(cls, [*K, "fqcn"], "left")
              .withColumn("class_level", F.coalesce("class_level", F.lit(False))))
    m = (f.methods.withColumn("owner_id", F.concat_ws("#m", "fqcn", F.col("ord").cast("string")))
         .join(own, [*K, "owner_id"], "left").withColumn("own", F.coalesce("own", F.lit(False))))
    flags = B.effective_flag(m, owners, member_owner="fqcn", owner_id="fqcn", own="own",
                             inherited="class_level", excluded="is_private", skip_owner="is_interface",
                             keys=K)
    calls = f.calls.where(F.col("method_ord").isNotNull()).join(
        f.methods.select(*K, "fqcn", F.col("ord").alias("method_ord"), F.col("name").alias("caller")),
        [*K, "fqcn", "method_ord"])
    si = B.self_invocation(calls, flags.select(*K, "fqcn", "name", "transactional"), owner="fqcn",
                           caller="caller", callee="callee", receiver="receiver", member_name="name",
                           keys=K)
    return (flags.select(*K, "fqcn", F.col("name").alias("method"), "line", "transactional", "source", "dead"),
            si.select(*K, "fqcn", "caller", "callee", "line"))


# --- test roles -----------------------------------------------------------------------------------

def test_roles(f: Facts) -> tuple[DataFrame, DataFrame]:
    """(roles, unresolved) of every test class; ``f`` holds the test source set's facts."""
    types = f.types
    top = types.where(F.col("is_top_level") & ~F.col("is_interface")).select(
        *K, F.col("fqcn").alias("test_fqcn"), "path", F.col("package").alias("_pkg"))
    nested_ann = (f.annotations.where((F.col("owner_kind") == "type") & (F.col("simple_name") == "Nested"))
                  .select(*K, F.col("owner_id").alias("fqcn")).distinct())
    # scopes: the top class and its @Nested classes, with the chain of names below the top
    kc = lambda c: F.concat_ws("\u0001", *K, c)
    chain = G.ancestor_chain(types.select(kc("fqcn").alias("n"), kc("parent_fqcn").alias("p"),
                                          "simple_name", "is_top_level"),
                             node="n", parent="p", name="simple_name", is_root="is_top_level")
    nested = (types.join(nested_ann, [*K, "fqcn"]).withColumn("n", kc("fqcn")).join(chain, "n")
              .select(*K, "fqcn", F.col("chain").alias("nested_scope"), "path"))
    scope_top = (top.select(*K, F.col("test_fqcn").alias("fqcn"), "test_fqcn", "path")
                 .withColumn("nested_scope", F.lit(None).cast("string")))
    scopes_n = nested.join(top.select(*K, "test_fqcn", "path"), [*K, "path"]).where(
        F.col("fqcn").startswith(F.concat(F.col("test_fqcn"), F.lit("."))))
    scopes = scope_top.unionByName(scopes_n.select(*K, "fqcn", "test_fqcn", "path", "nested_scope"))
    # declared roles: known field annotations, accepted only if the file imports the right name
    fann = (f.annotations.where(F.col("owner_kind") == "field")
            .withColumn("fqcn", _owner_class()).join(scopes, [*K, "fqcn", "path"]))
    known = RL.known_annotations(fann.sparkSession)
    imp = f.imports.where(~F.col("is_static") & ~F.col("is_wildcard")).select(
        *K, "path", F.substring_index("name", ".", -1).alias("simple_name"), F.col("name").alias("imported"))
    wimp = f.imports.where(~F.col("is_static") & F.col("is_wildcard")).select(*K, "path", F.col("name").alias("_w"))
    fa = fann.join(known.select("simple_name"), "simple_name", "inner")
    fa = fa.join(imp, [*K, "path", "simple_name"], "left")
    fa = (fa.join(known.select("simple_name", "required_fqcn"), "simple_name")
          .join(wimp, [*K, "path"], "left")
          .withColumn("imported", F.when(F.col("imported").isNotNull(), F.col("imported"))
                      .when(F.concat_ws(".", "_w", "simple_name") == F.col("required_fqcn"), F.col("required_fqcn")))
          .drop("_w", "required_fqcn").dropDuplicates([*K, "owner_id", "ord"]))
    dr = RL.declared_roles(fa, simple_name="simple_name", imported_fqcn="imported")
    fields = f.fields.withColumn("owner_id", F.concat_ws("#f", "fqcn", F.col("ord").cast("string")))
    dr = dr.join(fields.select(*K, "owner_id", F.col("name").alias("field_name"), "type_written"), [*K, "owner_id"])
    # construction: initialisers and @BeforeEach assignments to own fields
    init = (fields.join(scopes, [*K, "fqcn", "path"])
            .where(F.col("init_kind").isin("new", "mock", "spy"))
            .select(*K, "test_fqcn", "nested_scope", F.col("name").alias("field_name"),
                    F.col("init_kind").alias("value_kind"), F.col("init_type").alias("value_type")))
    be = (f.annotations.where((F.col("owner_kind") == "method") & (F.col("simple_name") == "BeforeEach"))
          .select(*K, "owner_id").distinct())
    bm = (f.methods.withColumn("owner_id", F.concat_ws("#m", "fqcn", F.col("ord").cast("string")))
          .join(be, [*K, "owner_id"]).select(*K, "fqcn", F.col("ord").alias("method_ord")))
    asg = (f.assigns.join(bm, [*K, "fqcn", "method_ord"])
           .join(f.fields.select(*K, "fqcn", F.col("name").alias("target_name")), [*K, "fqcn", "target_name"],
                 "left_semi")
           .join(scopes, [*K, "fqcn", "path"])
           .select(*K, "test_fqcn", "nested_scope", F.col("target_name").alias("field_name"), "value_kind",
                   "value_type"))
    cr = RL.constructed_roles(init.unionByName(asg), value_kind="value_kind", value_type="value_type")
    # static freezes
    calls = (f.calls.where(F.col("callee") == "mockStatic").join(scopes, [*K, "fqcn", "path"]))
    methods = f.methods.select(*K, "fqcn", F.col("ord").alias("method_ord"), F.col("name").alias("_mname"))
    calls = (calls.join(methods, [*K, "fqcn", "method_ord"], "left")
             .join(bm.withColumn("_be", F.lit(True)), [*K, "fqcn", "method_ord"], "left"))
    calls = calls.select("*",
                         F.when(F.col("method_ord").isNull(), "field")
                         .when(F.col("_be"), "before_each").otherwise("method").alias("scope_kind"),
                         F.coalesce("_mname", F.lit("field")).alias("scope_name"))
    sr = RL.static_roles(calls, arg_kind="arg0_kind", arg_type="arg0_type", scope_kind="scope_kind",
                         scope_name="scope_name")
    # type names as written resolve by import, else package + name, else the name
    roles = (dr.where(F.col("status") == "resolved").select(
                *K, "test_fqcn", "nested_scope", "field_name", F.col("type_written").alias("type_name"), "role",
                "kind", F.lit(None).cast("string").alias("scope"), "path")
             .unionByName(cr.where(F.col("role").isNotNull()).join(
                 scopes.select(*K, "test_fqcn", "path").distinct(), [*K, "test_fqcn"]).select(
                 *K, "test_fqcn", "nested_scope", "field_name", F.col("type_fqcn").alias("type_name"), "role",
                 "kind", F.lit(None).cast("string").alias("scope"), "path"))
             .unionByName(sr.where(F.col("status") == "resolved").select(
                 *K, "test_fqcn", "nested_scope", F.lit(None).cast("string").alias("field_name"),
                 F.col("type_fqcn").alias("type_name"), "role", F.lit(None).cast("string").alias("kind"),
                 "scope", "path")))
    pk = top.select(*K, "path", "_pkg")
    imported = RS.imported_fqcn(f.imports.where(~F.col("is_static") & ~F.col("is_wildcard")),
                                path="path", name="name", order=["ord"], keys=K)
    roles = roles.join(pk, [*K, "path"]).withColumn("_simple", F.substring_index("type_name", ".", -1))
    roles = _resolve_simple_keyed(roles, imported)
    unresolved = (dr.where(F.col("status") == "unresolved").select(
                      *K, "test_fqcn", F.concat(F.lit("@"), F.col("simple_name"), F.lit(" "), F.col("field_name"))
                      .alias("description"), "reason")
                  .unionByName(sr.where(F.col("status") == "unresolved").select(
                      *K, "test_fqcn", F.concat(F.lit("mockStatic in "), F.col("scope_name")).alias("description"),
                      "reason")))
    return roles.drop("path", "_pkg", "_simple", "type_name"), unresolved


def _resolve_simple_keyed(roles: DataFrame, imported: DataFrame) -> DataFrame:
    imp = imported.select(*K, "path", F.col("simple").alias("type_name"), F.col("fqcn").alias("_imp"))
    j = roles.join(imp, [*K, "path", "type_name"], "left")
    dotted = F.col("type_name").contains(".")
    fq = (F.when(dotted, F.col("type_name")).when(F.col("_imp").isNotNull(), F.col("_imp"))
          .when(F.col("_pkg") != "", F.concat_ws(".", "_pkg", "type_name")).otherwise(F.col("type_name")))
    return j.withColumn("type_fqcn", fq).drop("_imp")


def test_classes(f: Facts) -> DataFrame:
    """Every top-level test class (tests or not): annotation texts, resolved @ExtendWith classes
    and whether it starts a Spring context."""
    top = f.types.where(F.col("is_top_level") & ~F.col("is_interface")).select(
        *K, F.col("fqcn").alias("test_fqcn"), "path", "package")
    ann = (f.annotations.where(F.col("owner_kind") == "type")
           .join(top.withColumnRenamed("test_fqcn", "owner_id"), [*K, "owner_id", "path"])
           .withColumnRenamed("owner_id", "test_fqcn"))
    ew_ann = ann.where(F.col("simple_name") == "ExtendWith").select(*K, "test_fqcn", "path", "package",
                                                                     F.col("ord").alias("annotation_ord"))
    vals = f.values.where(F.col("expr_kind") == "class_literal").select(
        *K, F.col("owner_id").alias("test_fqcn"), "annotation_ord", F.col("ord").alias("value_ord"),
        F.col("expr_text").alias("type_name"))
    ew = ew_ann.join(vals, [*K, "test_fqcn", "annotation_ord"])
    info = RL.slice_info(ann, ew, f.imports, test="test_fqcn", path="path", ord="ord", text="text",
                         package="package", keys=K)
    return (top.select(*K, "test_fqcn").join(info, [*K, "test_fqcn"], "left")
            .select(*K, "test_fqcn",
                    F.coalesce("class_annotations", F.array().cast("array<string>")).alias("class_annotations"),
                    F.coalesce("extend_with", F.array().cast("array<string>")).alias("extend_with"),
                    F.coalesce("is_context", F.lit(False)).alias("is_context")))


def write_partitioned(df: DataFrame, path: str, *, partition_by=("repo", "snapshot")) -> None:
    """Sink: Parquet partitioned by scope; with dynamic partition overwrite (session default) a
    rerun of one snapshot replaces only that snapshot's partitions."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


# --- tool-level questions over the gold tables ------------------------------------------------------

def bean_graph(b: Beans) -> DataFrame:
    """Long edge list for traversal: one row per (bean, site, candidate); a collection site fans
    out to its candidates, an unresolved site keeps a null target. Keys are folded into the node
    ids so one traversal serves every (repo, snapshot)."""
    kn = lambda c: F.concat_ws("\u0001", *K, c)
    single = b.edges.where(F.col("kind").isNull() | (F.col("kind") != C.KIND_COLLECTION)).select(
        kn("bean").alias("src"), F.col("site_ord").cast("bigint").alias("edge_ord"),
        F.lit(0).cast("bigint").alias("cand_ord"),
        F.when(F.col("status") == "resolved", kn("target")).alias("dst"), "status")
    coll = (b.edges.where(F.col("kind") == C.KIND_COLLECTION)
            .join(b.edge_candidates.withColumnRenamed("edge_ord", "site_ord"), [*K, "bean", "site_ord"])
            .select(kn("bean").alias("src"), F.col("site_ord").cast("bigint").alias("edge_ord"),
                    F.dense_rank().over(Window.partitionBy(*K, "bean", "site_ord").orderBy("cand_ord"))
                    .cast("bigint").alias("cand_ord"),
                    kn("candidate").alias("dst"), F.lit("resolved").alias("status")))
    return single.unionByName(coll)


def trace_requests(requests: DataFrame, eps: Endpoints, b: Beans, *, max_depth: int | None = None,
                   with_steps: bool = True) -> G.Trace:
    """traceEndpoint: resolve each request (repo, snapshot, request_id, verb, path), then trace
    the bean graph from the handler's class. Results are keyed by start node; join
    ``trace.requests`` to map them back."""
    res = resolve_requests(requests, eps.endpoints).where(F.col("status") == "resolved")
    handler = F.split(F.col("route_id"), ROUTE_SEP).getItem(2)
    starts = res.select(F.concat_ws("\u0001", F.col("repo"), F.col("snapshot"),
                                    F.col("request_id").cast("string")).alias("request_id"),
                        F.concat_ws("\u0001", "repo", "snapshot", handler).alias("start"))
    nodes = b.beans.select(F.concat_ws("\u0001", *K, "fqcn").alias("node"), "terminal")
    return G.reach(starts, bean_graph(b), nodes, max_depth=max_depth, with_steps=with_steps)


def dependents_of(requests: DataFrame, b: Beans, *, req_type: str = "type_fqcn") -> DataFrame:
    """beanDependents for requested FQCNs (repo, snapshot, type_fqcn): via target, else declared
    type, else candidate."""
    return C.dependents(requests, b.edges.withColumn("edge_ord", F.col("site_ord")), b.edge_candidates,
                        req_type=req_type, bean="bean", edge_ord="edge_ord", target="target",
                        declared="declared_fqcn", candidate="candidate", keys=K)


def index_status(f: Facts, eps: Endpoints, b: Beans, files: DataFrame) -> DataFrame:
    """indexStatus for every (repo, snapshot): endpoint, file, bean and parse-failure counts
    plus the two reason breakdowns, in long form."""
    return CV.index_status([
        ("endpoints", eps.endpoints, None), ("files", files, None), ("beans", b.beans, None),
        ("unresolved_sites", b.edges.where(F.col("status") == "unresolved"), "reason"),
        ("unresolved_mappings", eps.unresolved, "reason"),
        ("parse_failures", f.failures, None)], keys=K)
