"""Test-side roles: which tests use a type as the real subject, a double, or a frozen static."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the test rules: the known test-double annotations (simple name -> the one
# qualified name that counts), their kinds, and the context-slice annotations.
KNOWN_ANNOTATIONS = [
    ("Mock", "org.mockito.Mock", "MOCK"),
    ("Spy", "org.mockito.Spy", "SPY"),
    ("InjectMocks", "org.mockito.InjectMocks", None),
    ("MockBean", "org.springframework.boot.test.mock.mockito.MockBean", "MOCK_BEAN"),
    ("SpyBean", "org.springframework.boot.test.mock.mockito.SpyBean", "SPY_BEAN"),
    ("MockitoBean", "org.springframework.test.context.bean.override.mockito.MockitoBean",
     "MOCKITO_BEAN"),
    ("MockitoSpyBean", "org.springframework.test.context.bean.override.mockito.MockitoSpyBean",
     "MOCKITO_SPY_BEAN"),
]
CONTEXT_SLICE_ANNOTATIONS = ["SpringBootTest", "WebMvcTest", "DataJpaTest", "JdbcTest",
                             "WebFluxTest", "DataMongoTest", "RestClientTest", "JsonTest",
                             "DataRedisTest", "DataLdapTest", "DataR2dbcTest"]
BEFORE_EACH_SCOPE = "@BeforeEach"
ROLES = ["real", "mocked", "static"]


def known_annotations(spark) -> DataFrame:
    """The 7-row lookup of known annotations; tiny and fixed, so it is always broadcast."""
    return F.broadcast(spark.createDataFrame(
        KNOWN_ANNOTATIONS, "simple_name string, required_fqcn string, kind string"))


def import_matches(refs: DataFrame, imports: DataFrame, *, path: str, fqcn: str,
                   name: str = "name", is_static: str = "is_static",
                   is_wildcard: str = "is_wildcard", keys: Sequence[str] = ()) -> DataFrame:
    """Left-semi: refs whose file has a non-static import equal to ``fqcn``, or a wildcard
    import of its package. Each distinct (file, name) is asked twice in one equi-join, by its name
    and by its package; the refs themselves, repeated ones included, only pass a semi join."""
    keys = list(keys)
    imp = (imports.where(~F.col(is_static)).select(*keys, F.col(path).alias("_p"), F.col(name).alias("_n"),
                                                   F.col(is_wildcard).alias("_w")).distinct())
    asked = refs.select(*keys, F.col(path).alias("_p"), F.col(fqcn).alias("_fqcn")).distinct()
    pkg = F.regexp_replace(F.col("_fqcn"), r"\.[^.]*$", "")
    probe = asked.select("*", F.explode(F.array(
        F.struct(F.col("_fqcn").alias("_n"), F.lit(False).alias("_w")),
        F.struct(pkg.alias("_n"), F.lit(True).alias("_w")))).alias("_a")).select(*keys, "_p", "_fqcn", "_a.*")
    found = probe.join(imp, [*keys, "_p", "_n", "_w"], "left_semi").select(*keys, "_p", "_fqcn").distinct()
    cond = [refs[k] == found[k] for k in keys] + [refs[path] == found["_p"], refs[fqcn] == found["_fqcn"]]
    return refs.join(found, cond, "left_semi")


def declared_roles(field_annotations: DataFrame, *, simple_name: str, imported_fqcn: str,
                   spark=None) -> DataFrame:
    """Field annotations among the 7 known names: accepted only when the file imports the one
    qualified name that counts (``imported_fqcn``, null if not imported), else unresolved.
    ``@InjectMocks`` -> role real; the six others -> role mocked with their kind."""
    spark = spark or field_annotations.sparkSession
    known = known_annotations(spark).select(F.col("simple_name").alias("__sn"),
                                            F.col("required_fqcn").alias("__req"),
                                            F.col("kind").alias("__kind"))
    j = field_annotations.join(known, field_annotations[simple_name] == known["__sn"], "inner")
    ok = F.coalesce(F.col(imported_fqcn) == F.col("__req"), F.lit(False))
    role = F.when(~ok, F.lit(None)).when(F.col("__kind").isNull(), F.lit("real")).otherwise(F.lit("mocked"))
    status = F.when(ok, F.lit("resolved")).otherwise(F.lit("unresolved"))
    reason = F.when(~ok, F.concat(F.lit("annotation @"), F.col("__sn"),
                                  F.lit(" does not resolve to "), F.col("__req")))
    return j.select(*[field_annotations[c] for c in field_annotations.columns],
                    role.alias("role"), F.when(ok, F.col("__kind")).alias("kind"),
                    status.alias("status"), reason.alias("reason"))


def constructed_roles(values: DataFrame, *, value_kind: str, value_type: str) -> DataFrame:
    """Initialisers and ``@BeforeEach`` assignments: ``new X`` -> real; ``mock(...)`` ->
    mocked MOCK_CALL; ``spy(...)`` -> mocked SPY_CALL; typed by the argument, not the field.
    Other values are not roles and say so."""
    k = F.col(value_kind)
    role = F.when(k == "new", "real").when(k.isin("mock", "spy"), "mocked")
    kind = F.when(k == "mock", "MOCK_CALL").when(k == "spy", "SPY_CALL")
    return values.select("*", role.alias("role"), kind.alias("kind"),
                         F.when(role.isNotNull(), F.col(value_type)).alias("type_fqcn"))


def static_roles(calls: DataFrame, *, arg_kind: str, arg_type: str, scope_kind: str,
                 scope_name: str) -> DataFrame:
    """``mockStatic(X.class)``: role static with scope = the method name, ``@BeforeEach``, or the
    field name; a non-class-literal argument is unresolved with a reason."""
    lit = F.col(arg_kind) == "class_literal"
    scope = F.when(F.col(scope_kind) == "before_each", F.lit(BEFORE_EACH_SCOPE)).otherwise(
        F.col(scope_name))
    return calls.select("*", F.when(lit, F.lit("static")).alias("role"),
                        F.when(lit, F.col(arg_type)).alias("type_fqcn"),
                        F.when(lit, scope).alias("scope"),
                        F.when(lit, F.lit("resolved")).otherwise(F.lit("unresolved")).alias("status"),
                        F.when(~lit, F.lit("mockStatic argument is not a class literal")).alias("reason"))


def context_slice_flag(annotation_texts: Column) -> Column:
    """True if any top-level class annotation text starts with one of the 11 slice names."""
    return F.exists(annotation_texts, lambda a: F.regexp_extract(a, r"^@?([\w$]*)", 1)
                    .isin(CONTEXT_SLICE_ANNOTATIONS))


def role_usage(roles: DataFrame, *, type_col: str, role: str, test: str,
               keys: Sequence[str] = ()) -> DataFrame:
    """Distinct tests per (type, role), long form; a hot type never becomes one array."""
    return roles.where(F.col(role).isNotNull()).select(*keys, type_col, role, test).distinct()


def usage_answer(requested: DataFrame, roles: DataFrame, context_tests: DataFrame, *, type_col: str,
                 role: str, test: str, keys: Sequence[str]) -> DataFrame:
    """testDoubleUsage for requested types: ``keys, type, bucket, n_tests`` for each of the three roles
    and ``unclassified`` (context tests of the scope that mention the type in no role). An unknown
    type has three empty buckets and every context test unclassified. Counts only, no pairing:
    unclassified = context tests - context tests that mention the type."""
    keys = list(keys)
    req = requested.select(*keys, type_col).distinct()
    used = role_usage(roles, type_col=type_col, role=role, test=test, keys=keys)
    per = used.groupBy(*keys, type_col, F.col(role).alias("bucket")).agg(F.count("*").alias("n_tests"))
    ctx = context_tests.select(*keys, test).distinct()
    total = ctx.groupBy(*keys).agg(F.count("*").alias("_all"))
    mention = (used.select(*keys, type_col, test).distinct().join(ctx, [*keys, test], "left_semi")
               .groupBy(*keys, type_col).agg(F.count("*").alias("_some")))
    free = (req.join(total, keys, "left").join(mention, [*keys, type_col], "left")
            .select(*keys, type_col, F.lit("unclassified").alias("bucket"),
                    (F.coalesce("_all", F.lit(0)) - F.coalesce("_some", F.lit(0))).alias("n_tests")))
    buckets = req.withColumn("bucket", F.explode(F.array(*map(F.lit, ROLES))))
    found = buckets.join(per, [*keys, type_col, "bucket"], "left").fillna(0, ["n_tests"])
    return found.select(*keys, type_col, "bucket", "n_tests").unionByName(free)


def unclassified_context(requested: DataFrame, context_tests: DataFrame, roles: DataFrame, *,
                         type_col: str, test: str, keys: Sequence[str] = ()) -> DataFrame:
    """Context tests that never mention a requested type in any role. The pairing is an
    equi-join on the scope keys, so it is bounded by (requested types x context tests of that
    repo and snapshot) — the size of the answer itself — then the mentions are removed."""
    keys = list(keys)
    req = requested.select(*keys, type_col).distinct()
    ctx = context_tests.select(*keys, test).distinct()
    if not keys:
        raise ValueError("unclassified_context needs scope keys (e.g. repo, snapshot)")
    pairs = req.join(ctx, keys, "inner")
    mentions = roles.select(*keys, type_col, test).distinct()
    return pairs.join(mentions, [*keys, type_col, test], "left_anti")


def slice_info(class_annotations: DataFrame, extend_with_values: DataFrame, imports: DataFrame, *,
               test: str, path: str, ord: str, text: str, package: str,
               keys: Sequence[str] = ()) -> DataFrame:
    """Per top-level test class: its annotation texts in declaration order, the ``@ExtendWith``
    class literals resolved by import (else own package + name, else the name), and whether it
    starts a Spring context (``is_context``). A class's own annotations are a handful, so they
    are folded into one ordered array per class."""
    keys = list(keys)
    texts = (class_annotations.groupBy(*keys, test)
             .agg(F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), F.col(text).alias("t"))))
                  .alias("_a")))
    imp = (imports.where(~F.col("is_static") & ~F.col("is_wildcard"))
           .select(*keys, F.col("path").alias("_ip"), F.substring_index("name", ".", -1).alias("_s"),
                   F.col("name").alias("_imp"), F.col("ord").alias("_io"))
           .groupBy(*keys, "_ip", "_s").agg(F.min_by("_imp", "_io").alias("_imp")))
    ew = extend_with_values.join(imp, [extend_with_values[k] == imp[k] for k in keys]
                                 + [extend_with_values[path] == imp["_ip"],
                                    extend_with_values["type_name"] == imp["_s"]], "left")
    fq = (F.when(F.col("type_name").contains("."), F.col("type_name"))
          .when(F.col("_imp").isNotNull(), F.col("_imp"))
          .when(F.coalesce(F.col(package), F.lit("")) != "", F.concat_ws(".", F.col(package), F.col("type_name")))
          .otherwise(F.col("type_name")))
    ews = (ew.select(*[extend_with_values[k] for k in keys], extend_with_values[test].alias(test),
                     F.col("value_ord"), fq.alias("_fq"))
           .groupBy(*keys, test).agg(F.array_sort(F.collect_list(F.struct("value_ord", "_fq"))).alias("_e")))
    out = texts.join(ews, [*keys, test], "full_outer")
    anns = F.coalesce(F.transform("_a", lambda x: x["t"]), F.array().cast("array<string>"))
    return out.select(*keys, test, anns.alias("class_annotations"),
                      F.coalesce(F.transform("_e", lambda x: x["_fq"]), F.array().cast("array<string>"))
                      .alias("extend_with"),
                      context_slice_flag(anns).alias("is_context"))
