"""Name resolution as joins: rung ladders, name lookups, imports and constants.

Every lookup side is first folded to one row per join key (the best candidate under the
rung's ordering), so each rung is a many-to-one join: a hot key on the reference side meets a
single row, never a group of candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LOOKUP_FOUND = "found"
LOOKUP_AMBIGUOUS = "ambiguous"
LOOKUP_NOT_FOUND = "not-found"


@dataclass
class Rung:
    """One step of a resolution ladder.

    ``ref_keys``/``target_keys`` are equal-length lists of expressions over the reference and
    target tables. ``applies`` (over refs) says whether the rung is tried at all; a ``final``
    rung that applies ends the ladder even when it finds nothing (an explicit import pointing
    outside the scan does not fall through to the package rung).
    """

    name: str
    ref_keys: Sequence[Column]
    target_keys: Sequence[Column]
    applies: Column | None = None
    final: bool = False
    extra: dict = field(default_factory=dict)


def _all_not_null(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def resolve_ladder(refs: DataFrame, targets: DataFrame, rungs: Sequence[Rung], *,
                   ref_id: Sequence[str], target_cols: Sequence[str], target_order: Sequence[str]) -> DataFrame:
    """For each ref, the first rung that hits or that is final and applies.

    Returns refs with ``rung`` (name of the deciding rung or null), ``status``
    (``resolved`` / ``final-miss`` / ``no-match``) and ``target_cols`` of the chosen target
    (lowest ``target_order`` within the rung's key). Each rung's targets are one row per key, so
    the refs pass once through a chain of many-to-one left joins; nothing regroups them.
    """
    best_struct = F.struct(*[F.col(c) for c in target_cols])
    order_struct = F.struct(*[F.col(c) for c in target_order])
    out, name, chosen = refs, F.lit(None).cast("string"), None
    decisions = []
    for i, rung in enumerate(rungs):
        tkeys = [f"_k{i}_{j}" for j in range(len(rung.target_keys))]
        best = (targets.select(*[k.alias(n) for k, n in zip(rung.target_keys, tkeys)],
                               best_struct.alias("_t"), order_struct.alias("_o"))
                .where(_all_not_null(tkeys)).groupBy(*tkeys).agg(F.min_by("_t", "_o").alias(f"_t{i}")))
        applies = rung.applies if rung.applies is not None else F.lit(True)
        out = out.withColumns({f"_a{i}": F.coalesce(applies, F.lit(False)),
                               **{n: F.when(applies, k) for n, k in zip(tkeys, rung.ref_keys)}})
        out = out.join(best, tkeys, "left").drop(*tkeys)
        hit = F.col(f"_a{i}") & (F.col(f"_t{i}").isNotNull() | F.lit(rung.final))
        decisions.append((hit, F.lit(rung.name), F.col(f"_t{i}")))
    for hit, label, target in reversed(decisions):
        name = F.when(hit, label).otherwise(name)
        chosen = F.when(hit, target) if chosen is None else F.when(hit, target).otherwise(chosen)
    out = out.withColumns({"_rung": name, "_t": chosen})
    status = (F.when(F.col("_t").isNotNull(), F.lit("resolved"))
              .when(F.col("_rung").isNotNull(), F.lit("final-miss"))
              .otherwise(F.lit("no-match")))
    return out.select(*refs.columns, F.when(F.col("_t").isNotNull(), F.col("_rung")).alias("rung"),
                      status.alias("status"), *[F.col("_t")[c].alias(c) for c in target_cols])


def lookup_outcome(requests: DataFrame, entities: DataFrame, *, req_id: str, name: str,
                   qualified: str, simple: str | None = None, mode: str = "simple",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Name lookup of every tool, in long form.

    An exact hit on ``qualified`` wins alone; otherwise every entity whose simple name equals
    the request (``mode='simple'``) or whose qualified name ends with ``'.' + name``
    (``mode='suffix'``) is a candidate. One row per (request, candidate) with ``n_matches`` and
    ``status`` found / ambiguous / not-found; a request without candidates keeps one row with a
    null candidate. Candidates stay long: a hot simple name never becomes one array, and rows of
    requests times matches are written as they are joined, never grouped.
    """
    keys = list(keys)
    ents = entities.select(*keys, F.col(qualified).alias("candidate"),
                           *( [F.col(simple).alias("_simple")] if simple else [] )).distinct()
    req = requests.select(*keys, req_id, F.col(name).alias("_name"))
    if mode == "simple":
        if not simple:
            raise ValueError("mode='simple' needs the simple-name column")
        probe = ents.select(*keys, F.col("_simple").alias("_name"), "candidate")
    elif mode == "suffix":
        # every proper dot-suffix of the qualified name is a join key: a.b.C -> b.C, C
        parts = F.split(F.col("candidate"), r"\.")
        sufs = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
                           lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        probe = (ents.select(*keys, "candidate", F.explode(F.array_distinct(sufs)).alias("_name"))
                 .where(F.col("_name") != ""))
    else:
        raise ValueError(mode)
    exact = ents.select(*keys, F.col("candidate").alias("_name"), "candidate").distinct()
    # what a name finds does not depend on who asks: candidates and their number are worked out per name
    found = (probe.distinct().join(exact.select(*keys, "_name"), [*keys, "_name"], "left_anti").withColumn("_exact", F.lit(False))
             .select(*keys, "_name", "candidate", "_exact").unionByName(exact.withColumn("_exact", F.lit(True))))
    sizes = found.groupBy(*keys, "_name").agg(F.count("*").alias("n_matches"))
    ids = req.groupBy(*keys, req_id).agg(F.min("_name").alias("_lo"), F.max("_name").alias("_hi"))
    asked = req.join(ids, [*keys, req_id], "left")
    one = (asked.where("_lo is null or _lo = _hi")
           .join(found.join(sizes, [*keys, "_name"]).select(*keys, F.col("_name").alias("_lo"), "candidate", "n_matches"),
                 [*keys, "_lo"], "left"))
    # an id that asks for several names has the union of what they find, of exact ones only if there are any
    several = asked.where("_lo <> _hi")
    hits = several.select(*keys, req_id, "_name").distinct().join(found, [*keys, "_name"])
    wins = hits.groupBy(*keys, req_id).agg(F.max("_exact").alias("_wins"))
    hits = hits.join(wins, [*keys, req_id]).where("_exact or not _wins").select(*keys, req_id, "candidate").distinct()
    counts = hits.groupBy(*keys, req_id).agg(F.count("*").alias("n_matches"))
    columns = [*keys, req_id, "_name", "candidate", "n_matches"]
    long = (one.select(*columns)
            .unionByName(several.join(hits, [*keys, req_id], "left").join(counts, [*keys, req_id], "left").select(*columns))
            .withColumn("n_matches", F.coalesce("n_matches", F.lit(0)).cast("long")))
    status = (F.when(F.col("n_matches") == 0, F.lit(LOOKUP_NOT_FOUND))
              .when(F.col("n_matches") == 1, F.lit(LOOKUP_FOUND))
              .otherwise(F.lit(LOOKUP_AMBIGUOUS)))
    return long.select(*keys, req_id, F.col("_name").alias(name), status.alias("status"),
                       "n_matches", "candidate")


def imported_fqcn(imports: DataFrame, *, path: str, name: str, order: Sequence[str],
                  simple: Column | None = None, keys: Sequence[str] = (),
                  is_static: str | None = None, is_wildcard: str | None = None) -> DataFrame:
    """First explicit non-static import per (file, simple name), scanned or not.

    ``simple`` defaults to the last dot-segment of ``name``. Output: keys, path, simple, fqcn.
    """
    df = imports
    if is_static:
        df = df.where(~F.col(is_static))
    if is_wildcard:
        df = df.where(~F.col(is_wildcard))
    simple_col = simple if simple is not None else F.substring_index(F.col(name), ".", -1)
    return (df.select(*keys, path, simple_col.alias("simple"), F.col(name).alias("fqcn"),
                      F.struct(*order).alias("_o"))
            .groupBy(*keys, path, "simple").agg(F.min_by("fqcn", "_o").alias("fqcn")))


def resolve_simple(refs: DataFrame, imported: DataFrame, *, path: str, simple: str,
                   package: str, keys: Sequence[str] = ()) -> DataFrame:
    """Test-side resolution with no table check: explicit import, else own package + name,
    else the bare name. Adds ``fqcn`` and ``source`` (import / package / bare)."""
    imp = imported.select(*keys, F.col(path).alias("_p"), F.col("simple").alias("_s"),
                          F.col("fqcn").alias("_imp"))
    cond = [refs[path] == imp["_p"], refs[simple] == imp["_s"]] + [refs[k] == imp[k] for k in keys]
    j = refs.join(imp, cond, "left")
    pkg = F.when(F.col(package).isNotNull() & (F.col(package) != ""),
                 F.concat(F.col(package), F.lit("."), F.col(simple)))
    fq = F.coalesce(F.col("_imp"), pkg, F.col(simple))
    src = (F.when(F.col("_imp").isNotNull(), F.lit("import"))
           .when(pkg.isNotNull(), F.lit("package")).otherwise(F.lit("bare")))
    return j.select(*[refs[c] for c in refs.columns], fq.alias("fqcn"), src.alias("source"))


def fact_dedupe_last(facts: DataFrame, *, key: Sequence[str], order: Sequence[str]
                     ) -> tuple[DataFrame, DataFrame]:
    """Duplicate keys: the row with the highest ``order`` wins (later file in sorted order).

    A hash aggregate with ``max_by`` (partial aggregation before the shuffle), so a key held by a
    third of all rows still ships one row per map task. Returns (winners, loser counts per key).
    """
    key = list(key)
    payload = [c for c in facts.columns if c not in key]
    agg = facts.groupBy(*key).agg(
        F.max_by(F.struct(*payload), F.struct(*order)).alias("_w"),
        (F.count("*") - 1).alias("n_shadowed"))
    winners = agg.select(*key, *[F.col("_w")[c].alias(c) for c in payload])
    losers = agg.where(F.col("n_shadowed") > 0).select(*key, "n_shadowed")
    return winners, losers


def known_types(*names: DataFrame) -> DataFrame:
    """Searchable names: the distinct union of every single-column input, sorted."""
    out = names[0]
    for n in names[1:]:
        out = out.unionByName(n)
    return out.distinct()


def resolve_constant(refs: DataFrame, rungs: Sequence[tuple[str, DataFrame, Sequence[str]]], *,
                     value: str = "value", order: str = "ord") -> DataFrame:
    """Best constant per reference over an ordered list of candidate sources.

    Each rung is ``(name, lookup, on)``: ``lookup`` holds the columns ``on`` that it shares with the
    refs, ``value`` and ``order`` (e.g. the static-import position; the lowest wins a key). The
    first rung with a value decides; refs with none keep a null value and rung (a reported miss,
    not a guess). Refs pass a chain of many-to-one left joins and are never regrouped.
    """
    out, names = refs, F.lit(None).cast("string")
    for i, (_, lookup, on) in enumerate(rungs):
        best = lookup.groupBy(*on).agg(F.min_by(value, order).alias(f"_v{i}"))
        out = out.join(best, list(on), "left")
    for i, (name, _, _) in reversed(list(enumerate(rungs))):
        names = F.when(F.col(f"_v{i}").isNotNull(), F.lit(name)).otherwise(names)
    return out.select(*refs.columns, F.coalesce(*[F.col(f"_v{i}") for i in range(len(rungs))]).alias(value),
                      names.alias("rung"))


def lookup_answer(look: DataFrame, parts: Sequence[tuple[str, DataFrame]], *, req_id: str,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Whole answers to name lookups, long form: ``req_id, status, part, item, detail``.

    ``look`` is ``lookup_outcome``'s result; each part is ``(name, rows)`` with ``candidate, item,
    detail``. A found name gives a ``type`` row with the type, then every row of every part; an
    ambiguous one a ``match`` row per candidate; a name that is not found one row without part.
    """
    keys = list(keys)
    head = F.when(F.col("status") == LOOKUP_FOUND, "type").when(F.col("status") == LOOKUP_AMBIGUOUS, "match")
    out = look.select(*keys, req_id, "status", head.alias("part"), F.col("candidate").alias("item"),
                      F.lit(None).cast("string").alias("detail"))
    found = look.where(F.col("status") == LOOKUP_FOUND).select(*keys, req_id, "status", "candidate")
    for name, rows in parts:
        out = out.unionByName(found.join(rows, [*keys, "candidate"]).select(
            *keys, req_id, "status", F.lit(name).alias("part"), F.col("item").cast("string").alias("item"), "detail"))
    return out
