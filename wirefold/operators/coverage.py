"""How much of the code the analysis covers: counts and reason breakdowns in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_status(parts: Sequence[tuple], *, keys: Sequence[str] = ()) -> DataFrame:
    """Long-form status of an index: one row per (metric, reason) with its count.

    ``parts`` are (metric name, rows, reason column or None[, column to sum instead of counting
    rows], e.g. the duplicates that each winner of ``fact_dedupe_last`` shadows). Each part is a partial
    aggregate; the union is tiny. Fleet-wide, pass ``keys=['repo', 'snapshot']``.
    """
    keys = list(keys)
    out = None
    for metric, df, reason, *weight in parts:
        r = F.col(reason) if reason else F.lit(None).cast("string")
        w = F.col(weight[0]) if weight else F.lit(1)
        agg = (df.select(*keys, r.alias("reason"), w.cast("long").alias("_w")).groupBy(*keys, "reason")
               .agg(F.sum("_w").alias("n")).select(*keys, F.lit(metric).alias("metric"), "reason", "n"))
        out = agg if out is None else out.unionByName(agg)
    return out


def flag_by_owner(annotations: DataFrame, *, owner: str, flag: Column,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Per owner: does any of its annotations satisfy ``flag``? (``bool_or``, partial aggregate)."""
    return annotations.groupBy(*keys, owner).agg(F.bool_or(flag).alias("flag"))


def conditional_flag(simple_name) -> Column:
    """``@Profile`` or any ``@ConditionalOn*`` makes a candidate environment-dependent."""
    s = F.col(simple_name) if isinstance(simple_name, str) else simple_name
    return (s == "Profile") | s.startswith("ConditionalOn")


def controller_filter(types: DataFrame, annotations: DataFrame, *, type_id: str,
                      is_interface: str, owner: str, written_name: str,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Classes (not interfaces) annotated ``@Controller``/``@RestController`` by their *written*
    name: a fully qualified ``@a.b.RestController`` does not count here."""
    from wirefold.operators.routes import CONTROLLER_ANNOTATIONS

    ctrl = annotations.where(F.col(written_name).isin(CONTROLLER_ANNOTATIONS)).select(
        *keys, F.col(owner).alias(type_id)).distinct()
    return types.where(~F.col(is_interface)).join(ctrl, [*keys, type_id], "left_semi")


def constants(fields: DataFrame, *, owner_is_interface: str, is_static: str, is_final: str,
              type_written: str, init_kind: str, init_text: str) -> DataFrame:
    """String constants usable in mappings: an interface field, or a ``static final`` one, of
    type written ``String`` whose initialiser is a string literal (quotes removed)."""
    ok = ((F.col(owner_is_interface) | (F.col(is_static) & F.col(is_final)))
          & (F.col(type_written) == "String") & (F.col(init_kind) == "string_literal"))
    value = F.regexp_replace(F.regexp_replace(F.col(init_text), r'^"', ""), r'"$', "")
    return fields.where(ok).withColumn("value", value)


def status_in_one_pass(inputs: Sequence[tuple], *, keys: Sequence[str] = ()) -> DataFrame:
    """``index_status`` where several metrics come from one table: ``keys, metric, reason, n``.

    ``inputs`` are (rows, metrics); a metric is (name, condition[, reason[, amount]]) over these rows:
    the number of rows that meet the condition, or the sum of ``amount``, per reason. Each row is
    tagged with the metrics that it counts for, all inputs' tags go through one grouped sum, and
    each input is read once, whatever the number of its metrics. Partial sums leave a task
    with one row per (keys, metric, reason). A condition that is null counts nothing, a null amount
    adds nothing; a metric that no row meets has no row, as in ``index_status``.
    """
    keys = list(keys)
    out = None
    for rows, metrics in inputs:
        tags = [F.when(cond, F.struct(F.lit(name).alias("metric"),
                                      (rest[0] if rest else F.lit(None)).cast("string").alias("reason"),
                                      (rest[1] if len(rest) > 1 else F.lit(1)).cast("long").alias("_w")))
                for name, cond, *rest in metrics]
        tagged = (rows.select(*keys, F.explode(F.array_compact(F.array(*tags))).alias("_t"))
                  .select(*keys, "_t.metric", "_t.reason", "_t._w"))
        out = tagged if out is None else out.unionByName(tagged)
    return out.groupBy(*keys, "metric", "reason").agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("n"))
