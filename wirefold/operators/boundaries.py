"""Where transactions apply: per-method flags inherited from the class, and self-invocations
that bypass the proxy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_flag(members: DataFrame, owners: DataFrame, *, member_owner: str, owner_id: str,
                   own: str, inherited: str, excluded: str, skip_owner: str | None = None,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Per member: ``source`` = ``method`` if its own flag is set, else ``class`` if the owner's
    flag is set and the member is not excluded (private), else ``none``; ``transactional`` is
    own or inherited; ``dead`` marks an own flag on an excluded member, which still counts as
    transactional. Members of skipped owners (interfaces) are left out as out-of-scope rows."""
    keys = list(keys)
    o = owners.select(*keys, F.col(owner_id).alias("_owner"), F.col(inherited).alias("_cls"),
                      (F.col(skip_owner) if skip_owner else F.lit(False)).alias("_skip"))
    j = members.join(o, [members[k] == o[k] for k in keys] + [members[member_owner] == o["_owner"]],
                     "left")
    own_c, cls = F.col(own), F.coalesce(F.col("_cls"), F.lit(False))
    priv = F.col(excluded)
    source = (F.when(own_c, F.lit("method")).when(cls & ~priv, F.lit("class"))
              .otherwise(F.lit("none")))
    return j.where(~F.coalesce(F.col("_skip"), F.lit(False))).select(
        *[members[c] for c in members.columns], (own_c | (cls & ~priv)).alias("transactional"),
        source.alias("source"), (own_c & priv).alias("dead"))


def self_invocation(calls: DataFrame, flags: DataFrame, *, owner: str, caller: str, callee: str,
                    receiver: str, member_name: str, transactional: str = "transactional",
                    keys: Sequence[str] = ()) -> DataFrame:
    """Calls with no receiver (or ``this``) whose callee *name* is transactional in the same class
    and differs from the caller's name (overloads merge; recursion is never reported)."""
    keys = list(keys)
    names = (flags.where(F.col(transactional))
             .select(*keys, F.col(owner).alias("_o"), F.col(member_name).alias("_n")).distinct())
    c = calls.where(F.col(receiver).isin("none", "this") & (F.col(callee) != F.col(caller)))
    j = c.join(names, [c[k] == names[k] for k in keys]
               + [c[owner] == names["_o"], c[callee] == names["_n"]], "left_semi")
    return j
