"""Lookups of partly qualified names as ranges of one sorted list of names.

``b.C`` finds every name that ends in ``.b.C``. With its segments turned round, ``a.b.C`` reads
``C.b.a.``, and all that end in ``.b.C`` begin with ``C.b.``: one run of the sorted list. A request is
thus two probes into the list, and how many names it finds is the difference of their places. No
name is stored once per suffix, and no request is paired with its matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.operators.ranks import running_sum
from wirefold.operators.resolve import LOOKUP_AMBIGUOUS, LOOKUP_FOUND, LOOKUP_NOT_FOUND
from wirefold.session import cut_lineage

RUN = 1024  # places of the sorted list that share a join key


class Lookups(NamedTuple):
    answers: DataFrame  # keys, request id, name, status, n_matches, candidate (of a found one)
    matches: DataFrame  # keys, name, candidate: of each ambiguous name once, however many ask for it


def turned(name: str | Column) -> Column:
    """``a.b.C`` as ``C.b.a.``."""
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.", -1)), "."), F.lit("."))


def lookup_suffix(requests: DataFrame, entities: DataFrame, *, req_id: str, name: str, qualified: str,
                  keys: Sequence[str] = ()) -> Lookups:
    """``lookup_outcome`` in suffix mode, with rows for requests plus matches and not for their product.

    An equal qualified name wins alone; otherwise every name that ends in ``'.' + name``. Distinct
    names are probed, once per scope. Names and probes are sorted together into ranges
    (``running_sum``); a scope or a last segment that holds a third of all names fills several ranges.
    An ambiguous name's run of places is cut into pieces of ``RUN`` places, and each name of the list
    meets the runs over its piece by an equi-join: at most one per distinct suffix that is asked for.

    A null or empty request name finds nothing; null entity names are left out; repeated ones count
    once; null scopes match nothing. Repeated requests keep their rows.
    """
    keys = list(keys)
    req = requests.select(*keys, req_id, F.col(name).alias("_name"))
    ents = (entities.select(*keys, F.col(qualified).alias("_q")).where(F.col("_q").isNotNull()).distinct())
    asked = cut_lineage(req.where("_name <> ''").select(*keys, "_name").distinct()
                        .join(ents.select(*keys, F.col("_q").alias("_name"), F.lit(True).alias("_exact")), [*keys, "_name"], "left"))
    no_name = F.lit(None).cast("string")
    probe = asked.where("_exact is null").withColumn("_at", turned("_name"))
    # "/" is the character after ".": whatever begins with "C.b." sorts before "C.b/"
    marks = probe.select(*keys, "_name", F.explode(F.array(
        F.struct(F.col("_at").alias("_at"), F.lit(0).alias("_side")),
        F.struct(F.regexp_replace("_at", r"\.$", "/").alias("_at"), F.lit(1).alias("_side")))).alias("_m"))
    listed = (ents.select(*keys, turned("_q").alias("_at"), F.lit(2).alias("_side"), no_name.alias("_name"), "_q", F.lit(1).alias("_one"))
              .unionByName(marks.select(*keys, "_m._at", "_m._side", "_name", no_name.alias("_q"), F.lit(0).alias("_one"))))
    placed = cut_lineage(running_sum(listed, [*keys, "_at", "_side", "_name"], "_one", "_place"))
    runs = (placed.where("_side < 2").groupBy(*keys, "_name")
            .agg(F.min("_place").alias("_from"), F.max("_place").alias("_to")))
    runs = cut_lineage(runs.where("_to > _from"))
    pieces = runs.select(*keys, "_name", "_from", "_to", F.explode(F.sequence(
        F.floor(F.col("_from") / RUN), F.floor((F.col("_to") - 1) / RUN))).alias("_piece"))
    names = placed.where("_side = 2").select(F.col("_q").alias("candidate"), F.col("_place"),
                                             F.floor(F.col("_place") / RUN).alias("_piece"))
    inside = (pieces.join(names, "_piece").where("_place >= _from and _place < _to")
              .select(*keys, F.col("_name"), "candidate", (F.col("_to") - F.col("_from") == 1).alias("_alone")))
    inside = cut_lineage(inside)
    alone = inside.where("_alone").select(*keys, "_name", "candidate")
    found = (asked.where("_exact").select(*keys, "_name", F.lit(1).cast("long").alias("n_matches"), F.col("_name").alias("candidate"))
             .unionByName(runs.join(alone, [*keys, "_name"], "left")
                          .select(*keys, "_name", (F.col("_to") - F.col("_from")).alias("n_matches"), "candidate")))
    n = F.coalesce("n_matches", F.lit(0).cast("long"))
    answers = req.join(found, [*keys, "_name"], "left").select(
        *keys, req_id, F.col("_name").alias(name),
        F.when(n == 0, LOOKUP_NOT_FOUND).when(n == 1, LOOKUP_FOUND).otherwise(LOOKUP_AMBIGUOUS).alias("status"),
        n.alias("n_matches"), "candidate")
    return Lookups(answers, inside.where("not _alone").select(*keys, F.col("_name").alias(name), "candidate"))
