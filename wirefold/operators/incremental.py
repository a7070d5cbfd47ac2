"""Answers kept up to date after a diff: signed rows flow through joins and aggregates, and only the
keys that they touch are worked out again.

A delta is a frame with a ``weight`` column: the rows of the new state minus those of the old one,
as a multiset. ``fact_delta`` takes it from the files that ``snapshot_diff`` names; the other
functions turn deltas of inputs into deltas of results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.operators.snapshots import snapshot_diff
from wirefold.session import cut_lineage

WEIGHT = "weight"


def consolidate(delta: DataFrame) -> DataFrame:
    """Equal rows as one with the sum of their weights; rows whose weights cancel out go."""
    cols = [c for c in delta.columns if c != WEIGHT]
    return delta.groupBy(*cols).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` minus ``old``."""
    minus, plus = (df.withColumn(WEIGHT, F.lit(w).cast("long")) for df, w in ((old, -1), (new, 1)))
    return consolidate(minus.unionByName(plus))


def fact_delta(old: DataFrame, new: DataFrame, changes: DataFrame, *, file: Sequence[str],
               change: str = "change") -> DataFrame:
    """Delta of a fact table of which only the changed files are looked at: ``old`` rows of modified
    and deleted files leave, ``new`` rows of modified and added files come. ``changes(file, change)``
    is what ``snapshot_diff`` returns; ``new`` needs to hold the rows of changed files only. Rows that
    a modified file has kept cancel out, so a file touched without effect changes nothing."""
    named = lambda *kinds: changes.where(F.col(change).isin(*kinds)).select(*file).distinct()
    gone = old.join(named("modified", "deleted"), list(file), "left_semi")
    came = new.join(named("modified", "added"), list(file), "left_semi")
    return signed(gone, came.select(*old.columns))


def apply_delta(old: DataFrame, delta: DataFrame) -> DataFrame:
    """The new state as a multiset: ``old`` plus ``delta``. Only rows equal to one in the delta are
    counted; all others pass through."""
    cols = old.columns
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"d.{c}")) for c in cols]
    on = same[0]
    for c in same[1:]:
        on &= c
    rest = old.alias("o").join(delta.select(*cols).distinct().alias("d"), on, "left_anti")
    met = old.alias("o").join(delta.select(*cols).distinct().alias("d"), on, "left_semi")
    total = consolidate(met.withColumn(WEIGHT, F.lit(1).cast("long")).unionByName(delta.select(*cols, WEIGHT)))
    return rest.unionByName(total.where(F.col(WEIGHT) > 0)
                            .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), WEIGHT))).select(*cols))


def join_delta(left: DataFrame, d_left: DataFrame, right: DataFrame, d_right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Delta of ``left JOIN right`` (``left`` and ``right`` as they were): what changed on one side
    meets the other side, and both changes meet. Three joins, each with a delta on one side, so the
    old product is never formed. Columns outside ``on`` must differ."""
    on = list(on)
    d_l, d_r = d_left.withColumnRenamed(WEIGHT, "_wl"), d_right.withColumnRenamed(WEIGHT, "_wr")
    a = d_l.join(right, on).withColumn(WEIGHT, F.col("_wl")).drop("_wl")
    b = left.join(d_r, on).withColumn(WEIGHT, F.col("_wr")).drop("_wr")
    both = d_l.join(d_r, on).withColumn(WEIGHT, F.col("_wl") * F.col("_wr")).drop("_wl", "_wr")
    return consolidate(a.unionByName(b).unionByName(both))


def refresh_sums(old: DataFrame, delta: DataFrame, *, keys: Sequence[str], count: str,
                 sums: Sequence[str] = ()) -> DataFrame:
    """An aggregate ``(keys, count, sums)`` after a delta of its input rows (which has the ``sums``
    columns as values): weights are added to the counts of the keys they touch, and a key whose
    count falls to 0 leaves. Null keys are a key."""
    keys = list(keys)
    part = delta.groupBy(*keys).agg(F.sum(WEIGHT).cast("long").alias(count),
                                    *[F.sum(F.col(WEIGHT) * F.col(s)).alias(s) for s in sums])
    both = old.select(*keys, count, *sums).unionByName(part.select(*keys, count, *sums))
    return both.groupBy(*keys).agg(F.sum(count).alias(count), *[F.sum(s).alias(s) for s in sums]).where(F.col(count) > 0)


class Refreshed(NamedTuple):
    """``rows``: the whole new result; ``upserts``: the rows worked out again; ``gone``: keys whose old
    rows leave (those worked out again and those that no longer exist)."""
    rows: DataFrame
    upserts: DataFrame
    gone: DataFrame


def refresh_lookups(old: DataFrame, sites: DataFrame, targets: DataFrame, site_delta: DataFrame,
                    target_deltas: Sequence[tuple[str, DataFrame]], *, site_key: Sequence[str], target_key: str,
                    resolve: Callable[[DataFrame, DataFrame], DataFrame]) -> Refreshed:
    """Result of ``resolve(sites, targets)`` (one or more rows per site, from the site and the targets
    under its key alone) after deltas of both sides.

    A site is worked out again if its own row changed or if any target under a key that it reads
    did: ``target_deltas`` pairs a column of ``sites`` with a frame of changed values of it. Those
    sites meet only the targets of their keys; minima, flags and counts per key are thus taken again
    for touched keys, and nothing else is read from ``targets``' result. ``target_key`` names the
    column of both ``sites`` and ``targets`` that ``resolve`` joins by; a null key meets nothing.
    """
    site_key = list(site_key)
    own = site_delta.select(*site_key).distinct()
    marked = sites.join(own.withColumn("_own", F.lit(True)), site_key, "left")
    hit = F.col("_own").isNotNull()
    for i, (column, changed) in enumerate(target_deltas):
        values = changed.select(F.col(changed.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct()
        marked = marked.join(values.withColumn(f"_t{i}", F.lit(True)), column, "left")
        hit |= F.col(f"_t{i}").isNotNull()
    touched = cut_lineage(marked.where(hit).select(*sites.columns))
    read = touched.select(target_key).where(F.col(target_key).isNotNull()).distinct()
    upserts = cut_lineage(resolve(touched, targets.join(read, target_key, "left_semi").select(*targets.columns)))
    gone = own.unionByName(touched.select(*site_key)).distinct()
    return Refreshed(old.join(gone, site_key, "left_anti").unionByName(upserts), upserts, gone)


def changed_files(old_files: DataFrame, new_files: DataFrame, *, key: Sequence[str],
                  fingerprint: Sequence[str]) -> DataFrame:
    """Files that are not the same in both listings, with their ``change``."""
    return snapshot_diff(old_files, new_files, key=key, fingerprint=fingerprint).where("change <> 'unchanged'")


def refresh_facts(old_facts: DataFrame, sources: DataFrame, changes: DataFrame, *, file: Sequence[str],
                  extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts of the new listing: those of unchanged files are kept, those of modified and added
    files are extracted again from ``sources``, those of deleted files leave."""
    file = list(file)
    stale = changes.select(*file).distinct()
    again = changes.where(F.col("change").isin("modified", "added")).select(*file).distinct()
    fresh = extract(sources.join(again, file, "left_semi").select(*sources.columns))
    return old_facts.join(stale, file, "left_anti").unionByName(fresh)
