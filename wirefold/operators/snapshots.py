"""Freshness, refs and retention: what changed between snapshots, which commit a ref meant at a
time, and which generations to keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wirefold.plans.sizing import top_k

DEFAULT_GENERATIONS = 5


def snapshot_diff(old: DataFrame, new: DataFrame, *, key: Sequence[str],
                  fingerprint: Sequence[str]) -> DataFrame:
    """Full outer join on ``key``: ``added`` / ``deleted`` / ``modified`` (any fingerprint column
    differs, null-safe) / ``unchanged``. Names the files, so only their facts are redone."""
    key = list(key)
    o = old.select(*key, F.struct(*fingerprint).alias("_old"))
    n = new.select(*key, F.struct(*fingerprint).alias("_new"))
    j = o.join(n, key, "full_outer")
    change = (F.when(F.col("_old").isNull(), F.lit("added"))
              .when(F.col("_new").isNull(), F.lit("deleted"))
              .when(~F.col("_old").eqNullSafe(F.col("_new")), F.lit("modified"))
              .otherwise(F.lit("unchanged")))
    return j.select(*key, change.alias("change"))


def row_hash(cols: Sequence[str | Column]) -> tuple[Column, Column]:
    """Both 64-bit halves of the md5 of the '|'-joined columns, as decimals (identical in any
    engine that has md5)."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"),
                                           F.lit("")) for c in cols])
    md5 = F.md5(joined)
    return tuple(F.conv(F.substring(md5, at, 16), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)") for at in (1, 17))


def snapshot_fingerprint(files: DataFrame, *, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Order-independent fingerprint of a file set per ``group`` (e.g. repo, snapshot,
    source_set): count plus the sums of both halves of a 128-bit row hash. A commutative aggregate, so it is
    computed partially per task; no group is ever collected into one array."""
    high, low = row_hash(fields)
    agg = files.groupBy(*group).agg(F.count("*").alias("n_files"), F.sum(high).alias("_s"), F.sum(low).alias("_t"))
    return agg.select(*group, "n_files",
                      F.concat_ws(":", F.col("n_files").cast("string"),
                                  F.col("_s").cast("string"), F.col("_t").cast("string")).alias("fingerprint"))


def asof_join(left: DataFrame, right: DataFrame, *, key: Sequence[str], left_ts: str,
              right_ts: str, left_id: str, right_cols: Sequence[str], right_order: str,
              bucket_seconds: int = 86_400) -> DataFrame:
    """For each left row, the latest right row of the same key at or before its time.

    Skew-aware: rows are windowed per (key, time bucket), so a hot key is spread over its
    buckets; a left row with no right row in its own bucket takes the last right row of the
    nearest earlier bucket, found on the per-(key, bucket) maxima (one row per bucket).
    Ties on time go to the highest ``right_order``. Adds ``right_cols`` (null when nothing
    precedes) and ``matched``.
    """
    key = list(key)
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_seconds * 1_000_000))
    lcols = left.columns
    r = right.select(*key, F.col(right_ts).alias("_ts"), F.col(right_order).cast("long").alias("_ro"),
                     F.struct(*right_cols).alias("_r")).withColumn("_b", bucket("_ts"))
    lt = left.select(*key, F.col(left_ts).alias("_ts"), bucket(left_ts).alias("_b"),
                     F.struct(*[F.col(c) for c in lcols]).alias("_l"))
    rtype = r.schema["_r"].dataType
    ltype = lt.schema["_l"].dataType
    # 1. in-bucket match: both sides in one window per (key, bucket); right rows sort before left
    #    rows of the same instant, so "at or before" holds
    u = (lt.select(*key, "_b", "_ts", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_ro"),
                   "_l", F.lit(None).cast(rtype).alias("_r"))
         .unionByName(r.select(*key, "_b", "_ts", F.lit(0).alias("_side"), "_ro",
                               F.lit(None).cast(ltype).alias("_l"), "_r")))
    w = (W.partitionBy(*key, "_b").orderBy("_ts", "_side", "_ro")
         .rowsBetween(W.unboundedPreceding, W.currentRow))
    inb = (u.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
           .where(F.col("_side") == 1).select(*key, "_b", "_l", "_m"))
    # 2. carry-over: latest right row of a strictly earlier bucket, on one row per bucket
    per_b = (r.groupBy(*key, "_b").agg(F.max_by("_r", F.struct("_ts", "_ro")).alias("_v"))
             .withColumn("_side", F.lit(1)))
    lb = inb.select(*key, "_b").distinct().select(*key, "_b", F.lit(None).cast(rtype).alias("_v"),
                                                  F.lit(0).alias("_side"))
    wb = (W.partitionBy(*key).orderBy("_b", "_side")
          .rowsBetween(W.unboundedPreceding, W.currentRow))
    prev = (lb.unionByName(per_b).withColumn("_prev", F.last("_v", ignorenulls=True).over(wb))
            .where(F.col("_side") == 0).select(*key, "_b", "_prev"))
    out = inb.join(prev, [*key, "_b"], "left")
    m = F.coalesce(F.col("_m"), F.col("_prev"))
    return out.select(*[F.col("_l")[c].alias(c) for c in lcols],
                      *[m[c].alias(c) for c in right_cols], m.isNotNull().alias("matched"))


def retain_generations(gens: DataFrame, *, group: Sequence[str], recency: Sequence[Column],
                       keep: int = DEFAULT_GENERATIONS) -> DataFrame:
    """Newest ``keep`` rows per group (ranked by ``recency`` descending); the rest are to drop.
    Adds ``generation`` (1 = newest)."""
    return top_k(gens, group, [c.desc() for c in recency], keep, rank_col="generation")


def root_kind(path, *, default: str, refs_base: str) -> Column:
    """``default`` if the root is the default root, ``ref`` if it is the refs base or lies under it
    (whole path components, so ``.refs-old`` is not under ``.refs``), else ``root``."""
    p = F.col(path) if isinstance(path, str) else path
    base = refs_base.rstrip("/")
    return (F.when(p == F.lit(default), F.lit("default"))
            .when((p == base) | p.startswith(base + "/"), F.lit("ref")).otherwise(F.lit("root")))
