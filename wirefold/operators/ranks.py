"""Row numbers for groups of any size: no window ever holds more than one range partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirefold.session import cut_lineage


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "position",
             total: str | None = None) -> DataFrame:
    """``df`` plus ``name``: the row's 0-based number within ``keys`` by ``order`` (ascending, nulls
    first; rows that tie in all of it get neighbouring numbers in any order), and plus ``total``, the
    number of rows of its ``keys``, where a name is given.

    Rows are dealt by range over ``keys + order`` and a running id, so even a group that holds most
    rows, or that consists of ties, spreads over many partitions. A window numbers the rows of one
    (partition, group); prefix sums of the partitions' counts, one row per partition and group,
    give each its offset. The dealt rows are checkpointed once: both steps see the same partitions.
    Null keys form a group; an empty frame stays empty.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    bucket, tie = "_part", "_part_tie"
    dealt = (df.withColumn(tie, F.monotonically_increasing_id())
             .repartitionByRange(*[F.col(k) for k in keys], *by, F.col(tie))
             .withColumn(bucket, F.spark_partition_id()))
    dealt = cut_lineage(dealt)
    counts = dealt.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_b"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    on = F.col(bucket) == F.col("_b")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = F.row_number().over(Window.partitionBy(bucket, *keys).orderBy(*by, tie)).cast("long") - 1
    return (dealt.withColumn(name, within).join(offsets, on)
            .withColumn(name, F.col(name) + F.col("_offset"))
            .select(*df.columns, name, *([F.col("_total").alias(total)] if total else [])))


def running_sum(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """``df`` plus ``name``: the sum of ``amount`` over all rows that stand before the row by ``order``
    (ascending, nulls first; 0 for the first). Rows that tie in ``order`` stand in any order.

    As in ``numbered``: ranges are summed on their own, and the sums of the ranges before, one row
    per range, give each its offset. No group holds more than one range.
    """
    bucket = "_part"
    dealt = cut_lineage(df.repartitionByRange(*[F.col(c) for c in order]).withColumn(bucket, F.spark_partition_id()))
    sums = dealt.groupBy(bucket).agg(F.sum(amount).alias("_s"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(bucket, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    within = (Window.partitionBy(bucket).orderBy(*[F.col(c) for c in order])
              .rowsBetween(Window.unboundedPreceding, -1))
    return (dealt.withColumn(name, F.coalesce(F.sum(amount).over(within), F.lit(0))).join(offsets, bucket)
            .withColumn(name, (F.col(name) + F.col("_offset")).cast("long")).select(*df.columns, name))
