"""Row numbers over ranges, against plain enumeration."""

import collections

from wirefold.operators.ranks import numbered


def test_numbers_follow_the_order_within_each_key(spark):
    rows = [(None if i % 5 == 0 else f"k{i % 3}", (i * 37) % 101 if i % 7 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, id long").repartition(6)
    got = numbered(df, ["k"], ["o", "id"], total="n").collect()
    by = collections.defaultdict(list)
    for k, o, i in rows:
        by[k].append((o is not None, o or 0, i))
    want = {(k, x[2]): (p, len(v)) for k, v in by.items() for p, x in enumerate(sorted(v))}
    assert {(r.k, r.id): (r.position, r.n) for r in got} == want


def test_numbers_of_ties_of_everything_and_of_nothing(spark):
    same = spark.createDataFrame([(1, "x")] * 300, "k long, o string").repartition(5)
    got = sorted(r.place for r in numbered(same, [], ["k", "o"], "place").collect())
    assert got == list(range(300))
    assert numbered(same.limit(0), ["k"], ["o"]).count() == 0


def test_one_hot_key_is_numbered_by_several_partitions(spark):
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
        parts = numbered(hot, ["k"], ["o"]).select(F.spark_partition_id().alias("p"), "position")
        assert parts.select("p").distinct().count() > 1
        assert parts.agg(F.countDistinct("position"), F.max("position")).first() == (20_000, 19_999)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
