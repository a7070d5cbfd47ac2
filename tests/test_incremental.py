"""Deltas against full rebuilds on random tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from wirefold.operators import incremental as I

LEFT, RIGHT = "k long, a long", "k long, b string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def tables(seed):
    r = random.Random(seed)
    left = lambda: [(r.choice([None, 1, 2, 3]), r.randrange(3)) for _ in range(r.randrange(12))]
    right = lambda: [(r.choice([None, 1, 2, 4]), r.choice(["x", None])) for _ in range(r.randrange(8))]
    return left(), left(), right(), right()


@pytest.mark.parametrize("seed", range(4))
def test_join_and_sums_after_deltas_equal_a_rebuild(spark, seed):
    l0, l1, r0, r1 = tables(seed)
    l0, l1, r0, r1 = (frame(spark, x, s) for x, s in ((l0, LEFT), (l1, LEFT), (r0, RIGHT), (r1, RIGHT)))
    d_l, d_r = I.signed(l0, l1), I.signed(r0, r1)
    assert bag(I.apply_delta(l0, d_l)) == bag(l1)
    joined = I.join_delta(l0, d_l, r0, d_r, ["k"])
    old, new = l0.join(r0, ["k"]), l1.join(r1, ["k"])
    assert bag(I.apply_delta(old, joined.select(*old.columns, I.WEIGHT))) == bag(new)
    total = lambda df: df.groupBy("b").agg(F.count("*").alias("n"), F.sum("a").alias("a"))
    got = I.refresh_sums(total(old), joined, keys=["b"], count="n", sums=["a"])
    assert bag(got.select("b", "n", "a")) == bag(total(new).select("b", "n", "a"))


def test_files_saved_without_a_change_touch_nothing(spark):
    old = frame(spark, [("a", 1), ("a", 1), ("b", 2), ("c", 3)], "file string, v long")
    new = frame(spark, [("a", 1), ("a", 1), ("b", 5), ("d", 4)], "file string, v long")
    files = lambda *x: frame(spark, list(x), "file string, mtime long")
    ch = I.changed_files(files(("a", 1), ("b", 1), ("c", 1)), files(("a", 2), ("b", 2), ("d", 1)), key=["file"], fingerprint=["mtime"])
    assert dict(tuple(r) for r in ch.collect()) == {"a": "modified", "b": "modified", "c": "deleted", "d": "added"}
    delta = I.fact_delta(old, new, ch, file=["file"])
    assert bag(delta) == {("b", 2, -1): 1, ("b", 5, 1): 1, ("c", 3, -1): 1, ("d", 4, 1): 1}
    seen = []

    def extract(src):
        seen.extend(r.file for r in src.collect())
        return new.join(src.select("file"), "file", "left_semi")

    sources = frame(spark, [("a", "x"), ("b", "y"), ("d", "z")], "file string, content string")
    assert bag(I.refresh_facts(old, sources, ch.where("file <> 'a'"), file=["file"], extract=extract)) == bag(new)
    assert sorted(seen) == ["b", "d"]


def least(sites, targets):
    """The smallest target of a site's key, and their number."""
    t = targets.groupBy("key").agg(F.min("t").alias("first"), F.count("*").alias("n"))
    return sites.join(t, "key", "left").select("site", "key", "first", F.coalesce("n", F.lit(0)).alias("n"))


@pytest.mark.parametrize("seed", range(3))
def test_lookups_redo_touched_keys_alone(spark, seed):
    r = random.Random(seed)
    keys = ["p", "q", "r", None]
    s0 = {i: r.choice(keys) for i in range(10)}
    s1 = {i: (r.choice(keys) if i in (1, 2) else k) for i, k in s0.items() if i != 3} | {20: "p"}
    t0 = [("p", 5), ("p", 7), ("q", 1), ("r", 3)]
    t1 = [("p", 7), ("q", 1), ("r", 3), ("s", 9)]
    rows = lambda d: frame(spark, list(d.items()), "site long, key string")
    a, b = rows(s0), rows(s1)
    x, y = (frame(spark, t, "key string, t long") for t in (t0, t1))
    out = I.refresh_lookups(least(a, x), b, y, I.signed(a, b), [("key", I.signed(x, y).select("key"))],
                            site_key=["site"], target_key="key", resolve=least)
    assert bag(out.rows) == bag(least(b, y))
    touched = {i for i, k in s1.items() if k == "p" or s0.get(i, "new") != k}
    assert {r.site for r in out.upserts.collect()} == touched
    assert {r.site for r in out.gone.collect()} == touched | {3}
