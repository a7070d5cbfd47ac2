"""Test roles as bitmaps: the tests of a type are bits, and what mentions it in no role is a complement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.operators.ranks import numbered
from wirefold.operators.roles import ROLES

#: Bits of one of Spark's bitmaps: a scope with more tests has a bitmap per so many of them.
BITS = 32_768
_HEX = "0123456789ABCDEF"


def complement(bits: Column) -> Column:
    """All bits of a bitmap turned over, by its hex digits."""
    return F.unhex(F.translate(F.hex(bits), _HEX, _HEX[::-1]))


def test_numbers(roles: DataFrame, context_tests: DataFrame, *, test: str, keys: Sequence[str]) -> DataFrame:
    """``keys, test, block, bit, width``: every test of a scope that has a role or starts a context,
    numbered by name. ``width`` is the number of tests in its block of ``BITS``. Null tests and
    scopes are left out."""
    cols = [*keys, test]
    tests = roles.select(*cols).union(context_tests.select(*cols)).dropna().distinct()
    n = numbered(tests, list(keys), [test], "_n", total="_all").withColumn("_n", F.col("_n") + 1)
    block = F.bitmap_bucket_number("_n")
    return n.select(*cols, block.alias("block"), F.bitmap_bit_position("_n").alias("bit"),
                    F.least(F.col("_all") - (block - 1) * BITS, F.lit(BITS)).alias("width"))


test_numbers.__test__ = False


def role_bitmaps(roles: DataFrame, numbers: DataFrame, *, type_col: str, role: str, test: str,
                 keys: Sequence[str]) -> DataFrame:
    """``keys, type, role, block, tests``: the tests of a type in a role as one bitmap per block.
    Repeated mentions set the same bit; a type named by most tests is folded before the shuffle and
    leaves one bitmap per task. Rows without role, type, test or scope say nothing."""
    by = [*keys, type_col, role]
    rows = roles.select(*by, test).dropna().join(numbers, [*keys, test])
    return rows.groupBy(*by, "block").agg(F.bitmap_construct_agg("bit").alias("tests"))


def unclassified_bitmaps(requested: DataFrame, context_tests: DataFrame, bitmaps: DataFrame, numbers: DataFrame, *,
                         type_col: str, test: str, keys: Sequence[str]) -> DataFrame:
    """``keys, type, block, width, tests``: context tests of the scope that mention a requested type in
    no role: the context bits and the complement of all its roles' bits. Rows are requested types x
    blocks of ``BITS`` tests, never types x tests; a block without context tests has no row, and one
    whose context tests are all classified has an empty bitmap."""
    by = [*keys, type_col]
    req = requested.select(*by).dropna().distinct()
    ctx = (context_tests.select(*keys, test).dropna().distinct().join(numbers, [*keys, test])
           .groupBy(*keys, "block").agg(F.bitmap_construct_agg("bit").alias("_ctx"), F.max("width").alias("width")))
    named = (bitmaps.join(req, by, "left_semi").groupBy(*by, "block")
             .agg(complement(F.bitmap_or_agg("tests")).alias("_free")))
    both = req.join(ctx, list(keys)).join(named, [*by, "block"], "left")
    both = both.select(*by, "block", "width", F.explode(F.array("_ctx", F.coalesce("_free", "_ctx"))).alias("_bits"))
    return both.groupBy(*by, "block", "width").agg(F.bitmap_and_agg("_bits").alias("tests"))


def tests_of(bitmaps: DataFrame, numbers: DataFrame, *, test: str, keys: Sequence[str]) -> DataFrame:
    """One row per set bit of ``bitmaps`` (``keys, ..., block, width, tests``): its other columns and ``test``."""
    rest = [c for c in bitmaps.columns if c not in ("width", "tests")]
    byte = lambda i: F.substring(F.col("tests"), i, F.lit(1))
    filled = F.filter(F.sequence(F.lit(1), F.ceil(F.col("width") / 8).cast("int")),
                      lambda i: byte(i) != F.lit(bytes(1)))
    each = (bitmaps.select(*rest, "tests", F.explode(filled).alias("_at"))
            .select(*rest, "_at", F.conv(F.hex(byte(F.col("_at"))), 16, 10).cast("int").alias("_v")))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.getbit(F.col("_v"), j) == 1)
    bits = each.select(*rest, F.explode(set_bits).alias("_j"), "_at")
    bits = bits.select(*rest, ((F.col("_at") - 1) * 8 + F.col("_j")).cast("long").alias("bit"))
    return bits.join(numbers.drop("width"), [*keys, "block", "bit"]).select(*rest, test).drop("block")


def usage_counts(requested: DataFrame, roles: DataFrame, context_tests: DataFrame, *, type_col: str, role: str,
                 test: str, keys: Sequence[str]) -> DataFrame:
    """``keys, type, bucket, n_tests`` of requested types: how many tests use it in each of the three
    roles, and how many context tests of the scope in none (``unclassified``). A type that no test
    names has three empty buckets and every context test unclassified."""
    by = [*keys, type_col]
    names = {"type_col": type_col, "test": test, "keys": keys}
    numbers = test_numbers(roles.where(F.col(role).isNotNull()), context_tests, test=test, keys=keys)
    bitmaps = role_bitmaps(roles, numbers, role=role, **names)
    size = F.sum(F.bitmap_count("tests")).alias("n_tests")
    used = bitmaps.groupBy(*by, F.col(role).alias("bucket")).agg(size)
    free = (unclassified_bitmaps(requested, context_tests, bitmaps, numbers, **names)
            .groupBy(*by, F.lit("unclassified").alias("bucket")).agg(size))
    buckets = F.array(*map(F.lit, [*ROLES, "unclassified"]))
    asked = requested.select(*by).dropna().distinct().withColumn("bucket", F.explode(buckets))
    return asked.join(used.unionByName(free), [*by, "bucket"], "left").fillna(0, ["n_tests"])
