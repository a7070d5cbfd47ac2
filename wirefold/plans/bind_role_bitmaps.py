"""Role bitmaps bound to the driver tables: the tests and types of ``bind_tx_roles``, eight users to a repository."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import role_bitmaps as B
from wirefold.plans.bind_tx_roles import _annotations
from wirefold.plans.registry import ORACLE, query, table


def _scoped(spark, sf_dir, types: int):
    """Requested types, role rows and context tests, each with its repository."""
    repo = lambda user: F.floor(F.col(user) / 8).alias("repo")
    ev = table(spark, sf_dir, "events").select("*", repo("user_id"))
    req = ev.select("repo", F.concat(F.lit("T"), (F.col("event_id") % types).cast("string")).alias("type_fqcn"))
    ctx = ev.where(F.col("user_id") % 2 == 0).select("repo", F.col("user_id").alias("test"))
    return req, _annotations(spark, sf_dir).select("*", repo("test")), ctx


@query("role_bitmap_counts", ORACLE["role_usage_request"])
def q_role_bitmap_counts(spark, sf_dir):
    """testDoubleUsage by bitmaps: tests per role and unclassified ones."""
    req, roles, ctx = _scoped(spark, sf_dir, 40)
    return B.usage_counts(req, roles, ctx, type_col="type_fqcn", role="role", test="test", keys=["repo"])


@query("unclassified_bitmaps", ORACLE["unclassified_context"])
def q_unclassified_bitmaps(spark, sf_dir):
    """Context tests that mention a requested type in no role, as a complement of bitmaps, listed."""
    req, roles, ctx = _scoped(spark, sf_dir, 37)
    names = {"test": "test", "keys": ["repo"]}
    roles = roles.where(F.col("role").isNotNull())
    numbers = B.test_numbers(roles, ctx, **names)
    bitmaps = B.role_bitmaps(roles, numbers, type_col="type_fqcn", role="role", **names)
    free = B.unclassified_bitmaps(req, ctx, bitmaps, numbers, type_col="type_fqcn", **names)
    return B.tests_of(free, numbers, **names).select("type_fqcn", "test")
