"""Role bitmaps against sets of tests."""

import random

import pytest

from wirefold.operators import role_bitmaps as B

NAMES = {"test": "test", "keys": ["repo"]}


def frames(spark, req, roles, ctx):
    return (spark.createDataFrame(req, "repo string, type string"),
            spark.createDataFrame(roles, "repo string, type string, role string, test string"),
            spark.createDataFrame(ctx, "repo string, test string"))


def plain(req, roles, ctx):
    out, free = {}, set()
    for repo, t in set(req):
        if repo is None or t is None:
            continue
        for role in ("real", "mocked", "static"):
            out[repo, t, role] = len({x for r, y, z, x in roles if (r, y, z) == (repo, t, role) and x is not None})
        named = {x for r, y, z, x in roles if (r, y) == (repo, t) and z is not None}
        rest = {x for r, x in ctx if r == repo and x is not None} - named
        out[repo, t, "unclassified"] = len(rest)
        free |= {(repo, t, x) for x in rest}
    return out, free


def listed(req, roles, ctx):
    roles = roles.where("role is not null")
    numbers = B.test_numbers(roles, ctx, **NAMES)
    bitmaps = B.role_bitmaps(roles, numbers, type_col="type", role="role", **NAMES)
    found = B.unclassified_bitmaps(req, ctx, bitmaps, numbers, type_col="type", **NAMES)
    rows = [tuple(r) for r in B.tests_of(found, numbers, **NAMES).select("repo", "type", "test").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def counts(req, roles, ctx):
    got = B.usage_counts(req, roles, ctx, type_col="type", role="role", **NAMES)
    return {(r.repo, r.type, r.bucket): r.n_tests for r in got.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_random_scopes(spark, seed):
    r = random.Random(seed)
    pick = lambda values: r.choice([*values, None])
    repos, types, tests = ["a", "b", "c"], ["T0", "T1", "T2"], [f"t{i}" for i in range(20)]
    roles = [(pick(repos), pick(types), pick(["real", "mocked", "static"]), pick(tests)) for _ in range(150)]
    ctx = [(r.choice(["a", "b"]), pick(tests)) for _ in range(25)]
    req = [(pick([*repos, "z"]), pick([*types, "unknown"])) for _ in range(30)]
    want, free = plain(req, roles, ctx)
    f = frames(spark, req, roles, ctx)
    assert counts(*f) == want
    assert listed(*f) == free


def test_more_tests_than_one_bitmap_holds(spark):
    n = B.BITS + 100
    tests = spark.range(n).selectExpr("'a' as repo", "format_string('t%06d', id) as test", "id")
    roles = tests.where("id % 3 = 0").selectExpr("repo", "'T' as type", "if(id % 2 = 0, 'real', 'mocked') as role", "test")
    ctx = tests.where(f"id % 5 = 0 or id >= {B.BITS}").select("repo", "test")
    req = spark.createDataFrame([("a", "T"), ("a", "none")], "repo string, type string")
    context = [i for i in range(n) if i % 5 == 0 or i >= B.BITS]
    free = [i for i in context if i % 3]
    assert counts(req, roles, ctx) == {
        ("a", "T", "real"): len(range(0, n, 6)), ("a", "T", "mocked"): len(range(3, n, 6)), ("a", "T", "static"): 0,
        ("a", "T", "unclassified"): len(free),
        ("a", "none", "real"): 0, ("a", "none", "mocked"): 0, ("a", "none", "static"): 0,
        ("a", "none", "unclassified"): len(context)}
    assert listed(req, roles, ctx) == ({("a", "T", f"t{i:06}") for i in free} | {("a", "none", f"t{i:06}") for i in context})


def test_empty_tables(spark):
    f = frames(spark, [], [], [])
    assert counts(*f) == {} and listed(*f) == set()
    f = frames(spark, [("a", "T")], [], [])
    assert set(counts(*f).values()) == {0} and listed(*f) == set()
