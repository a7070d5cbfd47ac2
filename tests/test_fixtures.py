"""Fact-row fixtures replaying the odd cases of the reference's sample project (our own rows)."""

from pyspark.sql import functions as F

from wirefold.operators import boundaries as B
from wirefold.operators import candidates as C
from wirefold.operators import snapshots as S
from wirefold.sources.files import source_set


def test_file_selection(spark):
    cases = {
        "src/main/java/com/example/A.java": "production",
        "src/main/java/com/example/test/A.java": "production",
        "src/main/resources/application.properties": "excluded",
        "README.md": "excluded",
        "build/generated/x/Gen.java": "excluded",
        "target/x/Y.java": "excluded",
        "out/Y.java": "excluded",
        "bin/Y.java": "excluded",
        "frontend/node_modules/x/Y.java": "excluded",
        ".git/objects/Fake.java": "excluded",
        ".git/src/test/Fake.java": "excluded",
        ".idea/Y.java": "excluded",
        "src/test/java/a/ATest.java": "test",
        "src/integrationTest/java/a/B.java": "test",
        "src/testFixtures/java/a/C.java": "test",
        "src/test/java/build/Fake.java": "excluded",
        "A.java": "production",
        "test/src/A.java": "production",
    }
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    got = {r.path: r.s for r in df.select("path", source_set("path").alias("s")).collect()}
    assert got == cases


def test_candidate_ladder_cases(spark):
    # contract -> candidates (name, order, primary, conditional)
    cands = spark.createDataFrame([
        ("Greeting", "DefaultGreeting", "defaultGreeting", 1, False, False),
        ("Gateway", "Stripe", "stripe", 1, True, False),
        ("Gateway", "MockGateway", "mockGateway", 2, False, False),
        ("Export", "Csv", "csv", 1, False, False),
        ("Export", "Json", "json", 2, False, False),
        ("Cache", "InMemory", "inMemory", 1, False, True),
        ("Cache", "Redis", "redis", 2, False, True),
        ("Solo", "OnlyProfiled", "onlyProfiled", 1, False, True),
    ], "contract string, cand string, name string, ord int, prim boolean, cond boolean")
    sites = spark.createDataFrame([
        (1, "Greeting", None), (2, "Gateway", None), (3, "Gateway", "mockGateway"),
        (4, "Export", None), (5, "Cache", None), (6, "Verifier", None),
        (7, "Greeting", "nope"), (8, "Solo", None)],
        "site int, contract string, qualifier string")
    out = C.resolve_candidate(sites, cands, contract="contract", qualifier="qualifier",
                              cand_contract="contract", cand_id="cand", cand_name="name",
                              cand_order="ord", primary="prim", conditional="cond")
    got = {r.site: (r.status, r.kind or r.reason, r.target) for r in out.collect()}
    assert got == {
        1: ("resolved", "single-implementation", "DefaultGreeting"),
        2: ("resolved", "primary", "Stripe"),
        3: ("resolved", "qualifier", "MockGateway"),
        4: ("unresolved", "multiple-candidates", None),
        5: ("unresolved", "conditional-candidates", None),
        6: ("unresolved", "no-implementation-found", None),
        7: ("unresolved", "multiple-candidates", None),   # a wrong qualifier, even with one candidate
        8: ("unresolved", "conditional-candidates", None),  # a sole @Profile candidate
    }
    assert out.count() == sites.count()  # conservation


def test_collection_sites(spark):
    impls = spark.createDataFrame([("Format", "Csv", 1), ("Format", "Json", 2)],
                                  "contract string, bean string, bean_ord int")
    sites = spark.createDataFrame([
        (1, "List", ["Format"]), (2, "Set", ["Format"]), (3, "Map", ["String", "Format"]),
        (4, "Map", ["Long", "Format"]), (5, "List", ["Verifier"]), (6, "List", [])],
        "site int, container string, args array<string>")
    out = C.resolve_collection(sites, impls, container="container", type_args="args")
    got = {}
    for r in out.collect():
        got.setdefault(r.site, set()).add((r.status, r.kind or r.reason, r.candidate))
    assert got[1] == got[2] == got[3] == {("resolved", "collection", "Csv"), ("resolved", "collection", "Json")}
    assert got[4] == {("unresolved", "collection-injection", None)}
    assert got[5] == {("unresolved", "no-implementation-found", None)}
    assert got[6] == {("unresolved", "collection-injection", None)}


def test_transaction_flags_and_self_calls(spark):
    methods = spark.createDataFrame([
        ("OrderTx", "place", True, False), ("OrderTx", "audit", True, False),
        ("OrderTx", "validate", False, False), ("OrderTx", "notifyAll2", False, False),
        ("OrderTx", "secret", True, True), ("TxClass", "save", False, False),
        ("TxClass", "load", False, False), ("TxClass", "helper", False, True)],
        "cls string, name string, own boolean, priv boolean")
    owners = spark.createDataFrame([("OrderTx", False), ("TxClass", True)], "cls string, class_level boolean")
    f = B.effective_flag(methods, owners, member_owner="cls", owner_id="cls", own="own",
                         inherited="class_level", excluded="priv")
    got = {(r.cls, r.name): (r.transactional, r.source, r.dead) for r in f.collect()}
    assert got[("OrderTx", "secret")] == (True, "method", True)
    assert got[("OrderTx", "validate")] == (False, "none", False)
    assert got[("TxClass", "save")] == (True, "class", False)
    assert got[("TxClass", "helper")] == (False, "none", False)
    calls = spark.createDataFrame([
        ("OrderTx", "place", "audit", "none"), ("OrderTx", "notifyAll2", "audit", "this"),
        ("OrderTx", "place", "validate", "none"), ("OrderTx", "audit", "audit", "none"),
        ("OrderTx", "place", "audit", "other")], "cls string, caller string, callee string, recv string")
    si = B.self_invocation(calls, f, owner="cls", caller="caller", callee="callee", receiver="recv",
                           member_name="name")
    assert sorted((r.caller, r.callee) for r in si.collect()) == [("notifyAll2", "audit"), ("place", "audit")]


def test_snapshot_diff_and_fingerprint(spark):
    old = spark.createDataFrame([("A.java", 10, 1), ("B.java", 5, 1), ("T.java", 3, 1)],
                                "path string, size long, mtime long")
    new = spark.createDataFrame([("A.java", 11, 2), ("C.java", 4, 2), ("T.java", 3, 1)],
                                "path string, size long, mtime long")
    got = {r.path: r.change for r in S.snapshot_diff(old, new, key=["path"],
                                                     fingerprint=["size", "mtime"]).collect()}
    assert got == {"A.java": "modified", "B.java": "deleted", "C.java": "added", "T.java": "unchanged"}
    files = spark.createDataFrame([
        ("v1", "production", "A.java", 10, 1), ("v1", "test", "T.java", 3, 1),
        ("v2", "production", "A.java", 11, 2), ("v2", "test", "T.java", 3, 1)],
        "v string, source_set string, path string, size long, mtime long")
    fp = {(r.v, r.source_set): r.fingerprint for r in
          S.snapshot_fingerprint(files, group=["v", "source_set"], fields=["path", "size", "mtime"]).collect()}
    assert fp[("v1", "test")] == fp[("v2", "test")]          # a production edit leaves tests alone
    assert fp[("v1", "production")] != fp[("v2", "production")]


def test_retention_and_root_kind(spark):
    gens = spark.createDataFrame([("main", "c1", 1), ("main", "c2", 2), ("main", "c3", 3)],
                                 "ref string, sha string, t long")
    kept = S.retain_generations(gens, group=["ref"], recency=[F.col("t")], keep=2)
    assert sorted(r.sha for r in kept.collect()) == ["c2", "c3"]
    roots = spark.createDataFrame([("/w/default",), ("/w/other",), ("/w/.refs/abc",)], "p string")
    got = {r.p: r.k for r in roots.select("p", S.root_kind("p", default="/w/default",
                                                               refs_base="/w/.refs/").alias("k")).collect()}
    assert got == {"/w/default": "default", "/w/other": "root", "/w/.refs/abc": "ref"}


def test_partition_independence(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL

    keys = ["route_resolve", "resolve_candidate", "reach", "ref_asof", "dependents"]
    res = {}
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        res[parts] = {k: sorted(map(repr, E.queries()[k](spark, SF_SMALL).collect())) for k in keys}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res["1"] == res["8"]


def test_asof_join_carries_across_buckets(spark):
    import datetime as dt
    import random

    rnd = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    left, right = [], []
    for i in range(200):
        left.append((i, rnd.randrange(4), base + dt.timedelta(seconds=rnd.randrange(60))))
    for j in range(60):
        right.append((1000 + j, rnd.randrange(4), base + dt.timedelta(seconds=rnd.randrange(60))))
    right.append((5000, 0, left[0][2]))  # a right row at exactly a left row's instant counts
    ldf = spark.createDataFrame(left, "id long, k long, ts timestamp")
    rdf = spark.createDataFrame(right, "rid long, k long, ts timestamp")
    for bucket in (1, 7, 3600):
        out = S.asof_join(ldf, rdf, key=["k"], left_ts="ts", right_ts="ts", left_id="id",
                          right_cols=["rid"], right_order="rid", bucket_seconds=bucket)
        got = {r.id: r.rid for r in out.collect()}
        for i, k, ts in left:
            cands = [(rts, rid) for rid, rk, rts in right if rk == k and rts <= ts]
            want = max(cands)[1] if cands else None
            assert got[i] == want, (bucket, i)


def test_reason_rollup(spark):
    edges = spark.createDataFrame([("a", "unresolved", "x"), ("a", "unresolved", "y"),
                                   ("b", "unresolved", "x"), ("b", "resolved", None)],
                                  "repo string, status string, reason string")
    got = {(r.repo, r.reason): r.n for r in C.unresolved_by_reason(edges, keys=["repo"], rollup=True).collect()}
    assert got[("a", "x")] == 1 and got[("a", None)] == 2 and got[(None, None)] == 3
