"""From source text to gold tables on a small project of our own (tests/javasrc/shop)."""

import os

import pytest
from pyspark.sql import functions as F

from wirefold.plans import gold
from wirefold.sources.files import read_sources
from wirefold.sources.java_facts import extract_facts

ROOT = os.path.join(os.path.dirname(__file__), "javasrc", "shop")


def short(x):
    return x.split(".")[-1] if x else x


@pytest.fixture(scope="module")
def sources(spark):
    return read_sources(spark, ROOT, repo="shop", snapshot="s1").cache()


@pytest.fixture(scope="module")
def prod(sources):
    facts = extract_facts(sources.where(F.col("source_set") == "production")).cache()
    return facts, gold.split_facts(facts)


def test_selection_and_parse_failures(sources, prod):
    sets = {r.path: r.source_set for r in sources.select("path", "source_set").collect()}
    assert "build/gen/Ghost.java" not in sets            # excluded files are never read
    assert sets["src/test/java/com/shop/AppTest.java"] == "test"
    facts, _ = prod
    fails = [(r.path, r.reason) for r in facts.where("fact_kind = 'parse_failures'").collect()]
    assert len(fails) == 1 and fails[0][0].endswith("Broken.java") and fails[0][1].startswith("line 4")


def test_endpoints(prod):
    _, f = prod
    e = gold.endpoints(f)
    eps = {(r.http_method, r.path_pattern, short(r.fqcn), r.method_name) for r in e.endpoints.collect()}
    assert eps == {
        ("GET", "/health", "HealthController", "health"),
        ("ANY", "/legacy", "HealthController", "legacy"),
        ("GET", "/api/orders", "OrderController", "list"),
        ("GET", "/api/orders/{id}", "OrderController", "get"),          # own-class constant
        ("GET", "/api/orders/items", "OrderController", "items"),       # static import
        ("POST", "/api/orders/items", "OrderController", "items"),
        ("POST", "/api/orders/raw", "OrderController", "raw"),          # qualified constant
        ("GET", "/api/orders/special", "OrderController", "special"),
        ("GET", "/v2/ping", "PingController", "ping"),                  # own prefix beats the interface's
        ("DELETE", "/v2/ping/{id}", "PingController", "drop"),
    }
    unres = {(short(r.location.split("#")[0]) + ("#" + r.location.split("#")[1] if "#" in r.location else ""),
              r.reason) for r in e.unresolved.collect()}
    assert unres == {("OrderController#shadow", "constant-reference"),
                     ("OrderController#computed", "non-literal-expression"),
                     ("OrderController#files", "unsupported-pattern"),
                     ("GenController", "interface-mappings-not-found")}
    reqs = f.types.sparkSession.createDataFrame(
        [("shop", "s1", 1, "get", "/api/orders/42"), ("shop", "s1", 2, "GET", "/api/orders/special"),
         ("shop", "s1", 3, "DELETE", "/legacy"), ("shop", "s1", 4, "GET", "/api/order/42"),
         ("other", "s1", 5, "GET", "/health")],
        "repo string, snapshot string, request_id int, verb string, path string")
    got = {r.request_id: r.path_pattern for r in gold.resolve_requests(reqs, e.endpoints).collect()}
    assert got == {1: "/api/orders/{id}", 2: "/api/orders/special", 3: "/legacy", 4: None, 5: None}


def test_beans_and_edges(prod):
    _, f = prod
    b = gold.beans(f)
    beans = {short(r.fqcn): (r.stereotype, r.terminal) for r in b.beans.collect()}
    assert beans["Repo"] == ("JpaRepository", True) and beans["BaseRepo"] == ("JpaRepository", True)
    assert beans["RateLimiter"] == ("Bean", False)
    assert beans["OrderController"] == ("RestController", False)
    assert "Helper" not in beans and "Gateway" not in beans
    edges = {(short(r.bean), r.field_name): (r.status, r.kind or r.reason, short(r.target))
             for r in b.edges.collect()}
    assert edges[("OrderService", "repo")] == ("resolved", "terminal", "Repo")
    assert edges[("OrderService", "greeting")] == ("resolved", "single-implementation", "DefaultGreeting")
    assert edges[("OrderService", "gateway")] == ("resolved", "qualifier", "FastGateway")
    assert edges[("OrderService", "anyGateway")] == ("resolved", "primary", "SlowGateway")
    assert edges[("OrderService", "formats")] == ("resolved", "collection", None)
    assert edges[("OrderService", "formatsById")] == ("unresolved", "collection-injection", None)
    assert edges[("OrderService", "format")] == ("unresolved", "multiple-candidates", None)
    assert edges[("OrderService", "cache")] == ("unresolved", "conditional-candidates", None)
    assert edges[("OrderService", "verifier")] == ("unresolved", "no-implementation-found", None)
    assert edges[("OrderService", "helper")] == ("unresolved", "not-a-scanned-bean", None)
    assert edges[("RateLimiter", "repo")] == ("resolved", "terminal", "Repo")   # factory parameter
    assert ("OrderService", "name") not in edges and ("OrderService", "retries") not in edges
    assert ("OrderService", "clock") not in edges
    assert b.edges.where((F.col("bean").endswith("RateLimiter"))).count() == 2   # params only


def test_transactions(prod):
    _, f = prod
    tx, si = gold.transactions(f)
    got = {(short(r.fqcn), r.method): (r.transactional, r.source, r.dead) for r in tx.collect()}
    assert got[("TxService", "secret")] == (True, "method", True)
    assert got[("TxService", "validate")] == (False, "none", False)
    assert sorted((r.caller, r.callee) for r in si.collect()) == [("place", "audit"), ("validate", "audit")]


def test_test_roles(sources):
    tf = gold.split_facts(extract_facts(sources.where(F.col("source_set") == "test")))
    roles, unres = gold.test_roles(tf)
    got = {(short(r.test_fqcn), r.nested_scope, r.field_name, short(r.type_fqcn), r.role, r.kind, r.scope)
           for r in roles.collect()}
    assert got == {
        ("AppTest", None, "gateway", "Gateway", "mocked", "MOCKITO_BEAN", None),
        ("AppTest", None, None, "Gateway", "static", None, "t"),
        ("OrderServiceTest", None, "gateway", "Gateway", "mocked", "MOCK", None),
        ("OrderServiceTest", None, "service", "OrderService", "real", None, None),
        ("OrderServiceTest", "WhenEmpty", "format", "Format", "mocked", "MOCK", None),
        ("OrderServiceTest", None, "direct", "Format", "mocked", "MOCK_CALL", None),
    }
    assert sorted(r.reason[:24] for r in unres.collect()) == ["annotation @Mock does no",
                                                              "mockStatic argument is n"]


def test_slice_info(sources):
    tf = gold.split_facts(extract_facts(sources.where(F.col("source_set") == "test")))
    got = {short(r.test_fqcn): (r.is_context, list(r.extend_with), [a.split("(")[0] for a in r.class_annotations])
           for r in gold.test_classes(tf).collect()}
    assert got["AppTest"] == (True, [], ["@SpringBootTest"])
    assert got["OrderServiceTest"] == (False, ["com.shop.MockitoExtension"], ["@ExtendWith"])


def test_sink_overwrites_one_snapshot(spark, tmp_path):
    out = str(tmp_path / "gold")
    a = spark.createDataFrame([("r", "s1", 1), ("r", "s2", 2)], "repo string, snapshot string, v int")
    gold.write_partitioned(a, out)
    gold.write_partitioned(spark.createDataFrame([("r", "s2", 3)], "repo string, snapshot string, v int"), out)
    assert sorted((r.snapshot, r.v) for r in spark.read.parquet(out).collect()) == [("s1", 1), ("s2", 3)]


def test_trace_dependents_and_status(spark, sources, prod):
    facts, f = prod
    e = gold.endpoints(f)
    b = gold.beans(f)
    reqs = spark.createDataFrame([("shop", "s1", 1, "GET", "/api/orders")],
                                 "repo string, snapshot string, request_id int, verb string, path string")
    t = gold.trace_requests(reqs, e, b)
    steps = sorted((r.step_order, short(r.src.split("\u0001")[-1]), short(r.dst.split("\u0001")[-1]), r.depth)
                   for r in t.steps.collect())
    got = [(s, d, dep) for _, s, d, dep in steps]
    assert got[0] == ("OrderController", "OrderService", 1)
    assert ("OrderService", "Csv", 2) in got and ("OrderService", "Json", 2) in got   # collection fans out
    assert ("TxService", "TxService", 3) in got                                        # step to a visited node
    assert {short(r.node.split("\u0001")[-1]) for r in t.terminals.collect()} == {"Repo"}
    assert {r.truncated for r in t.truncated.collect()} == {False}
    t1 = gold.trace_requests(reqs, e, b, max_depth=1)
    assert {r.truncated for r in t1.truncated.collect()} == {True}
    dq = spark.createDataFrame([("shop", "s1", "com.shop.service.Gateway"), ("shop", "s1", "com.shop.service.Csv")],
                               "repo string, snapshot string, type_fqcn string")
    dep = {(short(r.type_fqcn), short(r.bean), r.via) for r in gold.dependents_of(dq, b).collect()}
    assert ("Gateway", "OrderService", "declared-type") in dep and ("Gateway", "DefaultGreeting", "declared-type") in dep
    assert ("Csv", "OrderService", "candidate") in dep
    files = sources.where(F.col("source_set") == "production")
    st = {(r.metric, r.reason): r.n for r in gold.index_status(f, e, b, files).collect()}
    assert st[("endpoints", None)] == 10 and st[("parse_failures", None)] == 1
    assert st[("unresolved_mappings", "constant-reference")] == 1
    assert st[("unresolved_sites", "no-implementation-found")] == 2


def test_two_repos_with_the_same_fqcn_never_mix(spark):
    r1 = read_sources(spark, ROOT, repo="r1", snapshot="s")
    r2 = read_sources(spark, ROOT, repo="r2", snapshot="s").where(
        ~F.col("path").contains("HealthController"))
    facts = extract_facts(r1.unionByName(r2).where(F.col("source_set") == "production"))
    f = gold.split_facts(facts)
    e = gold.endpoints(f)
    reqs = spark.createDataFrame([("r1", "s", 1, "GET", "/health"), ("r2", "s", 2, "GET", "/health"),
                                  ("r2", "s", 3, "GET", "/api/orders/7")],
                                 "repo string, snapshot string, request_id int, verb string, path string")
    got = {r.request_id: r.status for r in gold.resolve_requests(reqs, e.endpoints).collect()}
    assert got == {1: "resolved", 2: "miss", 3: "resolved"}


STEREO = "import org.springframework.stereotype.*;\nimport org.springframework.beans.factory.annotation.*;\n"


def test_members_qualifiers_and_names_of_beans(spark):
    """Same FQCN in two files (scope d), qualifiers on parameters and their written form (q), explicit
    names by the stereotype list (n); one job over three snapshots."""
    impl = "package {0};\n" + STEREO + "{3}@Service(\"{2}\") class {1} implements G {{}}"
    files = {
        ("d", "m1/S.java"): f"package p;\n{STEREO}@Service class S {{ A a; }}",
        ("d", "m2/S.java"): f"package p;\n{STEREO}@Service class S {{ B b; }}",
        ("d", "A.java"): f"package p;\n{STEREO}@Service class A {{}}", ("d", "B.java"): f"package p;\n{STEREO}@Service class B {{}}",
        ("q", "G.java"): "package q;\ninterface G {}", ("q", "X.java"): "package q;\nclass X {}",
        ("q", "F1.java"): impl.format("q", "F1", "one", ""), ("q", "F2.java"): impl.format("q", "F2", "two", ""),
        ("q", "C.java"): "package q;\nimport org.springframework.context.annotation.*;\n" + STEREO
                         + "@Configuration class C { @Bean X x(@Qualifier(\"two\") G g) { return null; } }",
        ("q", "U.java"): f"package q;\n{STEREO}@Service class U {{ @Qualifier(\"one\") G a; @Qualifier(value = \"one\") G b; }}",
        ("n", "G.java"): "package n;\ninterface G {}", ("n", "A.java"): impl.format("n", "A", "early", "@Component(\"late\") "),
        ("n", "B.java"): f"package n;\n{STEREO}@Service class B implements G {{}}",
        ("n", "U.java"): f"package n;\n{STEREO}@Service class U {{ @Qualifier(\"early\") G g; @Qualifier(\"late\") G h; }}"}
    rows = [("r", s, p, c) for (s, p), c in files.items()]
    src = spark.createDataFrame(rows, "repo string, snapshot string, path string, content string")
    edges = gold.beans(gold.split_facts(extract_facts(src))).edges.collect()
    got = {(e.bean, e.field_name): (e.kind, e.reason, e.target) for e in edges}
    assert got == {("p.S", "b"): ("concrete", None, "p.B"), ("q.X", "g"): ("qualifier", None, "q.F2"),
                   ("q.U", "a"): ("qualifier", None, "q.F1"), ("q.U", "b"): (None, "multiple-candidates", None),
                   ("n.U", "g"): ("qualifier", None, "n.A"), ("n.U", "h"): (None, "multiple-candidates", None)}
