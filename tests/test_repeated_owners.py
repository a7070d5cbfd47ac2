"""Several files with one FQCN, inherited mappings and factory methods: one repository per case, all
worked out in one run."""

import collections

import pytest

from wirefold.plans import gold
from wirefold.sources.java_facts import extract_facts

CASES = {
    "twice": {
        "m1/E.java": 'package p;\n@RestController class E {\n  @GetMapping("/a") void a() {}\n}',
        "m2/E.java": 'package p;\n@RestController class E {\n\n  @GetMapping("/b") void b() {}\n}'},
    "imports": {  # a constant is looked up from its own file; the last declaration of a constant counts
        "m1/E.java": 'package p;\nimport static q.K.ONE;\n@RestController class E {\n  @GetMapping(ONE) void a() {}\n}',
        "m2/E.java": 'package p;\nimport static q.K.TWO;\n@RestController class E {\n  @GetMapping(TWO) void a() {}\n'
                     '  @GetMapping(ONE) void b() {}\n}',
        "k1/K.java": 'package q;\nclass K {\n  static final String ONE = "/one-old";\n  static final String TWO = "/two";\n}',
        "k2/K.java": 'package q;\nclass K {\n  static final String ONE = "/one";\n}'},
    "handler": {
        "c/Ctl.java": '@RestController class Ctl implements Api { public void ping() {} }',
        "i/Api.java": 'interface Api {\n\n\n\n\n  @GetMapping("/ping") void ping();\n\n\n'
                      '  @GetMapping("/extra") default void extra() {}\n}'},
    "rejects": {
        "Ctl.java": '@RestController class Ctl implements Api, Other, Gone {\n  public void ok() {}\n}',
        "Api.java": 'interface Api {\n  @GetMapping(Far.AWAY) void lost();\n  @GetMapping("/ok") void ok();\n'
                    '  @GetMapping("/star/*") void star();\n}',
        "Other.java": '@RequestMapping(path())\ninterface Other {\n  @GetMapping("/never") void never();\n}'},
    "missing": {"Ctl.java": '\n@RestController class Ctl implements Gone {}'},
    "factory": {
        "a/One.java": 'package p;\n@Configuration class One {\n  @Bean Thing thing(Left left) { return null; }\n'
                      '  @Bean Both both(Left left) { return null; }\n}',
        "b/Two.java": 'package p;\n@Configuration class Two {\n  @Bean Thing other(Right right) { return null; }\n}',
        "t/Thing.java": 'package p;\nclass Thing {}',
        "t/Both.java": 'package p;\n@Service class Both {\n  private Right right;\n}',
        "t/Left.java": 'package p;\n@Service class Left {}',
        "t/Right.java": 'package p;\n@Service class Right {}'},
    "universe": {
        "m1/D.java": 'package p;\n@Service class D {\n  private X first;\n}',
        "m2/D.java": 'package p;\nclass D {\n  private X second;\n}',
        "x/X.java": 'package p;\n@Component class X {}'},
}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(repo, "s", path, text) for repo, files in CASES.items() for path, text in files.items()]
    sources = spark.createDataFrame(rows, "repo string, snapshot string, path string, content string")
    return gold.split_facts(extract_facts(sources).cache())


def by_repo(df, *cols):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.repo].append(tuple(r[c] for c in cols))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_endpoints_and_rejects(facts):
    e = gold.endpoints(facts)
    eps = by_repo(e.endpoints, "path_pattern", "method_name", "path", "line")
    assert eps == {
        "twice": [("/a", "a", "m1/E.java", 3), ("/b", "b", "m2/E.java", 4)],
        "imports": [("/one", "a", "m1/E.java", 4), ("/two", "a", "m2/E.java", 4)],
        "handler": [("/extra", "extra", "i/Api.java", 9), ("/ping", "ping", "c/Ctl.java", 1)],
        "rejects": [("/ok", "ok", "Ctl.java", 2)],
    }
    assert by_repo(e.unresolved, "path", "line", "location", "reason") == {
        "imports": [("m2/E.java", 5, "p.E#b", "constant-reference")],
        "rejects": [("Api.java", 2, "Ctl#lost", "constant-reference"), ("Api.java", 4, "Ctl#star", "unsupported-pattern"),
                    ("Other.java", 1, "Ctl", "non-literal-expression")],
        "missing": [("Ctl.java", 2, "Ctl", "interface-mappings-not-found")],
    }


def test_beans_and_sites(facts):
    b = gold.beans(facts)
    beans = by_repo(b.beans, "fqcn", "stereotype", "path")
    assert beans["factory"] == [("p.Both", "Service", "t/Both.java"), ("p.Left", "Service", "t/Left.java"),
                                ("p.One", "Configuration", "a/One.java"), ("p.Right", "Service", "t/Right.java"),
                                ("p.Thing", "Bean", "a/One.java"), ("p.Two", "Configuration", "b/Two.java")]
    assert beans["universe"] == [("p.D", "Service", "m1/D.java"), ("p.X", "Component", "x/X.java")]
    edges = by_repo(b.edges, "bean", "field_name", "target")
    assert edges["factory"] == [("p.Both", "right", "p.Right"), ("p.Thing", "left", "p.Left")]
    assert edges["universe"] == [("p.D", "second", "p.X")]  # members of the type table's entry
