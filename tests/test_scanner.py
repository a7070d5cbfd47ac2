"""The declaration-level scanner on syntax that must not fail a file (pure Python, fast)."""

from collections import Counter

from wirefold.sources.java_facts import scan_source

MODERN = r'''
package com.acme.modern;

import java.util.*;
import static java.util.Map.entry;

@RestController
@RequestMapping(path = "/modern", produces = {"application/json"})
public sealed class ModernController permits ModernController.Sub {
    @Value("${x:1}") private int x;
    private final Map<String, List<? extends Number>> data = new HashMap<>();
    private static final char C = '{';
    private static final String BLOCK = """
        { "a": "}" }
        """;

    @GetMapping
    public <T extends Comparable<T>> String describe(Object o, @RequestParam(required = false) T t) {
        String r = switch (o) {
            case Integer i when i > 3 -> "big";
            case String s -> { yield "s" + s; }
            default -> "other";
        };
        if (o instanceof Map<?, ?> m && !m.isEmpty()) { r = r + m.size(); }
        int[] arr = new int[]{1, 2};
        var list = List.of(1, 2, 3);
        list.forEach(v -> helper(v));
        Runnable run = new Runnable() { @Override public void run() { helper(1); } };
        return r + C + BLOCK;
    }

    void helper(int v) {}

    public static final class Sub extends ModernController {}

    public enum Kind { A("a") { void f() {} }, B("b"); Kind(String s) {} void f() {} }

    public record Point(@JsonProperty("x") int x, int y) implements Comparable<Point> {
        public Point { if (x < 0) throw new IllegalArgumentException(); }
        public int compareTo(Point o) { return 0; }
    }

    @interface Marker { String value() default "m"; int[] nums() default {1, 2}; }

    static { System.out.println("init"); }
    { x = 2; }
}
'''


def test_modern_syntax_is_scanned():
    rows = scan_source("Modern.java", MODERN)
    kinds = Counter(r["fact_kind"] for r in rows)
    assert kinds["parse_failures"] == 0
    types = {r["fqcn"]: r["is_annotation"] for r in rows if r["fact_kind"] == "types"}
    assert types == {"com.acme.modern.ModernController": False,
                     "com.acme.modern.ModernController.Sub": False,
                     "com.acme.modern.ModernController.Marker": True}   # records and enums are skipped
    fields = {r["name"]: r.get("init_kind") for r in rows if r["fact_kind"] == "fields"}
    assert fields == {"x": None, "data": "new", "C": "other", "BLOCK": "string_literal"}
    calls = [(r["callee"], r["receiver"]) for r in rows if r["fact_kind"] == "calls"]
    assert calls.count(("helper", "none")) == 2        # inside a lambda and an anonymous class
    ann = [r for r in rows if r["fact_kind"] == "annotation_values" and r["owner_id"].endswith("Controller")]
    assert ("path", "literal", "/modern") in {(a["attr"], a["expr_kind"], a["expr_text"]) for a in ann}


def test_broken_file_is_one_failure_row():
    rows = scan_source("Bad.java", "package a;\nclass Bad {\n  void f( {\n}\n")
    assert len(rows) == 1 and rows[0]["fact_kind"] == "parse_failures"
    assert rows[0]["reason"].startswith("line 3")


def test_unterminated_comment_and_string_fail_cleanly():
    for text in ("class A { /* never closed }", 'class A { String s = "open; }'):
        rows = scan_source("X.java", text)
        assert [r["fact_kind"] for r in rows] == ["parse_failures"]


def test_cut_off_generics_are_one_failure_row():
    for text in ("class A { <T>", "class A { <", "class A<", "@", "class A { @X("):
        rows = scan_source("X.java", text)
        assert [r["fact_kind"] for r in rows] == ["parse_failures"] and rows[0]["reason"], text
