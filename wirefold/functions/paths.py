"""Column expressions for route paths. All JVM-side (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the endpoint rules.
ANY_METHOD = "ANY"
SUGGESTION_LIMIT = 5
VERB_MISMATCH_PENALTY = 1000


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_path(col) -> Column:
    """Blank -> ''; trim; ensure one leading '/'; strip trailing '/' unless the path is '/'."""
    c = F.trim(_c(col))
    lead = F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c))
    stripped = F.regexp_replace(lead, "(?<=.)/+$", "")
    return F.when(_c(col).isNull() | (c == ""), F.lit("")).otherwise(stripped)


def combine_paths(base, path) -> Column:
    """Class prefix + method path, each normalised; empty result is '/'."""
    joined = F.concat(normalize_path(base), normalize_path(path))
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def url_path(col) -> Column:
    """Path part of an absolute URL, without query string or fragment."""
    return F.regexp_extract(_c(col), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(col) -> Column:
    """Path segments; empty segments (leading, doubled or trailing '/') are dropped."""
    return F.filter(F.split(_c(col), "/"), lambda s: s != "")


def is_var(seg: Column) -> Column:
    """A whole segment written '{...}' is a variable; '{id}.json' is a literal."""
    return seg.startswith("{") & seg.endswith("}")


def var_count(segs) -> Column:
    return F.size(F.filter(_c(segs), is_var))


def verb_matches(route_verb, request_verb) -> Column:
    return (_c(route_verb) == F.lit(ANY_METHOD)) | (_c(route_verb) == _c(request_verb))


def pattern_matches(pattern_segs, path_segs) -> Column:
    """Equal length and every pattern segment is a variable or equal to the path segment."""
    p, q = _c(pattern_segs), _c(path_segs)
    return (F.size(p) == F.size(q)) & F.forall(
        F.zip_with(p, q, lambda a, b: is_var(a) | (a == b)), lambda ok: ok)


def anchor(pattern_segs) -> Column:
    """Join anchor of a pattern: (position, literal) of its first literal segment, (0, '') if none.

    A request probes every (i, segment_i) plus (0, ''), so each pattern is met through exactly one
    equi-join key, and no key collects all patterns of one length.
    """
    p = _c(pattern_segs)
    lits = F.filter(F.transform(p, lambda s, i: F.struct((i + 1).alias("pos"), s.alias("seg"))),
                    lambda t: ~is_var(t["seg"]))
    first = F.element_at(lits, 1)
    return F.when(F.size(lits) > 0, first).otherwise(
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("seg")))


def probes(path_segs) -> Column:
    q = _c(path_segs)
    return F.concat(F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("seg"))),
                    F.transform(q, lambda s, i: F.struct((i + 1).alias("pos"), s.alias("seg"))))


def segment_distance(pattern_segs, path_segs) -> Column:
    """Levenshtein distance over segments; a variable pattern segment matches any segment at cost 0.

    Row-by-row dynamic programme as two nested ``aggregate``s; the outer fold runs over pattern
    segments carrying the previous DP row, the inner one builds the next row left to right.
    """
    p, q = _c(pattern_segs), _c(path_segs)
    n = F.size(q)
    first_row = F.transform(F.array_repeat(F.lit(0), n + 1), lambda _x, j: j)
    pat = F.transform(p, lambda s, i: F.struct(s.alias("s"), (i + 1).alias("i")))
    qq = F.transform(q, lambda s, j: F.struct(s.alias("s"), (j + 1).alias("j")))

    def next_row(prev, ps):
        cost_free = is_var(ps["s"])

        def step(row, qs):
            j = qs["j"]
            cost = F.when(cost_free | (ps["s"] == qs["s"]), F.lit(0)).otherwise(F.lit(1))
            val = F.least(F.element_at(row, -1) + 1,
                          F.element_at(prev, j + 1) + 1,
                          F.element_at(prev, j) + cost)
            return F.concat(row, F.array(val))

        return F.aggregate(qq, F.array(ps["i"]), step)

    return F.element_at(F.aggregate(pat, first_row, next_row), -1)
