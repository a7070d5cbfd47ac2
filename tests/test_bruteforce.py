"""Operators against tiny pure-Python versions of the reference semantics, on random inputs."""

import random
from collections import deque

import pytest

from pyspark.sql import functions as F

from wirefold.functions import paths as P
from wirefold.operators import graph as G
from wirefold.operators import routes as R


def py_bfs(edges, beans, terminal, start, max_depth=None):
    """The reference's queue BFS: steps, first-seen terminals, blocked, truncated."""
    by_src = {}
    for s, eo, co, d, st in sorted(edges, key=lambda e: (e[0], e[1], e[2])):
        by_src.setdefault(s, []).append((eo, co, d, st))
    if start not in beans:
        return [], [], [], False
    steps, terms, blocked, seen = [], [], [], {start}
    q, trunc = deque([(start, 0)]), False
    while q:
        n, d = q.popleft()
        es = by_src.get(n, [])
        if max_depth is not None and d >= max_depth:
            trunc = trunc or any(st == "resolved" for *_, st in es)
            continue
        for eo, co, t, st in es:
            if st == "unresolved":
                blocked.append((n, eo))
                continue
            steps.append((n, eo, co, t, d + 1))
            if t in terminal and t not in terms:
                terms.append(t)
            if t not in seen:
                seen.add(t)
                q.append((t, d + 1))
    return steps, terms, blocked, trunc


def test_reach_matches_queue_bfs(spark):
    rnd = random.Random(7)
    for trial in range(3):
        n = 12
        edges = set()
        for s in range(n):
            for eo in range(rnd.randint(0, 3)):
                d = rnd.randrange(n)
                st = "unresolved" if rnd.random() < 0.15 else "resolved"
                ncand = 2 if rnd.random() < 0.2 else 1
                for co in range(ncand):
                    dd = (d + co) % n
                    edges.add((s, eo, co, None if st == "unresolved" else dd, st))
        beans = set(range(n - 1))  # the last node is not a bean
        terminal = {x for x in beans if x % 4 == 3}
        edf = spark.createDataFrame(sorted(edges, key=str), "src long, edge_ord long, cand_ord long, dst long, status string")
        ndf = spark.createDataFrame([(b, b in terminal) for b in sorted(beans)], "node long, terminal boolean")
        starts = spark.createDataFrame([(i, i % n) for i in range(n)], "request_id long, start long")
        for md in (None, 1, 2):
            t = G.reach(starts, edf, ndf, max_depth=md)
            steps = {}
            for r in t.steps.collect():
                steps.setdefault(r.start, []).append((r.step_order, (r.src, r.edge_ord, r.cand_ord, r.dst, r.depth)))
            terms = {}
            for r in t.terminals.collect():
                terms.setdefault(r.start, []).append((r.first_step, r.node))
            trunc = {r.start: r.truncated for r in t.truncated.collect()}
            blocked = {}
            for r in t.blocked.collect():
                blocked.setdefault(r.start, []).append((r.src, r.edge_ord))
            for s in range(n):
                ps, pt, pb, ptr = py_bfs(edges, beans, terminal, s, md)
                got = [x for _, x in sorted(steps.get(s, []))]
                assert got == ps, (trial, md, s)
                assert [x for _, x in sorted(terms.get(s, []))] == pt
                assert sorted(blocked.get(s, [])) == sorted(pb)
                assert trunc.get(s, False) == ptr


def py_first_base(parents, bases, start):
    """Depth-first: own bases in order, then parents in order, with one visited set."""
    visited = {start}

    def go(n):
        for _, b in sorted(bases.get(n, [])):
            return b
        for _, p in sorted(parents.get(n, [])):
            if p in visited:
                continue
            visited.add(p)
            r = go(p)
            if r is not None:
                return r
        return None

    return go(start)


def test_first_base_matches_dfs(spark):
    rnd = random.Random(3)
    for _ in range(4):
        n = 10
        parents, bases, prow, brow = {}, {}, [], []
        for c in range(n):
            for o in rnd.sample(range(6), rnd.randint(0, 3)):
                if rnd.random() < 0.3:
                    b = f"B{rnd.randrange(3)}"
                    bases.setdefault(c, []).append((o, b))
                    brow.append((c, o, b))
                else:
                    p = rnd.randrange(n)
                    parents.setdefault(c, []).append((o, p))
                    prow.append((c, p, o))
        pdf = spark.createDataFrame(prow or [(0, 0, 99)], "child long, parent long, ord long")
        bdf = spark.createDataFrame(brow or [(99, 0, "none")], "owner long, ord long, base string")
        starts = spark.createDataFrame([(i, i) for i in range(n)], "request_id long, start long")
        got = {r.request_id: r.base for r in G.first_base(starts, pdf, bdf, req_id="request_id",
                                                          start="start").collect()}
        for s in range(n):
            assert got.get(s) == py_first_base(parents, bases, s), s


def py_dist(p, q):
    prev = list(range(len(q) + 1))
    for i, ps in enumerate(p, 1):
        cur = [i]
        var = ps.startswith("{") and ps.endswith("}")
        for j, qs in enumerate(q, 1):
            cost = 0 if var or ps == qs else 1
            cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + cost))
        prev = cur
    return prev[-1]


def test_segment_distance_matches_python(spark):
    rnd = random.Random(11)
    alpha = ["a", "b", "c", "{id}", "x"]
    rows = []
    for _ in range(300):
        p = [rnd.choice(alpha) for _ in range(rnd.randint(0, 4))]
        q = [rnd.choice(alpha[:3] + ["x", "y"]) for _ in range(rnd.randint(0, 4))]
        rows.append((p, q))
    df = spark.createDataFrame(rows, "p array<string>, q array<string>")
    got = [r.d for r in df.select(P.segment_distance("p", "q").alias("d")).collect()]
    assert got == [py_dist(p, q) for p, q in rows]
    # fixed values from the reference's examples
    assert py_dist(["api", "users", "{id}"], ["api", "user", "42"]) == 1
    assert py_dist(["health"], ["api", "user", "42"]) == 3


@pytest.mark.parametrize("seed,hot,limit,common_df", [(5, False, 5, 64), (6, True, 10, 64), (8, True, 5, 8), (9, True, 10, 1)])
def test_route_suggest_matches_brute_force(spark, seed, hot, limit, common_df):
    rnd = random.Random(seed)
    segs = ["api", "users", "orders", "v1", "{id}", "{name}", "items", "x"]
    verbs = ["GET", "POST", "ANY", "PUT"]
    routes = []
    for i in range(60):
        body = [rnd.choice(segs) for _ in range(rnd.randint(0, 4))]
        if hot and rnd.random() < 0.8:
            body = ["api"] + body          # one segment carried by most routes
        routes.append((i, rnd.choice(verbs), "/" + "/".join(body), i))
    reqs = []
    for i in range(40):
        body = [rnd.choice(segs[:4] + ["42", "zz"]) for _ in range(rnd.randint(0, 5))]
        if hot and rnd.random() < 0.8:
            body = ["api"] + body
        reqs.append((i, rnd.choice(["GET", "POST", "DELETE", "PURGE"]), "/" + "/".join(body)))
    rdf = spark.createDataFrame(routes, "route_id long, http_method string, path_pattern string, scan_ord long")
    qdf = spark.createDataFrame(reqs, "request_id long, verb string, path string")
    got = {}
    for r in R.route_suggest(qdf, rdf, limit=limit, common_df=common_df).collect():
        got.setdefault(r.request_id, []).append((r.rank, r.route_id, r.score))
    for rid, v, p in reqs:
        q = [s for s in p.split("/") if s]
        scored = []
        for i, rv, rp, so in routes:
            pen = 0 if rv in ("ANY", v) else 1000
            scored.append((pen + py_dist([s for s in rp.split("/") if s], q), so, i))
        scored.sort()
        want = [(k + 1, i, sc) for k, (sc, _, i) in enumerate(scored[:limit])]
        assert sorted(got[rid]) == want, rid


def test_route_resolve_specificity_and_conservation(spark):
    routes = spark.createDataFrame([
        (1, "GET", "/items/{id}", 1), (2, "GET", "/items/special", 2), (3, "ANY", "/legacy/any", 3),
        (4, "GET", "/api/users/{id}", 4), (5, "GET", "/x/{a}.json", 5)],
        "route_id long, http_method string, path_pattern string, scan_ord long")
    reqs = spark.createDataFrame([
        (1, "GET", "/items/special"), (2, "GET", "/items/123"), (3, "DELETE", "/legacy/any"),
        (4, "get", "/api/users/42/"), (5, "GET", "/api/user/42"), (6, "GET", "/x/{a}.json"),
        (7, "GET", "/x/7.json"), (8, "GET", "//items//special")],
        "request_id long, verb string, path string")
    got = {r.request_id: r.route_id for r in R.route_resolve(reqs, routes).collect()}
    assert got == {1: 2, 2: 1, 3: 3, 4: 4, 5: None, 6: 5, 7: None, 8: 2}
