"""Ordered traces against a queue."""

import collections
import random

import pytest

from wirefold.operators.ordered import ordered_trace


def queue_trace(start, edges, nodes, limit):
    """steps, terminals, blocked in the order of a first-in first-out walk."""
    steps, terminals, blocked = [], [], []
    if start not in nodes:
        return steps, terminals, blocked
    seen, todo = {start}, collections.deque([(start, 0)])
    while todo:
        node, depth = todo.popleft()
        if limit is not None and depth >= limit:
            continue
        for src, o, c, dst, ok in sorted((e for e in edges if e[0] == node), key=lambda e: e[1:3]):
            if not ok:
                blocked.append((src, o, depth))
                continue
            steps.append((src, o, c, dst, depth + 1))
            if nodes.get(dst) and dst not in terminals:
                terminals.append(dst)
            if dst not in seen:
                seen.add(dst)
                todo.append((dst, depth + 1))
    return steps, terminals, blocked


@pytest.mark.parametrize("seed,limit", [(1, None), (2, 2), (3, 3)])
def test_order_equals_a_queue(spark, seed, limit):
    r = random.Random(seed)
    nodes = {n: r.random() < 0.3 for n in range(14)}
    edges = []
    for n in range(16):
        for o in r.sample(range(50), r.randrange(4)):
            for c in range(r.choice([1, 1, 2])):
                ok = r.random() < 0.85
                edges.append((n, o, c, r.randrange(16) if ok else None, ok))
    starts = [0, 1, 5, 15, 99, 0]
    e = spark.createDataFrame([(s, o, c, d, "resolved" if ok else "unresolved") for s, o, c, d, ok in edges],
                              "src long, edge_ord long, cand_ord long, dst long, status string")
    t = ordered_trace(spark.createDataFrame(list(enumerate(starts)), "request_id long, start long"), e,
                      spark.createDataFrame(list(nodes.items()), "node long, terminal boolean"), max_depth=limit)
    got = {k: collections.defaultdict(list) for k in ("steps", "terminals", "blocked")}
    for row in sorted(t.steps.collect(), key=lambda x: x.step):
        got["steps"][row.start].append((row.step, (row.src, row.edge_ord, row.cand_ord, row.dst, row.depth)))
    for row in sorted(t.terminals.collect(), key=lambda x: x.place):
        got["terminals"][row.start].append((row.place, row.node))
    for row in sorted(t.blocked.collect(), key=lambda x: x.place):
        got["blocked"][row.start].append((row.place, (row.src, row.edge_ord, row.depth)))
    for s in set(starts):
        want = queue_trace(s, edges, nodes, limit)
        for name, rows in zip(("steps", "terminals", "blocked"), want):
            assert got[name][s] == list(enumerate(rows, 1)), (name, s)
