"""Components and shared answers against plain walks."""

import random

import pytest

from wirefold.operators.condensed import shared_reach, strongly_connected


def walks(edges, nodes):
    """Nodes that each node meets in at least one step."""
    out = {n: {d for s, d in edges if s == n and d in nodes} for n in nodes}
    while True:
        more = {n: out[n].union(*(out[d] for d in out[n])) for n in nodes}
        if more == out:
            return out
        out = more


CHAIN = [(i, i + 1) for i in range(11)]
GRAPHS = {"chain": CHAIN, "ring": CHAIN + [(11, 0)], "rings": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 4), (5, 0), (7, 7), (6, 99)],
          "none": []}


@pytest.mark.parametrize("name", ["ring", "rings", "none", 1])
def test_components_and_answers(spark, name):
    r = random.Random(name)
    nodes = list(range(12))
    edges = GRAPHS[name] if name in GRAPHS else [(r.randrange(12), r.randrange(12)) for _ in range(14 + 3 * name)]
    marked = {n: n % 3 == 0 for n in nodes}
    e = spark.createDataFrame(edges + edges[:2] + [(None, 1), (1, None)], "src long, dst long")
    n = spark.createDataFrame(list(marked.items()), "node long, terminal boolean")
    meet = walks(edges, set(nodes))
    want = {a: min([a] + [b for b in meet[a] if a in meet[b]]) for a in nodes}
    if name != 1:
        assert {x.node: x.component for x in strongly_connected(n, e).collect()} == want
    starts = [0, 4, 7, 50]
    got = shared_reach(spark.createDataFrame([(s,) for s in starts], "start long"), e, n)
    component = {x.node: x.component for x in got.members.collect()}
    assert component == want
    answers = {}
    for x in got.answers.collect():
        answers.setdefault(x.component, set()).add(x.node)
    assert set(answers) <= {want[s] for s in starts if s in want}
    for s in starts[:3]:
        assert answers.get(want[s], set()) == {b for b in meet[s] if marked[b]}
