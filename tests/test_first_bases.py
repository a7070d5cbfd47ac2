"""First bases by doubling against a depth-first walk."""

import random

import pytest

from tests.test_bruteforce import py_first_base
from wirefold.operators.first_bases import first_bases, run_to_end


def check(spark, prow, brow, nodes):
    pdf = spark.createDataFrame(prow, "child long, parent long, ord long").repartition(3)
    bdf = spark.createDataFrame(brow, "owner long, ord long, base string").repartition(3)
    parents, bases = {}, {}
    for c, p, o in prow:
        parents.setdefault(c, []).append((o, p))
    for c, o, b in brow:
        bases.setdefault(c, []).append((o, b))
    rows = first_bases(pdf, bdf).collect()
    got = {r.node: r.base for r in rows}
    assert len(got) == len(rows)
    for n in nodes:
        assert got.get(n) == py_first_base(parents, bases, n), n
    return {r.node: r.walk_len for r in rows}


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs_with_circles(spark, seed):
    rnd = random.Random(seed)
    n = 30
    prow, brow = [], []
    for c in range(n):
        for o in rnd.sample(range(6), rnd.choice([0, 1, 1, 1, 2, 3])):
            prow.append((c, rnd.randrange(n) if seed % 2 else min(n - 1, c + rnd.randint(0, 4)), o))
        if rnd.random() < 0.1:
            brow += [(c, o, f"B{rnd.randrange(3)}{c}") for o in rnd.sample(range(4), 2)]
    check(spark, prow, brow, range(n))


def test_answer_in_a_circle_depends_on_the_start(spark):
    check(spark, [(1, 2, 0), (1, 8, 1), (2, 1, 0), (2, 9, 1), (3, 1, 0)], [(8, 0, "X"), (9, 0, "Y")], [1, 2, 3, 8, 9])


def test_long_chain_has_its_length(spark):
    n = 300
    walk = check(spark, [(i, i + 1, 0) for i in range(n)], [(n, 0, "B")], range(0, n, 50))
    assert walk == {i: n - i + 1 for i in range(n + 1)}


def test_rounds_follow_the_logarithm_of_the_chain(spark, monkeypatch):
    from wirefold.operators import first_bases as FB

    cuts = []
    plain = FB.cut_lineage
    monkeypatch.setattr(FB, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    ended, _ = run_to_end(spark.range(200).selectExpr("id as node", "id + 1 as to", "1L as len"))
    assert {(r.to, r.len) for r in ended.collect()} == {(200, 200 - i) for i in range(200)}
    assert len(cuts) <= 10


def test_nulls_repeats_and_nothing(spark):
    check(spark, [(1, 2, 0), (1, 2, 0), (1, None, 1), (None, 2, 0), (3, 3, 0)], [(2, 1, "B"), (2, 1, "B"), (2, 0, None), (None, 0, "C")][:2], [1, 2, 3])
    assert first_bases(spark.createDataFrame([], "child long, parent long, ord long"),
                       spark.createDataFrame([], "owner long, ord long, base string")).count() == 0
