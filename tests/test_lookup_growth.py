"""Lookups write requests times matches as they are joined: no product is shuffled."""

from wirefold.operators.resolve import lookup_outcome


def plan_nodes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from plan_nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from plan_nodes(plan.plan())
    else:
        yield kind, plan
        for i in range(plan.children().size()):
            yield from plan_nodes(plan.children().apply(i))


def shuffled_rows(df):
    df.collect()
    found = 0
    for kind, plan in plan_nodes(df._jdf.queryExecution().executedPlan()):
        if kind == "ShuffleExchangeExec":
            found += plan.metrics().apply("shuffleRecordsWritten").value()
    return found


def test_lookup_shuffles_no_products(spark):
    ents = spark.createDataFrame([(f"p{i}.C",) for i in range(100)], "q string")
    req = spark.createDataFrame([(i, "C") for i in range(200)], "id long, name string")
    out = lookup_outcome(req, ents, req_id="id", name="name", qualified="q", mode="suffix")
    assert shuffled_rows(out) < 3_000
    assert out.count() == 20_000 and out.where("n_matches <> 100 or status <> 'ambiguous'").isEmpty()


def test_lookup_ids_with_several_names(spark):
    ents = spark.createDataFrame([("a.b.C",), ("x.b.C",), ("y.D",), (None,)], "q string")
    req = spark.createDataFrame([(1, "C"), (1, "b.C"), (2, "C"), (2, "y.D"), (3, "D"), (3, None), (4, "no"), (None, "C"), (5, "D"), (5, "D")],
                                "id long, name string")
    got = lookup_outcome(req, ents, req_id="id", name="name", qualified="q", mode="suffix").collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append((r.name, r.candidate, r.n_matches))
    two = [("a.b.C", 2), ("x.b.C", 2)]
    assert sorted(by_id[1]) == sorted((n, *c) for n in ("C", "b.C") for c in two)
    assert sorted(by_id[2]) == [("C", "y.D", 1), ("y.D", "y.D", 1)]
    assert sorted(by_id[3], key=str) == sorted([("D", "y.D", 1), (None, "y.D", 1)], key=str)
    assert by_id[4] == [("no", None, 0)] and by_id[None] == [("C", None, 0)] and by_id[5] == [("D", "y.D", 1)] * 2
