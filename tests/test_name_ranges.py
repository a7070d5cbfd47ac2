"""Suffix lookups by ranges against the plain rule."""

import random

from wirefold.operators import name_ranges as NR
from wirefold.operators.ranks import running_sum


def plain(requests, entities):
    """{request id: (status, n, sorted candidates)} by comparing every request with every name."""
    out = {}
    for repo, rid, name in requests:
        names = {q for r, q in entities if r is not None and r == repo and q is not None}
        hits = []
        if name:
            hits = [name] if name in names else sorted(q for q in names if q.endswith("." + name))
        out[rid] = ("not-found" if not hits else "found" if len(hits) == 1 else "ambiguous", len(hits), hits)
    return out


def check(spark, requests, entities):
    req = spark.createDataFrame(requests, "repo string, id long, name string").repartition(3)
    ents = spark.createDataFrame(entities, "repo string, q string").repartition(3)
    got = NR.lookup_suffix(req, ents, req_id="id", name="name", qualified="q", keys=["repo"])
    members = {}
    for r in got.matches.collect():
        members.setdefault((r.repo, r.name), []).append(r.candidate)
    answers = got.answers.collect()
    assert len(answers) == len(requests)
    want = plain(requests, entities)
    for r in answers:
        hits = [r.candidate] if r.candidate else sorted(members.get((r.repo, r.name), []))
        assert (r.status, r.n_matches, hits) == want[r.id], (r, hits)
    asked = {(r.repo, r.name) for r in answers if r.status == "ambiguous"}
    assert set(members) == asked and all(len(v) == len(set(v)) for v in members.values())


def test_random_names_with_shared_and_nested_suffixes(spark):
    rnd = random.Random(5)
    seg = ["a", "b", "C", "C-", "C/", "é", "", "aa", "$"]
    ents = [(rnd.choice(["x", "y"]), ".".join(rnd.choice(seg) for _ in range(rnd.randint(1, 5)))) for _ in range(400)]
    req = [(rnd.choice(["x", "y", "z"]), i, ".".join(rnd.choice(seg) for _ in range(rnd.randint(1, 3)))) for i in range(400)]
    check(spark, req, ents)


def test_hot_name_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(NR, "RUN", 16)
    ents = [("x", f"p{i}.{'Main' if i % 2 else 'Other' + str(i)}") for i in range(600)]
    check(spark, [("x", 1, "Main"), ("x", 2, "Main"), ("x", 3, "p3.Main"), ("x", 4, "Other4"), ("x", 5, "ain")], ents)


def test_nulls_repeats_and_empty_tables(spark):
    ents = [("x", "a.C"), ("x", "a.C"), ("x", None), (None, "a.C"), ("x", ""), ("x", ".")]
    req = [("x", 1, "C"), ("x", 2, None), (None, 3, "C"), ("x", 4, ""), ("x", 5, "a.C"), ("y", 6, "C")]
    check(spark, req, ents)
    check(spark, req, [])
    check(spark, [], ents)


def test_running_sum_counts_what_stands_before(spark):
    rows = [(i % 7, i, i % 3) for i in range(300)]
    got = running_sum(spark.createDataFrame(rows, "a long, b long, n long").repartition(5), ["a", "b"], "n", "s").collect()
    total, want = 0, {}
    for a, b, n in sorted(rows):
        want[a, b] = total
        total += n
    assert {(r.a, r.b): r.s for r in got} == want
