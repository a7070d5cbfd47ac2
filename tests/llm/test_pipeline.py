"""The corpus pipeline against plain Python, stage by stage on what its predecessor kept."""

import collections

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_operators import WORD, components, contamination, expected_ids, shingle_set
from wirefold.llm.common import store, table
from wirefold.llm.line_rules import measure


def test_pipeline(spark):
    docs = table(spark, SF_SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixture", "encoding"]
    results, columns = [docs], docs.columns
    for stage in stages.values():
        results.append(store(stage(spark, results[-1], SF_SMALL)))
    assert all(r.columns == columns for r in results[:-1])
    rows = [[(r.doc_id, r.text) for r in x.collect()] for x in results[:-1]]

    want = {i: m[-1] for i, t in rows[0] if (m := measure(t))[-2]}
    assert dict(rows[1]) == want and len(rows[1]) == len(want)

    group = components({i: shingle_set(t) for i, t in rows[1]})
    assert sorted(rows[2]) == sorted((i, t) for i, t in rows[1] if group[i] == i)

    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    dirty = {i for i, _, hit, _ in contamination(rows[2], items) if hit}
    assert sorted(rows[3]) == sorted((i, t) for i, t in rows[2] if i not in dirty)

    size = {i: len(WORD.findall(t)) for i, t in rows[3]}
    source = {r.doc_id: r.source for r in results[3].collect()}
    before, taken = dict(rows[3]), collections.Counter()
    for i, t in rows[4]:
        assert before[i].startswith(t)
        taken[i] += len(WORD.findall(t))
    assert all(n <= 3 * size[i] for i, n in taken.items())
    names = sorted(set(source.values()))
    share, have = collections.Counter(), collections.Counter()
    for i, n in size.items():
        have[source[i]] += n
    for i, n in taken.items():
        share[source[i]] += n
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    free, left = set(names), sum(have.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * have[s]]:
        for s in over:
            free.discard(s)
        left = sum(have.values()) - sum(3 * have[s] for s in names if s not in free)
    for s in names:
        target = left * weight[s] / sum(weight[x] for x in free) if s in free else 3 * have[s]
        assert abs(share[s] - target) <= 5

    got = collections.defaultdict(list)
    for r in results[5].collect():
        got[r.doc_id].append((r.n_tokens, r.ids_crc32))
    encoded = expected_ids(sorted(rows[4]))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted((n, c) for _, n, c in x) for i, x in encoded.items()}
    starts = sorted((r.start, r.start + r.n_tokens, r.doc_id) for r in results[5].collect())
    assert starts[0][0] == 0 and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(starts, starts[1:]))
