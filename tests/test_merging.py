"""Merging in order against a plain loop over sorted pairs."""

import random

import pytest
from sedge.operators import merging
from sedge.streaming.shared import kept


def plain(pairs):
    """The loop: a pair is skipped if either side was merged away before."""
    to = {}
    for a, b in sorted({(min(p), max(p)) for p in pairs if None not in p and p[0] != p[1]}):
        if a not in to and b not in to:
            to[b] = a
    return to


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    return {r.node: r.target for r in merging.merges_in_order(df, kept).collect()}


@pytest.mark.parametrize("task_pairs", [50_000, 4])
def test_same_as_the_loop(spark, monkeypatch, task_pairs):
    monkeypatch.setattr(merging, "TASK_PAIRS", task_pairs)
    r = random.Random(task_pairs)
    cases = [[(r.randrange(n), r.randrange(n)) for _ in range(m)] for n, m in ((12, 20), (200, 170))]
    chain, star = [(i, i + 1) for i in range(9)], [(0, i) for i in range(1, 30)] + [(i, 40) for i in range(1, 30)]
    turned = [(b, a) for a, b in chain] + [(3, 3), (None, 2), (2, None)] + chain[:4]
    for pairs in (*cases, star, turned, [(1, 3), (2, 3), (3, 4), (4, 5)]):
        assert run(spark, pairs) == plain(pairs), pairs


def test_chain_does_not_collapse_and_no_pairs(spark):
    assert run(spark, [(1, 2), (2, 3), (3, 4)]) == {2: 1, 4: 3}
    assert run(spark, []) == {}


def test_entities_and_relations(spark):
    r = random.Random(3)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(70)]
    rows = [(i, f"n{i}", [f"x{r.randrange(9)}" for _ in range(r.randrange(3))], r.randrange(5), [r.randrange(20) for _ in range(r.randrange(4))], r.choice([None, "d" * r.randrange(6)])) for i in range(80)]
    relations = [(r.randrange(80), r.randrange(80), k) for k in range(200)]
    to, mine = plain(pairs), {x[0]: [x[1], list(x[2]), x[3], list(x[4]), x[5]] for x in rows}
    for a, b in sorted((a, b) for b, a in to.items()):
        one, two = mine[a], mine.pop(b)
        one[1] += [two[0], *two[1]]
        one[2] += two[2]
        one[3] += two[3]
        if len(two[4] or "") > len(one[4] or ""):
            one[4] = two[4]
    want = {i: (n, list(dict.fromkeys(a)), m, list(dict.fromkeys(c)), d) for i, (n, a, m, c, d) in mine.items()}
    entities = spark.createDataFrame(rows, "id long, name string, aliases array<string>, mentions int, chunks array<int>, description string").repartition(3)
    merges = kept(merging.merges_in_order(spark.createDataFrame(pairs, "a long, b long"), kept))
    got = {x.id: (x.name, x.aliases, x.mentions, x.chunks, x.description) for x in merging.merged_entities(entities, merges).collect()}
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()} and all((got[k][4] or "") == (v[4] or "") for k, v in want.items())
    moved = [tuple(x) for x in merging.rewritten_relations(spark.createDataFrame(relations, "a long, b long, kind int"), merges).collect()]
    assert sorted(moved) == sorted((to.get(a, a), to.get(b, b), k) for a, b, k in relations if to.get(a, a) != to.get(b, b))
